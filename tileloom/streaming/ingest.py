"""S8 as a stream: item files picked up once, items already in the catalog left out."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tileloom import schemas
from tileloom.session import cut_lineage
from tileloom.sources.catalog import items_from_features, not_yet


def ingest_new_items(spark: SparkSession, source: str, catalog: str, state: str) -> StreamingQuery:
    """Append the new items under ``source`` to the catalog table at ``catalog``.

    The file source remembers files in ``state``; a batch that is run again finds its
    own items in the catalog, so a retry adds nothing twice. Runs until all waiting
    files are read, then stops.
    """
    files = spark.readStream.schema(schemas.ITEM_FILE).option("multiLine", True).json(source)

    def add(batch, _):
        items = items_from_features(batch).dropDuplicates(["item_id"])
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(catalog)
        fs = path.getFileSystem(session._jsc.hadoopConfiguration())
        if fs.exists(path):
            items = cut_lineage(not_yet(items, session.read.parquet(catalog)))
        items.write.mode("append").parquet(catalog)

    return (
        files.writeStream.foreachBatch(add)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
