"""Exact dedup through a sharded cuckoo-filter index (operator 2).

A text is known by the SHA-256 of its normalised bytes. The index has two tables: ``content`` holds
the digests of live rows, bucketed by shard, and ``filters`` one cuckoo filter per shard with a
16-bit fingerprint for each digest that is live. A lookup that misses the filter is surely new; a
hit is verified against the bucketed content. A filter that overflows is rebuilt with twice the
buckets from the stored keys. Shards are ranges of digests, so they are even, and equal texts are
summed up in each task before they are dealt out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileloom.llm import common as c
from tileloom.session import cut_lineage

#: Live rows of a shard, on average.
SHARD_ROWS = 1 << 17
SLOTS, KICKS = 4, 500
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

DIGESTS = "doc_id long, digest binary"
KEPT = "digest binary, keep_id long, group_size long"


class CuckooFilter:
    """Fingerprints of digests in buckets of four; a digest has two buckets it may be in."""

    def __init__(self, buckets: int = 64):
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @staticmethod
    def mark(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def places(self, mark: int, digest: bytes | None = None, at: int = 0) -> tuple[int, int]:
        mask = len(self.table) - 1
        first = int.from_bytes(digest[2:8], "little") & mask if digest is not None else at
        return first, first ^ (mark * 0x5BD1E995 & mask)

    def __contains__(self, digest: bytes) -> bool:
        mark = self.mark(digest)
        a, b = self.places(mark, digest)
        return mark in self.table[a].tolist() or mark in self.table[b].tolist()

    def add(self, digest: bytes) -> bool:
        """False if there is no room: then the filter must be rebuilt with more buckets."""
        mark = self.mark(digest)
        a, b = self.places(mark, digest)
        for kick in range(KICKS):
            for at in (a, b):
                row = self.table[at]
                for slot in range(SLOTS):
                    if not row[slot]:
                        row[slot] = mark
                        return True
            slot = kick % SLOTS
            mark, self.table[b, slot] = int(self.table[b, slot]), mark
            a, b = b, self.places(mark, at=b)[1]
        return False

    def remove(self, digest: bytes) -> bool:
        mark = self.mark(digest)
        for at in self.places(mark, digest):
            for slot in range(SLOTS):
                if self.table[at, slot] == mark:
                    self.table[at, slot] = 0
                    return True
        return False

    @classmethod
    def of(cls, digests, buckets: int = 64) -> CuckooFilter:
        """A filter with room for all digests: doubled until none overflows."""
        digests = list(digests)
        while buckets * SLOTS * 0.9 < len(digests):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(map(made.add, digests)):
                return made
            buckets *= 2

    def blob(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def read(cls, blob: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return made


class Shard:
    """A filter, and the bucketed content that its hits are verified against."""

    def __init__(self):
        self.filter, self.content = CuckooFilter(), {}

    def put(self, digest: bytes, doc_id: int | None, n: int) -> None:
        if digest in self.filter:
            have = self.content.get(digest[2:8], {}).get(digest)
            if have is not None:
                have[0] = doc_id if have[0] is None else have[0] if doc_id is None else max(have[0], doc_id)
                have[1] += n
                return
        self.content.setdefault(digest[2:8], {})[digest] = [doc_id, n]
        if not self.filter.add(digest):
            self.filter = CuckooFilter.of(self.keys(), 2 * len(self.filter.table))

    def keys(self):
        return (digest for bucket in self.content.values() for digest in bucket)


def normal(text: bytes) -> bytes:
    """Lower case in A-Z; no other letter changes."""
    return text.lower()


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of each row; null text counts as empty."""

    def run(batches):
        for batch in batches:
            out = [hashlib.sha256(normal(t.as_buffer().to_pybytes()) if t.is_valid else b"").digest() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, DIGESTS)


def shard_of(digest: bytes, n_shards: int) -> int:
    return int.from_bytes(digest[8:16], "big") * n_shards >> 64


def copies(rows: DataFrame, n_shards: int) -> DataFrame:
    """(digest, keep_id, group_size) of the distinct digests of ``rows`` (doc_id, digest)."""

    def sum_up(batches):
        for batch in batches:
            own: dict[bytes, list] = {}
            for doc_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                have = own.setdefault(digest, [doc_id, 0])
                have[1] += 1
                if doc_id is not None and (have[0] is None or doc_id > have[0]):
                    have[0] = doc_id
            yield pa.record_batch(
                [
                    pa.array([shard_of(d, n_shards) for d in own], pa.int32()),
                    pa.array(list(own), pa.binary()),
                    pa.array([v[0] for v in own.values()], pa.int64()),
                    pa.array([v[1] for v in own.values()], pa.int64()),
                ],
                names=["shard", "digest", "doc_id", "n"],
            )

    def fold(key, rows):
        shard = Shard()
        for digest, doc_id, n in zip(*(rows.column(x).to_pylist() for x in ("digest", "doc_id", "n")), strict=True):
            shard.put(digest, doc_id, n)
        found = [(d, *v) for bucket in shard.content.values() for d, v in bucket.items()]
        cols = list(zip(*found, strict=True)) or [[]] * 3
        return pa.table({"digest": pa.array(cols[0], pa.binary()), "keep_id": pa.array(cols[1], pa.int64()), "group_size": pa.array(cols[2], pa.int64())})

    return rows.mapInArrow(sum_up, "shard int, digest binary, doc_id long, n long").groupBy("shard").applyInArrow(fold, KEPT)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Which row of each group of equal texts stays: that with the largest doc_id.

    ``docs`` has doc_id and text; other columns are ignored. Texts are equal when they are identical
    after lower-casing A-Z; null counts as empty. Returns one row per input row: doc_id, digest,
    keep_id, group_size and kept. Rows repeated with the largest id are all marked as kept. A row
    without an id is kept only if no row of its group has one.
    """
    rows = c.stage(digests(docs))
    kept = copies(rows, max(1, rows.count() // SHARD_ROWS))
    return rows.join(kept, "digest").select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text; all columns.

    Of rows with one id and one text one is left; rows with one id and several texts stay for each
    of these that names that id. Rows without an id all stay, as no id names them.
    """
    kept = cut_lineage(exact_duplicates(docs).where("kept and doc_id is not null").select("doc_id", "digest").distinct())
    named = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)
    repeated = cut_lineage(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if not repeated.isEmpty():
        # Only such rows are told apart by their text.
        text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, UPPER.lower())
        again = named.join(repeated, "doc_id", "left_semi").withColumn("digest_of_text", F.unhex(F.sha2(text.cast("binary"), 256)))
        again = again.join(kept.toDF("doc_id", "digest_of_text"), ["doc_id", "digest_of_text"], "left_semi")
        one = c.one_of_each(again, ["doc_id", "digest_of_text"], docs.columns)
        named = named.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one)
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


# --- a standing index ------------------------------------------------------------------------


@dataclass
class Index:
    """Live rows (shard, digest, doc_id) and the filter of each shard (shard, filter)."""

    content: DataFrame
    filters: DataFrame
    n_shards: int


def bucketed(docs: DataFrame, n_shards: int) -> DataFrame:
    of = F.udf(lambda d: shard_of(bytes(d), n_shards), "int", useArrow=True)
    return digests(docs).select(of("digest").alias("shard"), "digest", "doc_id")


def empty_index(spark, n_shards: int = 16) -> Index:
    return Index(
        spark.createDataFrame([], "shard int, digest binary, doc_id long"),
        spark.createDataFrame([], "shard int, filter binary"),
        n_shards,
    )


def insert(index: Index, docs: DataFrame) -> Index:
    """The index with the rows of ``docs`` as well."""
    return changed(index, bucketed(docs, index.n_shards), +1)


def delete(index: Index, docs: DataFrame) -> Index:
    """The index without the rows (doc_id, text) of ``docs``; rows that aren't live are passed over."""
    return changed(index, bucketed(docs, index.n_shards), -1)


def changed(index: Index, rows: DataFrame, sign: int) -> Index:
    rows = c.stage(rows)
    if sign > 0:
        content = c.stage(index.content.unionByName(rows))
    else:
        content = c.stage(index.content.join(rows.distinct(), ["shard", "digest", "doc_id"], "left_anti"))
    # Distinct digests only: a text with very many copies is one entry.
    live = content.groupBy("shard", "digest").agg(F.lit(True).alias("live"))
    before = index.content.groupBy("shard", "digest").agg(F.lit(True).alias("was"))
    touched = rows.select("shard", "digest").distinct().join(live, ["shard", "digest"], "left").join(before, ["shard", "digest"], "left")
    steps = touched.select(
        "shard", "digest", F.lit(None).cast("binary").alias("filter"),
        F.when(F.col("live").isNotNull() & F.col("was").isNull(), 1).when(F.col("live").isNull() & F.col("was").isNotNull(), -1).otherwise(0).alias("step"),
    )
    state = index.filters.select("shard", F.lit(None).cast("binary").alias("digest"), "filter", F.lit(0).alias("step"))
    keys = live.select("shard", "digest")

    def update(key, changes, keys):
        rows = list(zip(*(changes.column(x).to_pylist() for x in ("digest", "filter", "step")), strict=True))
        blob = next((f for _, f, _ in rows if f is not None), None)
        own = CuckooFilter.read(blob) if blob else CuckooFilter()
        for digest, _, step in rows:
            if step < 0:
                own.remove(digest)
        if not all(own.add(digest) for digest, _, step in rows if step > 0):
            own = CuckooFilter.of(keys.column("digest").to_pylist(), 2 * len(own.table))
        shard = key[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([own.blob()], pa.binary())})

    filters = steps.unionByName(state).groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(update, "shard int, filter binary")
    return Index(content, c.stage(filters), index.n_shards)


def lookup(index: Index, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, hit (the filter's answer) and live_id.

    live_id is the largest live doc_id with that text, null if there is none; it comes from the
    content, and only for hits.
    """
    rows = bucketed(docs, index.n_shards)
    asked = rows.select("shard", "digest").distinct()

    def probe(key, asked, state):
        blobs = state.column("filter").to_pylist()
        own = CuckooFilter.read(blobs[0]) if blobs else None
        found = asked.column("digest").to_pylist()
        return pa.table({"digest": pa.array(found, pa.binary()), "hit": pa.array([own is not None and d in own for d in found], pa.bool_())})

    hits = asked.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(probe, "digest binary, hit boolean")
    verified = hits.where("hit").join(index.content.groupBy("digest").agg(F.max("doc_id").alias("live_id")), "digest", "left").select("digest", "live_id")
    return rows.join(hits, "digest").join(verified, "digest", "left").select("doc_id", "digest", "hit", "live_id")


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
