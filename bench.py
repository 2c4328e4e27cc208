"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from contract import load
from tileloom.session import local_session

HEADLINE = [
    "tile_validity", "tile_coverage", "points_to_tiles", "items_on_tiles", "canopy_height",
    "density_metrics", "height_statistics", "idw_surface", "voxel_downsample", "chamfer_squared",
    "knn_graph", "acquisition_events", "band_statistics", "capped_cloud", "spearman",
    "polygon_split",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=8, memory="12g")
    queries, _ = load()
    queries["report_overview"](spark, folder).collect()  # start the workers
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
