"""SimHash near-dedup over vantage-point trees (operator 10).

Fingerprints are made in the scan. Equal ones become one row. A vantage-point tree, fitted on a
bounded sample, deals all distinct fingerprints to shards: at each node those within the radius of
the vantage point go inside, those beyond it outside, and those so near the border that a partner
may be on the other side go to both (the triangle inequality bounds that margin). Every pair
within the distance thus meets in some shard. A shard goes on splitting the same way until its
parts are small, compares these exactly, and hands on a star per group instead of all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileloom.llm import common as c
from tileloom.llm import near_copies
from tileloom.llm.components import components
from tileloom.session import cut_lineage

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Fingerprints the tree is fitted on; an upper bound whatever the corpus.
SAMPLE = 16_384
#: Distinct fingerprints in a shard, and in a part of it that is compared pair by pair.
SHARD, PART = 131_072, 4_096

PRINTS = "doc_id long, fp long"


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of a text: XXH64 of its word shingles, lower-cased in A-Z; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = memoryview(b" ".join(words))
    long = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(long + 1) - 1
    starts = ends - long
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed long. Null text is empty."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            prints = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in texts], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PRINTS)


# --- the tree --------------------------------------------------------------------------------


def halves(points: np.ndarray, vantage: np.uint64, radius: int, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes inside and outside; points whose partners may be across the border are in both."""
    far = np.bitwise_count(points ^ vantage)
    return np.flatnonzero(far <= radius), np.flatnonzero(far.astype(np.int64) > radius - margin)


def choose(points: np.ndarray, margin: int, tries: int = 8):
    """The vantage point and radius that copy the fewest points over, or None if none divides them."""
    best, n = None, len(points)
    for at in np.linspace(0, n - 1, min(tries, n)).astype(int):
        far = np.bitwise_count(points ^ points[at]).astype(np.int64)
        radius = int(np.median(far))
        for r in (radius, radius - 1):
            inside, outside = int((far <= r).sum()), int((far > r - margin).sum())
            if max(inside, outside) < 0.9 * n and (best is None or inside + outside < best[0]):
                best = (inside + outside, points[at], r)
    return best and best[1:]


def fit_tree(sample: np.ndarray, n_all: int, margin: int = DISTANCE, shard: int = SHARD) -> list:
    """Nodes (vantage, radius, inside, outside), the root first; None is a shard.

    ``sample`` are distinct fingerprints, ``n_all`` how many there are in all. A node is split while
    about ``shard`` of all fingerprints would be in it and at least 32 of the sample are.
    """
    nodes: list = [None]
    todo = [(0, sample)]
    while todo:
        at, points = todo.pop()
        if len(points) * n_all <= shard * len(sample) or len(points) < 32:
            continue
        cut = choose(points, margin)
        if cut is None:
            continue
        inside, outside = halves(points, cut[0], cut[1], margin)
        nodes[at] = (int(cut[0]), cut[1], len(nodes), len(nodes) + 1)
        todo += [(len(nodes), points[inside]), (len(nodes) + 1, points[outside])]
        nodes += [None, None]
    return nodes


def deal(points: np.ndarray, nodes: list, margin: int = DISTANCE):
    """(shard, indexes) of all shards each point belongs to."""
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, index = todo.pop()
        if nodes[at] is None or not len(index):
            if len(index):
                yield at, index
            continue
        vantage, radius, left, right = nodes[at]
        inside, outside = halves(points[index], np.uint64(vantage), radius, margin)
        todo += [(left, index[inside]), (right, index[outside])]


def shard_links(points: np.ndarray, distance: int = DISTANCE, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """A star (member, smallest) of each group of distinct points linked within ``distance``."""
    points = np.sort(points)
    root = np.arange(len(points))
    todo = [np.arange(len(points))]
    while todo:
        index = todo.pop()
        if len(index) > part:
            cut = choose(points[index], distance)
            if cut is not None:
                inside, outside = halves(points[index], cut[0], cut[1], distance)
                todo += [index[inside], index[outside]]
                continue
        link_part(points, index, root, distance)
    while True:
        above = root[root]
        if (above == root).all():
            break
        root = above
    moved = np.flatnonzero(root != np.arange(len(points)))
    return points[moved], points[root[moved]]


def find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def link_part(points: np.ndarray, index: np.ndarray, root: np.ndarray, distance: int) -> None:
    """Join what lies within ``distance`` among some points. ``index`` ascends."""
    own = points[index]
    rows = max(1, (1 << 20) // max(1, len(own)))
    for a in range(0, len(own), rows):
        near = np.bitwise_count(own[a : a + rows, None] ^ own[None, a:]) <= distance
        i, j = np.nonzero(near)
        keep = i < j
        i, j = index[i[keep] + a], index[j[keep] + a]
        # Most pairs of a dense group are linked already: only pairs with other roots are joined.
        while len(i):
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            x, y = find(root, int(i[0])), find(root, int(j[0]))
            root[max(x, y)] = min(x, y)
            if len(i) > 64:
                while True:
                    above = root[root]
                    if (above == root).all():
                        break
                    root[:] = above
            else:
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = find(root, p), find(root, q)
                    root[max(x, y)] = min(x, y)
                break


# --- the operator ----------------------------------------------------------------------------


def links(distinct: DataFrame, distance: int = DISTANCE, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``distinct`` (fp) within ``distance`` bits."""
    n_all = distinct.count()
    drawn = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    nodes = fit_tree(np.array([r[0] for r in drawn], np.int64).view(np.uint64), n_all, distance, shard)

    def route(batches):
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for leaf, index in deal(points, nodes, distance):
                yield pa.record_batch([pa.array(np.full(len(index), leaf, np.int32)), pa.array(points[index].view(np.int64))], names=["shard", "fp"])

    def compare(key, rows):
        points = rows.column("fp").to_numpy().view(np.uint64)
        member, smallest = shard_links(points, distance)
        return pa.table({"a": pa.array(member.view(np.int64)), "b": pa.array(smallest.view(np.int64))})

    dealt = distinct.mapInArrow(route, "shard int, fp long")
    return dealt.groupBy("shard").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """Documents linked by fingerprints at ``distance`` bits or fewer, directly or through others.

    ``docs`` has doc_id and text; other columns are ignored. Returns one row per input row: doc_id,
    fp and component_id, the smallest doc_id of the component. A null or empty text has the
    fingerprint zero and is linked like any other. A row without an id belongs to its component but
    never names it; a component without any id has a null component_id.
    """
    prints = c.stage(fingerprints(docs, size))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies stays; all columns. The 3 bits of the query miss most near
    copies, so the pipeline's stage goes by verified similarity: see ``near_copies``."""
    return near_copies.keep_one(docs)


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
