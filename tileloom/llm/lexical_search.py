"""Ranked lexical search over document FP-trees (operator 11).

1. Texts are read once. Each document is restricted to the terms that some item asks for: a vector of
   (term, tf), with the document's length. The vectors are written; the corpus statistics (documents,
   terms, documents per term) are aggregates over them.
2. Terms are renumbered by falling document frequency. A task takes its documents ``TREE`` at a time and
   puts their vectors into an FP-tree: vectors that begin with the same frequent terms share a path. A
   node is a range of documents in path order with the greatest tf of each term below it and the least
   m. As a term's score grows with tf and falls with m, these bound every document below the node.
3. The tree is searched depth first, all items together: at each node one sparse product bounds the
   scores of all items that are still alive there; an item whose bound is below its 20th best score
   so far leaves that branch. Small subtrees side by side are a leaf and are scored exactly.
4. A task hands on its best 20 of each item; these are merged in two steps.

Nothing is cut but by the bounds, so the ranks are exact. Items come in blocks of at most
``BLOCK_TERMS`` distinct terms, which is what a task is sent, whatever the benchmark's size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tileloom.llm import common as c

TOP = 20
#: Documents of a tree and of a leaf.
TREE, LEAF = 8192, 32
#: Distinct terms and items of a block.
BLOCK_TERMS, BLOCK_ITEMS = 1 << 16, 1 << 12

#: Letters, digits and all that is not ASCII belong to terms.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = False
APART[128:] = False

VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"
BEST = "item int, doc_id long, score long"


def term_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each term of some texts (A-Z lower-cased), and its document."""
    data = c.LOWER[data]
    start, end, doc = c.word_bounds(data, bounds, APART)
    return c.word_hashes(data, start, end), doc


# --- items -------------------------------------------------------------------------------------


class Block:
    """Some items as a sparse matrix over the block's distinct terms: counts of each term per item."""

    def __init__(self, items: list[tuple[int, str]]):
        raw = [t.encode() for _, t in items]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        hashes, item = term_hashes(np.frombuffer(b"".join(raw), np.uint8), bounds)
        self.terms, which = np.unique(hashes, return_inverse=True)
        pair, self.count = np.unique(item * max(1, len(self.terms)) + which, return_counts=True)
        self.item, self.term = pair // max(1, len(self.terms)), pair % max(1, len(self.terms))

    def renumbered(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, term, count) with each term's new number."""
        return self.item, order[self.term], self.count


def blocks_of(items: DataFrame, block_terms: int, block_items: int):
    """(numbers and ids, Block) of the items, block by block; an item has its text and is there once."""
    rows = items.select("item_id", "text").where("text is not null").distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("at"), "item_id", "text")
    total = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    # A term takes at least two characters with the gap after it.
    n = max(1, -(-total[0] // block_items), -(-(total[1] or 0) // (2 * block_terms)))
    for k in range(n):
        own = rows.where(F.pmod("at", F.lit(n)) == k) if n > 1 else rows
        found = own.orderBy("item_id", "text").collect()
        if found:
            yield [r["item_id"] for r in found], Block([(i, r["text"]) for i, r in enumerate(found)])


# --- vectors -----------------------------------------------------------------------------------


def restrict(vocabulary: np.ndarray):
    """(doc_id, n, terms, tfs): the terms of ``vocabulary`` (sorted hashes) in each document."""

    def run(batches):
        size = max(1, len(vocabulary))
        for batch in batches:
            raw, bounds = c.binary_parts(batch.column(1))
            for a, b in c.blocks(bounds):
                hashes, doc = term_hashes(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                n = np.bincount(doc, minlength=b - a)
                at = np.searchsorted(vocabulary, hashes)
                at[at == len(vocabulary)] = 0
                wanted = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                pair, tf = np.unique(doc[wanted] * size + at[wanted], return_counts=True)
                upto = np.searchsorted(pair // size, np.arange(b - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x.astype(np.int32))) for x in (pair % size, tf)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


# --- the tree ----------------------------------------------------------------------------------


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Tree:
    """An FP-tree over documents given as vectors in path order of their terms.

    ``terms`` ascend within a document and are numbered by falling frequency, so a document's
    terms are its path. Documents are sorted by path; a node is a range of them.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int):
        path = terms.astype(">u4").tobytes()
        spans = zip((4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist(), strict=True)
        keys = [path[a:b] for a, b in spans]
        order = np.array(sorted(range(len(ids)), key=keys.__getitem__), np.int64)
        long = np.diff(bounds)[order]
        self.upto = np.concatenate([[0], np.cumsum(long)])
        source = np.repeat(bounds[:-1][order] - self.upto[:-1], long) + np.arange(self.upto[-1])
        self.terms, self.tfs = terms[source].astype(np.int64), tfs[source].astype(np.int64)
        self.ids, self.m, self.n_terms = ids[order], m[order], n_terms

    def shared(self, a: int, b: int) -> int:
        """Length of the path that documents a..b-1 have in common: that of the first and the last."""
        x, y = self.terms[self.upto[a] : self.upto[a + 1]], self.terms[self.upto[b - 1] : self.upto[b]]
        n = min(len(x), len(y))
        apart = np.flatnonzero(x[:n] != y[:n])
        return int(apart[0]) if len(apart) else n

    def children(self, a: int, b: int, leaf: int) -> list[tuple[int, int]]:
        """The subtrees below the node of documents a..b-1; small ones side by side are one."""
        depth = self.shared(a, b)
        at = self.upto[a:b] + depth
        ended = at >= self.upto[a + 1 : b + 1]
        step = np.where(ended, -1, self.terms[np.minimum(at, len(self.terms) - 1)])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [b - a]])
        if len(cuts) == 2:  # equal vectors: any cut will do
            cuts = np.array([0, (b - a) // 2, b - a])
        out, start = [], 0
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if y - start > leaf and x > start:
                out.append((a + start, a + x))
                start = x
            if y - start > leaf:
                out.append((a + start, a + y))
                start = y
        if start < b - a:
            out.append((a + start, b))
        return out

    def highest(self, a: int, b: int) -> np.ndarray:
        """Greatest tf of each term in the subtree."""
        own = slice(self.upto[a], self.upto[b])
        top = np.zeros(self.n_terms, np.int64)
        np.maximum.at(top, self.terms[own], self.tfs[own])
        return top

    def vectors(self, a: int, b: int) -> np.ndarray:
        """tf of all terms of documents a..b-1, a row each."""
        out = np.zeros((b - a, self.n_terms), np.int64)
        out[np.repeat(np.arange(b - a), np.diff(self.upto[a : b + 1])), self.terms[self.upto[a] : self.upto[b]]] = self.tfs[self.upto[a] : self.upto[b]]
        return out


class Ranking:
    """The best documents of each item so far, and the score that a new one must reach."""

    def __init__(self, n_items: int, top: int):
        self.top, self.floor = top, np.ones(n_items, np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n_items

    def offer(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.best[item][0], ids]), np.concatenate([self.best[item][1], scores])
        first = np.lexsort((ids, -scores))[: self.top]
        self.best[item] = ids[first], scores[first]
        if len(first) == self.top:
            self.floor[item] = scores[first[-1]]


class Items:
    """Items of a block, ready for bounds: a row of (term, weight times count) each."""

    def __init__(self, item: np.ndarray, term: np.ndarray, worth: np.ndarray):
        self.term, self.worth = term, worth
        self.numbers, self.starts = np.unique(item, return_index=True)
        self.ends = np.append(self.starts[1:], len(term))

    def some(self, alive: np.ndarray) -> Items:
        """The items at some places of this list."""
        part = Items.__new__(Items)
        long = (self.ends - self.starts)[alive]
        part.ends = np.cumsum(long)
        part.starts = part.ends - long
        source = np.repeat(self.starts[alive] - part.starts, long) + np.arange(long.sum())
        part.numbers, part.term, part.worth = self.numbers[alive], self.term[source], self.worth[source]
        return part


def search(tree: Tree, items: Items, ranking: Ranking, leaf: int = LEAF) -> int:
    """Depth-first branch and bound over ``tree`` for all items; the number of documents scored."""
    scored = 0
    todo = [(0, len(tree.ids), items)]
    while todo:
        a, b, alive = todo.pop()
        least = tree.m[a:b].min()
        bound = np.add.reduceat(gain(tree.highest(a, b), least)[alive.term] * alive.worth, alive.starts)
        stay = np.flatnonzero(bound >= ranking.floor[alive.numbers])
        if not len(stay):
            continue
        if len(stay) < len(bound):
            alive = alive.some(stay)
        if b - a > leaf:
            parts = tree.children(a, b, leaf)
            # The subtree with the longest shared path comes last on the stack and is searched first.
            todo += [(x, y, alive) for x, y in sorted(parts, key=lambda p: tree.shared(*p))]
            continue
        scored += b - a
        gains = gain(tree.vectors(a, b), tree.m[a:b, None])
        scores = np.add.reduceat(gains[:, alive.term] * alive.worth, alive.starts, axis=1)
        enough = scores >= ranking.floor[alive.numbers]
        for k in np.flatnonzero(enough.any(axis=0)).tolist():
            rows = np.flatnonzero(enough[:, k])
            ranking.offer(int(alive.numbers[k]), tree.ids[a + rows], scores[rows, k])
    return scored


def searcher(item, term, worth, order, n_docs: int, n_all: int, top: int, size: int, leaf: int):
    """(item, doc_id, score): the best of the task's documents."""

    def run(batches):
        items = Items(item, term, worth)
        if not len(items.numbers):
            return
        ranking = Ranking(int(items.numbers.max()) + 1, top)
        for ids, n, upto, terms, tfs in trees(batches, size):
            terms = order[terms]
            doc = np.repeat(np.arange(len(ids)), np.diff(upto))
            by_path = np.lexsort((terms, doc))
            m = 100 - 25 + (25 * n * n_docs) // n_all
            search(Tree(ids, m, upto, terms[by_path], tfs[by_path], len(order)), items, ranking, leaf)
        for k, (ids, scores) in enumerate(ranking.best):
            if len(ids):
                yield pa.record_batch([pa.array(np.full(len(ids), k, np.int32)), pa.array(ids), pa.array(scores)], names=["item", "doc_id", "score"])

    return run


def trees(batches, size: int):
    """The documents of a task, ``size`` at a time: ids, lengths, bounds, terms, tfs."""
    held, count = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            if count and count + part.num_rows > size:
                yield joined(held)
                held, count = [], 0
            held.append(part)
            count += part.num_rows
    if count:
        yield joined(held)


def joined(held):
    table = pa.Table.from_batches(held).combine_chunks()
    ids, n = (table.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    terms, tfs = (table.column(k).combine_chunks() for k in (2, 3))
    terms, tfs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (terms, tfs))
    upto = terms.offsets.to_numpy().astype(np.int64)
    return ids, n, upto - upto[0], terms.flatten().to_numpy(), tfs.flatten().to_numpy()


# --- the operator ------------------------------------------------------------------------------


def best_of(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The ``top`` highest scores of each key, and then the lowest ids."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_block(docs: DataFrame, numbers: list, block: Block, top: int, tree: int, leaf: int) -> DataFrame | None:
    texts = c.fresh(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    vectors = c.stage(texts.mapInArrow(restrict(block.terms), VECTOR)).where("n > 0")
    total = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    df = np.zeros(len(block.terms), np.int64)
    df[[r["term"] for r in counted]] = [r["df"] for r in counted]
    weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * k + 1))) for k in df.tolist()], np.int64)
    order = np.empty(len(df), np.int64)
    order[np.argsort(-df, kind="stable")] = np.arange(len(df))
    item, term, count = block.renumbered(order)
    worth = count * weight[block.term]
    run = searcher(item, term, worth, order, total["docs"], total["terms"], top, tree, leaf)
    some = vectors.where("doc_id is not null and size(terms) > 0").mapInArrow(run, BEST)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    merged = best_of(best_of(some.withColumn("part", part), ["item", "part"], top), ["item"], top)
    named = docs.sparkSession.createDataFrame([(k, i) for k, i in enumerate(numbers)], "item int, item_id long")
    return merged.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, tree: int = TREE, leaf: int = LEAF, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The ``top`` documents of each item with a score above 0: item_id, rank, doc_id, score.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Equal scores
    are ranked by ascending doc_id. A null text has no terms. A document without an id counts in the
    statistics but is never ranked; rows with equal ids are ranked each. An item with a null text or
    without known terms has no rows; equal items are one, and items of one id with other texts are
    ranked each. Documents of more than 10^7 terms over a corpus of 10^10 documents exceed 64 bits.
    """
    out = None
    for numbers, block in blocks_of(items, block_terms, block_items):
        ranked = rank_block(docs, numbers, block, top, tree, leaf)
        if ranked is None:
            break
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """The best 20 documents of every benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return rank_documents(docs, items)
