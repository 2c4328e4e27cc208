"""Benchmark decontamination by CGK embedding and bit sampling (operator 6).

A passage leaks an item if some window of the document is within ``1 - SIMILARITY`` of the item's
words in edit distance (words inserted, deleted or replaced; lower-cased in A-Z).

1. Windows of an item's length are proposed where a document shares enough word runs with it: by
   the q-gram lemma a passage with e edits keeps all but q * e of the item's runs of q words, in
   a band of e diagonals. That loses no passage and leaves few windows.
2. Windows and items are embedded by the random walk of Chakraborty, Goldenberg and Koucky: at each
   step a symbol is written and the walk moves on if a random bit of the symbol says so. Edit
   distance e becomes a Hamming distance of the order of e.
3. ``TABLES`` times, ``BITS`` positions of a fresh embedding are sampled; a window goes on if it
   agrees with the item on all of them in one table or more. More tables are drawn as the wanted
   recall asks.
4. The survivors are verified by exact edit distance, with both ends of the passage free.

Benchmark items are taken in blocks of bounded size, one pass over the documents for each, so what
is broadcast never grows; a benchmark that fits in one block takes one pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileloom.llm import common as c

SIMILARITY = 0.8
RECALL = 0.99
BITS = 2
#: Words of the benchmark that are broadcast at a time.
BLOCK_WORDS = 200_000

FOUND = "doc_id long, item_id long, start_word long, n_words long, edit_distance long, similarity double"


def allowed(n_words: int, similarity: float) -> int:
    """Edits within the similarity."""
    return math.floor((1 - similarity) * n_words + 1e-9)


def run_size(n_words: int, edits: int) -> int:
    """Words in the runs an item is found by: at most 3, fewer where edits may break all longer ones."""
    return max(1, min(3, n_words, -(-(n_words - edits) // (edits + 1))))


def tables(n_words: int, edits: int, bits: int, recall: float) -> int:
    """Tables that reach the recall at ``edits``, if each edit spoils four of the 3n positions."""
    agree = max(0.05, 1 - 4 * edits / (3 * n_words)) ** bits
    return 1 if edits == 0 else max(4, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


class Items:
    """A block of benchmark items: their words, and the runs of words they are found by."""

    def __init__(self, rows: list[tuple[int, bytes]], similarity: float):
        self.ids, self.words = [], []
        for item_id, text in rows:
            data, bounds = c.LOWER[np.frombuffer(text, np.uint8)], np.array([0, len(text)])
            start, end, _ = c.word_bounds(data, bounds)
            if len(start):
                self.ids.append(item_id)
                self.words.append(c.word_hashes(data, start, end))
        self.edits = [allowed(len(w), similarity) for w in self.words]
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.sizes = [run_size(len(w), e) for w, e in zip(self.words, self.edits, strict=True)]
        for q in sorted(set(self.sizes)):
            own = [i for i, s in enumerate(self.sizes) if s == q]
            keys = [c.run_hashes(self.words[i], q) for i in own]
            item = np.concatenate([np.full(len(k), i) for i, k in zip(own, keys, strict=True)])
            place = np.concatenate([np.arange(len(k)) for k in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[(keys >> np.uint64(42)).astype(np.int64)] = True
            self.runs[q] = (keys[order], item[order], place[order], seen)


def proposals(words: np.ndarray, doc: np.ndarray, items: Items):
    """(item, document, diagonal) with enough shared runs near it; a diagonal is where the item would start."""
    out = []
    for q, (keys, item, place, seen) in items.runs.items():
        runs = c.run_hashes(words, q)
        if not len(runs):
            continue
        whole = doc[: len(runs)] == doc[q - 1 :]
        at = np.flatnonzero(seen[(runs >> np.uint64(42)).astype(np.int64)] & whole)
        low, high = np.searchsorted(keys, runs[at], "left"), np.searchsorted(keys, runs[at], "right")
        for a, b, spot in zip(*((x[high > low]) for x in (low, high, at)), strict=True):
            out.append((item[a:b], np.full(b - a, spot), place[a:b]))
    if not out:
        return np.zeros((3, 0), np.int64)
    item, spot, place = (np.concatenate(x) for x in zip(*out, strict=True))
    start = spot - place
    order = np.lexsort((start, doc[spot], item))
    item, of, start = item[order], doc[spot][order], start[order]
    edits, size = np.array(items.edits)[item], np.array(items.sizes)[item]
    need = np.maximum(1, np.array([len(w) for w in items.words])[item] - size + 1 - size * edits)
    # Hits of one item and document whose diagonals are within e of each other.
    span = int(start.max() - start.min()) + 2 * int(edits.max()) + 2
    group = np.cumsum(np.concatenate([[0], (np.diff(item) != 0) | (np.diff(of) != 0)]))
    line = group * span + (start - start.min())
    near = np.searchsorted(line, line + edits, "right") - np.searchsorted(line, line - edits, "left")
    good = near >= need
    return np.unique(np.stack([item[good], of[good], start[good]]), axis=1)


def embedded(windows: np.ndarray, steps: int, seed: int, table: int) -> np.ndarray:
    """CGK embeddings of rows of word hashes (0 pads beyond the end); columns are the steps."""
    n, width = windows.shape
    at, out = np.zeros(n, np.int64), np.zeros((n, steps), np.uint64)
    rows = np.arange(n)
    salt = c.spread(seed * 1_000 + table, steps)
    for step in range(steps):
        symbol = np.where(at < width, windows[rows, np.minimum(at, width - 1)], np.uint64(0))
        out[:, step] = symbol
        at += (((symbol ^ salt[step]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64)
    return out


def collide(item: np.ndarray, windows: np.ndarray, edits: int, bits: int, recall: float) -> np.ndarray:
    """Which windows (rows, as long as the item) agree with it on all sampled positions of some table."""
    n = len(item)
    found = np.zeros(len(windows), bool)
    for t in range(tables(n, edits, bits, recall)):
        left = np.flatnonzero(~found)
        if not len(left):
            break
        both = embedded(np.vstack([item[None], windows[left]]), 3 * n, 7, t)
        sampled = np.random.default_rng(t).choice(3 * n, min(bits, 3 * n), replace=False)
        found[left] = (both[1:, sampled] == both[0, sampled]).all(axis=1)
    return found


def passage(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the part of ``words`` nearest to the item; the leftmost such."""
    n, m = len(item), len(words)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i in range(1, n + 1):
        step = cost[:-1] + (words != item[i - 1])
        drop = cost[1:] + 1
        best = np.minimum(step, drop)
        where = np.where(step <= drop, start[:-1], start[1:])
        row, frm = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        row[0], frm[0] = i, 0
        for j in range(1, m + 1):
            if row[j - 1] + 1 < best[j - 1]:
                row[j], frm[j] = row[j - 1] + 1, frm[j - 1]
            else:
                row[j], frm[j] = best[j - 1], where[j - 1]
        cost, start = row, frm
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def leaks_of_block(data: np.ndarray, bounds: np.ndarray, items: Items, bits: int, recall: float):
    """(document, item, start word, words, distance): the nearest passage of each leaked item."""
    start, end, doc = c.word_bounds(data, bounds)
    if not len(start):
        return
    words = c.word_hashes(data, start, end)
    item, of, diagonal = proposals(words, doc, items)
    first = np.searchsorted(doc, np.arange(len(bounds)))
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(item) != 0) | (np.diff(of) != 0)) + 1, [len(item)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        i, d = int(item[a]), int(of[a])
        own, e = items.words[i], items.edits[i]
        text = words[first[d] : first[d + 1]]
        starts = np.unique((diagonal[a:b, None] - first[d] + np.arange(-e, e + 1)).ravel())
        starts = starts[(starts > -len(own)) & (starts < len(text))]
        spots = starts[:, None] + np.arange(len(own))
        windows = np.where((spots >= 0) & (spots < len(text)), text[np.clip(spots, 0, len(text) - 1)], np.uint64(0))
        best = None
        hits = starts[collide(own, windows, e, bits, recall)]
        # Windows that overlap are verified as one stretch.
        for part in np.split(hits, np.flatnonzero(np.diff(hits) > len(own) + 2 * e) + 1):
            if not len(part):
                continue
            low, high = max(0, int(part[0]) - e), min(len(text), int(part[-1]) + len(own) + e)
            distance, s, t = passage(own, text[low:high])
            if distance <= e and (best is None or distance < best[0]):
                best = (distance, low + s, t - s)
        if best is not None:
            yield d, i, best[1], best[2], best[0]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, bits: int = BITS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Benchmark items that documents hold, whole or with few edits.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Returns
    one row per document row and leaked item: doc_id, item_id, start_word, n_words (the nearest
    passage, the first of several), edit_distance in words and similarity. Null or empty texts and
    items without words leak nothing. Items with equal texts are each reported; a row repeated in
    ``docs`` is reported as often.
    """
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // (6 * block_words)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    found = None
    for block in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        items = Items([(r[0], bytes(r[1])) for r in part], similarity)
        one = rows.mapInArrow(scanner(items, bits, recall), FOUND)
        found = one if found is None else found.unionByName(one)
    return found


def scanner(items: Items, bits: int, recall: float):
    def run(batches):
        for batch in batches:
            ids, valid = c.ids_of(batch.column(0))
            raw, bounds = c.binary_parts(batch.column(1))
            out = []
            for a, b in c.blocks(bounds):
                data = c.LOWER[raw[bounds[a] : bounds[b]]]
                for d, i, s, n, e in leaks_of_block(data, bounds[a : b + 1] - bounds[a], items, bits, recall):
                    doc_id = int(ids[a + d]) if valid[a + d] else None
                    out.append((doc_id, items.ids[i], s, n, e, 1 - e / len(items.words[i])))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "edit_distance", "similarity"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows without an id stay."""
    bad = leaks(docs, benchmark).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, passage, edit distance."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
