"""Substring dedup (operator 1): windows of words that repeat across documents are cut.

1. Each chunk of documents sketches its windows: a count-min sketch of ``DEPTH`` rows, kept sparse
   (sorted cells and counts). The sketches are merged cell by cell, in one task per range of cells;
   a chunk learns which of its cells hold two or more windows. Counts can only be too high.
2. Only windows all of whose cells repeat go on, as 128-bit digests of their words with the
   smallest document of the chunk. They are grouped exactly, in one task per range of digests;
   the chunk learns which of them start in a smaller document elsewhere. A window copied into a
   third of all documents is at most one entry per chunk.
3. Each chunk marks the words its repeated windows cover and returns what is left.

The sketch is as wide as the corpus is long, so its error stays at any size; it is spread over
tasks and never broadcast. Texts are shuffled once, compressed, and reused by all three passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileloom.llm import common as c

WINDOW = 13
DEPTH = 2
#: Cells of a sketch row per byte of text, before rounding up to a power of two.
CELLS_PER_BYTE = 2

ASKS = "chunk int, block int, keys binary, low binary, extra binary"
ANSWERS = "chunk int, block int, kind int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


class Windows:
    """The windows of a block of documents."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, size: int):
        self.start, self.end, self.doc = c.word_bounds(data, bounds)
        self.data, self.size = data, size
        n = len(self.start) - size + 1
        self.at = np.flatnonzero(self.doc[: max(n, 0)] == self.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
        words = c.word_hashes(data, self.start, self.end)
        self.hash = c.run_hashes(words, size)[self.at] if n > 0 else np.zeros(0, np.uint64)

    def digests(self, chosen: np.ndarray) -> np.ndarray:
        """128-bit digests (n x 2) of the word sequences of some windows."""
        if not len(chosen):
            return np.zeros((0, 2), np.uint64)
        # Words joined by one space, so that white space does not tell windows apart.
        long = self.end - self.start
        at = np.concatenate([[0], np.cumsum(long + 1)])
        clean = np.full(int(at[-1]), 32, np.uint8)
        inside = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        clean[np.repeat(at[:-1], long) + inside] = self.data[np.repeat(self.start, long) + inside]
        view, first = memoryview(clean), self.at[chosen]
        raw = b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(at[first].tolist(), (at[first + self.size] - 1).tolist(), strict=True))
        return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def cells(hashes: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """The cell of each window in each row; row r has the cells from r << bits on."""
    down = np.uint64(64 - bits)
    return np.stack([(c.mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (2**64 - 1))) >> down) + np.uint64(r << bits) for r in range(depth)])


def chunk_cells(docs: c.Docs, size: int, bits: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketch of a chunk: its cells and whether one holds several of its windows."""
    parts = [cells(Windows(data, bounds, size).hash, bits, depth).ravel() for _, data, bounds in c.blocks_with_id(docs)]
    keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return np.unique(keys, return_counts=True)


def repeated(docs: c.Docs, size: int, bits: int, depth: int, hot: np.ndarray):
    """(document, word, digest) of the windows whose cells are all in ``hot`` (sorted)."""
    docs_of, words_of, digests = [], [], []
    n_words = 0
    for first, data, bounds in c.blocks_with_id(docs):
        w = Windows(data, bounds, size)
        if len(w.hash) and len(hot):
            grid = cells(w.hash, bits, depth)
            near = np.minimum(np.searchsorted(hot, grid), len(hot) - 1)
            chosen = np.flatnonzero((hot[near] == grid).all(axis=0))
            at = w.at[chosen]
            docs_of.append(w.doc[at] + first)
            words_of.append(at + n_words)
            digests.append(w.digests(chosen))
        n_words += len(w.start)
    if not docs_of:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, 2), np.uint64)
    return np.concatenate(docs_of), np.concatenate(words_of), np.concatenate(digests)


def entries(docs: c.Docs, doc_at: np.ndarray, digests: np.ndarray):
    """Distinct digests of a chunk in order, their smallest document, and the entry of each window."""
    ids = docs.ids[doc_at]
    order = np.lexsort((ids, digests[:, 1], digests[:, 0]))
    high, low = digests[order, 0], digests[order, 1]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return high[new], low[new], ids[order][new], entry


def hot_cells(docs: c.Docs, size: int, bits: int, depth: int, answers: pa.Table) -> np.ndarray:
    keys, _ = chunk_cells(docs, size, bits, depth)
    return keys[answer_bits(answers, 0, len(keys))]


def answer_bits(answers: pa.Table, kind: int, n: int) -> np.ndarray:
    """The answers of one kind, in the order of the keys asked."""
    rows = sorted((b, bits) for b, k, bits in zip(*(answers.column(x).to_pylist() for x in ("block", "kind", "bits")), strict=True) if k == kind)
    parts = [np.unpackbits(np.frombuffer(bits, np.uint8, offset=8), count=int(np.frombuffer(bits, np.int64, 1)[0])) for _, bits in rows]
    out = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    if len(out) != n:
        raise RuntimeError(f"{len(out)} answers to {n} keys: the input changed between two passes")
    return out


def with_length(flags: np.ndarray) -> bytes:
    return np.int64(len(flags)).tobytes() + np.packbits(flags).tobytes()


def table(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(values, kinds[kind]) for (name, kind), values in zip(fields, columns, strict=True)})


def remove_repeats(docs: DataFrame, size: int = WINDOW, depth: int = DEPTH, chunk_bytes: int = c.CHUNK_BYTES) -> DataFrame:
    """Cut each word covered by a window of ``size`` words that also starts in a document with a smaller id.

    ``docs`` has doc_id and text; other columns are ignored. Returns one row per input row:
    doc_id, n_words, n_removed and kept_text (words that stay, joined by one space). Windows are
    judged on the input. A null or empty text has no words. A document without an id is compared
    with none: it stays whole and removes nothing. Rows with one id do not remove each other's words.
    """
    total = c.text_bytes(docs)
    n_chunks = c.chunk_count(total, chunk_bytes)
    bits = max(16, (CELLS_PER_BYTE * total - 1).bit_length() if total else 0)
    n_blocks = max(1, depth * total // (5 * c.BLOCK_KEYS))
    cell_edges, digest_edges = c.block_edges(depth << bits, n_blocks), c.block_edges(1 << 64, n_blocks)
    texts = c.chunked(docs, n_chunks)

    def ask_cells(key, rows):
        docs = c.Docs(rows.column("payload").to_pylist())
        keys, counts = chunk_cells(docs, size, bits, depth)
        out = [(key[0].as_py(), b, c.pack_sorted(keys[s]), None, c.planes(np.minimum(counts[s], 2))) for b, s in c.by_block(keys, cell_edges)]
        return table(ASKS, list(zip(*out, strict=True)) if out else [[]] * 5)

    def merge_cells(key, rows):
        lists = [c.unpack_sorted(x) for x in rows.column("keys").to_pylist()]
        counts = np.concatenate([c.unplanes(x) for x in rows.column("extra").to_pylist()])
        _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        several = np.bincount(inverse, counts)[inverse] >= 2
        ends = np.cumsum([len(x) for x in lists])
        bits_of = [with_length(several[e - len(x) : e]) for x, e in zip(lists, ends, strict=True)]
        return table(ANSWERS, [rows.column("chunk").to_pylist(), [key[0].as_py()] * len(lists), [0] * len(lists), bits_of])

    def ask_digests(key, rows, answers):
        docs = c.Docs(rows.column("payload").to_pylist())
        hot = hot_cells(docs, size, bits, depth, answers)
        doc_at, _, digests = repeated(docs, size, bits, depth, hot)
        high, low, ids, _ = entries(docs, doc_at, digests)
        base = ids.min() if len(ids) else 0
        out = [
            (key[0].as_py(), b, c.pack_sorted(high[s]), low[s].tobytes(), np.int64(base).tobytes() + c.planes((ids[s] - base).astype(np.uint64)))
            for b, s in c.by_block(high, digest_edges)
        ]
        return table(ASKS, list(zip(*out, strict=True)) if out else [[]] * 5)

    def group_digests(key, rows):
        highs = [c.unpack_sorted(x) for x in rows.column("keys").to_pylist()]
        high = np.concatenate(highs)
        low = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("low").to_pylist()])
        ids = np.concatenate([np.frombuffer(x, np.int64, 1)[0] + c.unplanes(x[8:]).astype(np.int64) for x in rows.column("extra").to_pylist()])
        order = np.lexsort((ids, low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        smallest = np.empty(len(order), np.int64)
        smallest[order] = ids[order][new][np.cumsum(new) - 1]
        earlier = smallest < ids
        ends = np.cumsum([len(x) for x in highs])
        bits_of = [with_length(earlier[e - len(x) : e]) for x, e in zip(highs, ends, strict=True)]
        return table(ANSWERS, [rows.column("chunk").to_pylist(), [key[0].as_py()] * len(highs), [1] * len(highs), bits_of])

    def cut(key, rows, answers):
        docs = c.Docs(rows.column("payload").to_pylist())
        hot = hot_cells(docs, size, bits, depth, answers)
        doc_at, word_at, digests = repeated(docs, size, bits, depth, hot)
        _, _, ids, entry = entries(docs, doc_at, digests)
        earlier = answer_bits(answers, 1, len(ids))
        removed = word_at[earlier[entry] | (docs.ids[doc_at] > ids[entry])] if len(entry) else word_at
        return kept(docs, removed, size)

    by_chunk = texts.groupBy("chunk")
    answers0 = by_chunk.applyInArrow(ask_cells, ASKS).groupBy("block").applyInArrow(merge_cells, ANSWERS)
    asks = texts.groupBy("chunk").cogroup(answers0.groupBy("chunk")).applyInArrow(ask_digests, ASKS)
    answers1 = asks.groupBy("block").applyInArrow(group_digests, ANSWERS)
    answers = answers0.unionByName(answers1)
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, RESULT)


def kept(docs: c.Docs, removed: np.ndarray, size: int) -> pa.Table:
    """Rows of a chunk without the words that windows starting at ``removed`` cover."""
    ids, n_words, n_removed, texts = [], [], [], []
    before = 0
    for first, data, bounds in docs.blocks():
        start, end, doc = c.word_bounds(data, bounds)
        inside = removed[(removed >= before) & (removed < before + len(start))] - before
        covered = np.zeros(len(start) + 1, np.int64)
        np.add.at(covered, inside, 1)
        np.add.at(covered, inside + size, -1)
        gone = np.cumsum(covered)[:-1] > 0
        cuts = np.searchsorted(doc, np.arange(len(bounds)))
        raw = data.tobytes()
        for d in range(len(bounds) - 1):
            s = slice(cuts[d], cuts[d + 1])
            stay = ~gone[s]
            if stay.all():
                words = raw[bounds[d] : bounds[d + 1]].split()
            else:
                words = [raw[a:b] for a, b in zip(start[s][stay].tolist(), end[s][stay].tolist(), strict=True)]
            n_words.append(int(cuts[d + 1] - cuts[d]))
            n_removed.append(int((~stay).sum()))
            texts.append(b" ".join(words))
            ids.append(int(docs.ids[first + d]) if docs.has_id[first + d] else None)
        before += len(start)
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
        }
    )


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
