"""Best-fit decreasing packing of token ids into sequences (operator 13).

1. Each task encodes its documents. A text is cut where white space follows a visible character and
   where a sign follows a letter or digit; no token reaches across such a place, so each different
   unit is encoded once per task and documents are put together from the units' ids. An overlong document is cut into full
   windows and a rest.
2. Which window a piece goes to depends on nothing but how many pieces there are of each length: at
   most 2,048 numbers, whatever the corpus. ``plan`` takes lengths in descending order; a segment tree
   indexed by remaining capacity finds the tightest open windows, and all windows of one capacity
   take their pieces of one length in one step. The plan is a list of runs "pieces a..b of length L go
   to windows s.., q into each, from offset o". A window holds at most 63 different lengths, and a
   length opens at most two groups of windows and splits one, so there are fewer than 400,000 runs.
3. Pieces of one length are numbered: rows are dealt to buckets by a hash, numbered within (length,
   bucket) and moved on by the counts of the buckets before. A length that a third of all documents
   share is thus spread over all buckets. A piece's number then leads to its run.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tileloom.llm import common as c

WINDOW = 2048
#: The id after the last token of every document (fixed value).
END = 1
VOCABULARY = "byte_bpe_50k.json"
#: Pieces of a bucket, on average.
BUCKET_ROWS = 1 << 18
#: Units a process remembers, and the longest unit it remembers, in bytes.
UNITS, UNIT_BYTES = 3 << 18, 64

ALNUM, SIGN = np.zeros(256, bool), np.zeros(256, bool)
SIGN[33:127] = True
for low, high in ((48, 58), (65, 91), (97, 123)):
    ALNUM[low:high] = True
    SIGN[low:high] = False

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
IDS = ", ids binary"


# --- encoding ----------------------------------------------------------------------------------


def vocabulary_text(path: str | None = None) -> str:
    """The tokenizer file at ``path``, else the public one; its text travels, as executors may lack the file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First byte of every unit: document starts, white space after a character that is surely visible,
    and a sign after a letter or digit (all of ASCII)."""
    if not len(data):
        return np.zeros(0, np.int64)
    cut = c.SPACE[data]
    cut[0] = True
    before = data[:-1]
    cut[1:] &= before > 32
    # Wide spaces end in a byte of a character that starts with C2, E1, E2 or E3: no cut after such.
    cut[2:] &= ~((data[:-2] == 0xC2) & (before[1:] >= 0x80))
    cut[3:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & (before[2:] >= 0x80))
    cut[1:] |= SIGN[data[1:]] & ALNUM[before]
    inner = bounds[:-1][np.diff(bounds) > 0]
    cut[inner] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of documents; made in the task that uses it."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        # Names of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.known, self.ids = {}, np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, units: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)
        lists = [f.ids for f in found]
        long = np.fromiter(map(len, lists), np.int64, len(lists))
        self.known.update(zip(units, range(len(self.lengths), len(self.lengths) + len(units)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(long) - long])
        self.lengths = np.concatenate([self.lengths, long])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.uint32, long.sum())])

    def block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some documents one after the other, and the bounds of each document's ids."""
        starts = unit_starts(data, bounds)
        ends = np.append(starts[1:], len(data))
        _, first, which = np.unique(c.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(first) > UNITS or len(self.ids) > 8 * UNITS:
            self.forget()
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        fresh = list({u for u in units if u not in self.known})
        if fresh:
            self.learn(fresh)
        at = np.fromiter((self.known[u] for u in units), np.int64, len(units))[which]
        for u in fresh:
            if len(u) > UNIT_BYTES:
                del self.known[u]
        long = self.lengths[at]
        upto = np.concatenate([[0], np.cumsum(long)])
        source = np.repeat(self.starts[at] - upto[:-1], long) + np.arange(upto[-1])
        return self.ids[source], upto[np.searchsorted(starts, bounds)]


#: Encoders of a process, so that its next task knows the units of its last.
MADE = c.Kept()


def cutter(vocabulary: str, window: int, keep_ids: bool):
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of the pieces of each document."""

    def run(batches):
        encoder = MADE.setdefault(vocabulary, None) or Encoder(vocabulary)
        MADE[vocabulary] = encoder
        for batch in batches:
            raw, bounds = c.binary_parts(batch.column(1))
            for a, b in c.blocks(bounds):
                ids, upto = encoder.block(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                row, start, length, crc, total, parts = [], [], [], [], [], []
                for k in range(b - a):
                    own = np.append(ids[upto[k] : upto[k + 1]], np.uint32(END)).astype("<u4")
                    for at in range(0, len(own), window):
                        piece = own[at : at + window].tobytes()
                        row.append(a + k)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(own))
                        if keep_ids:
                            parts.append(piece)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.record_batch(columns, names=names)

    return run


# --- the plan ----------------------------------------------------------------------------------


class Capacities:
    """How many groups of open windows have each remaining capacity, as a segment tree of "any here"."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.any[i] += n
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that some open window has."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Runs (length, first, n, sequence, per_window, offset) that place all pieces.

    ``counts`` has the number of pieces of each length from 1 to ``window``. Pieces of equal length
    are told apart by a number from 0. Among windows of equal capacity the lowest go first.
    """
    capacities = Capacities(window)
    groups: dict[int, list] = {}
    opened, runs = 0, []

    def open_windows(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            groups.setdefault(capacity, []).append((first, n))
            capacities.add(capacity, 1)

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            capacity = capacities.tightest(length)
            if capacity is None:
                capacity, first = window, opened
                per = window // length
                n = -(-left // per)
                opened += n
            else:
                own = groups[capacity]
                own.sort(reverse=True)
                first, n = own.pop()
                capacities.add(capacity, -1)
                per = capacity // length
            used = min(n, -(-left // per))
            taken = min(left, used * per)
            runs.append((length, done, taken, first, per, window - capacity))
            full = taken // per
            open_windows(capacity - per * length, first, full)
            if taken % per:
                open_windows(capacity - taken % per * length, first + full, 1)
            open_windows(capacity, first + used, n - used)
            done, left = done + taken, left - taken
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 6)


def placer(runs: np.ndarray, schema):
    """Adds sequence_id and offset to pieces with their number among those of their length."""
    keys = (runs[:, 0] << 44) + runs[:, 1]

    def run(batches):
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "number"))
            at = np.searchsorted(keys, (length << 44) + number, "right") - 1
            step = number - runs[at, 1]
            sequence, offset = runs[at, 3] + step // runs[at, 4], runs[at, 5] + step % runs[at, 4] * length
            kept = [n for n in batch.schema.names if n != "number"]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


# --- the operator ------------------------------------------------------------------------------


def numbered(pieces: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``pieces`` with ``number``: from 0 among the pieces of one length."""
    n = pieces.count()
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(max(1, -(-n // bucket_rows))))
    rows = pieces.withColumn("bucket", bucket)
    before = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    rows = rows.withColumn("at", F.row_number().over(inside) - 1).join(before, ["length", "bucket"])
    return rows.withColumn("number", F.col("before") + F.col("at")).drop("bucket", "at", "before")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, keep_ids: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Where each piece of each document goes: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text is its end token
    alone. Rows with equal or null ids are packed like any others; equal rows may change places. With
    ``keep_ids`` the pieces carry their ids as little-endian 32-bit numbers. No rows give no rows.
    """
    texts = c.fresh(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = PIECE + (IDS if keep_ids else "")
    pieces = c.stage(texts.mapInArrow(cutter(vocabulary_text(vocabulary), window, keep_ids), schema))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = numbered(pieces, bucket_rows).select(*pieces.columns, "number")
    return placed.mapInArrow(placer(plan(counts, window), schema), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = WINDOW, pad: int = END) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array), n_tokens; ``packed`` carries ids.

    A sequence is padded to ``window`` unless its tokens number a power of two. One task holds one
    window's pieces at a time, never more than ``window`` ids.
    """

    def join(key, rows):
        order = np.argsort(rows.column("offset").to_numpy())
        blobs = rows.column("ids").to_pylist()
        ids = np.concatenate([np.frombuffer(blobs[k], "<u4") for k in order]).astype(np.int32)
        n = len(ids)
        if n & (n - 1):
            ids = np.concatenate([ids, np.full(window - n, pad, np.int32)])
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32())), "n_tokens": pa.array([n], pa.int64())})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<int>, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    """One row per piece of a document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
