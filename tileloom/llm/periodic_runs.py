"""Detection of periodic runs of words (operator 12).

A run is a stretch of words with smallest period q that is at least ``EXPONENT`` periods (and ``LEAST``
words) long and cannot be extended. Word i *matches* at q if word i + q is the same; a run of period
q is a longest interval of matching words, of at least (EXPONENT - 1) * q of them.

1. Texts are read once; words become 64-bit hashes. Every octave of periods 2^k .. 2^(k+1) - 1 has its
   own overlapping tiles of words. In a tile the multiples of B = 2^k are boundaries. A run of the
   octave has three such blocks of matches, so one block [b, b + B) surely lies in it: the block's
   hash is compared with those at b + B .. b + 2B - 1, one comparison a word. Where it agrees, the
   Z-functions at the boundary, to the right and to the left, give the interval of matches in the tile.
   An interval whose root is itself a power has a smaller period and is left out.
2. Documents of up to ``LONG`` words are tiled where they are read: several together, with a word between
   them that equals no other. The tiles of a longer document are rows and are dealt to all tasks.
3. Intervals are shuffled by (document, period) and stitched: those that touch are one. Only then is
   the length of a run judged.
4. Documents with a run get their words back by their key and drop the repeated periods. All others were
   finished in the first reading.

Intervals are verified word by word in their tile, so the block hashes only propose.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tileloom.llm import common as c

EXPONENT, LEAST = 4, 6
#: Words of a tile, at least, and blocks of its octave in it.
TILE, TILE_BLOCKS = 1 << 16, 16
#: A longer document's tiles are dealt to other tasks; tiles of so many octaves travel together.
LONG, OCTAVES = 1 << 20, 4
NO_RUN = hashlib.sha256(b"").hexdigest()

READ = "key binary, doc_id long, n_words long, sha256 string, words binary, periods array<long>, starts array<long>, ends array<long>, tile_octaves array<int>, tile_starts array<long>, tiles array<binary>"
FOUND = "key binary, period long, start long, end long"
RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


# --- words -------------------------------------------------------------------------------------


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of the words that the query judges instead of the original (fixed rule of the query)."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


# --- one tile ----------------------------------------------------------------------------------


class Tile:
    """Words of a tile with prefix sums, so that any two spans compare at once."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        self.up, self.down = c.powers(c.WORD_BASE, self.n + 1)
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * self.up[: self.n], out=self.total[1:])

    def blocks(self, size: int) -> np.ndarray:
        """The hash of the ``size`` words from each place on."""
        return (self.total[size:] - self.total[:-size]) * self.down[: self.n + 1 - size]

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.total[a + size] - self.total[a]) * self.down[a] == (self.total[b + size] - self.total[b]) * self.down[b]

    def z_right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b > a on agree."""
        return self.longest(self.n - b, lambda size: self.same(a, b, size))

    def z_left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b > a agree."""
        return self.longest(a, lambda size: self.same(a - size, b - size, size))

    @staticmethod
    def longest(most: np.ndarray, agrees) -> np.ndarray:
        """The largest size up to ``most`` that agrees, by bisection; smaller ones agree, too."""
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = agrees(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


FACTORS: dict[int, tuple[int, ...]] = {}


def prime_factors(q: int) -> tuple[int, ...]:
    if q not in FACTORS:
        left, out, p = q, [], 2
        while p * p <= left:
            if left % p == 0:
                out.append(p)
                while left % p == 0:
                    left //= p
            p += 1
        FACTORS[q] = tuple(out + [left] * (left > 1))
    return FACTORS[q]


def primitive(tile: Tile, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q words from each place on are no power of a shorter stretch."""
    good = np.ones(len(at), bool)
    values, which = np.unique(q, return_inverse=True)
    factors = [prime_factors(v) for v in values.tolist()]
    for k in range(max(map(len, factors), default=0)):
        shorter = np.array([v // f[k] if k < len(f) else 0 for v, f in zip(values.tolist(), factors, strict=True)], np.int64)[which]
        some = np.flatnonzero(good & (shorter > 0))
        good[some[tile.same(at[some], at[some] + shorter[some], q[some] - shorter[some])]] = False
    return good


def intervals(words: np.ndarray, octave: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, start, end) of the stretches of matching words of a tile that begins at word ``first``.

    Stretches are those around the boundaries (multiples of 2^octave, counted from word 0), as far as
    the tile goes; each holds at least 2^octave matches.
    """
    size = 1 << octave
    none = np.zeros(0, np.int64)
    skip = -first % size
    n_blocks = (len(words) - skip) // size
    if n_blocks < 3:
        return none, none, none
    tile = Tile(words)
    hashes = tile.blocks(size)
    hashes = hashes[skip:]
    rows = len(hashes) // size
    table = hashes[: rows * size].reshape(rows, size)
    row, shift = np.nonzero(table[1:] == table[:-1, :1])
    at, q = skip + row * size, size + shift
    whole = primitive(tile, at, q)
    at, q = at[whole], q[whole]
    if not len(at):
        return none, none, none
    start, end = at - tile.z_left(at, at + q), at + tile.z_right(at, at + q)
    found = np.unique(np.stack([q, start, end], 1), axis=0)
    out = []
    for period, a, b in found.tolist():
        agree = words[a:b] == words[a + period : b + period]
        if agree.all():
            out.append((period, first + a, first + b))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], agree, [False]]).astype(np.int8)))
        out += [(period, first + a + x, first + a + y) for x, y in edges.reshape(-1, 2).tolist() if y - x >= size]
    q, start, end = np.array(out, np.int64).reshape(-1, 3).T
    return q, start, end


def octaves(n: int) -> int:
    """Octaves of periods that a text of n words can hold a run of."""
    return max(0, (n // EXPONENT)).bit_length()


def tile_spans(n: int, octave: int, tile: int = TILE):
    """Overlapping tiles (first, last) of n words for the periods of one octave.

    A tile owns ``tile`` words or more, and also sees a block before them and three blocks after
    them: so far reach the matches that belong to its boundaries but to no other tile's.
    """
    size = 1 << octave
    own = max(tile // size, TILE_BLOCKS) * size
    for first in range(0, n, own):
        yield max(0, first - size), min(n, first + own + 3 * size)


# --- many documents ----------------------------------------------------------------------------


def merged(doc, period, start, end):
    """Intervals of one (document, period) that touch, as one."""
    order = np.lexsort((end, start, period, doc))
    doc, period, start, end = doc[order], period[order], start[order], end[order]
    if not len(doc):
        return doc, period, start, end
    # Within a document and period the greatest end so far, as rows of others are moved far apart.
    group = np.cumsum(np.concatenate([[0], (np.diff(doc) != 0) | (np.diff(period) != 0)]))
    span = int(end.max()) + 2
    reach = np.maximum.accumulate(end + group * span)
    new = np.concatenate([[True], start[1:] + group[1:] * span > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], period[at], start[at], reach[last] - group[last] * span


def stream_intervals(words: np.ndarray, bounds: np.ndarray, longest: int, tile: int = TILE):
    """(document, period, start, end) of the matching stretches of several documents.

    ``words`` are all of them one after the other, each followed by a word of its own; the matches
    that make a run touch no such word, so no run goes from one document to the next.
    """
    parts = []
    for octave in range(octaves(longest)):
        for a, b in tile_spans(len(words), octave, tile):
            parts.append(intervals(words[a:b], octave, a))
    period, start, end = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
    doc = np.searchsorted(bounds, start, "right") - 1
    doc, period, start, end = merged(doc, period, start, end)
    # What a document's two ends cut is as long as it will get.
    keep = long_enough(period, end - start)
    return doc[keep], period[keep], start[keep] - bounds[doc[keep]], end[keep] - bounds[doc[keep]]


def long_enough(period, matches):
    return (matches >= (EXPONENT - 1) * period) & (matches + period >= LEAST)


def row_key(doc_id: int | None, text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text, seed=0 if doc_id is None else (doc_id * 2 + 1) & (1 << 64) - 1)


def reader(rule, tile: int, long: int):
    """A row for each document: finished, or with its words and its intervals, or with tiles."""

    def run(batches):
        for batch in batches:
            ids, valid = c.ids_of(batch.column(0))
            raw, bounds = c.binary_parts(batch.column(1))
            for a, b in c.blocks(bounds):
                yield read_block([i if ok else None for i, ok in zip(ids[a:b].tolist(), valid[a:b].tolist(), strict=True)], raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], rule, tile, long)

    return run


def read_block(ids, data, bounds, rule, tile, long):
    start, end, doc = c.word_bounds(data, bounds)
    hashes = c.word_hashes(data, start, end)
    first = np.searchsorted(doc, np.arange(len(bounds)))
    n = np.diff(first)
    raw = data.tobytes()
    marks = c.mixed(np.arange(1, len(ids) + 1, dtype=np.uint64) * c.BASE)
    parts, orders, at, upto, near = [], [], 0, [0], []
    for k, i in enumerate(ids):
        order = rule(i, int(n[k])) if rule else None
        own = hashes[first[k] : first[k + 1]]
        own = own if order is None else own[order]
        orders.append(order)
        if n[k] <= long:
            near.append(k)
            parts += [own, marks[k : k + 1]]
            upto.append(upto[-1] + len(own) + 1)
    stream = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    at, period, begin, stop = stream_intervals(stream, np.array(upto, np.int64), int(n[near].max(initial=0)), tile)
    at = np.array(near, np.int64)[at] if len(at) else at
    rows = []
    for k, i in enumerate(ids):
        text = raw[bounds[k] : bounds[k + 1]]
        words = text.split()
        if orders[k] is not None:
            words = [words[j] for j in orders[k].tolist()]
        line = b" ".join(words)
        mine = slice(*np.searchsorted(at, [k, k + 1]))
        row = [row_key(i, text), i, len(words), None, None, None, None, None, None, None, None]
        if len(words) > long:
            own = hashes[first[k] : first[k + 1]]
            own = own if orders[k] is None else own[orders[k]]
            cut = [(o, a, b) for o in range(0, octaves(len(own)), OCTAVES) for a, b in tile_spans(len(own), min(o + OCTAVES, octaves(len(own))) - 1, tile)]
            row[4], row[8:] = line, [[o for o, _, _ in cut], [a for _, a, _ in cut], [own[a:b].tobytes() for _, a, b in cut]]
        elif mine.start < mine.stop:
            row[4:8] = line, period[mine].tolist(), begin[mine].tolist(), stop[mine].tolist()
        else:
            row[3] = hashlib.sha256(line).hexdigest()
        rows.append(row)
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]
    columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.record_batch(columns, names=[f.split()[0] for f in READ.split(", ")])


def solve_tiles(batches):
    """(key, period, start, end) of the tiles of long documents."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for k in range(batch.num_rows):
            octave, first = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
            words = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
            parts = [intervals(words, o, first) for o in range(octave, octave + OCTAVES)]
            period, start, end = (np.concatenate([p[j] for p in parts]) for j in range(3))
            _, period, start, end = merged(np.zeros(len(period), np.int64), period, start, end)
            yield pa.record_batch([pa.array([keys[k]] * len(period), pa.binary()), pa.array(period), pa.array(start), pa.array(end)], names=["key", "period", "start", "end"])


# --- the operator ------------------------------------------------------------------------------


def stitched(found: DataFrame) -> DataFrame:
    """The runs (key, period, start, length): touching intervals as one, judged by their length."""
    along = Window.partitionBy("key", "period").orderBy("start", "end")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    rows = found.distinct().withColumn("reach", F.max("end").over(before))
    rows = rows.withColumn("piece", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(along))
    whole = rows.groupBy("key", "period", "piece").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    matches = F.col("end") - F.col("start")
    runs = whole.where((matches >= (EXPONENT - 1) * F.col("period")) & (matches + F.col("period") >= LEAST))
    # A stretch with several periods has the smallest; intervals of powers are left out in their tile.
    return runs.groupBy("key", "start", (F.col("end") + F.col("period")).alias("stop")).agg(F.min("period").alias("period")).select(
        "key", "start", (F.col("stop") - F.col("start")).alias("length"), "period"
    )


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run (start, length, period) has after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def best_run(runs):
    """The greatest length / period, then the smallest start, then the smallest period."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def finish(batches):
    for batch in batches:
        out = []
        for doc_id, n, line, runs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            runs = sorted(((r["start"], r["length"], r["period"]) for r in runs or []), key=lambda r: (r[0], r[2]))
            best = best_run(runs)
            listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()
            kept = b" ".join(collapse(line.split(b" "), runs)) if n else b""
            top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            out.append((doc_id, n, len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
        names = [f.split()[0] for f in RESULT.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        columns = list(zip(*out, strict=True)) if out else [[]] * 9
        yield pa.record_batch([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names=names)


def read(docs: DataFrame, rule=None, tile: int = TILE, long: int = LONG) -> DataFrame:
    texts = c.fresh(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return c.stage(texts.mapInArrow(reader(rule, tile, long), READ))


def runs_of(seen: DataFrame) -> DataFrame:
    """All runs (key, start, length, period) of the documents that ``read`` has read."""
    near = seen.where("periods is not null").select("key", F.explode(F.arrays_zip("periods", "starts", "ends")).alias("i"))
    near = near.select("key", F.col("i.periods").alias("period"), F.col("i.starts").alias("start"), F.col("i.ends").alias("end"))
    tiles = seen.where("tiles is not null").select("key", F.explode(F.arrays_zip("tile_octaves", "tile_starts", "tiles")).alias("t"))
    tiles = tiles.select("key", F.col("t.tile_octaves").alias("octave"), F.col("t.tile_starts").alias("first"), F.col("t.tiles").alias("words"))
    tiles = tiles.repartition(F.col("key"), F.col("octave"), F.col("first"))
    return stitched(near.unionByName(tiles.mapInArrow(solve_tiles, FOUND)))


def periodic_runs(docs: DataFrame, rule=None, tile: int = TILE, long: int = LONG) -> DataFrame:
    """Per document: doc_id, n_words, n_runs, the run of the greatest exponent, and two digests.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text has no words. Each
    row is judged on its own, with or without an id; ``rule`` (doc_id, n) may give the order in which
    its words are read. No rows give no rows.
    """
    seen = read(docs, rule, tile, long)
    runs = runs_of(seen).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    empty = F.lit(None).cast("long")
    done = seen.where("words is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_runs"), empty.alias("start"), empty.alias("length"), empty.alias("period"),
        empty.alias("exponent_milli"), F.lit(NO_RUN).alias("runs_sha256"), F.col("sha256").alias("collapsed_sha256"),
    )
    open_ = seen.where("words is not null").join(runs, "key", "left").select("doc_id", "n_words", "words", "runs")
    return done.unionByName(open_.mapInArrow(finish, RESULT))


def query(spark, sf_dir: str) -> DataFrame:
    """Per document its runs; the words are read in the query's planted order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return periodic_runs(docs, planted).drop("n_words")
