"""What several operators share: words of a text, chunks of documents, packed key lists.

A *chunk* is a set of documents dealt by a hash of their id; its texts travel once, compressed.
Questions a chunk has about the whole corpus ("how often does this key occur?") go out as packed
sorted key lists, one per range of keys, and the answers come back in the same order. No list
that grows with the corpus is broadcast or held by one task.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileloom.session import ensure_checkpoint_dir

#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 8 << 20
#: Bytes of text whose words are hashed at a time.
BLOCK_BYTES = 1 << 20
#: Keys that meet in one task, on average.
BLOCK_KEYS = 1 << 21

#: The space and \t \n \v \f \r separate words; nothing else does.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNKS = "chunk int, payload binary"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; one that is missing is null."""
    have = set(docs.columns)
    return docs.select(*[F.col(f"`{n}`") if n in have else F.lit(None).alias(n) for n in names])


def one_of_each(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each value of ``keys``, the same on every run."""
    row = F.struct(*[F.col(f"`{n}`") for n in columns])
    picked = rows.groupBy(*keys).agg(F.min_by(row, F.struct(F.xxhash64(row), F.to_json(row))).alias("row_of_each"))
    return picked.select("row_of_each.*")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0




# --- texts and words -------------------------------------------------------------------------


def binary_parts(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary or string array and the n + 1 bounds; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) else "")
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    kind = np.int64 if wide else np.int32
    n = len(array)
    _, bounds, data = array.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(bounds, kind, n + 1, array.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(bounds: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges of whole documents of about ``most`` bytes; a longer document is one of its own."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE):
    """Start, end and document of every word; ``bounds`` are those of the documents in ``data``, and
    ``space`` tells which bytes separate words."""
    gap = space[data]
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    opens = ~gap
    starts = opens.copy()
    starts[1:] &= gap[:-1]
    ends = opens.copy()
    ends[:-1] &= gap[1:]
    # A document's first byte starts a word, and the byte before it ends one.
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    starts[inner] = opens[inner]
    ends[inner - 1] = opens[inner - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def spread(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_VALUE = spread(1, 256)
BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Kept(dict):
    """What a process has computed; it stays behind when a function travels to the executors."""

    def __reduce__(self):
        return Kept, ()


POWERS = Kept()


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64."""
    have = POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        n = max(n, 2 * BLOCK_BYTES)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(n, base), np.full(n, inverse)
        up[0] = down[0] = 1
        POWERS[int(base)] = have = (np.cumprod(up), np.cumprod(down))
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit value, well spread."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of each run ``values[start:end]``, wherever it stands."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_hash(BYTE_VALUE[data], starts, ends, BASE)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return spans_hash(words, starts, starts + size, WORD_BASE)


# --- packed arrays ---------------------------------------------------------------------------


def planes(a: np.ndarray) -> bytes:
    """An unsigned array in its narrowest type, byte plane by byte plane; high planes compress."""
    top = int(a.max()) if len(a) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    a = np.ascontiguousarray(a.astype(kind))
    return bytes([a.itemsize]) + a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1).T
    return np.ascontiguousarray(raw).view(f"<u{width}").ravel().astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob), dtype=np.uint64)


def block_edges(space: int, n_blocks: int) -> np.ndarray:
    """First key of every block but the first, when keys are below ``space``."""
    return np.array([space * k // n_blocks for k in range(1, n_blocks)], np.uint64)


def by_block(keys: np.ndarray, edges: np.ndarray):
    """(block, slice) of sorted keys."""
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    for block in np.flatnonzero(np.diff(cuts)):
        yield int(block), slice(int(cuts[block]), int(cuts[block + 1]))


# --- chunks of documents ---------------------------------------------------------------------


def chunk_count(total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(1, -(-total_bytes // chunk_bytes))


def chunk_of(column, n_chunks: int):
    return F.pmod(F.xxhash64(column), F.lit(n_chunks)).cast("int")


def chunked(docs: DataFrame, n_chunks: int) -> DataFrame:
    """Rows (chunk, payload): the compressed ids and texts of some documents of a chunk.

    ``docs`` has doc_id and text. A document without an id is dealt by its text.
    """
    rows = docs.select(
        chunk_of(F.coalesce(F.col("doc_id"), F.xxhash64("text")), n_chunks).alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    )
    return rows.mapInArrow(pack_batches, CHUNKS)


def pack_batches(batches):
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(chunk, kind="stable")
        batch = batch.take(pa.array(order))
        chunk = chunk[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]])
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            ids, valid = ids_of(part.column(1))
            raw, bounds = binary_parts(part.column(2))
            flags = valid.astype(np.uint8) | (part.column(2).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8) << 1)
            body = b"".join((np.int64(b - a).tobytes(), ids.tobytes(), flags.tobytes(), np.diff(bounds).astype(np.int64).tobytes(), raw.tobytes()))
            out.append(np.int64(len(body)).tobytes() + codec.compress(body, asbytes=True))
        yield pa.record_batch([pa.array(chunk[cuts[:-1]], pa.int32()), pa.array(out, pa.binary())], names=["chunk", "payload"])


def ids_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64 (0 where null) and where they are not null."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), valid


class Docs:
    """The documents of a chunk, sorted by id (those without one last)."""

    def __init__(self, payloads):
        codec = pa.Codec("zstd")
        ids, flags, sizes, texts = [], [], [], []
        for blob in payloads:
            size = int(np.frombuffer(blob, np.int64, 1)[0])
            body = codec.decompress(blob[8:], decompressed_size=size, asbytes=True)
            n = int(np.frombuffer(body, np.int64, 1)[0])
            ids.append(np.frombuffer(body, np.int64, n, 8))
            flags.append(np.frombuffer(body, np.uint8, n, 8 + 8 * n))
            sizes.append(np.frombuffer(body, np.int64, n, 8 + 9 * n))
            texts.append(np.frombuffer(body, np.uint8, -1, 8 + 17 * n))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        ids, flags, sizes, data = join(ids, np.int64), join(flags, np.uint8), join(sizes, np.int64), join(texts, np.uint8)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        # Equal ids are told apart by their text, so that every pass sees one order.
        view = memoryview(data)
        marks = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.uint64)
        order = np.lexsort((marks, ids, (flags & 1) == 0))
        self.ids, self.has_id, self.has_text = ids[order], (flags[order] & 1) == 1, (flags[order] & 2) == 2
        self._data, self._from, self._sizes = data, ends[:-1][order], sizes[order]
        self.bounds = np.concatenate([[0], np.cumsum(self._sizes)])

    def __len__(self):
        return len(self.ids)

    def bytes(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts of some documents one after the other, and their bounds."""
        parts = [self._data[a : a + n] for a, n in zip(self._from[first:last], self._sizes[first:last], strict=True)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8), self.bounds[first : last + 1] - self.bounds[first]

    def blocks(self, most: int = BLOCK_BYTES):
        """(first document, bytes, bounds) of ranges of documents."""
        for a, b in blocks(self.bounds, most):
            yield a, *self.bytes(a, b)




def blocks_with_id(docs: Docs):
    """Blocks of the documents that have an id; these come first in a chunk."""
    bounds = docs.bounds[: int(docs.has_id.sum()) + 1]
    for a, b in blocks(bounds):
        yield a, *docs.bytes(a, b)
