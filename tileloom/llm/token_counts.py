"""Edit-aware token counts over per-document segment trees (operator 4).

A text is cut into leaves of whole pre-tokens. A cut stands before a white-space character that
follows another character than white space; there every pre-token of the patterns served here ends,
so the tokens of a text are those of its leaves. A tree holds the characters and tokens of each
leaf and their sums. An edit finds its leaves by descending the sums, re-encodes only these (they
reach to the next cut on either side) and updates the sums above them.

Trees are kept as two arrays per document, in any table; edits come as an array per document or
from an edits table. All work on a document is in one task, and documents are never put together.
"""

from __future__ import annotations

import base64
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf, at least, where cuts allow it.
LEAF = 256
#: The public vocabulary used by the query, and the pattern of its pre-tokens (fixed values).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")

TREE = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"
EDIT = "array<struct<start:int,length:int,text:string>>"
COUNTED = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, n_edits long, n_tokens_before long, chars_reencoded long"


class Encoder:
    """Counts tokens; the vocabulary's bytes travel with it, as executors may lack the file."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.vocabulary, self.pattern, self._made = vocabulary, pattern, None

    @classmethod
    def read(cls, path: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
        with open(os.path.realpath(path), "rb") as f:
            return cls(f.read(), pattern)

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "pattern": self.pattern, "_made": None}

    def count(self, text: str) -> int:
        if self._made is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.vocabulary.splitlines())}
            self._made = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return len(self._made.encode_ordinary(text))


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """The text in parts of whole pre-tokens, each of ``leaf`` characters or the next cut after them."""
    out, at = [], 0
    while at < len(text):
        cut = CUT.search(text, at + leaf)
        end = cut.start() if cut and cut.start() > at else len(text)
        out.append(text[at:end])
        at = end
    return out


class Tree:
    """Sums of characters and tokens over the leaves of one document."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = max(1, len(chars))
        self.size = 1 << (self.n - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(chars)] = chars
        self.tokens[self.size : self.size + len(tokens)] = tokens
        for i in range(self.size - 1, 0, -1):
            self.pull(i)

    def pull(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a character offset, and where the leaf starts; the last leaf at the end."""
        if offset >= self.chars[1]:
            last = self.n - 1
            return last, self.chars[1] - self.chars[self.size + last]
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if offset >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self.pull(i)


class Document:
    """A text in leaves under a tree; edits re-encode what they touch."""

    def __init__(self, parts: list[str], tokens: list[int], encoder: Encoder, leaf: int = LEAF):
        self.parts, self.encoder, self.leaf = parts or [""], encoder, leaf
        self.tree = Tree([len(p) for p in self.parts], tokens or [0])
        self.reencoded = 0

    def edit(self, start: int, length: int, text: str) -> None:
        """Put ``text`` in the place of ``length`` characters from ``start``; out of range is cut off."""
        start = min(max(0, start), self.tree.chars[1])
        end = min(start + max(0, length), self.tree.chars[1])
        first, offset = self.tree.find(start)
        last, last_offset = self.tree.find(max(start, end - 1))
        # A leaf that begins at the edit may come to follow other characters: take the one before.
        if start == offset and first > 0:
            first -= 1
            while first > 0 and not self.parts[first]:
                first -= 1
            offset = sum_before(self.tree, first)
        stop = last_offset + len(self.parts[last])
        # So may the leaf after it, if the edit reaches to the end of its own.
        if end >= stop:
            while last < self.tree.n - 1:
                last += 1
                if self.parts[last]:
                    break
            stop = sum_before(self.tree, last) + len(self.parts[last])
        old = "".join(self.parts[first : last + 1])
        new = old[: start - offset] + text + old[end - offset :]
        own = leaves(new, self.leaf)
        self.reencoded += len(new)
        count = self.encoder.count
        room = last + 1 - first
        if len(own) > room:
            # More leaves than there were: the tree is laid out anew, but only these are encoded.
            tokens = self.tree.tokens[self.tree.size : self.tree.size + self.tree.n]
            self.parts[first : last + 1] = own
            tokens[first : last + 1] = [count(p) for p in own]
            self.tree = Tree([len(p) for p in self.parts], tokens)
            return
        own += [""] * (room - len(own))
        for i, part in enumerate(own, first):
            self.parts[i] = part
            self.tree.set(i, len(part), count(part) if part else 0)

    def state(self) -> tuple[str, list[int], list[int], int]:
        kept = [(len(p), self.tree.tokens[self.tree.size + i]) for i, p in enumerate(self.parts) if p]
        return "".join(self.parts), [k[0] for k in kept], [k[1] for k in kept], self.tree.tokens[1]


def sum_before(tree: Tree, leaf: int) -> int:
    """Characters before a leaf, from the sums above it."""
    i, total = leaf + tree.size, 0
    while i > 1:
        if i % 2:
            total += tree.chars[i - 1]
        i //= 2
    return total


# --- the operator ----------------------------------------------------------------------------


def build_trees(docs: DataFrame, encoder: Encoder, leaf: int = LEAF, *keep: str) -> DataFrame:
    """The tree of each text: doc_id, text, leaf_chars, leaf_tokens, n_tokens and the columns ``keep``.

    ``docs`` has doc_id and text; other columns are ignored unless kept. A null text counts as empty.
    """
    more = "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        for batch in batches:
            chars, tokens = [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for text in texts:
                parts = leaves(text, leaf)
                chars.append([len(p) for p in parts])
                tokens.append([encoder.count(p) for p in parts])
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), pa.array([sum(t) for t in tokens], pa.int64())]
            yield pa.record_batch(columns + batch.columns[2:], names=["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", *keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return rows.mapInArrow(run, TREE + more)


def apply_edits(trees: DataFrame, encoder: Encoder, leaf: int = LEAF) -> DataFrame:
    """The trees after their edits, applied in order, each to what the one before left.

    ``trees`` is as from ``build_trees``, with a column edits (array of start, length, text; in
    characters). Null edits are none; an edit out of range is cut off at the text's ends. Returns
    the tree columns and n_edits, n_tokens_before and chars_reencoded.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, chars, tokens, n, edits in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if not edits:
                    out.append((doc_id, text, chars, tokens, n, 0, n, 0))
                    continue
                parts, at = [], 0
                for k in chars:
                    parts.append(text[at : at + k])
                    at += k
                doc = Document(parts, tokens, encoder, leaf)
                for e in edits:
                    doc.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")
                out.append((doc_id, *doc.state(), len(edits), n, doc.reencoded))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.int64()] * 4
            yield pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in COUNTED.split(", ")])

    columns = ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", F.col("edits").cast(EDIT)]
    return trees.select(*columns).mapInArrow(run, COUNTED)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the edits of a table (doc_id, seq, start, length, text), in order of seq."""
    packed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "text"))).alias("edits"))
    packed = packed.select("doc_id", F.transform("edits", lambda e: F.struct(e["start"].cast("int").alias("start"), e["length"].cast("int").alias("length"), e["text"].alias("text"))).alias("edits"))
    return trees.join(packed, "doc_id", "left")


#: What the query's edits redact: mail addresses, IPv4 addresses, keys in hexadecimal, long numbers.
PRIVATE = re.compile(r"[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63})+|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[0-9a-f]{32,}\b|\b\d{12,19}\b")


def redactions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edits): edits that put [X] in the place of what is private in a text."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                shift, own = 0, []
                for m in PRIVATE.finditer(text or ""):
                    own.append({"start": m.start() + shift, "length": len(m[0]), "text": "[X]"})
                    shift += 3 - len(m[0])
                out.append(own)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("text", pa.string())]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc_id", "text", "edits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, text string, edits {EDIT}")


def query(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after redacting what is private in it.

    One row per document: doc_id, n_tokens_before, n_tokens, n_edits, n_chars (after),
    chars_reencoded, text_sha256 (after).
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoder = Encoder.read()
    trees = build_trees(redactions(docs), encoder, LEAF, "edits")
    return apply_edits(trees, encoder).select(
        "doc_id", "n_tokens_before", "n_tokens", "n_edits", F.length("text").cast("long").alias("n_chars"), "chars_reencoded", F.sha2(F.col("text"), 256).alias("text_sha256")
    )
