"""Language ID: sparse multinomial logistic regression on character n-grams (operator 9).

Features are character 1- to 3-grams hashed to ``WIDTH`` columns, weighted by TF-IDF and scaled to
length one. Document frequencies cover all training documents. The regression is trained with
follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) on a bounded sample of
labelled documents, dealt to ``SHARDS`` tasks whose states are averaged after each epoch. A second
sample fits the temperature of the softmax. Prediction is one scan with the weights broadcast:
WIDTH times the number of languages, whatever the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileloom.session import cut_lineage

WIDTH = 1 << 15
SHARDS, EPOCHS = 8, 4
#: Labelled documents of a language drawn for training and calibration, about.
PER_LANGUAGE = 1_500
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
FOLDS = 5
NONE = "und"


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    """A document without an id takes no part in training."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


def columns_of(text: str) -> np.ndarray:
    """The column of each 1-, 2- and 3-gram of a text, white space being one space."""
    line = " " + " ".join(text.lower().split()) + " "
    x = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    top = np.uint64(64 - (WIDTH.bit_length() - 1))
    out = []
    for n in (1, 2, 3):
        if len(x) >= n:
            key = x[n - 1 :].copy()
            for k in range(1, n):
                key |= x[n - 1 - k : len(x) - k] << np.uint64(21 * k)
            out.append((key * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> top)
    return np.concatenate(out).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a text's scaled TF-IDF vector."""
    counts = np.bincount(columns_of(text), minlength=WIDTH)
    at = np.flatnonzero(counts)
    values = counts[at] * idf[at]
    norm = np.sqrt((values * values).sum())
    return at, values / norm if norm else values


# --- training --------------------------------------------------------------------------------


class Leader:
    """State of follow-the-regularised-leader for all columns and languages."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(sample: DataFrame, idf: np.ndarray, langs: list[str], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (WIDTH x languages) from ``sample`` (shard, doc_id, lang, text)."""
    z, n = np.zeros((WIDTH, len(langs))), np.zeros((WIDTH, len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}

    def run(z, n, epoch):
        def pass_over(rows):
            own = Leader(z.copy(), n.copy())
            docs = list(zip(rows.column("doc_id").to_pylist(), rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True))
            docs.sort(key=lambda d: zlib.crc32(f"{epoch}-{d[0]}".encode()))
            for _, lang, text in docs:
                own.learn(*vector(text, idf), place[lang])
            moved = np.flatnonzero((own.n != n).any(axis=1))
            return pa.table({"at": pa.array([moved.astype(np.int32).tobytes()], pa.binary()), "z": pa.array([(own.z - z)[moved].tobytes()], pa.binary()), "n": pa.array([(own.n - n)[moved].tobytes()], pa.binary())})

        return pass_over

    for epoch in range(epochs):
        # One row per shard, with the columns it has moved: bounded by WIDTH times the languages.
        states = sample.groupBy("shard").applyInArrow(run(z, n, epoch), "at binary, z binary, n binary").collect()
        z, n = z.copy(), n.copy()
        touched = np.zeros(WIDTH)
        dz, dn = np.zeros_like(z), np.zeros_like(n)
        for row in states:
            at = np.frombuffer(row["at"], np.int32)
            dz[at] += np.frombuffer(row["z"], float).reshape(len(at), -1)
            dn[at] += np.frombuffer(row["n"], float).reshape(len(at), -1)
            touched[at] += 1
        share = 1 / np.maximum(touched, 1)[:, None]
        z, n = z + dz * share, n + dn * share
    return Leader(z, n).weights()


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which the labels are likeliest, by golden-section search."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    low, high, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


# --- the operator ----------------------------------------------------------------------------


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the column)) + 1, over all of ``texts``."""

    def run(batches):
        for batch in batches:
            have, n = np.zeros(WIDTH, np.int64), 0
            for text in batch.column(0).to_pylist():
                if text:
                    have[np.unique(columns_of(text))] += 1
                    n += 1
            at = np.flatnonzero(have)
            yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(have[at], n))], names=["at", "n"])

    have = np.zeros(WIDTH + 1, np.int64)
    for row in texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # WIDTH + 1 rows
        have[row["at"]] = row["n"]
    return np.log((1 + have[-1]) / (1 + have[:-1])) + 1


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = FOLDS):
    """(languages, weights, idf, temperature) from the training documents with a language."""
    labelled = docs.where("doc_id is not null and lang is not null and text is not null").where(
        F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != 0
    )
    share = labelled.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share")).withColumnRenamed("lang", "l")
    rows = {r["l"]: r["share"] for r in share.collect()}  # one row per language
    langs = sorted(rows)
    if not langs:
        return [], None, None, 1.0
    idf = inverse_frequencies(labelled.select("text"))
    limit = F.create_map(*[x for lang, s in rows.items() for x in (F.lit(lang), F.lit(s))])[F.col("lang")]
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("lang")), 1)
    sample = labelled.where(draw / 2.0**63 < limit).select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS + 2)).cast("int").alias("shard"))
    sample = cut_lineage(sample)
    weights = train(sample.where(F.col("shard") < SHARDS), idf, langs)
    place = {lang: i for i, lang in enumerate(langs)}

    def logits(batches):
        for batch in batches:
            found = [(place[lang], (lambda at, v: v @ weights[at])(*vector(text, idf)).tolist()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["label", "logits"])

    held = sample.where(F.col("shard") >= SHARDS).select("lang", "text").mapInArrow(logits, "label int, logits array<double>").collect()
    heat = temperature(np.array([r["logits"] for r in held]).reshape(len(held), len(langs)), np.array([r["label"] for r in held], int))
    return langs, weights, idf, heat


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = FOLDS) -> DataFrame:
    """The language of each text.

    ``docs`` has doc_id, text and lang; other columns are ignored. Training uses the documents with
    a language whose crc32(doc_id) mod ``folds`` isn't 0; a prediction uses the text alone. Returns
    one row per input row: doc_id, held_out, lang_pred and score (the calibrated probability). A
    null text, or one without a letter, is 'und' with score 0, as is every text if nothing was
    learned. A row without an id is held out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, weights, idf, heat = learn(rows, per_language, folds)

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                if not langs or not has_letter(text):
                    found.append((NONE, 0.0))
                    continue
                at, values = vector(text, idf)
                p = softmax(values @ weights[at] / heat)
                best = int(np.argmax(p))
                found.append((langs[best], float(p[best])))
            ids = batch.column(0).to_pylist()
            yield pa.record_batch(
                [batch.column(0), pa.array([held_out(i, folds) for i in ids], pa.bool_()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
