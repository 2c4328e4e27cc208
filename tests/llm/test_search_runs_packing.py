"""Operators 11 to 13 against brute force, on rows with every awkward case."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tileloom.llm import lexical_search, packing, periodic_runs

SCHEMA = "doc_id long, text string, lang string, n long, number long, key binary, words string, terms string, score long, part long, item int, rank int"
RND = random.Random(11)
VOCABULARY = ["w%d" % k for k in range(60)] + ["The", "of", "é", "naïve", "x-y", "İ", "日本"]


def line(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


def repeated(k):
    unit = [RND.choice(VOCABULARY) for _ in range(RND.randint(1, 9))]
    return " ".join((unit * k)[: RND.randint(1, len(unit) * k)])


TEXTS = [line(RND.randint(1, 60)) for _ in range(40)] + [repeated(9) for _ in range(40)]
TEXTS += [TEXTS[0], TEXTS[0].upper(), TEXTS[1] + " tail", None, "", "  \n\t", "!!! ... 42", line(3000), "same " * 700, "a b c  d\x1ce", "<|endoftext|> x"]
ROWS = [(None if k % 29 == 7 else (k % 75) * 3 - 4, t, "en", 1, 2, b"k", "clash", "clash", 9, 9, 9, 9) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[0], ROWS[0], ROWS[45], (None, None, *ROWS[0][2:]), (2**62, TEXTS[44], *ROWS[0][2:])]
RND.shuffle(ROWS)
ITEMS = [(1, "The of w1 w2 w2 w3"), (2, TEXTS[3]), (3, None), (4, ""), (5, "unheard-of words"), (6, "İ 日本 NAÏVE"), (2, TEXTS[3]), (None, "w9"), (7, "..."), (8, "same")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, t, "clash", 7) for i, t in ITEMS]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string, score long")


def terms(text):
    lower = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranking(rows, items, top):
    vectors = [(r[0], terms(r[1])) for r in rows]
    n_docs = sum(1 for _, t in vectors if t)
    n_all = sum(len(t) for _, t in vectors)
    df = Counter(w for _, t in vectors for w in set(t))
    out = []
    for item, text in set(items):
        found = []
        for doc, t in vectors:
            if doc is None:
                continue
            m = 75 + (25 * len(t) * n_docs) // n_all
            score, tf = 0, Counter(t)
            for w in terms(text):
                if tf[w]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 12 * m))
            if score > 0:
                found.append((-score, doc))
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("top, tree, leaf, block_terms, block_items", [(20, 8192, 32, 1 << 16, 1 << 12), (3, 16, 2, 1 << 16, 1 << 12), (5, 40, 1, 40, 2), (200, 7, 4, 1 << 16, 3)])
def test_search_equals_brute_force(docs, items, top, tree, leaf, block_terms, block_items):
    found = lexical_search.rank_documents(docs, items, top, tree, leaf, block_terms, block_items)
    assert sorted((tuple(r) for r in found.collect()), key=str) == ranking(ROWS, ITEMS, top)


def test_search_of_empty_tables(docs, none, items):
    assert lexical_search.rank_documents(none, items).collect() == []
    assert lexical_search.rank_documents(docs, items.limit(0)).collect() == []


def test_bounds_leave_out_most_of_a_tree():
    """Documents of another language lie in other branches, and their bounds end the search there."""
    rnd = np.random.default_rng(1)
    vectors = [np.unique(np.concatenate([[k % 2], 2 + (k % 2) * 100 + rnd.integers(0, 100, 30)])) for k in range(4000)]
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    flat = np.concatenate(vectors)
    tree = lexical_search.Tree(np.arange(4000), np.full(4000, 100), bounds, flat, np.ones(len(flat), np.int64), 202)
    query = lexical_search.Items(np.zeros(8, np.int64), np.arange(2, 10), np.full(8, 1000))
    ranking = lexical_search.Ranking(1, 20)
    assert lexical_search.search(tree, query, ranking) < 2100
    scores = [len(set(range(2, 10)) & set(v.tolist())) for v in vectors]
    want = sorted(range(4000), key=lambda k: (-scores[k], k))[:20]
    assert ranking.best[0][0].tolist() == want


# --- runs --------------------------------------------------------------------------------------


def order_of(doc, n):
    """The query's rule, word for word."""
    if doc is None or not n:
        return list(range(n))
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return list(range(n))
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [i if i < a else a + (i - a) % p for i in range(n)]


def runs_of(w):
    out, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in out.items())


def described(doc, text, planted):
    w = (text or "").encode().split()
    if planted:
        w = [w[i] for i in order_of(doc, len(w))]
    runs = sorted(runs_of(w), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(w), len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("tile, long", [(1 << 16, 1 << 20), (16, 1 << 20), (32, 40), (1 << 16, 0)])
def test_runs_equal_brute_force(docs, tile, long):
    got = periodic_runs.periodic_runs(docs, periodic_runs.planted, tile, long).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((described(r[0], r[1], True) for r in ROWS), key=str)


def test_runs_without_the_rule_and_without_rows(docs, none):
    got = periodic_runs.periodic_runs(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((described(r[0], r[1], False) for r in ROWS), key=str)
    assert periodic_runs.periodic_runs(none).collect() == []


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(k):
    word = "0"
    for _ in range(k):
        word += word.translate(str.maketrans("01", "10"))
    return word


@pytest.mark.parametrize("letters", [fibonacci(600), thue_morse(12), thue_morse(6) * 5, "a" * 700, ("a" * 7 + "b") * 40 + "a" * 9, "ab" * 3, "aaaaa", "aaaaaa"])
@pytest.mark.parametrize("tile", [16, 128, 1 << 16])
def test_runs_of_words_with_many_repetitions(letters, tile):
    own = {ch: np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k, ch in enumerate(sorted(set(letters)), 1)}
    stream = np.array([own[ch] for ch in letters] + [12345], np.uint64)
    _, q, start, end = periodic_runs.stream_intervals(stream, np.array([0, len(stream)]), len(letters), tile)
    assert sorted(zip(start.tolist(), (end - start + q).tolist(), q.tolist(), strict=True)) == runs_of(letters)


# --- packing -----------------------------------------------------------------------------------


def encoded(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check_packing(rows, packed, window):
    ids = [(r[0], encoded(r[1])) for r in rows]
    want = Counter()
    for doc, own in ids:
        for at in range(0, len(own), window):
            piece = np.array(own[at : at + window], "<u4").tobytes()
            want[doc, at, len(piece) // 4, zlib.crc32(piece), len(own)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == want
    filled = {}
    for r in packed:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(filled) == list(range(len(filled)))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sorted(sorted(length for _, length in pieces) for pieces in filled.values())


def best_fit(lengths, window):
    """Best-fit decreasing, one piece at a time."""
    space, filled = [], []
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(space, (length, -1))
        capacity, at = space.pop(i) if i < len(space) else (window, len(filled))
        if at == len(filled):
            filled.append([])
        filled[at].append(length)
        if capacity > length:
            bisect.insort(space, (capacity - length, at))
    return sorted(map(sorted, filled))


@pytest.mark.parametrize("window, bucket_rows", [(2048, 1 << 18), (64, 5), (10, 1)])
def test_packing_equals_best_fit(docs, window, bucket_rows):
    packed = packing.pack(docs, window, bucket_rows=bucket_rows).collect()
    assert check_packing(ROWS, packed, window) == best_fit([r.length for r in packed], window)


def test_sequences_give_back_the_documents(docs, none):
    packed = packing.pack(docs, 64, keep_ids=True).cache()
    rows = {r.sequence_id: r for r in packing.sequences(packed, 64).collect()}
    for r in rows.values():
        n = r.n_tokens
        assert len(r.ids) == (n if n & (n - 1) == 0 else 64)
    for p in packed.collect():
        own = rows[p.sequence_id].ids[p.offset : p.offset + p.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == p.ids_crc32
    assert packing.pack(none).collect() == []


def test_units_encode_as_the_whole_text():
    rnd = random.Random(2)
    parts = [" ", "  ", "\n", "\t", " ", " ", "　", "\u0085", "\x1c", "a", "Word", "é", "日本", "'s", "'ll", "'", "1", "23", "!!", ".", "-", "<|endoftext|>", "😀", "\x0b", "\r\n", "x" * 70, "́"]
    encoder = packing.Encoder(packing.vocabulary_text())
    for _ in range(40):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(20)]
        raw = [t.encode() for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
        ids, upto = encoder.block(np.frombuffer(b"".join(raw), np.uint8), bounds)
        for k, text in enumerate(texts):
            whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[upto[k] : upto[k + 1]].tolist() == whole


@pytest.mark.parametrize("window", [8, 33, 100])
def test_plan_equals_best_fit(window):
    rnd = random.Random(window)
    for _ in range(20):
        counts = {k: n for k in range(1, window + 1) if (n := rnd.randint(0, 9) * rnd.randint(0, 1))}
        filled = {}
        for length, _, n, first, per, _ in packing.plan(counts, window).tolist():
            for j in range(n):
                filled.setdefault(first + j // per, []).append(length)
        assert sorted(map(sorted, filled.values())) == best_fit([k for k, n in counts.items() for _ in range(n)], window)
