"""Each operator against a brute-force version, on rows with every awkward case."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tileloom.llm import brown_lm, decontamination, exact_dedup, html_text, language_id, mixing, quality, simhash_dedup, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, fp string, digest string, size string, block string"
RND = random.Random(3)
VOCABULARY = ["w%d" % k for k in range(400)] + ["The", "of", "é", "naïve", "x y"]


def line(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated ids, a hot source."""
    base = [line(RND.randint(1, 60)) for _ in range(30)]
    passage = line(40)
    texts = base + [base[0], base[0].upper(), base[1] + " tail", passage, "a b " + passage, passage + "\n" + line(9)]
    texts += [None, "", "   \n\t", "!!! ... 42", line(4000) + " " + passage, " ".join(["same"] * 50)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [(7, base[2]), (7, base[2]), (None, base[3]), (None, None), (-5, passage), (2**62, base[4])]
    out = []
    for k, (i, t) in enumerate(rows):
        source = None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 4}"
        out.append((i, t, None if k % 9 == 0 else "en", source, None, 5, "clash", "clash", "clash", "clash"))
    RND.shuffle(out)
    return out


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def key(row):
    return tuple((v is not None, v) for v in row)


def test_substring_dedup(docs, none):
    size = 5
    least = {}
    for r in ROWS:
        w = words(r[1])
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if r[0] is not None:
                least[k] = min(least.get(k, r[0]), r[0])
    want = []
    for r in ROWS:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if r[0] is not None and least[tuple(w[i : i + size])] < r[0]:
                gone[i : i + size] = [True] * size
        want.append((r[0], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs, size, chunk_bytes=3000).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substring_dedup.remove_repeats(none).collect() == []


def test_exact_dedup(docs, none):
    norm = lambda t: (t or "").encode().lower()
    groups = {}
    for r in ROWS:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = []
    for r in ROWS:
        ids = groups[norm(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], hashlib.sha256(norm(r[1])).digest(), keep, len(ids), r[0] == keep))
    got = [(r[0], bytes(r[1]), *r[2:]) for r in exact_dedup.exact_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r["text"]) for r in kept.where("doc_id is not null").collect()) == sorted({norm(r[1]) for r in ROWS if r[0] is not None and r[0] == max(i for i in groups[norm(r[1])] if i is not None)})
    assert exact_dedup.exact_duplicates(none).collect() == []


def test_cuckoo_filter_holds_live_digests():
    made, all_of = exact_dedup.CuckooFilter(2), [hashlib.sha256(b"%d" % k).digest() for k in range(3000)]
    shard = exact_dedup.Shard()
    for d in all_of:
        shard.put(d, 1, 1)
        shard.put(d, 2, 1)
    assert len(shard.filter.table) > 64 and all(d in shard.filter for d in all_of)
    assert all(bucket[d] == [2, 2] for bucket in shard.content.values() for d in bucket)
    made = exact_dedup.CuckooFilter.of(all_of)
    for d in all_of[:1500]:
        assert made.remove(d)
    assert all(d in made for d in all_of[1500:])
    assert sum(d in made for d in all_of[:1500]) < 30
    assert exact_dedup.CuckooFilter.read(made.blob()).table.tolist() == made.table.tolist()


def test_cuckoo_index_inserts_and_deletes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.insert(exact_dedup.empty_index(spark, 2), frame([(1, "a"), (2, "A"), (3, "b"), (4, None)]))
    ask = frame([(10, "a"), (11, "B"), (12, ""), (13, "new")])
    live = {r["doc_id"]: r["live_id"] for r in exact_dedup.lookup(index, ask).collect()}
    assert live == {10: 2, 11: 3, 12: 4, 13: None}
    index = exact_dedup.delete(index, frame([(2, "a"), (3, "b"), (9, "a")]))
    live = {r["doc_id"]: r["live_id"] for r in exact_dedup.lookup(index, ask).collect()}
    assert live == {10: 1, 11: None, 12: 4, 13: None}
    hits = {r["doc_id"]: r["hit"] for r in exact_dedup.lookup(index, ask).collect()}
    assert hits[10] and hits[12] and not hits[11]


def test_mixing(docs, none):
    rows = [tuple(r) for r in mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()]
    assert sorted(rows, key=key) == sorted((tuple(r) for r in mixing.mix(docs.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()), key=key)
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=key) == sorted(((r[0], r[3], len(words(r[1]))) for r in ROWS), key=key)
    sizes = Counter()
    for r in rows:
        sizes[r[1]] += r[2]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not full:
            target.update({s: share * weight[s] for s in free})
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= full
    for s in order:
        own = [r for r in rows if r[1] == s]
        assert all(r[3] == sizes[s] and r[4] == pytest.approx(target[s]) for r in own)
        assert abs(sum(r[6] for r in own) - target[s]) <= max(r[2] for r in own)
    assert all(r[6] == r[5] * r[2] and 0 <= r[5] <= 3 for r in rows)
    assert mixing.mix(none).collect() == []


def test_token_edits():
    enc = token_counts.Encoder.read()
    parts = ["a", "b", "the ", " ", "\n", "  ", "é", "123", "'s", ".", "!!", " \n ", "word ", "\t", "\x1c", "　", "x@y.z"]
    for _ in range(300):
        text = "".join(RND.choice(parts) for _ in range(RND.randint(0, 300)))
        leaf = RND.choice([1, 8, 64])
        own = token_counts.leaves(text, leaf)
        assert "".join(own) == text
        doc = token_counts.Document(own, [enc.count(p) for p in own], enc, leaf)
        for _ in range(4):
            at, n = RND.randint(0, len(text) + 2), RND.choice([0, 1, 5, 60])
            put = "".join(RND.choice(parts) for _ in range(RND.choice([0, 1, 50])))
            doc.edit(at, n, put)
            at = min(at, len(text))
            text = text[:at] + put + text[at + n :]
        after, chars, tokens, total = doc.state()
        assert (after, total, sum(chars)) == (text, enc.count(text), len(text)) and total == sum(tokens)


def test_token_counts(spark, docs, none):
    enc = token_counts.Encoder.read()
    trees = token_counts.build_trees(docs, enc)
    assert sorted((r["n_tokens"] for r in trees.collect())) == sorted(enc.count(r[1] or "") for r in ROWS)
    edits = spark.createDataFrame([(1, 2, 0, 0, "zz "), (1, 1, 5, 3, None), (10**9, 1, 0, 1, "q")], "doc_id long, seq int, start int, length int, text string")
    done = token_counts.apply_edits(token_counts.with_edits(trees, edits), enc).where("doc_id = 1").first()
    text = next(r[1] for r in ROWS if r[0] == 1)
    assert done["text"] == "zz " + text[:5] + text[8:] and done["n_tokens"] == enc.count(done["text"]) and done["n_edits"] == 2
    assert token_counts.build_trees(none, enc).collect() == []


def test_brown_lm(spark, docs, none):
    got = brown_lm.word_scores(docs, chunk_bytes=3000, rounds=2).collect()
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter()
    for r in ROWS:
        if not out(r[0]):
            counts.update([w.lower() for w in words(r[1])] + [None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in ROWS:
        w = [x.lower() for x in words(r[1])] + [None]
        want.append((r[0], out(r[0]), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    assert sorted(((*r[:5], round(r["base_score"], 6)) for r in got), key=key) == sorted(want, key=key)
    assert all(r["score"] < 0 for r in got)
    assert brown_lm.word_scores(none).collect() == []


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 50, (97, 97)).astype(float)
    right, left = np.minimum(table[3], 4), np.minimum(table[:, 3], 3)
    right[3] = left[3] = 0
    best, gain = brown_lm.best_moves(3, right, left, 0.0, table)
    moved = table.copy()
    moved[3] -= right
    moved[:, 3] -= left
    moved[best] += right
    moved[:, best] += left
    assert gain == pytest.approx(brown_lm.likelihood(moved) - brown_lm.likelihood(table), abs=1e-6)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_decontamination(spark, docs, none):
    items = [line(n) for n in (12, 20, 31, 45)] + ["lone", "one two three four five"]
    rows, want = [], set()
    for k in range(80):
        i = k % len(items)
        w = items[i].split()
        for _ in range(RND.randint(0, decontamination.allowed(len(w), 0.8))):
            at = RND.randrange(len(w))
            if RND.random() < 0.5:
                w[at] = "edit%d" % RND.randrange(99)
            elif RND.random() < 0.5:
                w.insert(at, "more%d" % RND.randrange(99))
            else:
                del w[at]
        text = f"{line(30)} {' '.join(w).upper()} \n{line(20)}"
        rows.append((k, text))
        if edit_distance(" ".join(w).upper().encode().lower().split(), items[i].encode().lower().split()) <= decontamination.allowed(len(items[i].encode().split()), 0.8):
            want.add((k, i))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " "), (None, items[0])], "item_id long, text string")
    plain = [t.encode().lower().split() for _, t in rows]
    found = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_words=20).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found if r["item_id"] is not None}
    assert len(want & got) >= 0.97 * len(want)
    for r in found:
        if r["item_id"] is not None:
            own = plain[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]]
            assert edit_distance(own, items[r["item_id"]].encode().lower().split()) == r["edit_distance"]
    assert decontamination.leaks(docs, bench.limit(0)).collect() == [] and decontamination.leaks(none, bench).collect() == []
    assert decontamination.drop_leaks(docs, bench).columns == docs.columns


def test_quality(spark, none):
    good = [("the cat sat on the mat and the dog ran to the %s" % w, 1) for w in VOCABULARY[:120]]
    bad = [("&&&& ###### $$$$ %%%%%% " * 4 + w, 0) for w in VOCABULARY[:20]]
    rows = [(k, t, None if k % 7 == 0 else "en", q) for k, (t, q) in enumerate(good + bad)]
    docs = spark.createDataFrame([r[:3] for r in rows] + [(900, None, "en"), (901, " ", None), (None, good[0][0], "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows] + [(None, 1, None), (5, 1, None)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert len(kept) == len(rows) + 3
    assert not kept[900]["kept"] and kept[900]["perplexity"] is None and not kept[901]["kept"] and kept[None]["kept"]
    assert all(kept[r[0]]["kept"] == (r[3] == 1) for r in rows)
    # A text goes by what it lacks in all: one short by less than the allowance stays.
    lacks = lambda r: r["n_scored"] * (math.log(r["perplexity"]) - math.log(r["threshold"]))
    bad_lacks = min(lacks(r) for r in kept.values() if r["perplexity"] and not r["kept"])
    assert bad_lacks > quality.ALLOWANCE
    more = quality.score_quality(docs, labels, allowance=bad_lacks + 1e-6).where("kept").collect()
    assert all(r["kept"] == (lacks(r) <= bad_lacks + 1e-6) for r in more) and {r["doc_id"] for r in more} > {i for i, r in kept.items() if r["kept"]}
    assert quality.score_quality(none, labels).collect() == []
    free = quality.score_quality(docs, labels.limit(0)).collect()
    assert all(r["kept"] == (r["perplexity"] is not None) for r in free)


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("abca bcab cabd",), ("dab abc",), (None,)], "text string")
    model = quality.train(texts)
    base = int(quality.grams(b"abca")[-1]) >> quality.BITS << quality.BITS
    asked = spark.range(1 << quality.BITS).selectExpr(f"cast({base} as bigint) + id as gram")
    assert quality.probabilities(asked, model).selectExpr("sum(p0)").first()[0] == pytest.approx(1.0)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a>Menu</a></nav><header>Site</header>
<div class="cookie-notice">Accept</div><aside>side</aside><article><h1>One &amp; two</h1><p>First <b>bo</b>ld&nbsp;text<br>more
 words here.<p>Second paragraph of the article is here.<ul><li>an item of it</li></ul><div class="ad">Buy</div><form>mail</form>
<section id="comments"><p>I disagree with all of this.</p></section></article><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    want = "One & two\n\nFirst bold text more words here.\n\nSecond paragraph of the article is here.\n\nan item of it"
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (None, "u", "<nav>only</nav>", 1), (5, "u", "<article><p>" + "w " * 50_000 + "</article>", 1), (1, "u", PAGE, 1)]
    rows += [(9, "u", "plain words < 3 &am", 1), (10, "u", "<aside>left open<article><p>Body of text</article>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = [(r["page_id"], r["text"]) for r in html_text.extract(pages).collect()]
    assert sorted(got, key=key) == sorted(
        [(1, want), (1, want), (2, ""), (3, ""), (None, ""), (5, " ".join(["w"] * 50_000)), (9, "plain words < 3 &am"), (10, "Body of text")], key=key
    )
    assert html_text.extract(pages.limit(0)).collect() == []


def test_language(spark, none):
    make = {"en": "the of and to in that with ing", "de": "der die und ein sch ung keit ich", "zz": "ñá óñ íe ción ado que los las"}
    rows = []
    for k in range(300):
        lang = list(make)[k % 3]
        rows.append((k, " ".join(RND.choice(make[lang].split()) for _ in range(RND.randint(5, 60))), lang))
    more = [(900, None, "en"), (901, "", None), (902, "12 34 !!", "de"), (None, "der die und", None), (5, "the of and", None)]
    got = language_id.identify(spark.createDataFrame(rows + more, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) + len(more)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 5}
    held = [(by[i]["lang_pred"], lang) for i, _, lang in rows if i != 5 and by[i]["held_out"]]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in by if i is not None)
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[None]["lang_pred"] == "de" and by[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(none).collect() == []


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    prints = [brute_print(r[1]) for r in ROWS]
    root = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    ids = {r: min((ROWS[i][0] for i in range(len(ROWS)) if root[i] == r and ROWS[i][0] is not None), default=None) for r in set(root)}
    want = [(ROWS[i][0], prints[i], ids[root[i]]) for i in range(len(ROWS))]
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash_dedup.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash_dedup.keep_one(docs).columns == docs.columns
    assert simhash_dedup.near_duplicates(none).collect() == []


def test_vantage_point_shards_lose_no_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    near = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(5)])
    cluster = np.array([base[0] ^ np.uint64(1 << a | 1 << b) for a in range(64) for b in range(a)], np.uint64)
    points = np.unique(np.concatenate([near, cluster]))
    nodes = simhash_dedup.fit_tree(points[::3], len(points), shard=200)
    assert len(nodes) > 5
    meet = set()
    for _, index in simhash_dedup.deal(points, nodes):
        member, least = simhash_dedup.shard_links(points[index], part=50)
        meet |= set(zip(member.tolist(), least.tolist()))
    root = {int(p): int(p) for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in meet:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    for i, p in enumerate(points):
        for q in points[np.flatnonzero(np.bitwise_count(points ^ p) <= 3)]:
            assert find(int(p)) == find(int(q))
    apart = len({find(int(p)) for p in points})
    seen = np.zeros(len(points), bool)
    groups = 0
    for i in range(len(points)):
        if not seen[i]:
            groups += 1
            todo = [i]
            seen[i] = True
            while todo:
                new = np.flatnonzero((np.bitwise_count(points ^ points[todo.pop()]) <= 3) & ~seen)
                seen[new] = True
                todo += new.tolist()
    assert apart == groups


def five_words(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_copies_are_found_at_their_similarity(spark):
    rnd = random.Random(8)
    draw = lambda n: [rnd.choice(VOCABULARY[:400]) + str(rnd.randrange(50)) for _ in range(n)]
    rows, pairs, apart = [], [], []
    for k in range(120):
        base = draw(rnd.randint(120, 400))
        copy = base.copy()
        for at in rnd.sample(range(len(base)), max(1, len(base) * rnd.choice([1, 2, 8]) // 100)):
            copy[at] = "new%d" % rnd.randrange(10**6)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy).upper())]
        x, y = (five_words(t) for _, t in rows[-2:])
        (pairs if len(x & y) / len(x | y) >= 0.8 else apart).append(2 * k + 1)
    rows += [(1003, " ".join(draw(3))), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = {r["doc_id"] for r in simhash_dedup.keep_one(docs).collect()}
    assert len(pairs) > 60 and len(apart) > 20
    assert not left & set(pairs)
    assert left >= set(apart) | {2 * k for k in range(120)} | {1003, None}


def test_large_bucket_is_searched_beyond_its_star(spark):
    base = ["b%d" % k for k in range(200)]
    # Neighbours differ by two shingle runs; the ends of the row are far from each other.
    rows = [(k, " ".join(base[2 * k :] + ["t%d" % j for j in range(2 * k)])) for k in range(40)]
    got = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [five_words(t) for _, t in rows]
    near = [i for i in range(1, 40) if len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) >= 0.8]
    assert len(near) == 39 and [r["doc_id"] for r in got] == [0]


def test_quality_keeps_clean_documents_it_was_not_trained_on(spark):
    rnd = random.Random(4)
    letters = "etaoinshrdlucmfwyp"
    lexicon = ["".join(rnd.choices(letters, weights=range(18, 0, -1), k=rnd.randint(2, 9))) for _ in range(4000)]
    clean = lambda: " ".join(rnd.choice(lexicon) for _ in range(60))
    junk = lambda: "".join(rnd.choice("#$%&@{}<>|~^ 0123456789") for _ in range(300))
    rows = [(k, clean(), "en") for k in range(240)] + [(1000 + k, junk(), "en") for k in range(20)]
    rows += [(2000 + k, clean()[::-1], "yy") for k in range(60)] + [(3000, clean(), "zz")]
    labels = [(k, 1, 0) for k in range(160)] + [(2000 + k, 1, 0) for k in range(20)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert sum(got[k]["kept"] for k in range(160, 240)) >= 76
    assert not any(got[1000 + k]["kept"] for k in range(20))
    # Too few trusted documents to judge a language by.
    assert all(r["kept"] and r["threshold"] is None for i, r in got.items() if i >= 2000)
