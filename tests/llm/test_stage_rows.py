"""The duplicate stages of the pipeline on repeated ids, and the near stage's exact buckets."""

import random

from tileloom.llm import exact_dedup, near_copies

SCHEMA = "doc_id long, text string, key string, digest binary, n long, at int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", b"d", 3, 4) for i, t in rows], SCHEMA)


def texts(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_equal_ids_lose_no_text(spark):
    rows = [(7, "one text"), (7, "another text"), (7, "ONE text"), (7, "one text"), (9, "one text"), (8, "another text"), (None, "one text"), (3, None), (3, "")]
    docs = frame(spark, rows).repartition(3)
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns
    got = texts(kept)
    assert got == texts(exact_dedup.keep_last(docs.repartition(5)))
    assert [g for g in got if g[0] != "3"] == [("8", "another text"), ("9", "one text"), ("None", "one text")]
    assert len(got) == 4
    both = exact_dedup.keep_last(frame(spark, [(7, "x"), (7, "y"), (7, "y"), (5, "x")]).repartition(2))
    assert texts(both) == [("7", "x"), ("7", "y")]


def test_near_stage_keeps_every_text_of_a_repeated_id(spark):
    base = " ".join(f"b{k}" for k in range(60))
    rows = [(1, base), (1, base), (2, base + " x"), (4, "p q r"), (4, "s t u"), (4, "s t u"), (None, base), (9, None), (10, "")]
    docs = frame(spark, rows).repartition(3)
    left = near_copies.keep_one(docs)
    assert left.columns == docs.columns
    assert texts(left) == sorted([("1", base), ("4", "p q r"), ("4", "s t u"), ("None", base), ("9", None)], key=lambda r: (r[0], r[1] or ""))
    assert near_copies.keep_one(docs.limit(0)).collect() == []


def jaccard(a, b):
    runs = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y)


def group(rnd, n, changed, words=120):
    base = [f"v{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = base.copy()
        for at in rnd.sample(range(words), rnd.choice(changed)):
            copy[at] = f"n{rnd.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_groups_around_the_similarity_lose_no_pair(spark):
    """Groups whose texts are partly above and partly below the similarity to each other."""
    rnd = random.Random(6)
    rows = [t for g in range(8) for t in group(rnd, 14, [1, 2, 3, 4, 6])]
    rows += group(rnd, 60, [12, 15]) + [" ".join(f"s{k}" for k in range(90)) + " " + " ".join(f"u{j}x{k}" for k in range(60)) for j in range(40)]
    docs = frame(spark, list(enumerate(rows))).repartition(3)
    edges = {(r.a, r.b) for r in near_copies.linked(docs).edges.collect()}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i], rows[j]) >= 0.8]
    for i, j in near:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    want = {i for i in range(len(rows)) if find(i) == i}
    assert edges <= set(near) and len(near) > 40
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == want


def pairs_tried(spark, copies):
    rnd = random.Random(1)
    rows = [t for _ in range(copies) for t in group(rnd, 6, [2, 9])] + group(rnd, 8 * copies, [13, 16])
    rows += [f"{' '.join(f's{k}' for k in range(80))} {' '.join(f'u{j}x{k}' for k in range(60))}" for j in range(12 * copies)]
    seen = []
    compare = near_copies.Search.compare

    def count(self, lead, members):
        compare(self, lead, members)
        seen.append(self.tried.count())

    near_copies.Search.compare = count
    try:
        near_copies.linked(frame(spark, list(enumerate(rows))))
    finally:
        near_copies.Search.compare = compare
    return seen[-1]


def test_pairs_grow_with_the_texts(spark):
    """Five times the texts, in groups five times as large, are held against each other about five times as often."""
    assert pairs_tried(spark, 25) < 12 * pairs_tried(spark, 5)
