"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tileloom.llm import (
    brown_lm,
    decontamination,
    exact_dedup,
    html_text,
    language_id,
    lexical_search,
    mixing,
    packing,
    periodic_runs,
    quality,
    simhash_dedup,
    substring_dedup,
    token_counts,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_mixing": mixing.query,
    "op4_token_counts": token_counts.query,
    "op5_brown_lm": brown_lm.query,
    "op6_decontamination": decontamination.query,
    "op7_quality": quality.query,
    "op8_html_text": html_text.query,
    "op9_language_id": language_id.query,
    "op10_simhash_dedup": simhash_dedup.query,
    "op11_lexical_search": lexical_search.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_packing": packing.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM pos),
mins AS (SELECT words, min(doc_id) AS least FROM win GROUP BY words),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN mins USING (words) WHERE least < doc_id),
per AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(l), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN l IS NULL THEN w ELSE [x FOR x, k IN w IF NOT list_contains(l, k)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN per ON d.doc_id = per.doc_id""",
    "op2_exact_dedup": """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents))""",
    "op11_lexical_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
v AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM v, s GROUP BY term, nn),
p AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score FROM v JOIN q USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0
QUALIFY rank <= 20""",
    "op12_periodic_runs": r"""
WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
  xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(doc_id AS VARCHAR), '')])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT) AS h FROM documents),
g AS (SELECT doc_id, o, h, len(o) AS n, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM c),
w AS (SELECT doc_id, n, CASE WHEN n > 0 AND h % 10 = 0 THEN list_concat(o[:a], [o[a + 1 + k % (1 + (n - a) // (3 + (h // 10) % 8))] FOR k IN range(n - a)]) ELSE o END AS w FROM g),
p AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM w),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n_runs, arg_max({'start': start, 'length': length, 'period': period}, (length / period, -start, -period)) AS b,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
e AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
f AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN e USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN t ON t.doc_id = w.doc_id LEFT JOIN f ON f.doc_id = w.doc_id""",
}
