"""DuckDB statements that check the training-data queries where SQL can say them."""

from __future__ import annotations

from filigree.llm.lookalike import fold_rows
from filigree.plans.checks import SPACE

_ONCE = "SELECT chunk_id, min(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id"

P1_FOUND = "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 4500"

P2_FOUND = f"""
WITH c AS ({_ONCE}),
w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM c),
g AS (
  SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 40)
),
n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id),
s AS (
  SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS shared
  FROM g x JOIN g y ON x.gram = y.gram AND x.chunk_id < y.chunk_id GROUP BY 1, 2
)
SELECT a AS chunk_id_a, b AS chunk_id_b
FROM s JOIN n na ON na.chunk_id = a JOIN n nb ON nb.chunk_id = b
WHERE 10 * shared >= 6 * (na.n + nb.n - shared)
"""

P2_GROUPS = """
WITH RECURSIVE c AS (SELECT chunk_id, min(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
w AS (SELECT chunk_id, coalesce(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), []) AS w FROM c),
g AS (
  SELECT DISTINCT chunk_id, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
),
k AS (
  SELECT chunk_id, CASE WHEN len(w) >= 5 THEN 's' || (SELECT md5(string_agg(gram, '|' ORDER BY gram)) FROM g WHERE g.chunk_id = w.chunk_id)
    WHEN len(w) > 0 THEN 'w' || array_to_string(w, ' ') ELSE 'k' || chunk_id END AS cls FROM w
),
r AS (SELECT cls, min(chunk_id) AS rep FROM k GROUP BY cls),
h AS (SELECT cls, gram FROM r JOIN g ON chunk_id = rep),
n AS (SELECT cls, count(*) AS n FROM h GROUP BY cls),
s AS (SELECT x.cls AS a, y.cls AS b, count(*) AS shared FROM h x JOIN h y ON x.gram = y.gram AND x.cls <> y.cls GROUP BY 1, 2),
e AS (SELECT a, b FROM s JOIN n na ON na.cls = a JOIN n nb ON nb.cls = b WHERE 10 * shared >= 8 * (na.n + nb.n - shared)),
t AS (SELECT cls, cls AS far FROM r UNION SELECT t.cls, e.b FROM t JOIN e ON e.a = t.far),
m AS (SELECT t.cls, min(rep) AS group_id FROM t JOIN r ON r.cls = far GROUP BY t.cls),
z AS (SELECT chunk_id, k.cls, group_id FROM k JOIN m USING (cls))
SELECT chunk_id, group_id, (SELECT count(*) FROM e WHERE a = z.cls) AS n_links, count(*) OVER (PARTITION BY group_id) AS group_size FROM z
"""

_NEAR = """
WITH v AS (
  SELECT window_id, min(window_map) AS record_no, any_value(embedding)::DOUBLE[96] AS e
  FROM index_windows WHERE embedding IS NOT NULL AND (list_max(embedding) > 0 OR list_min(embedding) < 0)
  GROUP BY window_id
),
r AS (
  SELECT a.window_id AS id, b.window_id AS other, a.record_no AS ra, b.record_no AS rb,
    array_cosine_similarity(a.e, b.e) AS cosine
  FROM v a JOIN v b ON a.window_id <> b.window_id
),
k AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS place FROM r WHERE cosine >= 0.79
)
"""

P3_FOUND = f"""{_NEAR}
SELECT DISTINCT least(id, other) AS window_id_a, greatest(id, other) AS window_id_b
FROM k WHERE place <= 5 AND cosine >= 0.8
"""

P3_TRACED = f"""{_NEAR.replace("WHERE cosine >= 0.79", "").replace("cosine DESC", "round(cosine, 6) DESC")},
c AS (SELECT record_no, min(chunk_id) AS chunk_id FROM chunks WHERE record_no IS NOT NULL GROUP BY 1)
SELECT id AS window_id, x.chunk_id, place, other AS similar_window_id, y.chunk_id AS similar_chunk_id, round(cosine, 2) AS cosine
FROM k LEFT JOIN c x ON x.record_no = ra LEFT JOIN c y ON y.record_no = rb WHERE place <= 5
"""

P4_FOUND = """
WITH r AS (
  SELECT qid, chunk_id,
    max(CASE WHEN isnan(bm25_score) THEN NULL ELSE bm25_score END) AS a,
    max(CASE WHEN isnan(embed_score) THEN NULL ELSE embed_score END) AS b,
    max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS c
  FROM retrieved_chunks GROUP BY 1, 2
),
p AS (
  SELECT qid, chunk_id, rank() OVER (PARTITION BY qid ORDER BY a DESC NULLS LAST)
    + rank() OVER (PARTITION BY qid ORDER BY b DESC NULLS LAST)
    + rank() OVER (PARTITION BY qid ORDER BY c DESC NULLS LAST) AS places FROM r
)
SELECT qid, chunk_id FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY places, chunk_id) = 1
"""


def _bound(c: str, q: str) -> str:
    return f"min(CASE WHEN n{c} >= ceil({q} * t{c}) THEN {c} END)"


P4_RANKING = f"""
WITH r AS (
  SELECT qid, chunk_id,
    max(CASE WHEN isnan(bm25_score) THEN NULL ELSE bm25_score END) AS a,
    max(CASE WHEN isnan(embed_score) THEN NULL ELSE embed_score END) AS b,
    max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS c
  FROM retrieved_chunks GROUP BY 1, 2
),
o AS (
  SELECT *,
    row_number() OVER (PARTITION BY qid ORDER BY a NULLS LAST) AS na, count(a) OVER (PARTITION BY qid) AS ta,
    row_number() OVER (PARTITION BY qid ORDER BY b NULLS LAST) AS nb, count(b) OVER (PARTITION BY qid) AS tb,
    row_number() OVER (PARTITION BY qid ORDER BY c NULLS LAST) AS nc, count(c) OVER (PARTITION BY qid) AS tc
  FROM r
),
q AS (
  SELECT qid, {_bound("a", "0.05")} AS la, {_bound("a", "0.95")} AS ha, {_bound("b", "0.05")} AS lb,
    {_bound("b", "0.95")} AS hb, {_bound("c", "0.05")} AS lc, {_bound("c", "0.95")} AS hc
  FROM o GROUP BY qid
),
w AS (
  SELECT r.qid, chunk_id,
    CASE WHEN a IS NOT NULL THEN least(greatest(a, la), ha) END AS a,
    CASE WHEN b IS NOT NULL THEN least(greatest(b, lb), hb) END AS b,
    CASE WHEN c IS NOT NULL THEN least(greatest(c, lc), hc) END AS c
  FROM r JOIN q ON r.qid = q.qid
),
s AS (
  SELECT qid, nullif(sqrt(sum(a * a)), 0) AS na, max(a) AS xa, min(a) AS ma, nullif(sqrt(sum(b * b)), 0) AS nb,
    max(b) AS xb, min(b) AS mb, nullif(sqrt(sum(c * c)), 0) AS nc, max(c) AS xc, min(c) AS mc
  FROM w GROUP BY qid
),
d AS (
  SELECT w.qid, chunk_id,
    sqrt(coalesce(((xa - coalesce(a, ma)) / na) ^ 2, 0) + coalesce(((xb - coalesce(b, mb)) / nb) ^ 2, 0)
      + coalesce(((xc - coalesce(c, mc)) / nc) ^ 2, 0)) AS near,
    sqrt(coalesce(((ma - coalesce(a, ma)) / na) ^ 2, 0) + coalesce(((mb - coalesce(b, mb)) / nb) ^ 2, 0)
      + coalesce(((mc - coalesce(c, mc)) / nc) ^ 2, 0)) AS far
  FROM w JOIN s ON w.qid = s.qid
),
e AS (SELECT qid, chunk_id, CASE WHEN near + far > 0 THEN far / (near + far) ELSE 0.5 END AS closeness FROM d)
SELECT qid, chunk_id, round(closeness, 6) AS closeness,
  row_number() OVER (PARTITION BY qid ORDER BY round(closeness, 12) DESC, chunk_id) AS place
FROM e
"""

P8_FOUND = """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ip AS (
  SELECT DISTINCT item_id, list_aggregate(w[i:i + 11], 'string_agg', ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)
),
dp AS (
  SELECT doc_id, list_aggregate(w[i:i + 11], 'string_agg', ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)
)
SELECT DISTINCT doc_id, item_id FROM dp JOIN ip USING (phrase)
"""

P9_FOUND = """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (
  SELECT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 50)
)
SELECT doc_id FROM g GROUP BY doc_id HAVING 10 * (count(*) - count(DISTINCT gram)) >= 3 * count(*)
"""

# Word k of a text ends and begins where the k-th match does; offsets are those of the words joined by what lies between.
P8_REMOVAL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w, string_split_regex(text, '[\\p{L}\\p{N}]+') AS between
  FROM documents WHERE text IS NOT NULL
),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ip AS (
  SELECT DISTINCT item_id, list_aggregate(w[i:i + 11], 'string_agg', ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)
),
dp AS (
  SELECT doc_id, i, lower(list_aggregate(w[i:i + 11], 'string_agg', ' ')) AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)
),
hit AS (SELECT doc_id, item_id, i FROM dp JOIN ip USING (phrase)),
x AS (
  SELECT hit.doc_id, item_id, i, list_sum(list_transform(between[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda y: length(y))), 0) AS a,
    list_sum(list_transform(between[1:i + 11], lambda y: length(y))) + list_sum(list_transform(w[1:i + 11], lambda y: length(y))) AS z
  FROM hit JOIN dw USING (doc_id)
),
"""

P8_SPANS = P8_REMOVAL + """
o AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) + 12, true) AS fresh FROM x),
g AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS span FROM o)
SELECT doc_id, item_id, min(a)::INT AS span_start, max(z)::INT AS span_end, (max(i) - min(i) + 12)::INT AS n_words FROM g GROUP BY doc_id, item_id, span
"""

P8_REMOVAL += """
o AS (SELECT *, coalesce(a > max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM x),
g AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS span FROM o),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items FROM x GROUP BY doc_id)
SELECT doc_id, min(a)::INT AS span_start, max(z)::INT AS span_end, any_value(n_items) AS n_items FROM g JOIN m USING (doc_id) GROUP BY doc_id, span
"""

_LINES = f"""
WITH l AS (
  SELECT doc_id, row_no, line, i AS line_no, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+') AS w
  FROM (SELECT doc_id, row_no, unnest(s) AS line, generate_subscripts(s, 1) AS i
    FROM (SELECT doc_id, row_number() OVER () AS row_no, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))
),
x AS (SELECT doc_id, row_no, line_no, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM l WHERE len(w) > 0),
g AS (
  SELECT row_no, line_no, lag(word, 4) OVER o || ' ' || lag(word, 3) OVER o || ' ' || lag(word, 2) OVER o || ' ' || lag(word) OVER o || ' ' || word
    AS gram, row_number() OVER o AS i
  FROM x WINDOW o AS (PARTITION BY row_no ORDER BY line_no, j)
),
r AS (SELECT row_no, line_no, row_number() OVER (PARTITION BY row_no, gram ORDER BY i) > 1 AS again FROM g WHERE gram IS NOT NULL),
q AS (SELECT row_no, line_no, count(*) AS sequences, count(*) FILTER (again) AS repeated FROM r GROUP BY 1, 2),
v AS (
  SELECT l.*, len(w) AS n, coalesce(sequences, 0) AS sequences, coalesce(repeated, 0) AS repeated,
    NOT regexp_matches(line, '[.!?…。！？:;"”’''»)\\]]' || replace({SPACE}, ']+', ']*') || '$') AS bad_end,
    len(w) < 3 OR len(regexp_extract_all(line, '[|»›>•·/\\\\]')) * 2 >= len(w) AS navigation,
    coalesce(repeated, 0) > 0 AND repeated >= 0.15 * sequences AS boilerplate
  FROM l LEFT JOIN q USING (row_no, line_no) WHERE len(w) > 0
),
d AS (
  SELECT row_no, sum(n)::INT AS n_words, sum(sequences)::INT AS n_sequences, sum(repeated)::INT AS n_repeated, count(*)::INT AS n_lines,
    count(*) FILTER (bad_end)::INT AS n_no_punctuation, count(*) FILTER (navigation)::INT AS n_navigation,
    count(*) FILTER (boilerplate)::INT AS n_boilerplate,
    coalesce(sum(n) FILTER (NOT (bad_end OR navigation OR boilerplate)), 0)::INT AS words_kept,
    string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT (bad_end OR navigation OR boilerplate)) AS kept_text
  FROM v GROUP BY row_no
),
e AS (
  SELECT k.doc_id, coalesce(kept_text, '') AS kept_text, coalesce(n_words, 0) AS n_words, coalesce(n_sequences, 0) AS n_sequences,
    coalesce(n_repeated, 0) AS n_repeated, coalesce(n_lines, 0) AS n_lines, coalesce(n_no_punctuation, 0) AS n_no_punctuation,
    coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(words_kept, 0) AS words_kept
  FROM (SELECT DISTINCT doc_id, row_no FROM l) k LEFT JOIN d USING (row_no)
)
"""

P9_LINES = f"""{_LINES}
SELECT doc_id, n_words, n_sequences, n_repeated, n_lines, n_no_punctuation, n_navigation, n_boilerplate, words_kept,
  CASE WHEN n_sequences > 0 THEN round(n_repeated / n_sequences, 9) ELSE 0.0 END AS repeated_share,
  CASE WHEN n_words > 0 THEN round((n_words - words_kept) / n_words, 9) ELSE 0.0 END AS lost_share,
  n_words > 0 AND (n_words - words_kept) * 2 >= n_words AS rejected
FROM e
"""

P9_CLEANED = f"""{_LINES}
SELECT doc_id, kept_text, words_kept, n_words > 0 AND (n_words - words_kept) * 2 >= n_words AS rejected FROM e
"""

def _folded() -> str:
    """CTEs ``t(k, t)`` to ``u(k, u)``: code points mapped by a table that Unicode's data gives, composed, blanks made one."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    rows = ", ".join(f"({ord(c)}, {quoted(''.join(x for x, _ in to))})" for c, to in fold_rows())
    return f"""m(cp, fold) AS (VALUES {rows}),
x AS (SELECT k, c, i FROM (SELECT k, unnest(s) AS c, generate_subscripts(s, 1) AS i FROM (SELECT k, string_split(t, '') AS s FROM t WHERE t <> ''))),
j AS (SELECT k, string_agg(coalesce(fold, c), '' ORDER BY i) AS j FROM x LEFT JOIN m ON cp = unicode(c) GROUP BY k),
u AS (SELECT k, CASE WHEN t IS NOT NULL THEN trim(regexp_replace(nfc_normalize(coalesce(j, '')), '[\\t-\\r\\x1c-\\x1f ]+', ' ', 'g')) END AS u
  FROM t LEFT JOIN j USING (k))"""


def lookalike_sql() -> dict[str, str]:
    folded = _folded()
    return {
        "p5_unified_chunks": f"WITH t AS (SELECT chunk_id AS k, min(text) AS t FROM chunks GROUP BY 1), {folded} SELECT k AS chunk_id, u AS unified FROM u",
        "p5_unified_quotes": f"WITH t AS (SELECT claim_id AS k, min(quote) AS t FROM verified_claims GROUP BY 1), {folded} SELECT k AS claim_id, u AS unified FROM u",
        "p5_found": f"""WITH c AS ({_ONCE}),
v AS (SELECT DISTINCT claim_id, chunk_id, quote FROM verified_claims WHERE quote IS NOT NULL),
o AS (SELECT claim_id, quote, text FROM v JOIN c USING (chunk_id) WHERE NOT contains(text, quote)),
t AS (SELECT DISTINCT k, t FROM (SELECT md5(quote) AS k, quote AS t FROM o UNION ALL SELECT md5(text), text FROM o)), {folded}
SELECT DISTINCT claim_id FROM o JOIN u q ON q.k = md5(quote) JOIN u z ON z.k = md5(text) WHERE q.u <> '' AND contains(z.u, q.u)""",
    }


SQL = {
    "p1_found": P1_FOUND,
    "p1_covered": "SELECT DISTINCT chunk_id, length(text) AS n_chars, true AS kept FROM chunks WHERE length(text) > 4500",
    "p7_kept": "SELECT doc_id, true AS kept FROM documents WHERE text <> ''",
    "p2_found": P2_FOUND,
    "p2_groups": P2_GROUPS,
    "p3_found": P3_FOUND,
    "p3_traced": P3_TRACED,
    "p4_found": P4_FOUND,
    "p4_ranking": P4_RANKING,
    "p8_found": P8_FOUND,
    "p8_spans": P8_SPANS,
    "p8_removal": P8_REMOVAL,
    "p9_found": P9_FOUND,
    "p9_lines": P9_LINES,
    "p9_cleaned": P9_CLEANED,
}


def sql() -> dict[str, str]:
    return SQL | lookalike_sql()
