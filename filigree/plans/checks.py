"""DuckDB statements that check the catalogue's queries."""

from __future__ import annotations

import difflib
import unicodedata

from filigree.operators.sections import ALIKE, ITEM_PATTERN, PART_PATTERN, slot_rows

ZERO_WIDTH = "chr(8203) || chr(65279)"
SPACE = (
    "'[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"
)


def once(source: str, keys: str, fields: str) -> str:
    """The least row per key, fields compared in order, nulls first."""
    order = ", ".join(f"{f} NULLS FIRST" for f in fields.split())
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys.split())
    names = ", ".join([*keys.split(), *fields.split()])
    return f"SELECT {names} FROM {source} WHERE {known} QUALIFY row_number() OVER (PARTITION BY {', '.join(keys.split())} ORDER BY {order}) = 1"


CHUNKS = once("chunks", "chunk_id", "ticker form filing_date report_date accession_number section_key section_title record_no source_sha256 text")
BLOCKS = once("blocks", "doc ord", "text char_start char_end in_table ticker")
CLAIMS = once("verified_claims", "claim_id", "qid claim_text quote chunk_id source_sha256 char_start char_end section_key")
RETRIEVED = once("retrieved_chunks", "qid chunk_id", "result_rank bm25_rank embed_rank score")


def norm(c: str) -> str:
    return f"trim(regexp_replace(translate({c}, {ZERO_WIDTH}, ''), {SPACE}, ' ', 'g'))"


def canon(c: str) -> str:
    # Curly quotes and long dashes get their plain shape; the two lists correspond place by place.
    old = "'’‘“”—–'"
    return f"""trim(regexp_replace(translate({norm(c)}, {old}, '''''""--'), ' +', ' ', 'g'))"""


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({norm(c)}), '[a-z0-9]+(?:[.\\-][a-z0-9]+)*')"


def strip(c: str) -> str:
    inner = SPACE.strip("'")
    return f"regexp_replace({c}, '^{inner}|{inner}$', '', 'g')"


TF = f"""
c AS ({CHUNKS}),
k AS (SELECT chunk_id, form, {tokens("text")} AS t FROM c WHERE text IS NOT NULL),
tf AS (SELECT chunk_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS term FROM k) GROUP BY 1, 2, 3),
st AS (SELECT (SELECT count(*) FROM c) AS n_docs, (SELECT coalesce(sum(len(t)), 0) FROM k) / (SELECT count(*) FROM c) AS avg_len),
idf AS (SELECT term, count(*) AS df, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, st GROUP BY term)
"""
BM25 = f"""{TF},
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({tokens("text")}) AS term FROM eval_items) GROUP BY 1, 2),
bm AS (
  SELECT item_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term), st GROUP BY 1, 2
)
"""
SLOTS = "list_distinct(list_transform({t}, lambda x: (('0x' || substr(sha256(x), 1, 8))::UBIGINT % 512)))"
HASHED = f"""
hs AS (SELECT chunk_id, form, CASE WHEN len(t) = 0 THEN [0::UBIGINT] ELSE {SLOTS.format(t="t")} END AS s FROM k),
hq AS (
  SELECT item_id, CASE WHEN len(t) = 0 THEN [0::UBIGINT] ELSE {SLOTS.format(t="t")} END AS s
  FROM (SELECT item_id, {tokens("text")} AS t FROM eval_items)
),
ha AS (
  SELECT item_id, chunk_id, form, count(*) / sqrt(any_value(nq) * any_value(nd)) AS score
  FROM (SELECT item_id, len(s) AS nq, unnest(s) AS slot FROM hq) JOIN (SELECT chunk_id, form, len(s) AS nd, unnest(s) AS slot FROM hs) USING (slot)
  GROUP BY 1, 2, 3
)
"""


def best(source: str, n: int, by: str = "score") -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round({by}, 9) DESC, chunk_id) AS rank FROM {source}"
        f" QUALIFY rank <= {n}"
    )


def header(c: str = "c", e: str = "e") -> str:
    return (
        f"coalesce({c}.ticker, '') || ' ' || coalesce(nullif({e}.n, ''), {c}.ticker, '') || ' | ' || coalesce({c}.form, '') || ' filed '"
        f" || coalesce({c}.filing_date, '') || ' period ' || coalesce({c}.report_date, '') || ' | ' || coalesce({c}.section_title, '')"
    )


RICH = f"""
e AS (SELECT ticker, max(entity_name) AS n FROM entities WHERE ticker IS NOT NULL GROUP BY ticker),
rich AS (SELECT c.*, {header()} AS header FROM ({CHUNKS}) c LEFT JOIN e ON c.ticker = e.ticker),
win AS (
  SELECT chunk_id, record_no AS window_map, form, ticker, win_no, header || ' | ' || substr(text, win_no * 600 + 1, 800) AS window_text
  FROM (SELECT *, unnest(range(0, greatest(0, ceil((length(text) - 800) / 600.0))::INT + 1)) AS win_no FROM rich WHERE text IS NOT NULL)
)
"""
# The same as TF, BM25 and HASHED, over enriched texts and windows.
ENRICHED = f"""{RICH},
{TF.replace(f"c AS ({CHUNKS})", "c AS (SELECT * REPLACE (header || ' | ' || text AS text) FROM rich)").strip()},
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({tokens("text")}) AS term FROM eval_items) GROUP BY 1, 2),
bm AS (
  SELECT item_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term), st GROUP BY 1, 2
),
wt AS (SELECT chunk_id, win_no, {tokens("window_text")} AS t FROM win),
hs AS (SELECT chunk_id, win_no, CASE WHEN len(t) = 0 THEN [0::UBIGINT] ELSE {SLOTS.format(t="t")} END AS s FROM wt),
hq AS (
  SELECT item_id, CASE WHEN len(t) = 0 THEN [0::UBIGINT] ELSE {SLOTS.format(t="t")} END AS s
  FROM (SELECT item_id, {tokens("text")} AS t FROM eval_items)
),
hp AS (
  SELECT item_id, chunk_id, win_no, count(*) / sqrt(any_value(nq) * any_value(nd)) AS score
  FROM (SELECT item_id, len(s) AS nq, unnest(s) AS slot FROM hq)
  JOIN (SELECT chunk_id, win_no, len(s) AS nd, unnest(s) AS slot FROM hs) USING (slot) GROUP BY 1, 2, 3
),
ha AS (
  SELECT item_id, c.chunk_id, coalesce(max(hp.score), 0) AS score
  FROM (SELECT DISTINCT item_id FROM eval_items) i CROSS JOIN (SELECT DISTINCT chunk_id FROM win) c LEFT JOIN hp USING (item_id, chunk_id) GROUP BY 1, 2
)
"""


def lists(keep: str = "true", questions: str = "eval_items") -> str:
    """CTEs ``b50`` and ``h50``: both methods' fifty best of each question."""
    return f"""{ENRICHED.replace("FROM eval_items", f"FROM {questions}")},
b50 AS ({best(f"(SELECT bm.* FROM bm JOIN c USING (chunk_id) WHERE {keep})", 50)}),
h50 AS ({best(f"(SELECT ha.* FROM ha JOIN c USING (chunk_id) WHERE {keep})", 50)}),
f AS (
  SELECT item_id, chunk_id, coalesce(1.0 / (5 + b50.rank), 0) + coalesce(1.0 / (5 + h50.rank), 0) AS fused, b50.rank AS bm25_rank,
    b50.score AS bm25_score, h50.rank AS embed_rank, h50.score AS embed_score
  FROM b50 FULL JOIN h50 USING (item_id, chunk_id)
)"""


def hybrid(by: str, keep: str = "true") -> str:
    return f"""WITH {lists(keep)},
g AS (SELECT *, {by} AS score FROM f WHERE {by} IS NOT NULL)
SELECT item_id, chunk_id, rank, round(score, 6) AS score, bm25_rank, round(bm25_score, 6) AS bm25_score, embed_rank,
  round(embed_score, 6) AS embed_score
FROM ({best("g", 8)})"""


def scoped(questions: str) -> str:
    """CTEs ``alias`` and ``sc(item_id, ticker)``: the one company that a question names."""
    return f"""
names AS (SELECT ticker, coalesce(nullif(max(entity_name), ''), ticker) AS name FROM entities WHERE ticker IS NOT NULL GROUP BY ticker),
nw AS (SELECT ticker, regexp_extract_all(lower(name), '[a-z0-9]+') AS w FROM names),
ns AS (
  SELECT ticker, array_to_string(list_filter(w, lambda x: x NOT IN ('inc', 'corp', 'corporation', 'ltd', 'llc', 'co', 'usa', 'plc', 'sa')), ' ') AS short,
    array_to_string(w, ' ') AS whole FROM nw
),
alias AS (
  SELECT alias, coalesce(max(ticker) FILTER (strong), min(ticker)) AS ticker FROM (
    SELECT ticker, lower(ticker) AS alias, true AS strong FROM ns UNION ALL SELECT ticker, short, true FROM ns
    UNION ALL SELECT ticker, whole, false FROM ns WHERE short <> '') WHERE alias <> '' GROUP BY alias
),
sq AS (SELECT DISTINCT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS s FROM {questions}),
sc AS (
  SELECT item_id, CASE WHEN count(DISTINCT alias.ticker) = 1 THEN min(alias.ticker) END AS ticker
  FROM sq LEFT JOIN alias ON contains(s, ' ' || alias || ' ') GROUP BY item_id
)"""


def answered(questions: str) -> str:
    """CTE ``ans``: what each question retrieves within its company, and what the first-sentence drafter makes of it."""
    inner = "(SELECT x.* FROM {} x JOIN c USING (chunk_id) JOIN sc USING (item_id) WHERE sc.ticker IS NULL OR upper(c.ticker) = sc.ticker)"
    return f"""{scoped(questions)}, {ENRICHED.replace("FROM eval_items", f"FROM {questions}")},
b50 AS ({best(inner.format("bm"), 50)}),
h50 AS ({best(inner.format("ha"), 50)}),
f AS (
  SELECT item_id, chunk_id, coalesce(1.0 / (5 + b50.rank), 0) + coalesce(1.0 / (5 + h50.rank), 0) AS score
  FROM b50 FULL JOIN h50 USING (item_id, chunk_id)
),
got AS ({best("f", 8)}),
cl AS (
  SELECT item_id, rank, chunk_id, accession_number, section_key,
    coalesce(nullif(regexp_extract(rich.text, '(?s)^(.{{1,400}}?[.!?])(?:\\s|$)', 1), ''), CASE WHEN length(rich.text) <= 400 THEN rich.text END, '') AS quote
  FROM got JOIN rich USING (chunk_id)
),
cv AS (SELECT *, length({strip("quote")}) >= 15 AND rank <= 3 AS good FROM cl),
ca AS (
  SELECT item_id, count(*) FILTER (good) AS n_verified, count(*) FILTER (rank <= 3 AND NOT good) AS dropped_claims,
    string_agg(chunk_id, ' ' ORDER BY rank) AS retrieved,
    coalesce(string_agg(concat_ws('|', chunk_id, accession_number, section_key, quote), '||' ORDER BY quote, chunk_id) FILTER (good), '') AS said
  FROM cv GROUP BY item_id
),
ans AS (
  SELECT item_id, ticker, coalesce(n_verified, 0) > 0 AS answered, retrieved, said, coalesce(n_verified, 0) AS n_verified,
    coalesce(dropped_claims, 0) AS dropped_claims,
    CASE WHEN retrieved IS NULL THEN 'retrieval_empty' WHEN n_verified = 0 THEN 'all_claims_unverified' END AS refusal_reason
  FROM sc LEFT JOIN ca USING (item_id)
)"""


# What the tables' headings say after their number; which titles it resembles is the matching-blocks ratio's to say.
TRAILING = (
    "Management Discussion and Analysis", "Risk Factors", "Financial Statements", "Exhibits", "Legal Proceedings", "Market Risk Disclosures", "Business",
    "Cybersecurity", "Controls and Procedures", "Unresolved Staff Comments", "usiness",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SLOT_VALUES = ", ".join(
    f"({quoted(form)}, {quoted(token)}, {seq}, {quoted(key)}, {quoted(title)}, {is_part})" for form, token, seq, key, title, is_part in slot_rows()
)
ALIKE_VALUES = ", ".join(
    f"({quoted(t)}, {quoted(title)})"
    for t in TRAILING
    for title in sorted({r[4] for r in slot_rows()})
    if difflib.SequenceMatcher(None, t.casefold(), title.casefold()).ratio() >= ALIKE
)
_ITEM, _PART = quoted(ITEM_PATTERN), quoted(PART_PATTERN)


def headings(blocks: str = "b") -> str:
    """CTEs up to ``hd(doc, ord, key, title, is_part)``, the heaviest chain of each document of ``blocks(doc, ord, text, in_table, form)``."""
    return f"""
slot(form, token, seq, key, title, is_part) AS (VALUES {SLOT_VALUES}),
alike(said, title) AS (VALUES {ALIKE_VALUES}),
mk AS (
  SELECT doc, ord, form, regexp_matches(text, {_ITEM}) AS is_item, regexp_extract(text, {_ITEM}, 3) AS said,
    CASE WHEN regexp_matches(text, {_ITEM}) THEN 'ITEM' || regexp_extract(text, {_ITEM}, 1) || upper(regexp_extract(text, {_ITEM}, 2))
      WHEN regexp_matches(text, {_PART}) THEN 'PART' || upper(regexp_extract(text, {_PART}, 1)) END AS token
  FROM {blocks} WHERE NOT coalesce(in_table, false)
),
cd AS (
  SELECT doc, ord, seq, key, slot.title, is_part,
    CASE WHEN is_part THEN 1.5 WHEN is_item AND alike.title IS NOT NULL THEN 1.5 ELSE 1.0 END AS weight,
    row_number() OVER (PARTITION BY doc ORDER BY ord, seq) AS i
  FROM mk JOIN slot USING (form, token) LEFT JOIN alike ON lower(alike.said) = lower(mk.said) AND alike.title = slot.title
  WHERE NOT is_item OR length(mk.said) <= 120
),
ls AS (SELECT doc, list(ord ORDER BY i) AS o, list(seq ORDER BY i) AS q, list(weight ORDER BY i) AS w FROM cd GROUP BY doc),
dp AS (
  SELECT doc, 0 AS n, []::DOUBLE[] AS best, []::INT[] AS back FROM ls
  UNION ALL
  SELECT doc, n + 1, list_append(best, w[n + 1] + coalesce(list_max(list_transform(js, lambda j: best[j])), 0)),
    list_append(back, coalesce(list_filter(js, lambda j: best[j] = list_max(list_transform(js, lambda k: best[k])))[1], 0)::INT)
  FROM (
    SELECT dp.*, o, q, w, list_filter(range(1, n + 1), lambda j: o[j] < o[n + 1] AND q[j] < q[n + 1]) AS js
    FROM dp JOIN ls USING (doc) WHERE n < len(o)
  )
),
done AS (SELECT doc, best, back FROM dp JOIN ls USING (doc) WHERE n = len(o)),
tr AS (
  SELECT doc, list_position(best, list_max(best))::INT AS i, back FROM done
  UNION ALL SELECT doc, back[i], back FROM tr WHERE back[i] > 0
),
hd AS (SELECT cd.doc, ord, key, title, is_part FROM cd JOIN tr ON tr.doc = cd.doc AND tr.i = cd.i)
"""


FORMS = "SELECT accession_number AS doc, min(form) AS form FROM filings GROUP BY 1"
LABELLED = f"""
b AS (SELECT x.*, form FROM ({BLOCKS}) x LEFT JOIN ({FORMS}) USING (doc)),
{headings()},
l AS (
  SELECT b.*, coalesce(last_value(hd.key IGNORE NULLS) OVER u, 'preamble') AS section_key,
    coalesce(last_value(hd.title IGNORE NULLS) OVER u, 'Preamble') AS section_title
  FROM b LEFT JOIN hd ON hd.doc = b.doc AND hd.ord = b.ord WINDOW u AS (PARTITION BY b.doc ORDER BY b.ord ROWS UNBOUNDED PRECEDING)
)
"""
# Chunks of the labelled blocks ``l``.
PACKED = """
p AS (SELECT *, length(text) AS n, row_number() OVER (PARTITION BY doc ORDER BY ord) AS i FROM l WHERE NOT in_table AND text IS NOT NULL),
w AS (
  SELECT doc, i, section_key, n AS held, 0 AS chunk_order FROM p WHERE i = 1
  UNION ALL
  SELECT p.doc, p.i, p.section_key, CASE WHEN p.section_key <> w.section_key OR w.held + 2 + p.n > 3000 THEN p.n ELSE w.held + 2 + p.n END,
    w.chunk_order + CASE WHEN p.section_key <> w.section_key OR w.held + 2 + p.n > 3000 THEN 1 ELSE 0 END
  FROM w JOIN p ON p.doc = w.doc AND p.i = w.i + 1
)
"""
# The filings' own documents: blocks as a reader sees them.
PARSED = f"""
f AS ({once("filings", "accession_number", "ticker cik form filing_date report_date stored_filename size_bytes")}),
s AS (
  SELECT accession_number AS doc, form, ticker, CASE WHEN size_bytes IS NULL THEN 'bytes_changed'
    WHEN coalesce(form, '') NOT IN ('10-K', '10-Q') THEN 'unsupported_form' ELSE 'ok' END AS status
  FROM f WHERE accession_number IN (SELECT doc FROM ({BLOCKS}))
),
b AS (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord) - 1 AS ord, text, in_table, form
  FROM (SELECT doc, ord, {norm("text")} AS text, in_table, form FROM ({BLOCKS}) JOIN s USING (doc) WHERE status = 'ok') WHERE text <> ''
),
{headings()},
l AS (
  SELECT b.*, coalesce(last_value(hd.key IGNORE NULLS) OVER u, 'preamble') AS section_key,
    coalesce(last_value(hd.title IGNORE NULLS) OVER u, 'Preamble') AS section_title
  FROM b LEFT JOIN hd ON hd.doc = b.doc AND hd.ord = b.ord WINDOW u AS (PARTITION BY b.doc ORDER BY b.ord ROWS UNBOUNDED PRECEDING)
),
{PACKED.strip()},
ch AS (
  SELECT doc, chunk_order, arg_min(p.section_key, p.i) AS section_key, arg_min(section_title, p.i) AS section_title, count(*) AS n_blocks,
    count(*) = 1 AND max(p.n) > 4500 AS oversized, md5(string_agg(text, chr(10) || chr(10) ORDER BY p.i)) AS digest
  FROM w JOIN p USING (doc, i) GROUP BY doc, chunk_order
)
"""
VERDICT = f"""
c AS ({CHUNKS}), v AS ({CLAIMS}), r AS ({RETRIEVED}),
t AS (
  SELECT v.*, c.text AS t, c.chunk_id IS NOT NULL AS known, r.chunk_id IS NOT NULL AS fetched
  FROM v LEFT JOIN c ON v.chunk_id = c.chunk_id LEFT JOIN r ON v.qid = r.qid AND v.chunk_id = r.chunk_id
)
"""


def verdict(known: str) -> str:
    return f"""CASE WHEN NOT ({known}) THEN 'unknown_chunk' WHEN coalesce(length({strip("quote")}), 0) < 15 THEN 'quote_too_short'
  WHEN NOT coalesce(contains({canon("t")}, {canon("quote")}), false) THEN 'quote_not_found' ELSE 'verified' END"""


# Compatibility forms and what they stand for, by Unicode's own data; canonical forms are nfc_normalize's to compose.
NFKC_VALUES = ", ".join(
    f"({cp}, {quoted(unicodedata.normalize('NFKD', chr(cp)))})"
    for cp in range(0xA0, 0x30000)
    if not 0xD800 <= cp <= 0xDFFF and unicodedata.normalize("NFKD", chr(cp)) != unicodedata.normalize("NFD", chr(cp))
)
AUDIT = f"""WITH c AS ({CHUNKS}), v AS ({CLAIMS}), r AS ({RETRIEVED}),
m(cp, fold) AS (VALUES {NFKC_VALUES}),
raw AS (
  SELECT 'q' || claim_id AS k, quote AS t FROM v WHERE quote IS NOT NULL
  UNION ALL SELECT 't' || chunk_id, text FROM c WHERE text IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM v)
),
x AS (SELECT k, unnest(s) AS ch, generate_subscripts(s, 1) AS i FROM (SELECT k, string_split(t, '') AS s FROM raw WHERE t <> '')),
n AS (SELECT k, nfc_normalize(string_agg(coalesce(fold, ch), '' ORDER BY i)) AS t FROM x LEFT JOIN m ON cp = unicode(ch) GROUP BY k),
u AS (
  SELECT raw.k, trim(regexp_replace(translate(coalesce(n.t, ''), '’‘“”—–', {quoted("''" + chr(34) * 2 + "--")}), {SPACE}, ' ', 'g')) AS u
  FROM raw LEFT JOIN n USING (k)
),
a AS (
  SELECT claim_id, c.chunk_id IS NOT NULL AS chunk_known, r.chunk_id IS NOT NULL AS was_retrieved,
    coalesce(v.source_sha256 = c.source_sha256, false) AS sha_matches, coalesce(char_start >= 0 AND char_end > char_start, false) AS offsets_sane,
    coalesce(length({strip("quote")}) >= 15, false) AS long_enough, coalesce(contains(t.u, q.u), false) AS verbatim
  FROM v LEFT JOIN c ON c.chunk_id = v.chunk_id LEFT JOIN r ON r.qid = v.qid AND r.chunk_id = v.chunk_id
  LEFT JOIN u q ON q.k = 'q' || claim_id LEFT JOIN u t ON t.k = 't' || v.chunk_id
)
SELECT *, chunk_known AND was_retrieved AND sha_matches AND offsets_sane AND long_enough AND verbatim AS ok FROM a"""


HITS = f"""
r AS ({RETRIEVED}), v AS ({CLAIMS}),
a AS (SELECT DISTINCT qid, chunk_id FROM v WHERE qid IS NOT NULL AND chunk_id IS NOT NULL),
m AS (
  SELECT 'fused' AS method, qid, chunk_id, result_rank AS rank FROM r UNION ALL SELECT 'bm25', qid, chunk_id, bm25_rank FROM r
  UNION ALL SELECT 'embed', qid, chunk_id, embed_rank FROM r
),
h AS (
  SELECT method, qid, (SELECT min(rank) FROM m JOIN a USING (qid, chunk_id) WHERE m.method = x.method AND m.qid = y.qid) AS hit_rank
  FROM (SELECT DISTINCT method FROM m WHERE rank IS NOT NULL) x, (SELECT DISTINCT qid FROM a) y
),
g AS (
  SELECT method, count(*) AS n_questions, avg(coalesce((hit_rank <= 5)::INT, 0)) AS recall_at_5,
    avg(coalesce((hit_rank <= 10)::INT, 0)) AS recall_at_10, avg(CASE WHEN hit_rank <= 10 THEN 1.0 / hit_rank ELSE 0 END) AS mrr
  FROM h GROUP BY method
)
"""

CROWDED = f"""c AS ({CHUNKS}), r AS ({RETRIEVED}),
w AS (SELECT window_id, min(window_map) AS record_no, any_value(embedding)::DOUBLE[96] AS e FROM index_windows
  WHERE embedding IS NOT NULL AND (list_max(embedding) > 0 OR list_min(embedding) < 0) GROUP BY 1),
d AS (SELECT chunk_id, e FROM w JOIN c USING (record_no)),
p AS (
  SELECT a.qid, a.chunk_id AS doc_a, b.chunk_id AS doc_b FROM r a JOIN r b ON a.qid = b.qid AND a.result_rank < b.result_rank
  WHERE a.result_rank <= 5 AND b.result_rank <= 5
),
z AS (
  SELECT qid, doc_a, doc_b, max(array_cosine_similarity(x.e, y.e)) AS similarity
  FROM p JOIN d x ON x.chunk_id = doc_a JOIN d y ON y.chunk_id = doc_b GROUP BY 1, 2, 3
)"""

SQL = {
    "normalized_blocks": f"WITH b AS ({BLOCKS}) SELECT doc, ord, {norm('text')} AS norm, {canon('text')} AS canonical FROM b",
    # The cut-off bytes read as Latin-1: each byte of the UTF-8 form is a character.
    "decoded_bytes": f"""WITH b AS ({BLOCKS}),
h AS (SELECT doc, ord, text, hex(encode(text)) || 'E9' AS h FROM b),
l AS (
  SELECT doc, ord, string_agg(chr(('0x' || substr(h, 2 * i - 1, 2))::INT), '' ORDER BY i) AS t
  FROM (SELECT doc, ord, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM h WHERE text IS NOT NULL) GROUP BY doc, ord
)
SELECT doc, ord, false AS cut_off, text, CASE WHEN text IS NOT NULL THEN 'utf-8' END AS encoding, sha256(text) AS sha256 FROM b
UNION ALL SELECT doc, ord, true, t, CASE WHEN t IS NOT NULL THEN 'latin-1' END, CASE WHEN t IS NOT NULL THEN sha256(unhex(h)) END
FROM h LEFT JOIN l USING (doc, ord)""",
    "filing_paths": """
SELECT DISTINCT accession_number, lpad(cik::BIGINT::VARCHAR, 10, '0') AS cik10,
  'https://data.sec.gov/submissions/CIK' || lpad(cik::BIGINT::VARCHAR, 10, '0') || '.json' AS history_url,
  concat_ws('/', 'https://www.sec.gov/Archives/edgar/data', cik::BIGINT::VARCHAR, replace(accession_number, '-', ''), primary_document)
    AS archive_url,
  CASE WHEN size_bytes >= 1000000 THEN format('{:.1f} MB', size_bytes / 1000000) WHEN size_bytes >= 1000 THEN format('{:.1f} KB', size_bytes / 1000)
    WHEN size_bytes IS NOT NULL THEN size_bytes || ' B' END AS human_size
FROM filings""",
    "windows_split": f"""WITH c AS ({CHUNKS}),
n AS (SELECT chunk_id, text, unnest(range(0, greatest(0, ceil((length(text) - 800) / 600.0))::INT + 1)) AS win_no FROM c WHERE text IS NOT NULL)
SELECT chunk_id, win_no, substr(text, win_no * 600 + 1, 800) AS window_text FROM n""",
    "enriched_headers": f"""WITH {RICH} SELECT chunk_id, header, length(header || ' | ' || text) AS n_chars FROM rich""",
    "normalized_vectors": """
WITH v AS (
  SELECT window_id, any_value(embedding)::DOUBLE[] AS e FROM index_windows WHERE window_id IS NOT NULL AND embedding IS NOT NULL GROUP BY window_id
),
x AS (SELECT window_id, unnest(e) / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12) AS x FROM v)
SELECT window_id, round(sum(x * x), 4) AS norm2, round(max(x::FLOAT)::DOUBLE, 5) AS largest FROM x GROUP BY window_id""",
    "term_freq": f"WITH {TF} SELECT chunk_id, term, tf, dl FROM tf",
    "doc_freq_idf": f"WITH {TF} SELECT term, df, round(idf, 9) AS idf FROM idf",
    "corpus_stats": f"WITH {TF} SELECT n_docs, round(avg_len, 6) AS avg_len FROM st",
    "bm25_topk": f"WITH {BM25} SELECT item_id, chunk_id, rank, round(score, 6) AS score FROM ({best('bm', 10)})",
    "bm25_topk_filtered": f"""WITH {BM25}
SELECT item_id, chunk_id, rank, round(score, 6) AS score FROM ({best("(SELECT bm.* FROM bm JOIN c USING (chunk_id) WHERE upper(form) = '10-K')", 10)})""",
    "window_maxpool": """
WITH v AS (
  SELECT window_id, min(window_map) AS record_no, any_value(embedding)::DOUBLE[96] AS e FROM index_windows
  WHERE embedding IS NOT NULL AND (list_max(embedding) > 0 OR list_min(embedding) < 0) GROUP BY window_id
),
s AS (
  SELECT a.window_id, b.record_no, max(array_cosine_similarity(a.e, b.e)) AS score
  FROM v a JOIN v b ON a.window_id <> b.window_id WHERE a.window_id % 20 = 0 GROUP BY 1, 2
)
SELECT window_id, record_no, row_number() OVER (PARTITION BY window_id ORDER BY round(score, 9) DESC, record_no) AS rank,
  round(score, 6) AS score
FROM s QUALIFY rank <= 5""",
    "hash_cosine_topk": f"WITH {TF}, {HASHED} SELECT item_id, chunk_id, rank, round(score, 6) AS score FROM ({best('ha', 10)})",
    "hybrid_topk": hybrid("fused"),
    "index_search": hybrid("fused"),
    "index_windows_cut": f"""WITH {RICH} SELECT chunk_id, window_map, win_no, md5(window_text) AS digest, length(window_text) AS n_chars FROM win""",
    "hashed_vectors": f"""WITH {TF}, {HASHED},
v AS (SELECT chunk_id, len(s) AS n, list_transform(range(0, 512), lambda i: CASE WHEN list_contains(s, i::UBIGINT) THEN '1' ELSE '0' END) AS v FROM hs)
SELECT chunk_id, n AS n_slots, round((1 / sqrt(n))::FLOAT::DOUBLE, 6) AS value, md5(array_to_string(v, '')) AS digest FROM v""",
    "hybrid_topk_scoped": hybrid("bm25_score", "upper(form) = '10-Q'"),
    "section_ffill": f"WITH RECURSIVE {LABELLED} SELECT doc, ord, section_key FROM l",
    "heading_chains": f"""WITH RECURSIVE b AS (SELECT x.*, form FROM ({BLOCKS}) x JOIN ({FORMS}) USING (doc)), {headings()}
SELECT doc, ord, key, is_part FROM hd""",
    "packed_chunks": f"""WITH RECURSIVE {LABELLED}, {PACKED.strip()}
SELECT doc, chunk_order, min(p.section_key) AS section_key, count(*) AS n_blocks, arg_min(p.char_start, p.i) AS char_start,
  arg_max(p.char_end, p.i) AS char_end, count(*) = 1 AND max(p.n) > 4500 AS oversized, sum(p.n) + 2 * (count(*) - 1) AS n_chars
FROM w JOIN p USING (doc, i) GROUP BY doc, chunk_order""",
    "parsed_chunks": f"""WITH RECURSIVE {PARSED}
SELECT replace(doc, '-', '') || '-' || lpad(chunk_order::VARCHAR, 5, '0') AS chunk_id, ticker, form, 'utf-8' AS encoding, section_key, section_title,
  chunk_order, n_blocks, oversized, digest FROM ch JOIN s USING (doc)""",
    "parse_manifest": f"""WITH RECURSIVE {PARSED},
x AS (
  SELECT doc, count(*) AS blocks, count(*) FILTER (NOT in_table) AS prose_blocks, count(*) FILTER (in_table) AS table_blocks,
    coalesce(sum(length(text)) FILTER (NOT in_table), 0) AS prose_chars FROM b GROUP BY doc
),
y AS (SELECT doc, count(*) AS chunks, count(*) FILTER (oversized) AS oversized_chunks FROM ch GROUP BY doc),
z AS (SELECT doc, count(*) FILTER (NOT is_part) AS sections_detected FROM hd GROUP BY doc)
SELECT doc AS accession_number, form, 'utf-8' AS encoding, coalesce(blocks, 0) AS blocks, coalesce(prose_blocks, 0) AS prose_blocks,
  coalesce(table_blocks, 0) AS table_blocks, coalesce(prose_chars, 0) AS prose_chars, coalesce(blocks, 0) AS blocks_passed, coalesce(chunks, 0) AS chunks,
  coalesce(oversized_chunks, 0) AS oversized_chunks, coalesce(chunks, 0) AS chunks_passed, coalesce(sections_detected, 0) AS sections_detected, status
FROM s LEFT JOIN x USING (doc) LEFT JOIN y USING (doc) LEFT JOIN z USING (doc)""",
    "html_roundtrip": f"""WITH b AS ({BLOCKS}), x AS (SELECT doc, ord, in_table, {norm("text")} AS text FROM b)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord) - 1 AS n, text, in_table, true AS verified FROM x WHERE text <> ''""",
    "block_stats": f"""WITH b AS ({BLOCKS})
SELECT doc, count(*) AS blocks, count(*) FILTER (NOT in_table) AS prose_blocks, sum(CASE WHEN in_table THEN 0 ELSE length(text) END) AS prose_chars
FROM b GROUP BY doc""",
    "latest_filings": """
SELECT upper(ticker) AS company, form, accession_number, filing_date FROM filings WHERE form IN ('10-K', '10-Q')
QUALIFY row_number() OVER (PARTITION BY upper(ticker), form ORDER BY filing_date DESC NULLS LAST, accession_number) = 1""",
    "missing_forms": """
SELECT company, form FROM (SELECT DISTINCT upper(ticker) AS company FROM filings), (VALUES ('10-K'), ('10-Q')) AS w(form)
WHERE NOT EXISTS (SELECT 1 FROM filings f WHERE upper(f.ticker) = company AND f.form = w.form)""",
    "stale_sources": f"""WITH c AS ({CHUNKS}), r AS (SELECT DISTINCT accession_number AS path, source_sha256 AS was FROM c),
n AS (SELECT DISTINCT accession_number AS path, sha256 AS now FROM filings)
SELECT path, CASE WHEN now IS NULL THEN 'missing' WHEN was IS NULL THEN 'new' ELSE 'changed' END AS problem
FROM r FULL JOIN n USING (path) WHERE was IS DISTINCT FROM now""",
    "repeated_deliveries": "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY chunk_id HAVING count(*) > 1",
    "scoped_questions": f"WITH {scoped('eval_items')} SELECT item_id, ticker FROM sc",
    "answers": f"""WITH {answered("eval_items")}
SELECT item_id AS qid, ticker, answered, refusal_reason, n_verified, dropped_claims, retrieved, md5(said) AS claims FROM ans""",
    "company_answers": f"""WITH cq AS (SELECT ticker AS item_id, 'What are the risks of ' || ticker || '?' AS text FROM entities WHERE ticker IS NOT NULL),
{answered("cq")} SELECT item_id AS qid, ticker, answered, refusal_reason, retrieved FROM ans""",
    "gold_evaluation": f"""WITH v AS ({CLAIMS}),
gq AS (SELECT claim_id AS item_id, claim_text AS text, chunk_id AS wanted FROM v WHERE claim_text IS NOT NULL AND chunk_id IS NOT NULL),
{lists("true", "gq")},
m AS (
  SELECT 'bm25' AS method, item_id, chunk_id, bm25_rank AS rank FROM f WHERE bm25_rank <= 10
  UNION ALL SELECT 'embed', item_id, chunk_id, embed_rank FROM f WHERE embed_rank <= 10
  UNION ALL SELECT 'fused', item_id, chunk_id, rank FROM ({best("f", 10, "fused")})
),
h AS (
  SELECT x.method, gq.item_id, min(rank) AS r
  FROM gq CROSS JOIN (VALUES ('bm25'), ('embed'), ('fused')) x(method) LEFT JOIN m ON m.method = x.method AND m.item_id = gq.item_id AND m.chunk_id = wanted
  GROUP BY 1, 2
)
SELECT method, count(*) AS n_questions, round(avg(coalesce((r <= 5)::INT, 0)), 9) AS recall_at_5, round(avg(coalesce((r <= 10)::INT, 0)), 9) AS recall_at_10,
  round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END), 9) AS mrr FROM h GROUP BY method""",
    "quote_verdicts": f"WITH {VERDICT} SELECT claim_id, {verdict('known')} AS verdict FROM t",
    "claims_grouped": f"""WITH {VERDICT}, x AS (SELECT qid, {verdict("known AND fetched")} AS verdict FROM t)
SELECT qid, count(*) AS n_claims, count(*) FILTER (verdict = 'verified') AS n_verified, count(*) FILTER (verdict <> 'verified') AS dropped_claims,
  CASE WHEN count(*) FILTER (verdict = 'verified') = 0 THEN 'all_claims_unverified' END AS refusal_reason
FROM x GROUP BY qid""",
    "expected_facts": f"""WITH v AS ({CLAIMS}), h AS (SELECT claim_id, concat_ws(' ', claim_text, quote) AS h FROM v)
SELECT claim_id, regexp_matches(h, '(?i)\\$[0-9.,]+') AND regexp_matches(h, '(?i)(fiscal|quarter) ') AS all_present FROM h""",
    "prompts": f"""WITH c AS ({CHUNKS}), r AS ({RETRIEVED}),
p AS (
  SELECT qid, result_rank, '[' || chunk_id || '] ' || coalesce(ticker, '') || ' ' || coalesce(form, '') || ' filed ' || coalesce(filing_date, '')
    || ' — ' || coalesce(section_title, '') || chr(10) || coalesce(text, '') AS p
  FROM r JOIN c USING (chunk_id) WHERE result_rank <= 8
),
g AS (
  SELECT qid, 'Question: ' || qid || chr(10) || chr(10) || 'Chunks:' || chr(10) || chr(10)
    || string_agg(p, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY result_rank, p) AS prompt FROM p GROUP BY qid
)
SELECT qid, length(prompt) AS n_chars, md5(prompt) AS digest FROM g""",
    "gold_metrics": f"""WITH {HITS} SELECT method, n_questions, round(recall_at_5, 9) AS recall_at_5, round(recall_at_10, 9) AS recall_at_10,
  round(mrr, 9) AS mrr FROM g""",
    "gold_bars": f"""WITH {HITS}, f AS (SELECT * FROM g WHERE method = 'fused')
SELECT 'recall_at_5' AS bar, recall_at_5 >= 0.85 AS passed FROM f UNION ALL SELECT 'recall_at_10', recall_at_10 >= 1.0 FROM f
UNION ALL SELECT 'fused_not_worse', recall_at_5 >= (SELECT max(recall_at_5) FROM g) FROM f""",
    "rescue_counts": f"""WITH {HITS},
x AS (SELECT qid, coalesce(max(CASE WHEN method = 'fused' THEN hit_rank <= 5 END), false) AS f,
  coalesce(max(CASE WHEN method = 'bm25' THEN hit_rank <= 5 END), false) AS b,
  coalesce(max(CASE WHEN method = 'embed' THEN hit_rank <= 5 END), false) AS e FROM h GROUP BY qid)
SELECT count(*) FILTER (f AND NOT e) AS rescued_by_bm25, count(*) FILTER (f AND NOT b) AS rescued_by_embed FROM x""",
    "crowded_results": f"""WITH {CROWDED} SELECT qid, doc_a, doc_b, round(similarity, 4) AS similarity FROM z WHERE similarity >= 0.5""",
    "crowding_count": f"""WITH {CROWDED}
SELECT (SELECT count(DISTINCT qid) FROM r) AS n_questions, count(DISTINCT qid) AS n_crowded FROM z WHERE similarity >= 0.97""",
    "gold_decoy_medians": f"""WITH r AS ({RETRIEVED}), v AS ({CLAIMS}),
b AS (SELECT qid, coalesce(max(CASE WHEN NOT isnan(score) THEN score END), 0) AS s FROM r GROUP BY qid)
SELECT CASE WHEN qid IN (SELECT qid FROM v WHERE qid IS NOT NULL AND chunk_id IS NOT NULL) THEN 'gold' ELSE 'decoy' END AS kind,
  count(*) AS n_questions, round(median(s), 6) AS median_score FROM b GROUP BY 1""",
    "citation_audit": AUDIT,
    "scope_check": f"""WITH c AS ({CHUNKS}), r AS ({RETRIEVED})
SELECT r.qid AS case_id, count(c.chunk_id) AS n_hits,
  coalesce(count(c.chunk_id) > 0 AND count(*) FILTER (c.chunk_id IS NOT NULL AND coalesce(upper(c.form) <> '10-K', true)) = 0, false) AS in_scope
FROM r LEFT JOIN c ON r.chunk_id = c.chunk_id GROUP BY r.qid""",
    "paraphrase_agreement": f"""WITH {VERDICT}, x AS (SELECT qid, {verdict("known")} <> 'verified' AS refused FROM t)
SELECT qid AS case_id, count(DISTINCT refused) <= 1 AS agree, NOT bool_or(refused) AS all_answered FROM x GROUP BY qid""",
    "case_results": f"""WITH {VERDICT}, x AS (SELECT qid, coalesce(lower(section_key), 'none') AS type, {verdict("known")} = 'verified' AS ok FROM t),
y AS (SELECT qid, type, bool_and(ok) AS passed FROM x GROUP BY 1, 2)
SELECT type, count(*) AS n_cases, count(*) FILTER (passed) AS n_passed FROM y GROUP BY type""",
    "upper_medians": """
WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n
  FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN i = n // 2 + 1 THEN value END) AS upper_median, max(value) AS largest FROM v GROUP BY event_type""",
}
