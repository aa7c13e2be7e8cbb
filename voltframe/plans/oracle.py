"""DuckDB SQL for every registered query (the correctness oracle).

Each statement re-derives its answer from the raw test tables with plain SQL: range joins
where the Spark side explodes days, ``lag`` where the Spark side joins ordinals, cross
joins where it multiplies matrices. Both sides share the fixed values and patterns.
"""

from __future__ import annotations

from voltframe.constants import (
    CHUNK_TOKENS,
    CITATION_ALIASES,
    CITATION_PATTERN,
    CONTEXT_SEPARATOR,
    DEFAULT_K,
    HASH_DIM,
    INTERCHANGE_CONVENTION,
    LINE_BREAK,
    NAME_TO_CODE,
    NOTE_NO_DATA,
    NOTE_NO_DATA_RETURNED,
    OVERLAP_TOKENS,
    POSITION_BALANCED,
    POSITION_EXPORTER,
    POSITION_IMPORTER,
    PROMPT_TEMPLATE,
    REFUSAL,
    REGION_CODES,
    REGION_NAMES,
    SERIES_LABELS,
    VALUE_DECIMAL,
    TOKEN_PATTERN_RE2 as TOKEN_PATTERN,
    WS_RE2 as WS,
)
from voltframe.plans import relations as R

STEP = CHUNK_TOKENS - OVERLAP_TOKENS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def case_map(expr: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def pick(codes: list[str], n: str) -> str:
    return f"{lst(codes)}[CAST(({n}) % {len(codes)} AS INTEGER) + 1]"


NAMES = [REGION_NAMES[c] for c in REGION_CODES]
CAP = "upper(substr(event_type, 1, 1)) || substr(event_type, 2)"

GEN = f"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS period,
  {pick(REGION_CODES, 'user_id')} AS respondent,
  {pick(NAMES, 'user_id')} AS respondent_name,
  upper(substr(event_type, 1, 3)) AS fueltype,
  {CAP} AS type_name,
  'megawatthours' AS value_units,
  value,
  event_id,
  CAST(json_extract(props, '$.k') AS INTEGER) AS k
FROM events"""

_TYPE = case_map("event_type", R.EVENT_TYPE_SERIES, "event_type")
REG = f"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS period,
  {pick(REGION_CODES, 'user_id')} AS respondent,
  {pick(NAMES, 'user_id')} AS respondent_name,
  {_TYPE} AS type,
  {case_map(_TYPE, R.SERIES_NAMES, CAP)} AS type_name,
  'megawatthours' AS value_units,
  CASE WHEN ({_TYPE}) = 'TI' THEN value - {R.TI_OFFSET} ELSE value END AS value
FROM events"""

_RAW_REGION = pick(R.REQUEST_REGIONS, "c_nationkey")
REQ = f"""SELECT CAST(c_custkey AS BIGINT) AS request_id,
  {case_map('c_mktsegment', R.SEGMENT_TOOLS, 'NULL')} AS tool,
  {_RAW_REGION} AS region_raw,
  {case_map(f'upper({_RAW_REGION})', NAME_TO_CODE, f'upper({_RAW_REGION})')} AS region,
  DATE '{R.REQUEST_EPOCH}' + CAST(c_custkey % 28 AS INTEGER) AS start,
  DATE '{R.REQUEST_EPOCH}' + CAST(c_custkey % 28 AS INTEGER) + CAST(c_custkey % 5 AS INTEGER) AS "end"
FROM customer"""

DEC = VALUE_DECIMAL.upper()


def dsum(col: str = "value") -> str:
    return f"COALESCE(sum(CAST({col} AS {DEC})), CAST(0 AS {DEC}))"


def ts_text(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- step 1: facts and checks
SQL["generation_range"] = f"""
WITH g AS ({GEN})
SELECT period, respondent, respondent_name, fueltype, type_name, value_units, value FROM g
WHERE respondent = 'CISO' AND period >= TIMESTAMP '2024-01-03 00:00:00' AND period < TIMESTAMP '2024-01-10 00:00:00'
"""

SQL["region_facets"] = f"""
WITH r AS ({REG})
SELECT * FROM r WHERE type IN ('D', 'NG', 'TI')
"""

SQL["region_valid"] = f"""
WITH q AS ({REQ})
SELECT request_id, region, region IN ({', '.join(q(c) for c in REGION_CODES)}) AS is_valid FROM q
"""

SQL["date_range_valid"] = f"""
SELECT o_orderkey AS invocation_id, {pick(REGION_CODES, 'o_custkey')} AS region,
  CAST(o_orderdate AS DATE) AS start,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 11 - 3 AS INTEGER) AS "end",
  (CAST(o_orderdate AS DATE) + CAST(o_orderkey % 11 - 3 AS INTEGER)) >= CAST(o_orderdate AS DATE) AS is_valid
FROM orders
"""

# ---------------------------------------------------------------- step 2: summaries
_MIX = f"""m AS (SELECT respondent, type_name, {dsum()} AS mwh_dec FROM g GROUP BY respondent, type_name),
rk AS (SELECT *, row_number() OVER (PARTITION BY respondent ORDER BY mwh_dec DESC, type_name) AS fuel_rank,
              CAST(sum(mwh_dec) OVER (PARTITION BY respondent) AS DOUBLE) AS total_mwh FROM m)"""

SQL["fuel_mix"] = f"""
WITH g AS ({GEN}), {_MIX}
SELECT respondent, type_name, CAST(mwh_dec AS DOUBLE) AS mwh, fuel_rank FROM rk
"""

SQL["fuel_share"] = f"""
WITH g AS ({GEN}), {_MIX}
SELECT respondent, type_name, CAST(mwh_dec AS DOUBLE) AS mwh, fuel_rank,
  CASE WHEN total_mwh <> 0 THEN CAST(mwh_dec AS DOUBLE) / total_mwh * 100.0 ELSE 0.0 END AS share_pct
FROM rk
"""

SQL["range_summary"] = f"""
WITH g AS ({GEN})
SELECT respondent, count(*) AS rows, {ts_text('min(period)')} AS period_start, {ts_text('max(period)')} AS period_end
FROM g GROUP BY respondent
"""

SQL["interchange_totals"] = f"""
WITH r AS ({REG})
SELECT respondent, type, {case_map('type', SERIES_LABELS, 'type')} AS series,
  CAST(round({dsum()}, 1) AS DOUBLE) AS total_mwh
FROM r GROUP BY respondent, type
"""


def _wide(code: str) -> str:
    return (f"CAST(round(CASE WHEN max(CASE WHEN type = '{code}' THEN 1 END) = 1 THEN "
            f"{dsum(f'CASE WHEN type = {q(code)} THEN value END')} END, 1) AS DOUBLE)")


SQL["net_position"] = f"""
WITH r AS ({REG}),
w AS (SELECT respondent, {_wide('D')} AS demand_mwh, {_wide('NG')} AS net_generation_mwh,
             {_wide('TI')} AS total_interchange_mwh FROM r GROUP BY respondent)
SELECT *, CASE WHEN total_interchange_mwh > 0 THEN {q(POSITION_EXPORTER)}
               WHEN total_interchange_mwh < 0 THEN {q(POSITION_IMPORTER)}
               WHEN total_interchange_mwh = 0 THEN {q(POSITION_BALANCED)} END AS position
FROM w
"""

SQL["mix_summary"] = f"""
WITH g AS ({GEN}), {_MIX},
s AS (SELECT *, CASE WHEN total_mwh <> 0 THEN CAST(mwh_dec AS DOUBLE) / total_mwh * 100.0 ELSE 0.0 END AS share_pct,
             max(fuel_rank) OVER (PARTITION BY respondent) AS n_fuels FROM rk)
SELECT respondent AS region, type_name AS top_fuel, round(share_pct, 1) AS top_fuel_pct,
  respondent || ': ' || type_name || ' is the largest of ' || CAST(n_fuels AS VARCHAR) || ' fuels at '
    || CAST(round(share_pct, 1) AS VARCHAR) || '% of net generation.' AS summary_text
FROM s WHERE fuel_rank = 1
"""

# ---------------------------------------------------------------- step 3: landed pages
_BAD = {R.K_MONTH_PERIOD: "period: invalid", R.K_NO_RESPONDENT: "respondent: missing",
        R.K_VALUE_WITH_UNIT: "value: not a finite number"}

SQL["page_parse"] = f"""
WITH g AS ({GEN})
SELECT period, respondent, respondent_name, fueltype, type_name, value_units,
  CASE WHEN k = {R.K_NAN_VALUE} THEN NULL ELSE value END AS value
FROM g WHERE k NOT IN ({', '.join(str(x) for x in _BAD)})
"""

SQL["page_rejects"] = f"""
WITH g AS ({GEN})
SELECT CASE WHEN k = {R.K_NO_RESPONDENT} THEN NULL ELSE respondent END AS raw_respondent,
  CASE WHEN k = {R.K_MONTH_PERIOD} THEN strftime(period, '%Y-%m') ELSE strftime(period, '%Y-%m-%dT%H') END AS raw_period,
  fueltype AS raw_fueltype,
  CASE WHEN k = {R.K_VALUE_WITH_UNIT} THEN CAST(value AS VARCHAR) || ' MWh' ELSE CAST(value AS VARCHAR) END AS raw_value,
  CASE {' '.join(f'WHEN k = {k} THEN {q(v)}' for k, v in _BAD.items())} END AS reject_reason
FROM g WHERE k IN ({', '.join(str(x) for x in _BAD)})
"""

# Number of a record within its region and of its small page.
SMALL = f"""n AS (SELECT g.*, (row_number() OVER (PARTITION BY respondent ORDER BY period, event_id) - 1) // {R.SMALL_PAGE} AS page FROM g)"""

SQL["page_manifest"] = f"""
WITH g AS ({GEN}), {SMALL},
pg AS (SELECT respondent, page, count(*) AS n_rows FROM n GROUP BY respondent, page),
landed AS (SELECT * FROM pg WHERE respondent <> '{R.LOST_REGION}' AND (page % 4 <> {R.LOST_PAGE} OR page = 0)),
totals AS (SELECT respondent, count(*) AS total FROM g WHERE respondent IN (SELECT respondent FROM landed) GROUP BY respondent),
asked AS (SELECT a.respondent, total FROM (SELECT unnest({lst(R.REQUESTED_REGIONS)}) AS respondent) a LEFT JOIN totals USING (respondent)),
expected AS (SELECT respondent, total, unnest(range(0, greatest(1, coalesce(total, 1)), {R.SMALL_PAGE})) AS page_offset FROM asked)
SELECT e.respondent, CAST(page_offset AS BIGINT) AS page_offset,
  CAST(CASE WHEN total IS NOT NULL THEN least({R.SMALL_PAGE}, total - page_offset) END AS BIGINT) AS expected_rows,
  l.n_rows IS NOT NULL AS landed, CAST(l.n_rows AS BIGINT) AS landed_rows
FROM expected e LEFT JOIN landed l ON l.respondent = e.respondent AND l.page * {R.SMALL_PAGE} = e.page_offset
"""

SQL["page_file_parse"] = f"""
WITH g AS ({GEN}), {SMALL}
SELECT period, respondent, respondent_name, fueltype, type_name, value_units,
  CASE WHEN k = {R.K_NAN_VALUE} THEN NULL ELSE value END AS value
FROM n WHERE k NOT IN ({', '.join(str(x) for x in _BAD)})
  AND page % 5 NOT IN ({R.PAGE_CUT_OFF}, {R.PAGE_BAD_TOTAL}, {R.PAGE_NO_DATA})
"""

SQL["page_envelope_rejects"] = f"""
WITH g AS ({GEN}), {SMALL}, pg AS (SELECT DISTINCT respondent, page FROM n),
r AS (SELECT CASE page % 5 WHEN {R.PAGE_CUT_OFF} THEN 'page: not JSON' WHEN {R.PAGE_BAD_TOTAL} THEN 'page: total not an integer'
                  WHEN {R.PAGE_NO_DATA} THEN 'page: data not a list of records' END AS reject_reason FROM pg)
SELECT reject_reason, count(*) AS pages FROM r WHERE reject_reason IS NOT NULL GROUP BY reject_reason
"""

SQL["page_source_range"] = f"""
WITH p AS ({SQL["page_parse"]})
SELECT * FROM p WHERE respondent = 'CISO' AND period >= TIMESTAMP '2024-01-03 00:00:00' AND period < TIMESTAMP '2024-01-10 00:00:00'
"""

# ---------------------------------------------------------------- step 4: tools over requests
SQL["alias_lookup"] = f"""
WITH q AS ({REQ}) SELECT request_id, region_raw, region FROM q
"""

_SEL = """sel AS (SELECT q.request_id, q.region, f.* FROM q JOIN {facts} f
  ON f.respondent = q.region AND CAST(f.period AS DATE) BETWEEN q.start AND q."end" WHERE q.tool = '{tool}')"""

SQL["tool_generation"] = f"""
WITH g AS ({GEN}), q AS ({REQ}), {_SEL.format(facts='g', tool='get_generation')},
per AS (SELECT request_id, region, type_name, {dsum()} AS total_dec FROM sel GROUP BY request_id, region, type_name),
b AS (SELECT request_id, count(*) AS rows, {ts_text('min(period)')} AS period_start,
             {ts_text('max(period)')} AS period_end FROM sel GROUP BY request_id)
SELECT per.request_id, region, rows, period_start, period_end, type_name,
  row_number() OVER (PARTITION BY per.request_id ORDER BY total_dec DESC, type_name) AS fuel_rank,
  CAST(round(total_dec, 1) AS DOUBLE) AS mwh
FROM per JOIN b ON per.request_id = b.request_id
"""

SQL["tool_ranges_function"] = SQL["tool_generation"]

SQL["tool_interchange"] = f"""
WITH r AS (SELECT * FROM ({REG}) WHERE type IN ('D', 'NG', 'TI')), q AS ({REQ}),
{_SEL.format(facts='r', tool='get_demand_and_interchange')},
per AS (SELECT request_id, region, type, {dsum()} AS total_dec FROM sel GROUP BY request_id, region, type),
b AS (SELECT request_id, count(*) AS rows FROM sel GROUP BY request_id)
SELECT per.request_id, region, rows, type, {case_map('type', SERIES_LABELS, 'type')} AS series,
  CAST(round(total_dec, 1) AS DOUBLE) AS total_mwh
FROM per JOIN b ON per.request_id = b.request_id
"""

SQL["tool_unknown"] = f"""
WITH q AS ({REQ})
SELECT request_id, tool, 'unknown tool ' || coalesce(tool, 'None') AS error FROM q
WHERE tool IS NULL OR tool NOT IN ('get_generation', 'get_demand_and_interchange')
"""

SQL["tool_no_data"] = f"""
WITH g AS ({GEN}), r AS (SELECT * FROM ({REG}) WHERE type IN ('D', 'NG', 'TI')), q AS ({REQ})
SELECT request_id, tool, region, CAST(0 AS BIGINT) AS rows, {q(NOTE_NO_DATA)} AS note FROM q
WHERE (tool = 'get_generation' AND NOT EXISTS (SELECT 1 FROM g WHERE g.respondent = q.region
         AND CAST(g.period AS DATE) BETWEEN q.start AND q."end"))
   OR (tool = 'get_demand_and_interchange' AND NOT EXISTS (SELECT 1 FROM r WHERE r.respondent = q.region
         AND CAST(r.period AS DATE) BETWEEN q.start AND q."end"))
"""

SQL["tool_generation_agent"] = SQL["tool_generation"].replace("rows, period_start, period_end, type_name,", "rows, type_name,")


def _dispatch_sql(bounds: bool, note: str) -> str:
    """All tools' answers as JSON text, fuels by rank and series by name."""
    period = """ || ',"period_start":"' || any_value(period_start) || '","period_end":"' || any_value(period_end) || '"'""" if bounds else ""
    gen = f"""SELECT request_id, 'get_generation' AS tool, '{{"region":"' || any_value(region) || '"'{period}
      || ',"rows":' || any_value(rows) || ',"generation_mwh_by_fuel":{{'
      || string_agg('"' || type_name || '":' || CAST(mwh AS VARCHAR), ',' ORDER BY fuel_rank) || '}}}}' AS result
      FROM ({SQL["tool_generation"]}) GROUP BY request_id"""
    inter = f"""SELECT request_id, 'get_demand_and_interchange' AS tool, '{{"region":"' || any_value(region) || '","rows":' || any_value(rows)
      || ',"totals":{{' || string_agg('"' || series || '":' || CAST(total_mwh AS VARCHAR), ',' ORDER BY series)
      || '}},"convention":' || {q('"' + INTERCHANGE_CONVENTION + '"')} || '}}' AS result
      FROM ({SQL["tool_interchange"]}) GROUP BY request_id"""
    none = f"""SELECT request_id, tool, '{{"region":"' || region || '","rows":0,"note":"{note}"}}' AS result FROM ({SQL["tool_no_data"]})"""
    unknown = f"""SELECT request_id, tool, '{{"error":"' || error || '"}}' AS result FROM ({SQL["tool_unknown"]})"""
    return " UNION ALL ".join((gen, inter, none, unknown))


SQL["dispatch_results"] = _dispatch_sql(False, NOTE_NO_DATA)
SQL["dispatch_results_single_turn"] = _dispatch_sql(True, NOTE_NO_DATA_RETURNED)

SQL["summary_lines"] = f"""
WITH g AS ({GEN}), {_MIX},
f AS (SELECT respondent, CAST(fuel_rank + 2 AS INTEGER) AS line_no,
  '    ' || CASE WHEN length(type_name) >= 22 THEN type_name ELSE rpad(type_name, 22, ' ') END || ' '
    || lpad(format('{{:,d}}', CAST(round_even(CAST(mwh_dec AS DOUBLE), 0) AS BIGINT)), 14, ' ') || ' MWh  ('
    || printf('%4.1f', CASE WHEN total_mwh <> 0 THEN CAST(mwh_dec AS DOUBLE) / total_mwh * 100.0 ELSE 0.0 END) || '%)' AS line FROM rk),
b AS (SELECT respondent, count(*) AS n, {ts_text('min(period)')} AS lo, {ts_text('max(period)')} AS hi FROM g GROUP BY respondent)
SELECT respondent, line_no, line FROM f
UNION ALL SELECT respondent, 1, respondent || ': ' || format('{{:,d}}', n) || ' rows' FROM b
UNION ALL SELECT respondent, 2, '  period:  ' || lo || ' ' || chr(8594) || ' ' || hi FROM b
"""

SQL["facts_round_trip"] = f"""
WITH g AS ({GEN})
SELECT period, respondent, respondent_name, fueltype, type_name, value_units, value FROM g
"""

SQL["generation_sorted"] = f"""
WITH g AS ({GEN})
SELECT period, fueltype, row_number() OVER (ORDER BY period, fueltype) AS position FROM g
WHERE respondent = 'CISO' AND period >= TIMESTAMP '2024-01-03 00:00:00' AND period < TIMESTAMP '2024-01-10 00:00:00'
"""

SQL["region_sorted"] = f"""
WITH r AS ({REG})
SELECT period, type, row_number() OVER (ORDER BY period, type) AS position FROM r
WHERE respondent = 'SWPP' AND type IN ('D', 'NG', 'TI')
  AND period >= TIMESTAMP '2024-01-01 00:00:00' AND period < TIMESTAMP '2024-01-31 00:00:00'
"""

# ---------------------------------------------------------------- step 5: pages and chunks
PAGES_CONV = """SELECT 'conv-' || CAST(conv_id AS VARCHAR) || '.pdf' AS source_pdf,
  CAST(turn + 1 AS INTEGER) AS page_number, text AS page_text FROM conversations"""
PAGES_DOC = """SELECT 'doc-' || CAST(doc_id AS VARCHAR) || '.pdf' AS source_pdf,
  CAST(1 AS INTEGER) AS page_number, text AS page_text FROM documents"""
PAGES_SRC = """SELECT source || '.pdf' AS source_pdf,
  CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page_number,
  text AS page_text FROM documents"""


def normalize_sql(col: str) -> str:
    lines = f"regexp_split_to_array(coalesce({col}, ''), {q(LINE_BREAK)})"
    clean = (f"list_transform({lines}, lambda l: regexp_replace(regexp_replace(l, '[ \\t]{{2,}}', ' ', 'g'), "
             f"{q(WS + '+' + chr(92) + 'z')}, ''))")
    return f"array_to_string(list_filter({clean}, lambda l: l <> ''), chr(10))"


def strip_sql(col: str) -> str:
    return f"regexp_replace({col}, {q('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def chunks_sql(pages: str) -> str:
    """CTE chain ending in ``chunks(chunk_id, source_pdf, page_number, chunk_index, text)``."""
    n_win = f"CASE WHEN nt <= {CHUNK_TOKENS} THEN 1 ELSE CAST(ceil((nt - {CHUNK_TOKENS}) / {STEP}.0) AS BIGINT) + 1 END"
    return f"""pg AS ({pages}),
tk AS (SELECT source_pdf, page_number, regexp_extract_all({normalize_sql('page_text')}, {q(TOKEN_PATTERN)}) AS tokens
       FROM pg),
ne AS (SELECT *, len(tokens) AS nt FROM tk WHERE len(tokens) > 0),
cy AS (SELECT *, lag(array_to_string(list_slice(tokens, greatest(1, nt - {OVERLAP_TOKENS - 1}), nt), ''))
         OVER (PARTITION BY source_pdf ORDER BY page_number) AS carry FROM ne),
wn AS (SELECT source_pdf, page_number, carry, tokens, unnest(range({n_win})) AS win FROM cy),
tx AS (SELECT source_pdf, page_number, CAST(win AS INTEGER) AS chunk_index,
         {strip_sql(f"(CASE WHEN win = 0 THEN coalesce(carry, '') ELSE '' END) || array_to_string(list_slice(tokens, win * {STEP} + 1, win * {STEP} + {CHUNK_TOKENS}), '')")} AS text
       FROM wn),
chunks AS (SELECT sha256(source_pdf || '|' || CAST(page_number AS VARCHAR) || '|' || CAST(chunk_index AS VARCHAR)
                         || '|' || text) AS chunk_id, source_pdf, page_number, chunk_index, text
           FROM tx WHERE text <> '')"""


SQL["normalize_pages"] = f"""
WITH pg AS ({PAGES_DOC})
SELECT source_pdf, page_number, {normalize_sql('page_text')} AS page_text FROM pg
"""

SQL["page_chunks"] = f"""
WITH {chunks_sql(PAGES_DOC)}
SELECT chunk_id, source_pdf, page_number, chunk_index, text FROM chunks
"""

SQL["cross_page_carry"] = f"""
WITH {chunks_sql(PAGES_CONV)}
SELECT chunk_id, source_pdf, page_number, chunk_index, text FROM chunks
"""

SQL["chunk_ids"] = f"""
WITH {chunks_sql(PAGES_SRC)}
SELECT chunk_id, source_pdf, page_number, chunk_index FROM chunks
"""

# ---------------------------------------------------------------- step 6: store and ingest
_STORE = """store AS (SELECT chunk_id FROM chunks
  WHERE source_pdf IN (SELECT 'doc-' || CAST(doc_id AS VARCHAR) || '.pdf' FROM labels))"""

SQL["incremental_chunks"] = f"""
WITH {chunks_sql(PAGES_DOC)}, {_STORE}
SELECT chunk_id, source_pdf, page_number, chunk_index FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM store)
"""

SQL["ingest_stats"] = f"""
WITH {chunks_sql(PAGES_DOC)}, {_STORE},
per AS (SELECT source_pdf, count(*) AS n_chunks,
               count(*) FILTER (WHERE chunk_id NOT IN (SELECT chunk_id FROM store)) AS n_new
        FROM chunks GROUP BY source_pdf),
docs AS (SELECT DISTINCT source_pdf FROM pg)
SELECT docs.source_pdf, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_new, 0) AS n_new,
       coalesce(n_chunks, 0) - coalesce(n_new, 0) AS n_skipped
FROM docs LEFT JOIN per USING (source_pdf)
"""

_BLANK = "(turn % 3 = 1 OR conv_id % 5 = 2)"
PAGES_BLANK = PAGES_CONV.replace("text AS page_text", f"""CASE WHEN {_BLANK} AND turn % 2 = 0 THEN '' WHEN {_BLANK} THEN ' ' || chr(10) || chr(9) || ' '
  ELSE text END AS page_text""")

SQL["blank_page_chunks"] = f"""
WITH {chunks_sql(PAGES_BLANK)}
SELECT chunk_id, source_pdf, page_number, chunk_index, text FROM chunks
"""

SQL["ingest_totals"] = f"""
WITH {chunks_sql(PAGES_BLANK)}
SELECT (SELECT count(DISTINCT source_pdf) FROM pg) AS n_documents, count(*) AS n_chunks, count(*) AS n_embedded, CAST(0 AS BIGINT) AS n_skipped
FROM chunks
"""

SQL["ingest_replay"] = f"""
WITH {chunks_sql(PAGES_CONV)},
h AS (SELECT count(*) AS half FROM chunks WHERE CAST(regexp_extract(source_pdf, '[0-9]+') AS BIGINT) % 2 = 0),
a AS (SELECT count(*) AS n FROM chunks)
SELECT CAST(0 AS BIGINT) AS batch_id, half AS n_chunks, half AS n_embedded, CAST(0 AS BIGINT) AS n_skipped,
       half AS embedded_so_far, CAST(0 AS BIGINT) AS skipped_so_far FROM h
UNION ALL SELECT 1, n, n - half, half, n, half FROM h, a
"""

SQL["ingest_log_batches"] = f"""
WITH {chunks_sql(PAGES_CONV)},
k AS (SELECT CAST(regexp_extract(source_pdf, '[0-9]+') AS BIGINT) % 3 AS part FROM chunks),
n AS (SELECT count(*) FILTER (part = 0) AS a, count(*) FILTER (part <= 1) AS b, count(*) AS c FROM k)
SELECT CAST(0 AS BIGINT) AS batch_id, a AS n_chunks, a AS n_embedded, CAST(0 AS BIGINT) AS n_skipped, a AS embedded_so_far,
       CAST(0 AS BIGINT) AS skipped_so_far, 'monday' AS batch FROM n
UNION ALL SELECT 1, b, b - a, a, b, a, 'tuesday' FROM n
UNION ALL SELECT 2, c, c - b, b, c, a + b, 'unnamed' FROM n
"""

SQL["stream_split_document"] = SQL["cross_page_carry"]

# ---------------------------------------------------------------- step 7: retrieval
SQL["topk_cosine"] = f"""
WITH ex AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cen AS (SELECT label, list(m ORDER BY pos) AS centroid
        FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM ex GROUP BY label, pos) GROUP BY label),
sc AS (SELECT cen.label, e.vec_id,
              round(list_cosine_similarity(cen.centroid, CAST(e.embedding AS DOUBLE[])), 6) AS similarity_score
       FROM cen, embeddings e),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity_score DESC, vec_id) AS rank FROM sc)
SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, similarity_score FROM rk WHERE rank <= {DEFAULT_K}
"""

SQL["topk_index_exact"] = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
           WHERE list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
sc AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.x, v.x), 6) AS similarity_score
       FROM v q, v WHERE q.vec_id % 50 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, vec_id) AS rank FROM sc)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, similarity_score FROM rk WHERE rank <= {DEFAULT_K}
"""


def hashed_sql(src: str, id_col: str, text_col: str, name: str) -> str:
    """CTEs ``{name}_v(id, bucket, x FLOAT)`` and ``{name}_n(id, n)`` for the hashing vectoriser."""
    lead = q("^" + WS + "+")
    return f"""{name}_t AS (SELECT {id_col} AS id, unnest(regexp_extract_all({text_col}, {q(TOKEN_PATTERN)})) AS tok FROM {src}),
{name}_h AS (SELECT id, md5(regexp_replace(tok, {lead}, '')) AS h FROM {name}_t),
{name}_w AS (SELECT id, CAST(('0x' || substr(h, 1, 8))::BIGINT % {HASH_DIM} AS INTEGER) AS bucket,
                    sum(CASE WHEN ('0x' || substr(h, 9, 2))::INTEGER < 128 THEN 1 ELSE -1 END) AS w
             FROM {name}_h GROUP BY ALL HAVING sum(CASE WHEN ('0x' || substr(h, 9, 2))::INTEGER < 128 THEN 1 ELSE -1 END) <> 0),
{name}_nn AS (SELECT id, sqrt(sum(CAST(w AS DOUBLE) * w)) AS norm FROM {name}_w GROUP BY id),
{name}_v AS (SELECT id, bucket, CAST(CAST(w AS DOUBLE) / norm AS FLOAT) AS x FROM {name}_w JOIN {name}_nn USING (id)
             WHERE norm > 0),
{name}_n AS (SELECT id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM {name}_v GROUP BY id)"""


HITS = f"""{chunks_sql(PAGES_DOC)},
{hashed_sql('chunks', 'chunk_id', 'text', 'cv')},
qsrc AS (SELECT item_id, CASE WHEN item_id % 10 = 3 THEN ' ' || chr(9) || ' ' ELSE text END AS text FROM benchmark),
{hashed_sql('qsrc', 'item_id', 'text', 'qv')},
dots AS (SELECT qv_v.id AS query_id, cv_v.id AS chunk_id, sum(CAST(qv_v.x AS DOUBLE) * CAST(cv_v.x AS DOUBLE)) AS d
         FROM qv_v JOIN cv_v ON qv_v.bucket = cv_v.bucket GROUP BY ALL),
allpairs AS (SELECT qv_n.id AS query_id, cv_n.id AS chunk_id, coalesce(d, 0.0) / (qv_n.n * cv_n.n) AS s
             FROM qv_n CROSS JOIN cv_n LEFT JOIN dots ON dots.query_id = qv_n.id AND dots.chunk_id = cv_n.id),
ranked AS (SELECT query_id, chunk_id, round(s, 6) AS similarity_score,
                  row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, chunk_id) AS rank FROM allpairs),
hits AS (SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.chunk_id, c.text AS chunk_text, c.source_pdf, c.page_number,
                r.similarity_score
         FROM ranked r JOIN chunks c ON c.chunk_id = r.chunk_id WHERE r.rank <= {DEFAULT_K})"""

SQL["search_hits"] = f"""
WITH {HITS}
SELECT query_id, rank, chunk_id, source_pdf, page_number, similarity_score FROM hits
"""

# ---------------------------------------------------------------- step 8: citations and answers
def stem_sql(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, '^.+\\.[^.]+$') THEN regexp_replace({col}, '\\.[^.]+$', '') ELSE {col} END"


def alias_sql(col: str) -> str:
    return case_map(col, CITATION_ALIASES, stem_sql(col))


SQL["citation_alias"] = f"""
WITH names AS (SELECT source_pdf FROM ({PAGES_CONV})
               UNION SELECT CASE WHEN doc_id % 11 = 3 THEN {pick(list(CITATION_ALIASES), 'doc_id')} ELSE 'doc-' || CAST(doc_id AS VARCHAR) || '.pdf' END FROM documents
               UNION SELECT source || '.pdf' FROM documents)
SELECT source_pdf, {alias_sql('source_pdf')} AS alias FROM names
"""

_CTX = f"""ctx AS (SELECT query_id, count(*) AS n_hits,
  string_agg('[' || ({alias_sql('source_pdf')}) || ' p.' || CAST(page_number AS VARCHAR) || ']' || chr(10) || chunk_text,
             {q(CONTEXT_SEPARATOR)} ORDER BY rank) AS context FROM hits GROUP BY query_id)"""

SQL["context_blocks"] = f"""
WITH {HITS}, {_CTX}
SELECT query_id, n_hits, context FROM ctx
"""


def prompt_sql(context: str, query: str) -> str:
    import string as _s

    values = {"refusal": q(REFUSAL), "context": context, "query": query}
    parts = []
    for lit, field, _, _ in _s.Formatter().parse(PROMPT_TEMPLATE):
        if lit:
            parts.append(q(lit))
        if field is not None:
            parts.append(values[field])
    return " || ".join(parts)


SQL["prompt_rows"] = f"""
WITH {HITS}, {_CTX}
SELECT b.item_id AS query_id, b.text AS question, ctx.context IS NULL AS refused,
  CASE WHEN ctx.context IS NOT NULL THEN {prompt_sql('ctx.context', 'b.text')} END AS prompt,
  CASE WHEN ctx.context IS NULL THEN {q(REFUSAL)} END AS response
FROM qsrc b LEFT JOIN ctx ON ctx.query_id = b.item_id
"""

_TAIL = "[" + ", ".join(" || ".join(["''", *(f"chr({ord(c)})" for c in t)]) for t in R.ANSWER_TAILS) + f"][CAST(turn % {len(R.ANSWER_TAILS)} AS INTEGER) + 1]"
_ANS = f"""ans AS (SELECT conv_id, turn,
  CASE WHEN conv_id % 17 = 5 THEN NULL WHEN conv_id % 17 = 6 THEN {_TAIL}
       WHEN conv_id % 3 = 0 THEN text || ' [conv-' || CAST(conv_id AS VARCHAR) || ' p.' || CAST(turn + 1 AS VARCHAR) || ']' || {_TAIL}
       WHEN conv_id % 3 = 1 THEN {_TAIL} || {q(REFUSAL)} || {_TAIL} ELSE {_TAIL} || text END AS answer
  FROM conversations WHERE role = 'assistant'),
said AS (SELECT *, {strip_sql("coalesce(answer, '')")} AS words FROM ans)"""

SQL["uncited_answers"] = f"""
WITH {_ANS}
SELECT conv_id, turn, answer FROM said
WHERE words <> '' AND words <> {q(REFUSAL)} AND NOT regexp_matches(words, {q(CITATION_PATTERN)})
"""

SQL["refusals"] = f"""
WITH {_ANS}
SELECT conv_id, turn FROM said WHERE words = {q(REFUSAL)}
"""

# ---------------------------------------------------------------- stream and SQL functions
SQL["stream_ingest"] = f"""
WITH {chunks_sql(PAGES_DOC)}
SELECT chunk_id, source_pdf, page_number, chunk_index FROM chunks
"""

SQL["tool_table_function"] = f"""
WITH g AS ({GEN}),
sel AS (SELECT * FROM g WHERE respondent = 'CISO' AND period >= TIMESTAMP '2024-01-03 00:00:00'
        AND period < TIMESTAMP '2024-01-10 00:00:00'),
per AS (SELECT type_name, {dsum()} AS total, count(*) AS n, min(period) AS lo, max(period) AS hi
        FROM sel GROUP BY type_name)
SELECT 'CISO' AS region, CAST(sum(n) OVER () AS BIGINT) AS rows, {ts_text('min(lo) OVER ()')} AS period_start,
       {ts_text('max(hi) OVER ()')} AS period_end, type_name,
       CAST(row_number() OVER (ORDER BY total DESC, type_name) AS INTEGER) AS fuel_rank,
       CAST(round(total, 1) AS DOUBLE) AS mwh
FROM per
"""

GEN_LARGE = f"""SELECT CAST(l_shipdate AS TIMESTAMP) AS period,
  {pick(REGION_CODES, 'l_suppkey')} AS respondent,
  l_returnflag || l_linestatus AS type_name,
  l_quantity AS value
FROM lineitem"""

SQL["fuel_share_large"] = f"""
WITH g AS ({GEN_LARGE}), {_MIX}
SELECT respondent, type_name, CAST(mwh_dec AS DOUBLE) AS mwh, fuel_rank,
  CASE WHEN total_mwh <> 0 THEN CAST(mwh_dec AS DOUBLE) / total_mwh * 100.0 ELSE 0.0 END AS share_pct
FROM rk
"""

REG_K = f"""SELECT r.*, CAST(json_extract(e.props, '$.k') AS INTEGER) AS k
FROM ({REG.replace('FROM events', ', event_id FROM events')}) r JOIN events e USING (event_id)"""

SQL["region_page_parse"] = f"""
WITH r AS ({REG_K})
SELECT period, respondent, respondent_name, type, type_name, value_units,
  CASE WHEN k = {R.K_NAN_VALUE} THEN NULL ELSE value END AS value
FROM r WHERE type IN ('D', 'NG', 'TI') AND k NOT IN ({', '.join(str(x) for x in _BAD)})
"""

SQL["tool_table_function_interchange"] = f"""
WITH r AS ({REG}),
sel AS (SELECT * FROM r WHERE respondent = 'SWPP' AND type IN ('D', 'NG', 'TI')
        AND period >= TIMESTAMP '2024-01-01 00:00:00' AND period < TIMESTAMP '2024-01-31 00:00:00'),
per AS (SELECT type, {dsum()} AS total, count(*) AS n FROM sel GROUP BY type)
SELECT 'SWPP' AS region, CAST(sum(n) OVER () AS BIGINT) AS rows, type, {case_map('type', SERIES_LABELS, 'type')} AS series,
  CAST(round(total, 1) AS DOUBLE) AS total_mwh,
  CASE WHEN max(CASE WHEN type = 'TI' THEN round(total, 1) END) OVER () > 0 THEN {q(POSITION_EXPORTER)}
       WHEN max(CASE WHEN type = 'TI' THEN round(total, 1) END) OVER () < 0 THEN {q(POSITION_IMPORTER)}
       WHEN max(CASE WHEN type = 'TI' THEN round(total, 1) END) OVER () = 0 THEN {q(POSITION_BALANCED)} END AS position
FROM per
"""

__all__ = ["SQL"]
