"""SQL for DuckDB that each catalogue query must agree with, and input expressions that both engines read."""

from __future__ import annotations

from ledgerloom.functions import normalize, text
from ledgerloom.operators import chunk, retrieve
from ledgerloom.plans.inputs import FACTS_SQL

ENTITY_INPUT = """CASE s_suppkey % 7 WHEN 0 THEN '  ' || s_name || ' Ltd.' WHEN 1 THEN s_name || ', Inc.' WHEN 2 THEN 'The ' || s_name || '  Co Pvt. Limited'
    WHEN 3 THEN 'M&M Ltd' WHEN 4 THEN 'Bajaj Finance Limited.' WHEN 5 THEN 'Company' ELSE upper(s_name) END"""
PERIOD_INPUT = """CASE o_orderkey % 8 WHEN 0 THEN 'FY' || (o_orderkey % 90 + 10) WHEN 1 THEN 'q3 fy ''' || (2000 + o_orderkey % 30) WHEN 2 THEN 'year ended 31 March ' || (1990 + o_orderkey % 40)
    WHEN 3 THEN 'Q2 ' || (1990 + o_orderkey % 40) WHEN 4 THEN '  as of today ' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE 'Fy' || (o_orderkey % 900 + 100) || ' Q4' END"""
VALUE_INPUT = """CASE o_orderkey % 6 WHEN 0 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR(30)) WHEN 1 THEN '-1,' || (o_orderkey % 900 + 100) || '.5%' WHEN 2 THEN 'resigned'
    WHEN 3 THEN '(' || (o_orderkey % 77) || ')' WHEN 4 THEN '.5' ELSE NULL END"""
LABEL_INPUT = """CASE event_id % 13 WHEN 0 THEN ' HIGH ' WHEN 1 THEN 'low' WHEN 2 THEN 'Consensus' WHEN 3 THEN 'needs-review' WHEN 4 THEN 'Corroborated' WHEN 5 THEN 'contradicting'
    WHEN 6 THEN 'reconcilable: different period' WHEN 7 THEN 'actual vs estimate' WHEN 8 THEN 'Different-Unit' WHEN 9 THEN 'reporting basis' WHEN 10 THEN 'TP' WHEN 11 THEN NULL ELSE 'methodology definition' END"""


def _map(aliases: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in aliases.items()) + "}"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _re(pattern: str, i: bool = True) -> str:
    """A pattern of ours for RE2: no (?U), whose classes are ASCII there."""
    return ("(?i)" if i else "") + pattern.replace("(?Ui)", "").replace("(?U)", "").replace("'", "''")


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


_BM25 = f"""
words AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL),
sizes AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents),
shape AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
asked AS (SELECT item_id, token, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY ALL),
frequency AS (SELECT token, count(*) AS df FROM words GROUP BY ALL),
scored AS (
    SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * {retrieve.K1 + 1}::DOUBLE / (tf + {retrieve.K1}::DOUBLE * ({1 - retrieve.B}::DOUBLE + {retrieve.B}::DOUBLE * dl / avgdl))) * qf) AS score
    FROM words JOIN asked USING (token) JOIN frequency USING (token) JOIN sizes USING (doc_id), shape GROUP BY ALL
),
best AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored)
"""

CLASSIFIED = f"""
WITH {FACTS_SQL},
pairs AS (
    SELECT a.id AS fact_a_id, b.id AS fact_b_id, a.period AS pa, b.period AS pb, a.value AS va, b.value AS vb, a.metric AS ma, b.metric AS mb, a.unit AS ua, b.unit AS ub, a.basis AS ba, b.basis AS bb,
        a.geography AS ga, b.geography AS gb, a.scope AS sa, b.scope AS sb, abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)) AS apart
    FROM facts a JOIN facts b ON a.entity = b.entity AND a.id % 10 < b.id % 10
),
ruled AS (
    SELECT *, CASE WHEN ma IS NULL OR mb IS NULL THEN 'C3' WHEN ba <> bb THEN 'C5' WHEN ga <> gb THEN 'C6' WHEN sa <> sb THEN 'C7' WHEN ua <> ub THEN 'C8'
        WHEN va = 0 AND vb = 0 THEN 'C10' WHEN pa <> pb THEN 'C11' WHEN apart <= 0.01 THEN 'C12' WHEN apart < 0.15 THEN 'C13' ELSE 'C14' END AS rule
    FROM pairs
),
judged AS (
    SELECT fact_a_id, fact_b_id, rule,
        CASE WHEN rule IN ('C3', 'C10', 'C14') THEN NULL WHEN rule = 'C12' THEN 'corroborates' ELSE 'reconcilable' END AS relation_type,
        CAST(CASE WHEN rule IN ('C3', 'C10', 'C14') THEN NULL WHEN rule = 'C5' THEN 0.88 WHEN rule = 'C12' THEN 0.95 WHEN rule = 'C13' THEN 0.75 ELSE 0.9 END AS DOUBLE) AS confidence,
        CASE rule WHEN 'C5' THEN 'actual_vs_estimate' WHEN 'C6' THEN 'different_geography' WHEN 'C7' THEN 'different_scope' WHEN 'C8' THEN CASE WHEN 'inr_crore' IN (ua, ub) THEN 'different_currency' ELSE 'different_unit' END
            WHEN 'C11' THEN 'different_reporting_period' WHEN 'C13' THEN 'updated_information' WHEN 'C12' THEN 'none' END AS reason
    FROM ruled
)
"""

_ENTITY = f"""
WITH bare AS (SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(trim({ENTITY_INPUT})), '[,.]+', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM supplier),
short AS (SELECT *, trim(regexp_replace(trim(regexp_replace(b, '{_re(normalize.LEGAL_SUFFIX)}', '', 'g')), '\\s+', ' ', 'g')) AS s FROM bare)
SELECT s_suppkey, coalesce({_map(normalize.ENTITY_ALIASES)}[b], {_map(normalize.ENTITY_ALIASES)}[s], nullif(s, ''), b) AS norm_entity FROM short
"""

_UNIT = f"""
WITH units AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN p_type ELSE {_list(list(normalize.UNIT_ALIASES))}[p_partkey % {len(normalize.UNIT_ALIASES)} + 1] END AS u FROM part),
named AS (SELECT p_partkey, CASE WHEN u IS NULL THEN 'unitless' ELSE coalesce({_map(normalize.UNIT_ALIASES)}[lower(trim(u))], {_slug('u')}) END AS norm_unit FROM units)
SELECT *, CASE WHEN norm_unit LIKE 'inr%' OR norm_unit = 'rs' THEN 'INR' WHEN norm_unit LIKE 'usd%' THEN 'USD' WHEN norm_unit LIKE 'eur%' THEN 'EUR' END AS norm_currency FROM named
"""

_PERIOD = f"""
WITH p AS (SELECT o_orderkey, {PERIOD_INPUT} AS period FROM orders),
found AS (
    SELECT *, regexp_extract(period, '{_re(normalize.FISCAL_YEAR)}', 1) AS fy, regexp_extract(period, '{_re(normalize.YEAR, False)}', 1) AS y, regexp_extract(period, '{_re(normalize.QUARTER)}', 1) AS q FROM p
)
SELECT o_orderkey, CASE WHEN period = '' THEN NULL WHEN fy <> '' THEN CASE WHEN q <> '' THEN 'Q' || q || ' ' ELSE '' END || 'FY' || CASE WHEN length(fy) = 2 THEN '20' || fy ELSE fy END
    WHEN y <> '' THEN y ELSE trim(period) END AS norm_period FROM found
"""

_COERCED = f"""
WITH rows_ AS (SELECT event_id, value, {LABEL_INPUT} AS label FROM events),
low AS (SELECT *, lower(trim(label)) AS s, coalesce(replace(replace(lower(trim(label)), '-', '_'), ' ', '_'), '') AS r FROM rows_)
SELECT event_id, CASE WHEN s IN ('low', 'medium', 'high') THEN s ELSE 'medium' END AS confidence,
    CASE WHEN s IS NULL OR s = '' OR s IN ('actual', 'reported', 'true') THEN 'actual' WHEN s IN ('estimate', 'estimated', 'e', 'consensus') THEN 'estimate'
        WHEN s IN ('forecast', 'projected', 'guidance', 'outlook') THEN 'forecast' WHEN s IN ('target', 'tp') THEN 'target' ELSE s END AS basis,
    round(CASE WHEN value IS NULL THEN 0.6 ELSE greatest(0, least(1, CASE WHEN value > 5 AND value <= 100 THEN value / 100 ELSE value END)) END, 6) AS numeric_confidence,
    CASE WHEN contains(coalesce(s, ''), 'review') THEN 'needs_review' WHEN contains(coalesce(s, ''), 'corroborat') THEN 'corroborates' WHEN contains(coalesce(s, ''), 'contradict') THEN 'contradicts'
        WHEN contains(coalesce(s, ''), 'reconcil') THEN 'reconcilable' ELSE 'unrelated' END AS relation_type,
    CASE WHEN contains(r, 'actual') AND contains(r, 'estimat') THEN 'actual_vs_estimate' WHEN contains(r, 'basis') THEN 'different_reporting_basis' WHEN contains(r, 'period') THEN 'different_reporting_period'
        WHEN contains(r, 'scope') THEN 'different_scope' WHEN contains(r, 'def') THEN 'different_definition' WHEN contains(r, 'geo') THEN 'different_geography' WHEN contains(r, 'unit') THEN 'different_unit'
        WHEN contains(r, 'curr') THEN 'different_currency' WHEN contains(r, 'update') OR contains(r, 'restate') THEN 'updated_information' WHEN contains(r, 'estimat') OR contains(r, 'method') THEN 'different_estimation_method'
        ELSE 'none' END AS reason
FROM low
"""

_CLEAN = """
WITH lines AS (SELECT doc_id, replace(replace(regexp_replace(' ' || chr(9) || replace(text, ' ', '  ') || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || ' x' || chr(9) || ' y ' || chr(13),
    '\\r\\n?', chr(10), 'g'), chr(160), ' '), chr(9), ' ') AS t FROM documents),
stripped AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, ' +', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM lines)
SELECT doc_id, length(trim(t, chr(10) || ' ')) AS n_clean, md5(trim(t, chr(10) || ' ')) AS clean_md5 FROM stripped
"""

_NUMBERS = f"list_sort(list_distinct(list_transform(regexp_extract_all(text, '{text.NUMBER_IN_ANSWER}'), lambda n: replace(n, ',', ''))))"

_MATCH = "lower(trim(regexp_replace(translate({}, chr(160) || '–—‘’“”', ' --''''\"\"'), '\\s+', ' ', 'g')))"

#: The facts' raw fields besides the normalized ones of FACTS_SQL.
_TEXTS = """
texts AS (
    SELECT *, e || ' ' || m || ' in ' || y AS quote FROM (
        SELECT f.id, f.doc, f.entity, coalesce(f.metric, '') AS metric, coalesce(f.period, '') AS period, CASE WHEN f.metric IS NULL THEN '' ELSE f.scope END AS scope, r.y, n_name AS e,
            CASE f.doc WHEN 'orders' THEN 'Revenue from operations' WHEN 'lines' THEN 'Net sales' ELSE 'Total revenue' END AS m, coalesce(CAST(r.v AS VARCHAR), 'n/a') AS val,
            CASE k WHEN 2 THEN 'INR crore' WHEN 5 THEN '%' ELSE 'USD' END AS u, CASE f.doc WHEN 'orders' THEN 'FY' WHEN 'lines' THEN 'FY ''' ELSE 'fy ' END || r.y AS p,
            CASE k WHEN 1 THEN 'standalone' ELSE 'consolidated' END AS sc, CASE k WHEN 3 THEN 'global' ELSE 'India' END AS g, CASE k WHEN 4 THEN 'estimate' ELSE 'actual' END AS b
        FROM facts f JOIN raw r ON f.id = r.id JOIN nation ON r.nk = n_nationkey
    )
),
words AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', e, m, val, u, p, sc, g, b, quote)), '[a-z0-9]+')) AS token FROM texts) GROUP BY ALL),
sizes AS (SELECT id, CAST(sum(tf) AS BIGINT) AS dl FROM words GROUP BY id)
"""

_SCORE = f"sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * {retrieve.K1 + 1}::DOUBLE / (tf + {retrieve.K1}::DOUBLE * ({1 - retrieve.B}::DOUBLE + {retrieve.B}::DOUBLE * dl / avgdl))) * qf)"


def _retrieved(new: str, vectors: bool) -> str:
    """CTEs up to ``retrieved`` (fact_id, cand_id, score, r): the candidates of the facts for which ``new`` holds."""
    near = """
slots AS (
    SELECT id, h % 384 AS slot, sum(CASE WHEN h < 384 THEN 1 ELSE -1 END) AS v FROM (
        SELECT id, (list_sum(list_transform(range(0, 7), lambda i: CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT))) * 256 + CAST('0x' || substr(h, 57, 8) AS BIGINT)) % 768 AS h
        FROM (SELECT id, sha256(unnest(regexp_extract_all(lower(concat_ws(' | ', e, m, val, u, p, sc, quote)), '[a-z0-9]+'))) AS h FROM texts)
    ) GROUP BY ALL
),
lengths AS (SELECT id, sqrt(sum(v * v)::DOUBLE) AS l FROM slots GROUP BY id),
dots AS (SELECT fact_id, cand_id, tier, sum(a.v * b.v)::DOUBLE AS d FROM pool JOIN slots a ON a.id = fact_id JOIN slots b ON b.id = cand_id AND a.slot = b.slot GROUP BY ALL),
near AS (
    SELECT * FROM (
        SELECT fact_id, cand_id, row_number() OVER (PARTITION BY fact_id ORDER BY round(d / (x.l * z.l), 9) DESC, tier, cand_id) AS vr
        FROM dots JOIN lengths x ON x.id = fact_id JOIN lengths z ON z.id = cand_id WHERE d / (x.l * z.l) >= 0.45
    ) WHERE vr <= 20
)"""
    none = "near AS (SELECT fact_id, cand_id, 1 AS vr FROM pool WHERE false)"
    return f"""{_TEXTS},
asked AS (SELECT * FROM texts WHERE {new}),
same AS (SELECT a.id AS fact_id, b.id AS cand_id, CASE WHEN a.metric <> '' AND a.metric = b.metric THEN 0 ELSE 1 END AS tier FROM asked a JOIN texts b ON a.entity = b.entity AND a.doc <> b.doc),
pool AS (
    SELECT * FROM same
    UNION ALL SELECT a.id, b.id, CASE WHEN a.metric <> '' AND a.metric = b.metric THEN 0 ELSE 1 END FROM asked a JOIN texts b ON a.doc <> b.doc WHERE a.id NOT IN (SELECT fact_id FROM same)
),
shape AS (SELECT fact_id, count(*) AS n, avg(dl) AS avgdl FROM pool JOIN sizes ON id = cand_id GROUP BY fact_id),
matched AS (SELECT fact_id, cand_id, tier, c.token, c.tf, q.tf AS qf FROM pool JOIN words c ON c.id = cand_id JOIN words q ON q.id = fact_id AND q.token = c.token),
frequency AS (SELECT fact_id, token, count(*) AS df FROM matched GROUP BY ALL),
scored AS (
    SELECT fact_id, cand_id, tier, {_SCORE} AS score FROM matched JOIN frequency USING (fact_id, token) JOIN shape USING (fact_id) JOIN sizes ON id = cand_id GROUP BY ALL
),
lexical AS (
    SELECT fact_id, cand_id, lr FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY round(score, 9) DESC, tier, cand_id) AS lr FROM scored WHERE score > 0) WHERE lr <= 20
),
{near if vectors else none},
merged AS (SELECT fact_id, cand_id, vr, lr FROM near FULL JOIN lexical USING (fact_id, cand_id)),
fused AS (
    SELECT fact_id, cand_id, vr, lr, coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0) + CASE WHEN a.entity = c.entity THEN 0.15::DOUBLE ELSE 0 END
        + CASE WHEN a.metric <> '' AND a.metric = c.metric THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN a.period <> '' AND lower(a.period) = lower(c.period) THEN 0.1::DOUBLE ELSE 0 END
        + CASE WHEN a.scope <> '' AND a.scope = c.scope THEN 0.05::DOUBLE ELSE 0 END AS score
    FROM merged JOIN texts a ON a.id = fact_id JOIN texts c ON c.id = cand_id
),
retrieved AS (
    SELECT * FROM (SELECT fact_id, cand_id, score, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY round(score, 9) DESC, vr NULLS LAST, lr NULLS LAST, cand_id) AS INT) AS r FROM fused) WHERE r <= 5
)"""


_WINDOWS = """
sized AS (SELECT *, greatest(20, CAST(floor(length(q) * 0.7::DOUBLE) AS BIGINT)) AS w FROM quoted),
windowed AS (
    SELECT *, CASE WHEN length(q) < 20 THEN [q] ELSE list_transform(range(0, greatest(length(q) - w, 0) + 1, greatest(1, w // 4)), lambda i: substr(q, i + 1, w)) END AS parts FROM sized
)
"""


_CANDIDATE = f"""length(trim(text)) >= {text.SHORTEST_PAGE} AND regexp_matches(text, '{_re(text.NUMBER)}')
        AND (regexp_matches(text, '{_re(text.CURRENCY)}') OR regexp_matches(text, '{_re(text.PERIOD)}') OR regexp_matches(text, '{_re(text.KEYWORDS)}') OR regexp_matches(text, '{_re(text.TABLE)}'))"""

#: Pages of a source, in the order of ids, as a document.
_PAGES = "own_pages AS (SELECT source AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no, text, doc_id FROM documents)"


def _packed(text: str) -> str:
    """A list of texts of whole paragraphs, greedily up to the limit."""
    first = f"list_transform(string_split({text}, chr(10)), lambda t: {{'done': CAST([] AS VARCHAR[]), 'open': t, 'cost': length(t) + 2}})"
    step = f"""CASE WHEN a.cost + length(x.open) > {chunk.CHUNK_LIMIT} THEN {{'done': list_append(a.done, a.open), 'open': x.open, 'cost': x.cost}}
        ELSE {{'done': a.done, 'open': a.open || chr(10) || x.open, 'cost': a.cost + x.cost}} END"""
    folded = f"list_reduce({first}, lambda a, x: {step})"
    return f"CASE WHEN length({text}) <= {chunk.CHUNK_LIMIT} THEN [{text}] ELSE list_append(({folded}).done, ({folded}).open) END"


#: Chunks of the pages ``own`` (document_id, page_no, text).
_CHUNKS = f"""
sized AS (SELECT *, length(text) AS size FROM own),
follows AS (
    SELECT *, coalesce(lag(page_no) OVER w = page_no - 1 AND lag(size) OVER w <= {chunk.CHUNK_LIMIT} AND size <= {chunk.CHUNK_LIMIT} AND lag(size) OVER w + size <= {chunk.MERGE_LIMIT}, false) AS f
    FROM sized WINDOW w AS (PARTITION BY document_id ORDER BY page_no)
),
runs AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY page_no) AS run FROM follows),
paired AS (SELECT *, (row_number() OVER (PARTITION BY document_id, run ORDER BY page_no) - 1) // 2 AS pair FROM runs),
texts_ AS (SELECT *, {_packed("text")} AS parts FROM paired),
parts AS (SELECT document_id, run, pair, page_no, unnest(parts) AS t, unnest(range(0, len(parts))) AS part FROM texts_),
grouped AS (
    SELECT document_id, run, pair, part, min(page_no) AS start_page, max(page_no) AS end_page, array_to_string(list(CAST(page_no AS VARCHAR) ORDER BY page_no, t), ',') AS page_map,
        string_agg('[page ' || page_no || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY page_no, t) AS text
    FROM parts GROUP BY ALL
),
made AS (SELECT *, document_id || '_c' || format('{{:03d}}', row_number() OVER (PARTITION BY document_id ORDER BY start_page, part) - 1) AS chunk_id FROM grouped)
"""


ORACLE_SQL: dict[str, str] = {
    "relation_pairs": f"{CLASSIFIED} SELECT * FROM judged",
    "relation_summary": f"{CLASSIFIED} SELECT relation_type, reason, count(*) AS n_pairs FROM judged GROUP BY ALL",
    "relation_top5_per_type": f"""{CLASSIFIED},
        ranked AS (SELECT *, count(*) OVER (PARTITION BY relation_type) AS n_pairs, CAST(row_number() OVER (PARTITION BY relation_type ORDER BY fact_a_id, fact_b_id) AS INT) AS nth FROM judged WHERE relation_type IS NOT NULL)
        SELECT relation_type, n_pairs, nth, fact_a_id, fact_b_id, a.doc AS document_a, b.doc AS document_b FROM ranked JOIN facts a ON a.id = fact_a_id JOIN facts b ON b.id = fact_b_id WHERE nth <= 5""",
    "fact_relations": f"""{CLASSIFIED},
        seen AS (
            SELECT fact_a_id AS fact_id, fact_b_id AS other_id, relation_type FROM judged WHERE rule IN ('C12', 'C13')
            UNION ALL SELECT fact_b_id, fact_a_id, relation_type FROM judged WHERE rule IN ('C12', 'C13')
        )
        SELECT fact_id, other_id, relation_type, doc AS other_document, period AS other_period FROM seen LEFT JOIN facts ON id = other_id""",
    "metric_history": f"""WITH {FACTS_SQL} SELECT id, doc AS document_id, entity AS norm_entity, metric AS norm_metric, period AS norm_period, value AS norm_value
        FROM facts WHERE entity = 'nation_7' AND (metric = 'revenue' OR metric IS NULL)""",
    "gold_projection": f"""WITH {FACTS_SQL} SELECT f.id AS fact_id, doc AS document_id, CASE WHEN metric IS NULL THEN upper(entity) ELSE entity END AS entity, coalesce(metric, 'Total revenue') AS metric, coalesce(unit, 'USD') AS unit,
        coalesce(period, 'fy ' || (f.id // 10) % 10000) AS period, scope, value FROM facts f""",
    "pair_dedupe": f"{CLASSIFIED} SELECT least(fact_a_id, fact_b_id) AS fact_a_id, greatest(fact_a_id, fact_b_id) AS fact_b_id, rule FROM judged WHERE rule <> 'C12'",
    "normalize_entity": _ENTITY,
    "normalize_metric": f"""WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE ' ' || upper({_list(list(normalize.METRIC_ALIASES))}[p_partkey % {len(normalize.METRIC_ALIASES)} + 1]) END AS m FROM part)
        SELECT p_partkey, coalesce({_map(normalize.METRIC_ALIASES)}[lower(trim(m))], {_slug('m')}) AS norm_metric FROM m""",
    "normalize_unit": _UNIT,
    "normalize_period": _PERIOD,
    "normalize_value": f"""WITH v AS (SELECT o_orderkey, {VALUE_INPUT} AS v FROM orders)
        SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(replace(v, ',', ''), '{_re(normalize.VALUE, False)}'), '') AS DOUBLE) AS norm_value FROM v""",
    "normalize_geography": f"""WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE {_list(list(normalize.GEOGRAPHY_ALIASES))}[c_custkey % {len(normalize.GEOGRAPHY_ALIASES)} + 1] END AS g FROM customer)
        SELECT c_custkey, coalesce({_map(normalize.GEOGRAPHY_ALIASES)}[lower(trim(g))], {_slug('g')}) AS norm_geography FROM g""",
    "coerced": _COERCED,
    "clean_text": _CLEAN,
    "candidate_docs": f"SELECT doc_id FROM documents WHERE {_CANDIDATE}",
    "split_long": f"""WITH long AS (SELECT doc_id, {_packed("text")} AS parts FROM documents WHERE length(text) > {chunk.CHUNK_LIMIT}),
        each_ AS (SELECT doc_id, unnest(range(0, len(parts))) AS part, unnest(parts) AS t FROM long)
        SELECT doc_id, part, length(t) AS n_chars, md5(t) AS part_md5 FROM each_""",
    "chunk_pages": f"""WITH {_PAGES}, own AS (SELECT document_id, page_no, text FROM own_pages), {_CHUNKS}
        SELECT document_id, chunk_id, CAST(start_page AS INT) AS start_page, CAST(end_page AS INT) AS end_page, length(text) AS n_chars FROM made""",
    "candidate_chunks": f"""WITH {_PAGES}, judged AS (SELECT *, coalesce({_CANDIDATE}, false) AS c, count(*) OVER (PARTITION BY document_id) AS n_pages FROM own_pages WHERE length(text) > 0),
        own AS (SELECT document_id, page_no, text FROM (SELECT *, bool_or(c) OVER (PARTITION BY document_id) AS any_c FROM judged) WHERE c OR NOT any_c), {_CHUNKS},
        counted AS (SELECT document_id, any_value(n_pages) AS n_pages FROM judged GROUP BY document_id)
        SELECT document_id, chunk_id, CAST(start_page AS INT) AS start_page, CAST(end_page AS INT) AS end_page, page_map, n_pages FROM made JOIN counted USING (document_id)""",
    "chunk_top25": """WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 6),
        scored AS (SELECT label, vec_id, max(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6)) AS best FROM embeddings, q GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY best DESC, vec_id) AS r FROM scored)
        SELECT CAST(label AS VARCHAR) AS document_id, vec_id, best FROM ranked WHERE r <= 25""",
    "token_stats": """WITH w AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL)
        SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS max_tf FROM w GROUP BY token""",
    "bm25_topk": f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM best WHERE r <= 5",
    "vector_topk": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
        SELECT query_id, vec_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM r WHERE r <= 5""",
    "hybrid_rrf": f"""WITH {_BM25},
        lexical AS (SELECT item_id, doc_id, r AS lr FROM best WHERE r <= 20),
        shortest AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_chars, doc_id) AS sr FROM lexical JOIN documents USING (doc_id)),
        fused AS (SELECT item_id, doc_id, coalesce(1.0::DOUBLE / (60 + CASE WHEN sr <= 10 THEN sr END), 0) + 1.0::DOUBLE / (60 + lr) AS score, CASE WHEN sr <= 10 THEN sr END AS sr, lr FROM shortest),
        final AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, sr NULLS LAST, lr, doc_id) AS r FROM fused)
        SELECT item_id, doc_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM final WHERE r <= 5""",
    "hash_embedding": """WITH t AS (SELECT item_id, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h FROM benchmark),
        m AS (SELECT item_id, (list_sum(list_transform(range(0, 7), lambda i: CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT))) * 256 + CAST('0x' || substr(h, 57, 8) AS BIGINT)) % 768 AS m FROM t)
        SELECT item_id, CAST(m % 384 AS BIGINT) AS slot, CAST(sum(CASE WHEN m < 384 THEN 1 ELSE -1 END) AS BIGINT) AS v FROM m GROUP BY item_id, m % 384 HAVING sum(CASE WHEN m < 384 THEN 1 ELSE -1 END) <> 0""",
    "quote_exact": f"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains({_MATCH.format('d.text')}, {_MATCH.format('b.text')})",
    "dedupe_content_hash": """WITH u AS (SELECT doc_id, source AS document_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS again FROM documents)
        SELECT doc_id, document_id, CASE WHEN again THEN 'skipped' ELSE 'new' END AS status, CASE WHEN NOT again THEN row_number() OVER (PARTITION BY document_id, again ORDER BY doc_id) END AS document_version FROM u""",
    "latest_version": """WITH v AS (SELECT event_id, user_id AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS document_version FROM events)
        SELECT *, document_version = max(document_version) OVER (PARTITION BY document_id) AS is_active FROM v""",
    "latest_status": """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "extract_numbers": f"SELECT doc_id, array_to_string({_NUMBERS}, ' ') AS numbers FROM documents WHERE len({_NUMBERS}) > 0",
    "unsupported_numbers": f"""WITH n AS (SELECT doc_id, text, {_NUMBERS} AS own FROM documents),
        j AS (
            SELECT d.doc_id, list_filter(regexp_extract_all(d.text, '{text.NUMBER_IN_ANSWER}'), lambda x: NOT regexp_matches(replace(x, ',', ''), '^(19|20)[0-9]{{2}}$')
                AND NOT list_contains(p.own, replace(x, ',', '')) AND NOT list_contains(p.own, regexp_replace(replace(x, ',', ''), '%+$', ''))) AS bad
            FROM n d JOIN n p ON p.doc_id + 1 = d.doc_id
        )
        SELECT doc_id, array_to_string(bad, ' ') AS unsupported FROM j WHERE len(bad) > 0""",
    "json_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL",
    "stream_dedupe": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "set_ops": """WITH l AS (SELECT doc_id FROM labels), d AS (SELECT doc_id FROM documents)
        SELECT 'both' AS part, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM (SELECT * FROM d INTERSECT SELECT * FROM l)
        UNION ALL SELECT 'unlabelled', count(*), CAST(sum(doc_id) AS BIGINT) FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM l)
        UNION ALL SELECT 'either', count(*), CAST(sum(doc_id) AS BIGINT) FROM (SELECT * FROM d UNION SELECT * FROM l)""",
}
ORACLE_SQL["hash_embedding_documents"] = ORACLE_SQL["hash_embedding"].replace("item_id", "doc_id").replace("FROM benchmark", "FROM documents")
ORACLE_SQL["retrieve_candidates"] = f"WITH {FACTS_SQL}, {_retrieved('true', True)} SELECT fact_id, cand_id, round(score, 6) AS score, r AS rank FROM retrieved"
ORACLE_SQL["compare_new_facts"] = f"""{CLASSIFIED}, {_retrieved("doc = 'review'", True)}
    SELECT r.fact_id AS fact_a_id, cand_id AS fact_b_id, coalesce(relation_type, 'needs_review') AS relation_type, coalesce(confidence, 0.3::DOUBLE) AS confidence, coalesce(reason, 'none') AS reason,
        CASE WHEN relation_type IS NULL THEN 'none' ELSE 'table' END AS source
    FROM retrieved r JOIN judged j ON j.fact_a_id = cand_id AND j.fact_b_id = r.fact_id"""
_SLOT = "(list_sum(list_transform(range(0, 7), lambda i: CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT))) * 256 + CAST('0x' || substr(h, 57, 8) AS BIGINT)) % 768"
#: The facts found for a question: ``ranked`` (id, rank), of ``texts``.
_QUESTION = f"""WITH {FACTS_SQL}, {_TEXTS},
    pool AS (SELECT * FROM texts WHERE entity = 'nation_7' AND (metric = 'revenue' OR contains(lower(m), 'revenue'))),
    said AS (SELECT unnest(['what', 'was', 'the', 'revenue', 'of', 'nation', '7', 'in', 'fy1996']) AS token),
    asked AS (SELECT token, 2 * count(*) AS qf FROM said GROUP BY ALL),
    shape AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM pool JOIN sizes USING (id)),
    frequency AS (SELECT token, count(*) AS df FROM words JOIN pool USING (id) GROUP BY token),
    scored AS (SELECT id, {_SCORE} AS score FROM words JOIN pool USING (id) JOIN asked USING (token) JOIN frequency USING (token) JOIN sizes USING (id), shape GROUP BY ALL),
    lexical AS (SELECT * FROM (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS lr FROM scored) WHERE lr <= 20),
    own AS (SELECT id, h % 384 AS slot, sum(CASE WHEN h < 384 THEN 1 ELSE -1 END) AS v FROM (
        SELECT id, {_SLOT} AS h FROM (SELECT id, sha256(unnest(regexp_extract_all(lower(concat_ws(' | ', e, m, val, u, p, sc, quote)), '[a-z0-9]+'))) AS h FROM pool)) GROUP BY ALL),
    question AS (SELECT h % 384 AS slot, sum(CASE WHEN h < 384 THEN 1 ELSE -1 END) AS v FROM (SELECT {_SLOT} AS h FROM (SELECT sha256(token) AS h FROM said)) GROUP BY ALL),
    close AS (
        SELECT id, sum(own.v * question.v)::DOUBLE / (any_value(l) * (SELECT sqrt(sum(v * v)::DOUBLE) FROM question)) AS c
        FROM own JOIN question USING (slot) JOIN (SELECT id, sqrt(sum(v * v)::DOUBLE) AS l FROM own GROUP BY id) USING (id) GROUP BY id
    ),
    near AS (SELECT * FROM (SELECT id, row_number() OVER (ORDER BY round(c, 9) DESC, id) AS vr FROM close WHERE c >= 0.45) WHERE vr <= 20),
    fused AS (SELECT id, vr, lr, coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0) AS score FROM near FULL JOIN lexical USING (id)),
    ranked AS (SELECT id, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, vr NULLS LAST, lr NULLS LAST, id) AS INT) AS rank FROM fused)
"""
ORACLE_SQL["question_facts"] = f"{_QUESTION} SELECT id, doc AS document_id, nullif(period, '') AS norm_period, rank FROM ranked JOIN pool USING (id) WHERE rank <= 8"
ORACLE_SQL["answer"] = f"""{_QUESTION},
    best AS (SELECT * FROM ranked JOIN pool USING (id) WHERE rank <= 8),
    told AS (SELECT string_agg('[' || id || '] ' || e || ' | ' || m || ' | ' || val || ' ' || u || ' | ' || p, chr(10) ORDER BY rank) FILTER (rank <= 5) AS lines, count(*) AS n FROM best)
    SELECT 'No model is available. Retrieved facts:' || chr(10) || lines AS answer, '' AS unsupported, CAST(n AS INT) AS n_cited FROM told"""
ORACLE_SQL["evidence_status"] = f"""WITH quoted AS (SELECT item_id AS fact_id, 'src' || item_id % 20 AS document_id, CAST(item_id % 50 + 1 AS BIGINT) AS claimed, {_MATCH.format("trim(text, ' ' || chr(9) || chr(10) || chr(13))")} AS q FROM benchmark), {_WINDOWS},
    numbered AS (SELECT source AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, {_MATCH.format("text")} AS t FROM documents),
    hits AS (SELECT fact_id, page, contains(t, q) AS exact, page = claimed AS right_ FROM windowed JOIN numbered USING (document_id) WHERE q <> '' AND len(list_filter(parts, lambda x: contains(t, x))) > 0),
    found AS (SELECT fact_id, bool_or(right_) AS right_, count(*) AS n, count_if(exact) AS n_exact, min(CASE WHEN exact THEN page END) AS exact_page, min(page) AS page FROM hits GROUP BY fact_id),
    judged AS (SELECT fact_id, document_id, claimed, CASE WHEN right_ THEN 1 ELSE coalesce(n, 0) END AS n_hits, CASE WHEN right_ THEN claimed WHEN n > 1 AND n_exact = 1 THEN exact_page ELSE page END AS page FROM windowed LEFT JOIN found USING (fact_id))
    SELECT fact_id, document_id, CASE WHEN page IS NULL THEN 'unverifiable' WHEN page = claimed THEN 'verified' ELSE 'flagged' END AS evidence_status, coalesce(page, claimed) AS page_no, n_hits FROM judged"""
ORACLE_SQL["quote_window"] = f"""WITH quoted AS (SELECT item_id, {_MATCH.format("trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))")} AS q FROM benchmark), {_WINDOWS}, d AS (SELECT doc_id, {_MATCH.format("text")} AS t FROM documents)
    SELECT item_id, doc_id, contains(t, q) AS exact FROM windowed JOIN d ON q <> '' AND (contains(t, q) OR len(list_filter(parts, lambda x: contains(t, x))) > 0)"""
ORACLE_SQL["html_pages"] = r"""
    WITH bare AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages),
    broken AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|title|section|article|ul|ol|table|nav|header|footer)\s*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM bare),
    decoded AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM broken),
    lines AS (SELECT page_id, replace(replace(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(160), ' '), chr(9), ' ') AS t FROM decoded),
    clean AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, ' +', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS t FROM lines)
    SELECT page_id, length(t) AS n_chars, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines FROM clean"""
_NUMBER = "regexp_replace(CAST(CAST({} AS DECIMAL(38, 6)) AS VARCHAR), '\\.?0+$', '')"
_LINE = "CASE WHEN w IS NULL THEN '' ELSE coalesce(metric, '') || ' = ' || concat_ws(' ', CASE WHEN w <> 0 THEN " + _NUMBER.format("w") + " END, unit) || coalesce(' (' || period || ')', '') END"
ORACLE_SQL["viewer_facts"] = f"""WITH {FACTS_SQL}, w AS (SELECT *, CASE WHEN (id // 100000) % 11 = 3 THEN 0 ELSE value END AS w FROM facts) SELECT id, {_LINE} AS line, basis FROM w"""
ORACLE_SQL["viewer_timeline"] = f"""WITH {FACTS_SQL} SELECT id, doc AS document_id, period, {_NUMBER.format('value')} AS value, unit, scope FROM facts WHERE entity = 'nation_7' AND metric = 'revenue' ORDER BY period, doc, id LIMIT 12"""
ORACLE_SQL["viewer_relations"] = f"""{CLASSIFIED}, {_TEXTS} SELECT fact_a_id, fact_b_id, CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS pct, CASE WHEN reason <> 'none' THEN replace(reason, '_', ' ') END AS reason,
    CASE WHEN (fact_a_id // 10) % 2 = 0 THEN quote ELSE 'seen: ' || quote END AS shown FROM judged JOIN texts ON id = fact_a_id WHERE relation_type IS NOT NULL"""
ORACLE_SQL["confidence_percent"] = f"""SELECT event_id, CASE WHEN event_id % 7 > 0 THEN CAST(floor(round(numeric_confidence, 4) * 100 + 0.5) AS BIGINT) END AS pct FROM ({_COERCED})"""
ORACLE_SQL["document_badges"] = "SELECT l_orderkey, count(*) + 1 > 7 AS is_large FROM lineitem GROUP BY ALL"
ORACLE_SQL["fact_lookup"] = f"WITH {FACTS_SQL} SELECT id, doc AS document_id, period AS norm_period, false AS is_active FROM facts WHERE id = 719961"
ORACLE_SQL["decision_counts"] = f"{CLASSIFIED} SELECT count(relation_type) AS by_table, count(*) - count(relation_type) AS by_model FROM judged"
ORACLE_SQL["page_counts"] = f"""WITH c AS ({ORACLE_SQL["candidate_docs"]}) SELECT source AS document_id, count(*) AS pages, count(c.doc_id) AS candidates, count(*) - count(c.doc_id) AS dropped FROM documents d LEFT JOIN c USING (doc_id) GROUP BY source"""
ORACLE_SQL["index_size"] = "SELECT count_if(len(embedding) > 0) AS size FROM embeddings"
