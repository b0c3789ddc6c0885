"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import iblt, jaccard, line_dedup, media, ordered_packing, packing, pieces, prefix_trie, quality, secret_scan, structure_repair, url_lists, warc
from ledgerloom.llm.runtime import documents

BPE = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP2_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (
    SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM payloads
),
named AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) % 32, 1)), '') AS payload_digest
    FROM digests
),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM firsts
"""


def op3_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), BPE, BPE_RANKS)


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures with a fetch day: the table has none, so the page id gives a day of 2024."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(page_id % 366 AS int))").alias("fetched"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages: for each host up to five entries, days and actions from its MD5."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("key")).where("key IS NOT NULL").distinct()
    digit = "cast(conv(substr(md5(key), {}, {}), 16, 10) AS int)"
    entries = hosts.select("key", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    return entries.where(f"{digit.format('i + 1', 1)} % 3 > 0").select(
        "key",
        F.expr(f"date_add(DATE'2023-12-15', {digit.format('i * 3 + 6', 3)} % 400)").alias("day"),
        F.expr(f"if({digit.format('i + 1', 1)} % 3 = 1, 'add', 'remove')").alias("action"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_lists.evaluate(dated_captures(pages), dated_entries(pages))


OP5_SQL = r"""
WITH captures AS (
    SELECT page_id, lower(url) AS url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS TIMESTAMP) AS fetched,
        nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
        regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS segment
    FROM pages
),
picks AS (
    SELECT host AS key, CAST('0x' || substr(md5(host), i + 1, 1) AS INT) AS pick,
        CAST('0x' || substr(md5(host), i * 3 + 6, 3) AS INT) AS shift
    FROM (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL), (SELECT unnest(range(0, 5)) AS i)
),
states AS (
    SELECT key, CAST(DATE '2023-12-15' + CAST(shift % 400 AS INT) AS TIMESTAMP) AS since, bool_or(pick % 3 = 1) AS listed
    FROM picks WHERE pick % 3 > 0 GROUP BY ALL
),
changes AS (
    SELECT * FROM (SELECT *, lag(listed) OVER (PARTITION BY key ORDER BY since) AS was FROM states)
    WHERE listed <> coalesce(was, false)
),
spans AS (
    SELECT key, since, until FROM (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM changes) WHERE listed
),
labels AS (SELECT *, string_split(host, '.') AS parts FROM captures WHERE host IS NOT NULL),
asked AS (
    SELECT DISTINCT page_id, url, fetched, key FROM (
        SELECT page_id, url, fetched, array_to_string(list_slice(parts, CAST(i AS INT), len(parts)), '.') AS key
        FROM labels, LATERAL (SELECT unnest(range(1, greatest(len(parts), 2))) AS i)
        UNION ALL SELECT page_id, url, fetched, host || '/' || segment FROM labels WHERE segment <> ''
    )
),
best AS (
    SELECT a.page_id, max_by({'k': a.key, 's': s.since, 'u': s.until}, length(a.key)) AS b
    FROM asked a JOIN spans s ON a.key = s.key AND a.fetched >= s.since AND (s.until IS NULL OR a.fetched < s.until)
    GROUP BY a.page_id
)
SELECT c.page_id, host, CAST(fetched AS DATE) AS fetched_on, b IS NOT NULL AS listed, b.k AS list_key,
    CAST(b.s AS DATE) AS listed_since, CAST(b.u AS DATE) AS listed_until
FROM captures c LEFT JOIN best USING (page_id)
"""


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"), counts=True)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(documents(spark, sf_dir), PIECES, keep_ids=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


#: CRC-32 of an ASCII text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda x, b: list_reduce(list_concat([xor(x, b)], range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))))"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(conversations(spark, sf_dir))


OP11_SQL = f"""
WITH kept AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS turns FROM kept GROUP BY conv_id
),
shared AS (SELECT *, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS base FROM own),
made AS (
    SELECT a.conv_id AS c, list_concat(coalesce(b.turns, [])[1:h], a.turns[h + 1:]) AS turns FROM shared a LEFT JOIN own b ON b.conv_id = a.base
),
prefixes AS (SELECT c, turns, CAST(unnest(range(0, len(turns) + 1)) AS BIGINT) AS depth FROM made),
nodes AS (
    SELECT depth, turns[1:depth] AS prefix, min(c) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(turns) = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY ALL
),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
children AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL),
counted AS (
    SELECT l.*, coalesce(k.n, 0) AS n_children,
        CASE WHEN l.depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(prefix[l.depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own_saved
    FROM linked l LEFT JOIN children k ON k.depth = l.depth AND k.conv_id = l.conv_id
),
up AS (SELECT prefix[1:d] AS prefix, n_children, own_saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted)),
sums AS (SELECT prefix, count_if(n_children = 0) AS n_leaves, CAST(sum(own_saved) AS BIGINT) AS saved_tokens FROM up GROUP BY prefix)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, saved_tokens, ends_sha256 FROM counted JOIN sums USING (prefix)
"""


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repaired(conversations(spark, sf_dir))


def _repair_sql() -> str:
    """The repair as a dynamic program over rows: a layer holds the best (cost, audit) of each state of the roles' grammar."""

    def step(state: str, cost: str, letter: str, when: str = "true") -> str:
        return f"CASE WHEN {when} AND {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}} END"

    def least(*states: str) -> str:
        return f"list_min([{', '.join(states)}])"

    inserted = {
        "t0": "s0",
        "t1": "s1",
        "t2": least("s2", step("s0", "3", "I"), step("s1", "3", "I"), step("s3", "3", "I")),
        "t3": least("s3", step(least("s2", step("s0", "3", "I"), step("s1", "3", "I"), step("s3", "3", "I")), "3", "I")),
    }
    sound, extra = "f NOT IN ('b', 'd')", "CASE WHEN f = 't' THEN 3 ELSE 0 END"

    def deleted(state: str) -> str:
        return step(state, "4", "D")

    def rerolled(state: str) -> str:
        return step(state, f"3 + {extra}", "R", sound)

    def kept(state: str, initial: str) -> str:
        return step(state, extra, "K", f"{sound} AND i = '{initial}'")

    following = [
        deleted("t0"),
        least(deleted("t1"), kept("t0", "s")),
        least(deleted("t2"), rerolled("t0"), rerolled("t1"), rerolled("t3"), kept("t0", "u"), kept("t1", "u"), kept("t3", "u")),
        least(deleted("t3"), rerolled("t2"), kept("t2", "a")),
    ]
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR))"
    return f"""
WITH RECURSIVE known AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM known
),
faulted AS (
    SELECT *, CASE WHEN role = '' THEN ' ' ELSE substr(role, 1, 1) END AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE ' ' END AS f
    FROM damaged
),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), f = 'd') AS k FROM faulted),
sums AS (
    SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(f = 'b') AS blank, count_if(f = 'd') AS duplicate, count_if(f = 't') AS truncated, max(k) AS n
    FROM rows_ GROUP BY conv_id
),
pairs AS (SELECT conv_id, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i AS pair FROM rows_) GROUP BY conv_id),
layers AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS k, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS t0, {none} AS t1, {{'c': CAST(3 AS BIGINT), 'a': 'I'}} AS t2, {{'c': CAST(6 AS BIGINT), 'a': 'II'}} AS t3 FROM sums
    UNION ALL
    SELECT conv_id, k, {', '.join(inserted.values())} FROM (
        SELECT r.conv_id, r.k, {', '.join(f"{x} AS s{n}" for n, x in enumerate(following))} FROM layers l JOIN rows_ r ON r.conv_id = l.conv_id AND r.k = l.k + 1
    )
),
best AS (SELECT l.conv_id, list_min([t0, t3]) AS b FROM layers l JOIN sums s ON s.conv_id = l.conv_id AND l.k = s.n),
letters AS (SELECT conv_id, unnest(string_split(b.a, '')) AS x, unnest(range(1, length(b.a) + 1)) AS p FROM best WHERE b.a <> ''),
placed AS (
    SELECT conv_id, x, p, count_if(x <> 'I') OVER w AS k, count_if(x <> 'D') OVER w AS j FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)
),
roled AS (
    SELECT q.conv_id, p, x, r.role, r.text, j - max(CASE WHEN x = 'K' AND r.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS j
    FROM placed q LEFT JOIN rows_ r ON r.conv_id = q.conv_id AND r.k = q.k AND q.x <> 'I' WHERE x <> 'D'
),
repaired AS (
    SELECT conv_id, string_agg(CASE x WHEN 'K' THEN role ELSE CASE WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM roled GROUP BY conv_id
)
SELECT c.conv_id, {', '.join(f'CAST(coalesce({x}, 0) AS BIGINT) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, coalesce(b.c, 0) AS cost,
    coalesce(b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums USING (conv_id) LEFT JOIN pairs USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""


OP12_SQL = _repair_sql()


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_packing.pack_in_order(documents(spark, sf_dir), WORDS)


QUERIES = {f.__name__: f for f in (op1_media, op2_warc, op3_iblt, op4_packing, op5_url_filters, op6_jaccard, op7_line_dedup, op8_secrets, op9_sentencepiece, op10_quality, op11_prefix_trie, op12_structure_repair, op13_packing)}
ORACLE_SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op5_url_filters": OP5_SQL, "op11_prefix_trie": OP11_SQL, "op12_structure_repair": OP12_SQL}
