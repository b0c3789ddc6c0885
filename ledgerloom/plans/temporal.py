"""Queries over time: late rows, sessions, sliding windows, stream joins, job states, interval and as-of joins, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.asof import asof_join
from ledgerloom.operators.intervals import interval_join
from ledgerloom.plans.inputs import FACTS_SQL, facts, table
from ledgerloom.sources.storage import materialize, new_path
from ledgerloom.streaming import state_machine, windows

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
DELAY = "1 day"
#: An event's arrival, in microseconds: one in 13 comes three days late, one in 29 half a day.
ARRIVAL = "{} + CASE WHEN event_id % 13 = 0 THEN 259200000000 WHEN event_id % 29 = 0 THEN 43200000000 ELSE 0 END"
DELIVERY = "CAST(floor((" + ARRIVAL + ") / 432000000000) AS BIGINT)"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def accepted(spark: SparkSession, sf_dir: str) -> windows.Accepted:
    """The events as they arrive, in deliveries of five days each, split into those in time and late ones."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("delivery", F.expr(f"coalesce({DELIVERY.format('unix_micros(ts)')}, 0)"))
    rows = materialize(rows.select(*[c.split()[0] for c in EVENTS.split(", ")], "delivery"), "deliveries")
    split, folder = windows.Accepted(spark, EVENTS, DELAY), new_path(spark, "arrived")
    for (number,) in sorted(rows.select("delivery").distinct().collect()):  # one a five days
        rows.where(F.col("delivery") == number).drop("delivery").write.mode("append").parquet(folder)
        split.take(spark.readStream.schema(EVENTS).parquet(folder))
    return split


def _stamp(column: str) -> F.Column:
    return F.date_format(column, STAMP).alias(column)


def _measures() -> dict[str, F.Column]:
    return {"n": F.count(F.lit(1)), "total": F.sum("value")}


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with gaps under 30 minutes, of the events in time."""
    split = accepted(spark, sf_dir)
    found = windows.run_to_end(lambda: windows.sessions(split.stream(), ["user_id"], _measures()), split, "30 minutes", [{}], "sessions")
    return found.select("user_id", _stamp("session_start"), _stamp("session_end"), "n", F.round("total", 2).alias("total"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hours' counts by type, every two hours, of the events in time."""
    split = accepted(spark, sf_dir)
    found = windows.run_to_end(lambda: windows.sliding(split.stream(), ["event_type"], _measures()), split, "6 hours", [{}], "sliding")
    return found.select("event_type", _stamp("window_start"), "n", F.round("total", 2).alias("total"))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late events."""
    return accepted(spark, sf_dir).rows(late=True).select("event_id", "user_id", "event_type", _stamp("ts"))


def stream_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view in time, with the number of its user's purchases up to an hour later and the first of them."""
    split = accepted(spark, sf_dir)

    def build() -> DataFrame:
        first, then = (split.stream().where(F.col("event_type") == kind).select("event_id", "user_id", "ts") for kind in ("view", "purchase"))
        return windows.followed(first, then, "user_id")

    pairs = windows.run_to_end(build, split, "1 hour", [{"event_type": "view", "user_id": -1}, {"event_type": "purchase", "user_id": -2}], "followed")
    found = pairs.groupBy("event_id", "user_id").agg(F.count("then_event_id").alias("n_after"), F.min(F.struct("then_ts", "then_event_id")).alias("next"))
    return found.select("event_id", "user_id", "n_after", F.col("next.then_event_id").alias("next_id"))


#: Users stand for jobs, their events for what is said of them.
JOB_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'complete' END"


def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event in time did to its job, and the jobs that hung."""
    split = accepted(spark, sf_dir)

    def build() -> DataFrame:
        named = split.stream().select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").alias("at"), F.expr(JOB_STATUS).alias("status"))
        return state_machine.job_transitions(named)

    found = windows.run_to_end(build, split, "6 hours", [{"event_type": "view", "user_id": -1}], "jobs")
    return found.select("job_id", "event_id", F.date_format("at", STAMP).alias("happened_at"), "was", "status", "outcome")


def outage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside the outage that any error opens, for as many minutes as its value says."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    until = F.timestamp_micros(F.unix_micros("ts") + (F.col("value") * 60e6).cast("long"))
    outages = rows.where("event_type = 'error'").select(F.col("event_id").alias("outage_id"), F.col("ts").alias("since"), until.alias("until"))
    return interval_join(rows.select("event_id", "ts"), outages, "ts", "since", "until").select("event_id", "outage_id")


def version_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the version of its user's account: a signup opens one, which holds until the next."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    versions = rows.where("event_type = 'signup'").select("user_id", F.row_number().over(order).cast("long").alias("version"), F.col("ts").alias("since"), F.lead("ts").over(order).alias("until"))
    return interval_join(rows.select("event_id", "user_id", "ts"), versions, "ts", "since", "until", ["user_id"], how="left").select("event_id", "user_id", "version")


def restatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stated value with the one last published before it for the same entity, metric and period, in cents."""
    cents = F.round(F.col("norm_value") * 100).cast("long").alias("cents")
    day = F.expr("timestamp_seconds(86400 * (id % 10))").alias("published")  # documents are published in the order of their numbers
    stated = facts(spark, sf_dir).where("norm_value IS NOT NULL").select("id", "norm_entity", "norm_metric", "norm_period", cents, day)
    keys = ["norm_entity", "norm_metric", "norm_period"]
    found = asof_join(stated, stated, keys, "published", ["id"], strictly=True)
    return found.select("id", "cents", "last_id", (F.col("cents") - F.col("last_cents")).alias("revision"))


def price_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line's unit price with that of the part's last earlier line."""
    lines = table(spark, sf_dir, "lineitem")
    # whole hundredths of a cent, so that both engines divide alike
    price = F.expr("cast(round(l_extendedprice * 100) AS bigint) * 100 div cast(l_quantity AS bigint)")
    rows = lines.select("l_partkey", F.col("l_shipdate").cast("timestamp").alias("shipped"), "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), price.alias("price"))
    found = asof_join(rows, rows, ["l_partkey"], "shipped", ["l_orderkey", "l_linenumber"], strictly=True, span=365 * 86400)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "price", "last_l_orderkey", (F.col("price") - F.col("last_price")).alias("revision"))


QUERIES = {f.__name__: f for f in (stream_sessions, stream_sliding, stream_late, stream_followed, stream_jobs, outage_events, version_at_event, restatements, price_revisions)}

_GOOD = f"""
WITH d AS (SELECT *, coalesce({DELIVERY.format("epoch_us(ts)")}, 0) AS delivery FROM events),
bounds AS (SELECT delivery, max(m) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM (SELECT delivery, max(ts) AS m FROM d GROUP BY delivery)),
marked AS (SELECT d.*, ts IS NULL OR coalesce(ts < newest - INTERVAL 1 DAY, false) AS late FROM d JOIN bounds USING (delivery)),
good AS (SELECT * FROM marked WHERE NOT late)
"""


def _text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {column}"


ORACLE_SQL = {
    "stream_sessions": f"""{_GOOD},
        gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM good WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM gaps),
        found AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 2) AS total FROM numbered GROUP BY user_id, s)
        SELECT user_id, {_text("session_start")}, {_text("session_end")}, n, total FROM found""",
    "stream_sliding": f"""{_GOOD},
        spread AS (SELECT *, make_timestamp(CAST(7200000000 * (epoch_us(ts) // 7200000000 - unnest([0, 1, 2])) AS BIGINT)) AS window_start FROM good),
        found AS (SELECT event_type, window_start, count(*) AS n, round(sum(value), 2) AS total FROM spread GROUP BY ALL)
        SELECT event_type, {_text("window_start")}, n, total FROM found""",
    "stream_late": f"{_GOOD} SELECT event_id, user_id, event_type, {_text('ts')} FROM marked WHERE late",
    "stream_followed": f"""{_GOOD},
        pairs AS (SELECT v.event_id, v.user_id, p.event_id AS p_id, p.ts AS p_ts FROM good v LEFT JOIN good p ON p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view')
        SELECT event_id, user_id, count(p_id) AS n_after, arg_min(p_id, {{'t': p_ts, 'i': p_id}}) AS next_id FROM pairs GROUP BY ALL""",
    "stream_jobs": f"""{_GOOD.replace("WITH d", "WITH RECURSIVE d")},
        said AS (SELECT user_id AS job_id, event_id, ts, {JOB_STATUS} AS status FROM good WHERE user_id IS NOT NULL),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, list_position(['queued', 'running', 'failed', 'complete'], status), event_id) AS k FROM said),
        legal AS (SELECT unnest([{", ".join(f"'{a or ''}:{b}'" for a, bs in state_machine.LEGAL.items() for b in bs)}]) AS step),
        run AS (
            SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS was, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS outcome,
                CAST(NULL AS VARCHAR) AS state, CAST(NULL AS TIMESTAMP) AS since, CAST(NULL AS TIMESTAMP) AS hung FROM ordered
            UNION ALL
            SELECT job_id, k, event_id, ts, was, status, outcome, CASE WHEN outcome = 'ok' THEN status ELSE was END, CASE WHEN outcome = 'ok' THEN ts ELSE since END, hung FROM (
                SELECT *, CASE WHEN status = was THEN 'repeated' WHEN coalesce(was, '') || ':' || status IN (SELECT step FROM legal) THEN 'ok' ELSE 'illegal' END AS outcome FROM (
                    SELECT o.job_id, o.k, o.event_id, o.ts, o.status, CASE WHEN r.state = 'running' AND r.since + INTERVAL 6 HOUR < o.ts THEN 'stuck' ELSE r.state END AS was,
                        r.since, CASE WHEN r.state = 'running' AND r.since + INTERVAL 6 HOUR < o.ts THEN r.since + INTERVAL 6 HOUR END AS hung
                    FROM run r JOIN ordered o ON o.job_id = r.job_id AND o.k = r.k + 1
                )
            )
        ),
        last AS (SELECT job_id, arg_max(state, k) AS state, arg_max(since, k) AS since FROM run GROUP BY job_id),
        found AS (
            SELECT job_id, event_id, ts AS happened, was, status, outcome FROM run WHERE k > 0
            UNION ALL SELECT job_id, NULL, hung, 'running', 'stuck', 'stuck' FROM run WHERE hung IS NOT NULL
            UNION ALL SELECT job_id, NULL, since + INTERVAL 6 HOUR, 'running', 'stuck', 'stuck' FROM last WHERE state = 'running'
        )
        SELECT job_id, event_id, strftime(happened, '%Y-%m-%d %H:%M:%S.%f') AS happened_at, was, status, outcome FROM found""",
    "outage_events": """WITH o AS (SELECT event_id AS outage_id, epoch_us(ts) AS since, epoch_us(ts) + CAST(trunc(value * 60e6) AS BIGINT) AS until FROM events WHERE event_type = 'error')
        SELECT event_id, outage_id FROM events JOIN o ON epoch_us(ts) >= since AND epoch_us(ts) < until""",
    "version_at_event": """WITH v AS (SELECT user_id, row_number() OVER w AS version, ts AS since, lead(ts) OVER w AS until FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, e.user_id, version FROM events e LEFT JOIN v ON v.user_id = e.user_id AND ts >= since AND (until IS NULL OR ts < until)""",
    "restatements": f"""WITH {FACTS_SQL}, c AS (SELECT id, entity, metric, period, CAST(round(value * 100) AS BIGINT) AS cents FROM facts WHERE value IS NOT NULL)
        SELECT id, cents, lag(id) OVER w AS last_id, cents - lag(cents) OVER w AS revision FROM c WINDOW w AS (PARTITION BY entity, metric, period ORDER BY id % 10, id)""",
    "price_revisions": """WITH p AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_shipdate, CAST(round(l_extendedprice * 100) AS BIGINT) * 100 // CAST(l_quantity AS BIGINT) AS price FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, price, lag(l_orderkey) OVER w AS last_l_orderkey, price - lag(price) OVER w AS revision FROM p WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber)""",
}
