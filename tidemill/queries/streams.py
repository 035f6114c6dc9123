"""Streams over events, run over all that is there."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.queries import Tables, query
from tidemill.streaming import events as E
from tidemill.streaming import feeds as D

_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("x1_change_feed", "SELECT DISTINCT user_id, event_type FROM events")
def _(t: Tables) -> DataFrame:
    feed = E.changes(E.event_stream(t.spark, t.folder).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "40 days")
    return E.run_once(feed.select("user_id", "event_type"))


@query("x3_stage_states", "SELECT user_id, arg_max(event_type, epoch_us(ts)) AS event_type, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return E.run_once(E.stage_states(E.event_stream(t.spark, t.folder), "user_id", "event_type"), "update")


@query("x6_tumbling_windows", f"""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 6 HOUR, min(ts), TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= {_CLOSED}""")
def _(t: Tables) -> DataFrame:
    out = E.run_once(E.windowed(E.event_stream(t.spark, t.folder), "1 hour", "6 hours"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("x6_sliding_windows", f"""WITH w AS (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS start FROM events)
SELECT start, event_type, count(*) AS n FROM w WHERE start + INTERVAL 2 HOUR <= {_CLOSED} GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    out = E.run_once(E.windowed(E.event_stream(t.spark, t.folder), "1 hour", "2 hours", "1 hour"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("x6_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS c FROM events),
s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 3 HOUR <= {_CLOSED}""")
def _(t: Tables) -> DataFrame:
    out = E.run_once(E.sessions(E.event_stream(t.spark, t.folder), "1 hour", "3 hours"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("x4_continuation")
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    pages = t.documents.select(
        F.floor(d / 40).alias("doc_id"), d.alias("page"), F.when(d % 5 == 0, F.concat(F.lit("CG "), (d % 3).cast("string"))).alias("form"), F.col("source").alias("policy"),
        (d % 7 == 0).alias("header"), (d % 11 == 0).alias("explicit"), F.col("text").rlike(r"^\s*[a-z]").alias("mid_sentence"), (d % 13 == 0).alias("follows"),
        (d % 17 == 0).alias("continuity"), (d % 3 == 0).alias("strong_header"),
    )
    return E.continued(pages)


_KEEP, _BEAT, _AFTER = 4 * 86_400_000, 86_400_000, "2024-01-12 00:00:00"


def _work(events: DataFrame) -> DataFrame:
    item = F.concat(F.lit("i"), (F.col("event_id") % 3).cast("string"))
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("workflow"), F.col("event_id").alias("id"), item.alias("item"),
        F.col("event_type").alias("status"), (F.col("event_id") % 40 == 0).alias("terminal"),
    )


_FEED = f"""wm AS (SELECT epoch_ms(max(ts)) - 3600000 AS ms FROM events),
r AS (SELECT user_id AS workflow, epoch_us(ts) AS "at", event_id AS id, 'i' || (event_id % 3) AS item, event_type AS status, event_id % 40 = 0 AS terminal FROM events, wm WHERE epoch_us(ts) <= ms * 1000),
g AS (SELECT *, sum(CASE WHEN "at" - p > {_KEEP}000 THEN 1 ELSE 0 END) OVER (PARTITION BY workflow ORDER BY "at", id) AS run FROM (SELECT *, lag("at") OVER (PARTITION BY workflow ORDER BY "at", id) AS p FROM r)),
o AS (SELECT *, coalesce(bool_or(terminal) OVER (PARTITION BY workflow, run ORDER BY "at", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS over,
  row_number() OVER (PARTITION BY workflow, run, item, status ORDER BY "at", id) AS nth FROM g),
b AS (SELECT workflow, run, min("at") AS began, max("at") AS last, min("at") FILTER (WHERE terminal) AS fin FROM g GROUP BY workflow, run),
h AS (SELECT workflow, began + k * {_BEAT}000 AS "at" FROM b, wm, range(1, 60) t(k) WHERE began + k * {_BEAT}000 <= least(last + {_KEEP}000, ms * 1000) AND (fin IS NULL OR began + k * {_BEAT}000 < fin)),
f AS (SELECT workflow, 'change' AS kind, "at", id, item, status FROM o WHERE NOT over AND nth = 1
  UNION ALL SELECT workflow, 'end', "at", id, NULL, status FROM o WHERE terminal AND NOT over
  UNION ALL SELECT workflow, 'heartbeat', "at", NULL, NULL, NULL FROM h)"""


@query("x1_workflow_feed", f"WITH {_FEED} SELECT * FROM f")
def _(t: Tables) -> DataFrame:
    with D.state_provider(t.spark):
        return E.run_once(D.change_feed(_work(E.event_stream(t.spark, t.folder)), "1 hour", _KEEP, _BEAT))


@query("x1_snapshot_then_feed", f"""WITH {_FEED},
k AS (SELECT workflow, max("at") AS last FROM r WHERE "at" < epoch_us(TIMESTAMP '{_AFTER}') GROUP BY 1),
live AS (SELECT g.workflow, min(g.run) AS run FROM g JOIN k ON g.workflow = k.workflow AND g."at" = k.last GROUP BY 1)
SELECT o.workflow, 'snapshot' AS kind, "at", id, item, status FROM o JOIN live USING (workflow, run) WHERE NOT over AND nth = 1 AND "at" < epoch_us(TIMESTAMP '{_AFTER}')
UNION ALL SELECT f.* FROM f LEFT JOIN k USING (workflow) WHERE f.kind <> 'heartbeat' AND f."at" >= epoch_us(TIMESTAMP '{_AFTER}')
UNION ALL SELECT f.* FROM f LEFT JOIN k USING (workflow) WHERE f.kind = 'heartbeat' AND (k.last IS NULL OR f."at" > k.last)""")
def _(t: Tables) -> DataFrame:
    # Rows before a moment come as a table, those after it as a stream that goes on from the table's snapshot.
    known = D.snapshot(_work(t.events).where(F.col("ts") < _AFTER), _KEEP)
    stream = _work(E.event_stream(t.spark, t.folder)).where(F.col("ts") >= _AFTER)
    with D.state_provider(t.spark):
        told = E.run_once(D.change_feed(stream, "1 hour", _KEEP, _BEAT, known))
    return known.select("workflow", F.lit("snapshot").alias("kind"), "at", "id", "item", "status").unionByName(told)


@query("x2_expiring_dedup", f'''WITH {_FEED} SELECT workflow, item, status, count(*) AS n, min("at") AS first FROM f WHERE kind = 'change' GROUP BY ALL''')
def _(t: Tables) -> DataFrame:
    # A pair is told again once its workflow was silent for longer than it is kept.
    with D.state_provider(t.spark):
        told = E.run_once(D.change_feed(_work(E.event_stream(t.spark, t.folder)), "1 hour", _KEEP, _BEAT))
    return told.where("kind = 'change'").groupBy("workflow", "item", "status").agg(F.count("*").alias("n"), F.min("at").alias("first"))
