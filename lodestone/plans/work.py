"""Work queues, readiness, change events and their consumers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import ledgers, queues
from lodestone.plans.registry import query

_JOBS = "jobs AS (SELECT o_orderkey AS asset, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'queued' ELSE 'error' END AS state, CAST(o_custkey % 5 AS INTEGER) AS attempts, strftime(o_orderdate, '%Y%m%d') AS captured, o_orderpriority AS priority FROM orders)"


def _jobs(t):
    state = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "queued").otherwise("error")
    return t.orders.select(F.col("o_orderkey").alias("asset"), state.alias("state"), (F.col("o_custkey") % 5).cast("int").alias("attempts"), F.date_format("o_orderdate", "yyyyMMdd").alias("captured"), F.col("o_orderpriority").alias("priority"))


@query("queue_counts", f"WITH {_JOBS} SELECT state, count(*) AS jobs, count(*) FILTER (attempts >= 3) AS exhausted FROM jobs GROUP BY state")
def _(t):
    return _jobs(t).groupBy("state").agg(F.count(F.lit(1)).alias("jobs"), F.count(F.when(F.col("attempts") >= 3, 1)).alias("exhausted"))


@query("pending_jobs", f"WITH {_JOBS} SELECT asset FROM jobs WHERE state IN ('queued', 'running') OR state = 'error' AND attempts < 3")
def _(t):
    return _jobs(t).filter(queues.pending()).select("asset")


@query("queue_next", f"WITH {_JOBS} SELECT asset, priority FROM jobs WHERE state = 'queued' ORDER BY priority, captured DESC, asset LIMIT 16")
def _(t):
    return _jobs(t).filter("state = 'queued'").orderBy("priority", F.desc("captured"), "asset").limit(16).select("asset", "priority")


@query("index_queue_order", f"WITH {_JOBS} SELECT asset FROM jobs WHERE state = 'error' AND attempts < 3 ORDER BY captured DESC, asset LIMIT 1")
def _(t):
    return _jobs(t).filter("state = 'error' AND attempts < 3").orderBy(F.desc("captured"), "asset").limit(1).select("asset")


@query("readiness_view", f"WITH {_JOBS} SELECT j.asset FROM jobs j WHERE j.state = 'queued' AND j.asset IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '0-PREVIEW')")
def _(t):
    previews = t.orders.filter("o_orderpriority = '0-PREVIEW'").limit(1).agg(F.count(F.lit(1)).alias("waiting"))  # one row
    done = t.lineitem.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("asset"))
    return _jobs(t).filter("state = 'queued'").join(done, "asset", "left_semi").join(F.broadcast(previews)).filter("waiting = 0").select("asset")


@query("pending_minus_failed", "SELECT o_orderkey AS asset FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.07) ORDER BY o_orderdate DESC, o_orderkey LIMIT 16")
def _(t):
    failed = t.lineitem.filter("l_tax > 0.07").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.filter("o_orderstatus = 'O'").join(failed, "o_orderkey", "left_anti").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(16).select(F.col("o_orderkey").alias("asset"))


@query("latest_superseded", "SELECT o_custkey AS asset, o_orderkey AS generation FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 2")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    return t.orders.withColumn("n", F.row_number().over(w)).filter("n = 2").select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("generation"))


@query("superseded_count", "SELECT o_custkey AS asset, CAST(greatest(count(*) - 2, 0) AS BIGINT) AS removable FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.col("o_custkey").alias("asset")).agg(F.greatest(F.count(F.lit(1)) - 2, F.lit(0)).cast("long").alias("removable"))


@query("generations_keep", "SELECT o_orderkey AS generation FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3 OR o_orderkey IN (1, 2)")
def _(t):
    newest = t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(3)
    return newest.unionByName(t.orders.filter("o_orderkey IN (1, 2)")).select(F.col("o_orderkey").alias("generation")).distinct()


@query("publish_if_present", "SELECT l_orderkey AS asset, count(*) AS units FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def _(t):
    jobs = t.orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(jobs, "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("asset")).agg(F.count(F.lit(1)).alias("units"))


@query("stale_signature_drop", "SELECT l_orderkey AS asset, l_linenumber AS unit FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 7 + 1")
def _(t):
    current = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7 + 1).cast("int").alias("l_linenumber"))
    return t.lineitem.join(current, ["l_orderkey", "l_linenumber"], "left_semi").select(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("unit"))


@query("exists_frame_one", "SELECT o_orderkey AS asset FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 5)")
def _(t):
    return t.orders.join(t.lineitem.filter("l_linenumber = 5"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_orderkey").alias("asset"))


@query("jobs_left_media", "SELECT o_orderkey AS asset, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def _(t):
    media = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return t.orders.join(media, "o_custkey", "left").select(F.col("o_orderkey").alias("asset"), "name")


@query("job_sync_diff", "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'removed' WHEN o_orderkey % 11 = 0 THEN 'changed' ELSE 'same' END AS action, count(*) AS jobs FROM orders GROUP BY 1")
def _(t):
    base = t.orders.select(F.col("o_orderkey").alias("asset"), F.col("o_orderstatus").alias("state"))
    old = base.filter("asset % 5 <> 0")
    new = base.filter("asset % 5 = 0 OR asset % 7 <> 0").withColumn("state", F.when(F.col("asset") % 11 == 0, "X").otherwise(F.col("state")))
    return ledgers.differences(old, new, "asset", ["state"]).groupBy("action").agg(F.count(F.lit(1)).alias("jobs"))


@query("unchanged_files", "SELECT o_orderkey AS asset, o_custkey % 2 = 0 AND o_orderstatus = 'F' AS unchanged FROM orders")
def _(t):
    seen = t.orders.select(F.col("o_orderkey").alias("asset"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("signature"), F.col("o_orderstatus").alias("state"))
    now = t.orders.select(F.col("o_orderkey").alias("asset"), F.col("o_custkey").alias("found"))
    return now.join(seen, "asset", "left").select("asset", (F.col("found").eqNullSafe(F.col("signature")) & (F.col("state") == "F")).alias("unchanged"))


@query("preview_stage_plan", f"WITH {_JOBS} SELECT asset, CASE attempts WHEN 0 THEN 'thumbnail' WHEN 1 THEN 'coarse' WHEN 2 THEN 'dense' ELSE 'done' END AS stage FROM jobs")
def _(t):
    return _jobs(t).select("asset", queues.stage(F.col("attempts")).alias("stage"))


@query("cdc_collapse", "SELECT user_id AS asset, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy(F.col("user_id").alias("asset")).agg(F.max(F.struct("event_id", "event_type")).alias("m")).select("asset", F.col("m.event_type").alias("last_type"))


@query("event_batch", "SELECT event_id AS sequence, user_id AS asset FROM events WHERE event_id > 300 ORDER BY event_id LIMIT 256")
def _(t):
    return t.events.filter("event_id > 300").orderBy("event_id").limit(256).select(F.col("event_id").alias("sequence"), F.col("user_id").alias("asset"))


@query("log_compaction", "SELECT count(*) AS kept, min(event_id) AS anchor FROM events WHERE event_id >= 4000")
def _(t):
    return queues.compacted(t.events, "event_id", 4000).agg(F.count(F.lit(1)).alias("kept"), F.min("event_id").alias("anchor"))


@query("changed_keys", "SELECT DISTINCT asset FROM (SELECT user_id AS asset FROM events WHERE event_type = 'error' UNION ALL SELECT user_id + 1 FROM events WHERE event_type = 'error')")
def _(t):
    errors = t.events.filter("event_type = 'error'")
    return errors.select(F.explode(F.array(F.col("user_id"), F.col("user_id") + 1)).alias("asset")).distinct()


@query("second_level_events", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def _(t):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("event_type"))).select("event_id")


@query("arrival_assign", "SELECT user_id AS asset, min(event_id) AS arrival FROM events GROUP BY user_id")
def _(t):
    known = t.events.filter("event_id <= 5000").groupBy(F.col("user_id").alias("asset")).agg(F.min("event_id").alias("arrival"))
    later = t.events.filter("event_id > 5000").groupBy(F.col("user_id").alias("asset")).agg(F.min("event_id").alias("arrival"))
    return known.unionByName(later.join(known.select("asset"), "asset", "left_anti"))


@query("quiet_window_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR GROUP BY user_id")
def _(t):
    return queues.sessions(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 6 * 3600).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("ttl_signal", "SELECT count(*) AS live FROM events WHERE ts + INTERVAL 15 DAY >= (SELECT max(ts) FROM events)")
def _(t):
    latest = t.events.agg(F.max("ts").alias("latest"))  # one row
    return t.events.select("ts").join(F.broadcast(latest)).filter(F.col("ts") + F.expr("INTERVAL 15 DAY") >= F.col("latest")).agg(F.count(F.lit(1)).alias("live"))


@query("distinct_assets", "SELECT DISTINCT user_id AS asset FROM events")
def _(t):
    return t.events.select(F.col("user_id").alias("asset")).distinct()


@query("max_coalesce", "SELECT COALESCE(max(event_id), 0) AS last, COALESCE((SELECT max(event_id) FROM events WHERE event_type = 'none'), 0) AS none FROM events")
def _(t):
    return t.events.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("last"), F.coalesce(F.max(F.when(F.col("event_type") == "none", F.col("event_id"))), F.lit(0)).alias("none"))


@query("frames_collected", "WITH {frames} SELECT asset, list(frame ORDER BY secs, frame) AS frames FROM frames GROUP BY asset")
def _(t):
    return t.frames.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("secs", "frame"))).alias("s")).select("asset", F.col("s.frame").alias("frames"))


@query("seed_ordinals", "SELECT l_orderkey AS asset, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ordinal FROM lineitem")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return t.lineitem.select(F.col("l_orderkey").alias("asset"), "l_linenumber", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))
