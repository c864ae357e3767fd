"""Audit, retention, copies, imports, suppression and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import ledgers
from lodestone.operators.ranking import first_per
from lodestone.plans.registry import REGISTRY, query


@query("content_dedup", "SELECT 'sha256:' || sha256(text) AS content, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))


@query("suppression", "SELECT DISTINCT sha256(text) AS content FROM documents WHERE doc_id % 2 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)")
def _(t):
    content = t.documents.select("doc_id", F.sha2("text", 256).alias("content"))
    return content.filter("doc_id % 2 = 0").join(content.filter("doc_id % 2 = 1"), "content", "left_anti").select("content").distinct()


@query("duplicate_candidates", "SELECT content, min(doc_id) AS first FROM (SELECT sha256(text) AS content, doc_id FROM documents UNION ALL SELECT sha256(text), item_id + 1000000 FROM benchmark) GROUP BY content")
def _(t):
    journal = t.documents.select(F.sha2("text", 256).alias("content"), "doc_id")
    catalogue = t.benchmark.select(F.sha2("text", 256).alias("content"), (F.col("item_id") + 1000000).alias("doc_id"))
    return first_per(journal.unionByName(catalogue), "content", "doc_id").select("content", F.col("doc_id").alias("first"))


_DIGEST = """WITH h AS (SELECT sha256(CAST(c_custkey AS VARCHAR) || chr(31) || c_name || chr(31) || c_mktsegment) AS d FROM customer)
SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(d, 1, 8)) AS BIGINT)) AS VARCHAR) AS part0, CAST(sum(CAST(('0x' || substr(d, 9, 8)) AS BIGINT)) AS VARCHAR) AS part1 FROM h"""


@query("snapshot_digest", _DIGEST)
def _(t):
    return ledgers.digest(t.customer, "c_custkey", "c_name", "c_mktsegment")


@query("copy_verify", "SELECT 0 AS missing, count(*) FILTER (p_partkey % 100 = 0) AS extra FROM part")
def _(t):
    part = t.part.select("p_partkey", "p_name")
    return ledgers.same_rows(part, part.unionByName(part.filter("p_partkey % 100 = 0"))).select(F.col("missing").cast("int").alias("missing"), "extra")


@query("frames_match", "SELECT l_orderkey AS asset FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS f FROM lineitem GROUP BY 1) WHERE f = [1, 2, 3]")
def _(t):
    frames = t.lineitem.groupBy(F.col("l_orderkey").alias("asset")).agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("last"), F.countDistinct("l_linenumber").alias("d"))
    return frames.filter("n = 3 AND d = 3 AND last = 3").select("asset")


@query("retention_tiers", """WITH s AS (SELECT event_id AS file, ts AS created, (SELECT max(ts) FROM events) - INTERVAL 10 DAY AS now FROM events), p AS (SELECT * FROM s WHERE created <= now)
SELECT DISTINCT file FROM (SELECT file FROM s WHERE created > now UNION ALL SELECT file FROM (SELECT file, row_number() OVER (ORDER BY created DESC, file) AS n FROM p) WHERE n <= 3
UNION ALL SELECT file FROM (SELECT file, row_number() OVER (PARTITION BY date_trunc('hour', created) ORDER BY created DESC, file) AS n FROM p WHERE created >= now - INTERVAL 24 HOUR) WHERE n = 1
UNION ALL SELECT file FROM (SELECT file, row_number() OVER (PARTITION BY date_trunc('day', created) ORDER BY created DESC, file) AS n FROM p WHERE created >= now - INTERVAL 30 DAY) WHERE n = 1
UNION ALL SELECT file FROM (SELECT file, row_number() OVER (PARTITION BY date_trunc('month', created) ORDER BY created DESC, file) AS n FROM p WHERE created >= now - INTERVAL 12 MONTH) WHERE n = 1)""")
def _(t):
    return _retained(t, t.events)


def _retained(t, events):
    now = t.events.agg(F.date_format(F.max("ts") - F.expr("INTERVAL 10 DAY"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    return ledgers.retained(events.select(F.col("event_id").alias("file"), F.col("ts").cast("timestamp").alias("created")), now)


# another name of the same query
@query("retention_tiers_all", REGISTRY["retention_tiers"][1])
def _(t):
    return _retained(t, t.events)


@query("forget_cascade", "SELECT 'lines' AS tab, count(*) AS rows FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT 'files', count(*) FROM orders WHERE o_orderkey % 10 <> 0")
def _(t):
    gone = t.orders.filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("asset"))
    left = ledgers.forget({"lines": t.lineitem.withColumnRenamed("l_orderkey", "asset"), "files": t.orders.withColumnRenamed("o_orderkey", "asset")}, gone, "asset")
    counts = [frame.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("rows")) for name, frame in left.items()]
    return counts[0].unionByName(counts[1])


@query("register_import", "SELECT CASE WHEN c.content IS NULL THEN 'new' ELSE 'known' END AS action, count(*) AS items FROM (SELECT sha256(text) AS content FROM conversations) v LEFT JOIN (SELECT DISTINCT sha256(text) AS content FROM documents) c ON v.content = c.content GROUP BY 1")
def _(t):
    known = t.documents.select(F.sha2("text", 256).alias("content")).distinct().withColumn("seen", F.lit(True))
    found = t.conversations.select(F.sha2("text", 256).alias("content")).join(known, "content", "left")
    return found.groupBy(F.when(F.col("seen").isNull(), "new").otherwise("known").alias("action")).agg(F.count(F.lit(1)).alias("items"))


@query("missing_artifacts", "SELECT o_orderkey AS asset FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("asset"))


@query("failure_bound", "SELECT o_orderkey AS asset, CAST(least(o_custkey % 5 + 1, 3) AS BIGINT) AS attempts, o_custkey % 5 + 1 >= 3 AS final FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    tries = F.col("o_custkey") % 5 + 1
    return t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("asset"), F.least(tries, F.lit(3)).cast("long").alias("attempts"), (tries >= 3).alias("final"))


@query("mirror_if_changed", "SELECT n_nationkey AS id, n_name || '!' AS name FROM nation WHERE n_regionkey = 2")
def _(t):
    mine = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    source = t.nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 2, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")).alias("name"))
    return source.exceptAll(mine)


@query("retire_eligible", "SELECT l_orderkey AS asset FROM lineitem GROUP BY 1 HAVING min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND bool_and(l_linestatus = 'F')")
def _(t):
    units = t.lineitem.groupBy(F.col("l_orderkey").alias("asset")).agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("z"), F.count(F.lit(1)).alias("n"), F.every(F.col("l_linestatus") == "F").alias("ok"))
    return units.filter("a = 1 AND z = n AND ok").select("asset")


@query("pinned_cleanup", "SELECT p_partkey AS generation FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey NOT IN (SELECT ps FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_returnflag = 'N' AND l_tax > 0.07))")
def _(t):
    pins = t.lineitem.filter("l_quantity > 49").select("l_partkey").unionByName(t.lineitem.filter("l_returnflag = 'N' AND l_tax > 0.07").select("l_partkey"))
    return t.part.join(pins, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.col("p_partkey").alias("generation"))


@query("metadata_merge", "SELECT c_custkey AS asset, CASE WHEN c_custkey % 3 = 0 THEN 'cloud' ELSE c_mktsegment END AS source, c_name AS kept FROM customer")
def _(t):
    stored = t.customer.select(F.col("c_custkey").alias("asset"), F.struct(F.col("c_mktsegment").alias("source"), F.col("c_name").alias("kept")).alias("unit"))
    fresh = stored.withColumn("unit", F.when(F.col("asset") % 3 == 0, F.col("unit").withField("source", F.lit("cloud"))).otherwise(F.col("unit")))
    return fresh.select("asset", "unit.source", "unit.kept")


@query("unit_reuse", "SELECT l_orderkey AS asset, l_linenumber AS unit, s_suppkey IS NOT NULL AS reused FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0")
def _(t):
    artifacts = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("there"))
    return t.lineitem.join(artifacts, "l_suppkey", "left").select(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("unit"), F.coalesce("there", F.lit(False)).alias("reused"))


@query("reuse_by_payload", "SELECT count(*) FILTER (doc_id % 4 = 0) AS loaded, count(*) FILTER (doc_id % 4 <> 0) AS reused FROM documents")
def _(t):
    old = t.documents.select("doc_id", F.xxhash64("text").alias("was"))
    new = t.documents.select("doc_id", F.xxhash64(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("now"))
    both = new.join(old, "doc_id")
    return both.agg(F.count(F.when(F.col("now") != F.col("was"), 1)).alias("loaded"), F.count(F.when(F.col("now") == F.col("was"), 1)).alias("reused"))


@query("reconnect_selection", "SELECT c_custkey AS asset, n_name AS place FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 1")
def _(t):
    current = first_per(t.nation.filter("n_regionkey <> 1"), "n_nationkey", "n_name").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    return t.customer.join(current, "c_nationkey", "left").select(F.col("c_custkey").alias("asset"), "place")


@query("policy_default", "SELECT c_custkey AS file, COALESCE(CASE WHEN c_custkey % 6 = 0 THEN 'skip' WHEN c_custkey % 6 = 1 THEN 'remove' END, 'keep') AS policy FROM customer")
def _(t):
    chosen = F.when(F.col("c_custkey") % 6 == 0, "skip").when(F.col("c_custkey") % 6 == 1, "remove")
    return t.customer.select(F.col("c_custkey").alias("file"), F.coalesce(chosen, F.lit("keep")).alias("policy"))


@query("resources_flatmap", "SELECT c_custkey AS asset, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['photo', 'pairedVideo'] ELSE ['video'] END) AS resource FROM customer WHERE c_custkey % 5 <> 0")
def _(t):
    resources = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("photo"), F.lit("adjustment"), F.lit("pairedVideo"))).otherwise(F.array(F.lit("video")))
    kept = F.filter(resources, lambda r: r.isin("photo", "video", "pairedVideo"))
    history = t.customer.filter("c_custkey % 5 = 0").select("c_custkey")
    return t.customer.join(history, "c_custkey", "left_anti").select(F.col("c_custkey").alias("asset"), F.explode(kept).alias("resource"))


@query("journal_side_input", "SELECT doc_id, n_chars FROM documents WHERE source = 'src3' AND lang IS NOT NULL")
def _(t):
    journal = t.documents.filter("source = 'src3' AND lang IS NOT NULL").select("doc_id", "n_chars")
    return t.documents.select("doc_id").join(journal, "doc_id")


@query("seed_legacy", "SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY turn) - 1 AS ordinal, turn FROM (SELECT conv_id AS asset, turn FROM conversations WHERE role <> 'system')")
def _(t):
    from pyspark.sql import Window

    rows = t.conversations.filter("role <> 'system'").select(F.col("conv_id").alias("asset"), "turn")
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy("asset").orderBy("turn")) - 1).cast("long"))


@query("manifest_samples", "SELECT conv_id AS path, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY 1")
def _(t):
    return t.conversations.groupBy(F.col("conv_id").alias("path")).agg(F.sort_array(F.collect_list("turn")).alias("turns"))


@query("transcripts_explode", "SELECT conv_id AS asset, turn, unnest(string_split(text, chr(10))) AS segment FROM conversations")
def _(t):
    return t.conversations.select(F.col("conv_id").alias("asset"), "turn", F.explode(F.split("text", "\n")).alias("segment"))


@query("stale_metadata", "SELECT event_id FROM events WHERE COALESCE(CAST(json_extract(props, '$.k') AS BIGINT), 0) < 50")
def _(t):
    return t.events.filter(F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) < 50).select("event_id")
