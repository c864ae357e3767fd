"""Browsing: pages, facets, scopes, filters and their small relatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import media
from lodestone.operators import browse
from lodestone.operators.ranking import first_per, placed
from lodestone.operators.scope import Scope
from lodestone.plans.registry import query
from lodestone.sources.storage import Scratch

_ROW = "asset, captured, camera"


@query("browse_page_newest", "WITH {files} SELECT asset, captured, camera FROM files ORDER BY captured = '', captured DESC, asset LIMIT 100")
def _(t):
    return browse.page(t.files).select("asset", "captured", "camera")


@query("browse_page_oldest", "WITH {files} SELECT asset, captured, camera FROM files ORDER BY captured = '', captured, asset LIMIT 100")
def _(t):
    return browse.page(t.files, newest=False).select("asset", "captured", "camera")


@query("browse_page_next", "WITH {files} SELECT asset, captured, camera FROM files WHERE camera = '1-URGENT' ORDER BY captured = '', captured DESC, asset LIMIT 50 OFFSET 50")
def _(t):
    scope = Scope(camera="1-URGENT")
    last = browse.page(t.files, scope, limit=50).tail(1)[0]  # a page is bounded: the cursor is its last row
    return browse.page(t.files, scope, after=(last["captured"], last["asset"]), limit=50).select("asset", "captured", "camera")


@query("facet_camera", "WITH {files} SELECT camera, count(*) AS files FROM files GROUP BY camera")
def _(t):
    return browse.facets(t.files, "camera")


@query("facet_day", "WITH {files} SELECT camera, shape, kind, left(captured, 8) AS day, count(*) AS files FROM files GROUP BY ALL")
def _(t):
    return browse.day_facets(t.files)


@query(
    "facet_router_total",
    """WITH {files} SELECT 'day' AS route, count(*) AS total FROM files WHERE camera = '2-HIGH' AND captured <> '' AND captured BETWEEN '19950101' AND '19961231235959' AND arrival <= 40000
    UNION ALL SELECT 'part', count(*) FROM files WHERE captured <> '' AND captured <= '19960615115959'""",
)
def _(t):
    counts = Scratch(t.spark, "facets").save(browse.day_facets(t.files))  # written once, read by every total
    whole = browse.total(t.files, counts, Scope(camera="2-HIGH", start="19950101", through="19961231235959", arrival_through=40000))
    part = browse.total(t.files, counts, Scope(through="19960615115959"))
    return whole.select(F.lit("day").alias("route"), "total").unionByName(part.select(F.lit("part").alias("route"), "total"))


@query(
    "facet_delta_merge",
    "WITH {files} SELECT CASE WHEN asset % 10 = 0 THEN 'Moved' ELSE camera END AS camera, count(*) AS files FROM files WHERE asset % 11 <> 0 GROUP BY 1",
)
def _(t):
    before = t.files.filter("asset % 10 = 0 OR asset % 11 = 0")
    after = before.filter("asset % 11 <> 0").withColumn("camera", F.lit("Moved"))
    return browse.merge_facets(browse.facets(t.files, "camera"), before, after, "camera")


@query("scope_assets_semi", "WITH {files} SELECT asset, captured FROM files WHERE kind = 'F' AND asset IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def _(t):
    wanted = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_orderkey").alias("asset"))
    return Scope(kind="F", assets=wanted).apply(t.files).select("asset", "captured")


@query("scope_empty_assets", "WITH {files} SELECT asset, captured FROM files WHERE false")
def _(t):
    return Scope(assets=t.files.filter("false").select("asset")).apply(t.files).select("asset", "captured")


@query("grid_lock_arrivals", "WITH {files} SELECT count(*) FILTER (arrival <= 30000) AS shown, count(*) FILTER (arrival > 30000) AS pending FROM files")
def _(t):
    return t.files.agg(F.count(F.when(F.col("arrival") <= 30000, 1)).alias("shown"), F.count(F.when(F.col("arrival") > 30000, 1)).alias("pending"))


_LABELS = "labels AS (SELECT p_partkey AS asset, string_split(lower(p_type), ' ') AS tags, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS place FROM part)"


def _annotations(t):
    return t.part.select(F.col("p_partkey").alias("asset"), F.split(F.lower("p_type"), " ").alias("tags"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")).alias("place"))


@query("label_vocabulary", f"WITH {_LABELS} SELECT DISTINCT label FROM (SELECT unnest(list_append(tags, place)) AS label FROM labels) WHERE label <> ''")
def _(t):
    return _annotations(t).select(F.explode(F.array_union("tags", F.array("place"))).alias("label")).filter("label <> ''").distinct()


@query("label_any_filter", f"WITH {_LABELS} SELECT asset FROM labels WHERE list_has_any(list_append(tags, place), ['promo', 'Brand#13'])")
def _(t):
    wanted = F.array(F.lit("promo"), F.lit("Brand#13"))
    return _annotations(t).filter(F.arrays_overlap(F.array_union("tags", F.array("place")), wanted)).select("asset")


@query("annotation_assets", f"WITH {_LABELS}, x AS (SELECT asset FROM labels WHERE list_contains(tags, 'promo')) SELECT DISTINCT l_orderkey AS asset FROM lineitem WHERE l_partkey IN (SELECT asset FROM x) AND l_linenumber = 1")
def _(t):
    tagged = _annotations(t).filter(F.array_contains("tags", "promo")).select(F.col("asset").alias("l_partkey"))
    return t.lineitem.filter("l_linenumber = 1").join(tagged, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("asset")).distinct()


@query(
    "classify_shape",
    """SELECT p_partkey AS asset, CASE WHEN w <= 0 OR h <= 0 THEN 'unknown' WHEN abs(w - h) <= 1 THEN 'square' WHEN h > w THEN 'vertical' ELSE 'horizontal' END AS shape
    FROM (SELECT p_partkey, CASE WHEN p_size % 9 BETWEEN 5 AND 8 THEN b ELSE a END AS w, CASE WHEN p_size % 9 BETWEEN 5 AND 8 THEN a ELSE b END AS h FROM (SELECT *, p_size - 3 AS a, CAST(p_partkey % 40 AS INT) AS b FROM part))""",
)
def _(t):
    return t.part.select(F.col("p_partkey").alias("asset"), media.shape(F.col("p_size") - 3, (F.col("p_partkey") % 40).cast("int"), F.col("p_size") % 9).alias("shape"))


@query("classify_origin", "WITH {files} SELECT asset, CASE WHEN lower(path) LIKE '%.png' THEN 'screen' WHEN camera IN ('', '5-LOW') THEN 'other' ELSE 'camera' END AS origin FROM (SELECT asset, camera, CASE WHEN asset % 7 = 0 THEN replace(path, '.mp4', '.PNG') ELSE path END AS path FROM files)")
def _(t):
    path = F.when(F.col("asset") % 7 == 0, F.replace("path", F.lit(".mp4"), F.lit(".PNG"))).otherwise(F.col("path"))
    camera = F.when(F.col("camera") == "5-LOW", "").otherwise(F.col("camera"))
    return t.files.select("asset", media.origin(path, camera).alias("origin"))


@query("display_title", r"SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS title, concat_ws(' · ', CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'place' END, CAST(page_id AS VARCHAR)) AS subtitle FROM pages")
def _(t):
    return t.pages.select("page_id", media.title(F.col("url")).alias("title"), media.subtitle(F.when(F.col("page_id") % 3 != 0, "place"), F.col("page_id").cast("string")).alias("subtitle"))


@query("kind_from_extension", "WITH {files} SELECT CASE lower(regexp_extract(path, '\\.([^.]+)$', 1)) WHEN 'jpg' THEN 'image' WHEN 'mp4' THEN 'video' END AS media_kind, count(*) AS files FROM files GROUP BY 1".replace("\\\\", "\\"))
def _(t):
    return t.files.groupBy(media.kind(F.col("path")).alias("media_kind")).agg(F.count(F.lit(1)).alias("files"))


@query("date_range_scan", "SELECT o_orderkey AS asset, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01'")
def _(t):
    when = F.col("o_orderdate")
    return t.orders.filter((when >= F.lit("1995-03-01").cast("timestamp_ntz")) & (when < F.lit("1995-04-01").cast("timestamp_ntz"))).select(F.col("o_orderkey").alias("asset"), F.date_format(when, "yyyy-MM-dd").alias("day"))


@query("lookup_list", "WITH {files} SELECT asset, path FROM files WHERE asset IN (7, 32, 33, 99999999)")
def _(t):
    wanted = t.rows("asset long", (33,), (7,), (7,), (99999999,), (32,)).distinct()
    return t.files.join(F.broadcast(wanted), "asset", "left_semi").select("asset", "path")


@query("summary_projection", "SELECT l_orderkey AS asset, count(*) AS frame_count, max(l_linenumber) AS last_frame, count(*) >= 3 AS scrubbable FROM lineitem GROUP BY l_orderkey")
def _(t):
    frames = t.lineitem.groupBy(F.col("l_orderkey").alias("asset")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("frames"))
    return frames.select("asset", F.size("frames").cast("long").alias("frame_count"), F.element_at("frames", -1).alias("last_frame"), (F.size("frames") >= 3).alias("scrubbable"))


@query("range_contains", "WITH {files} SELECT asset FROM files WHERE length(captured) >= 8 AND left(captured, 8) BETWEEN '19970110' AND '19970120'")
def _(t):
    return t.files.filter(media.in_days(F.col("captured"), "19970110", "19970120")).select("asset")


@query("range_intersect", "WITH {files} SELECT asset, captured FROM files WHERE captured <> '' AND captured >= '19960201' AND captured <= '19960229235959'")
def _(t):
    return Scope(start="19960101", through="19960229235959").intersect("19960201", "19960331").apply(t.files).select("asset", "captured")


@query("hide_deleted", "WITH {files} SELECT camera, count(*) AS files FROM files WHERE asset NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND asset % 13 <> 0 GROUP BY camera")
def _(t):
    deleted = t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("asset"))
    hidden = t.files.filter("asset % 13 = 0").select("asset")
    return browse.facets(t.files.join(deleted.unionByName(hidden), "asset", "left_anti"), "camera")


@query("result_sort_all", "WITH {files} SELECT path, captured, row_number() OVER (ORDER BY captured = '', captured, path) AS place FROM files")
def _(t):
    return placed(t.files.select("path", "captured"), F.col("captured") == "", "captured", "path")


@query("asset_intersection", "SELECT o_orderkey AS asset FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity < 5")
def _(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "asset")
    return t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("asset")).intersect(lines.filter("l_discount > 0.08").select("asset")).intersect(lines.filter("l_quantity < 5").select("asset"))


@query("toggle_selection", "(SELECT asset FROM (SELECT o_orderkey AS asset FROM orders WHERE o_orderkey % 2 = 0) EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def _(t):
    side = lambda n, bit: t.orders.filter(f"o_orderkey % {n} = 0").select(F.col("o_orderkey").alias("asset"), F.lit(bit).alias("side"))
    return side(2, 1).unionByName(side(3, 2)).groupBy("asset").agg(F.bit_or("side").alias("sides")).filter("sides < 3").select("asset")


@query("range_select", "WITH {files}, p AS (SELECT asset, row_number() OVER (ORDER BY captured, asset) AS n FROM files WHERE camera = '3-MEDIUM' AND captured LIKE '1996%') SELECT asset FROM p WHERE n BETWEEN (SELECT min(n) FROM p WHERE asset % 10 = 3) AND (SELECT min(n) + 20 FROM p WHERE asset % 10 = 3)")
def _(t):
    chosen = t.files.filter("camera = '3-MEDIUM' AND captured LIKE '1996%'")
    key = F.struct("captured", "asset")
    anchor = chosen.filter("asset % 10 = 3").agg(F.min(key).alias("a"))  # one row
    later = chosen.join(F.broadcast(anchor), F.struct(chosen["captured"], chosen["asset"]) >= F.col("a"))
    return later.orderBy("captured", "asset").limit(21).select("asset")


@query("ordered_dedup", "SELECT path, min(place) AS place FROM (SELECT c_mktsegment AS path, c_custkey AS place FROM customer UNION ALL SELECT n_name, n_nationkey + 100000 FROM nation UNION ALL SELECT 'BUILDING', 0) GROUP BY path")
def _(t):
    all_ = t.customer.selectExpr("c_mktsegment AS path", "c_custkey AS place").union(t.nation.selectExpr("n_name AS path", "n_nationkey + 100000L AS place")).union(t.rows("path string, place long", ("BUILDING", 0)))
    return first_per(all_, "path", "place")


@query("selection_list", "SELECT list_filter([5, 9, 1, 7], lambda x: x <> 9) AS removed, [5, 9, 1, 7, 3] AS added, [9, 5, 1, 7] AS moved")
def _(t):
    chosen = F.array(*[F.lit(x) for x in (5, 9, 1, 7)])
    return t.spark.range(1).select(F.array_remove(chosen, 9).alias("removed"), media.append_missing(chosen, F.array(F.lit(1), F.lit(3))).alias("added"), media.move(chosen, 1, -1).alias("moved"))
