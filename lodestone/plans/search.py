"""Transcript search, nearest frames and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import dates, text
from lodestone.operators.nearest import nearest
from lodestone.operators.postings import Postings
from lodestone.operators.ranking import first_per
from lodestone.plans.registry import query
from lodestone.sources.storage import Scratch

_WORDS = r"regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\p{L}\p{N}_]+')"
_TOKENS = "tokens AS (SELECT id, asset, ordinal, " + _WORDS + " AS w FROM speech)"


def _tokens(t):
    return t.speech.select("id", "asset", "ordinal", text.words(F.col("text")).alias("w"))


_INDEXES: dict[tuple[str, str], Postings] = {}


def _index(t) -> Postings:
    """The index of all documents, written once for an application and a folder of tables."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _INDEXES:
        index = Postings(t.spark, f"{Scratch(t.spark, 'postings').folder()}")
        index.append(t.documents.select(F.col("doc_id").alias("id"), "text"))
        _INDEXES[key] = index
    return _INDEXES[key]


_DOCS = "d AS (SELECT doc_id, source, " + _WORDS + " AS w FROM documents)"


@query("text_all_terms", f"WITH {_DOCS} SELECT doc_id FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'with') AND len(list_filter(w, lambda x: x LIKE 'then%')) > 0")
def _(t):
    return _index(t).search(text.query_words("the WITH then")).select(F.col("id").alias("doc_id"))


@query("text_prefix", f"WITH {_DOCS} SELECT doc_id FROM d WHERE len(list_filter(w, lambda x: x LIKE 'elle%')) > 0")
def _(t):
    return _index(t).search(text.query_words("Ellé")).select(F.col("id").alias("doc_id"))


@query("text_prefix_flag", f"WITH {_DOCS} SELECT 'prefix' AS form, count(*) AS hits FROM d WHERE len(list_filter(w, lambda x: x LIKE 'th%')) > 0 UNION ALL SELECT 'whole', count(*) FROM d WHERE list_contains(w, 'th')")
def _(t):
    part = lambda form, q: _index(t).search(text.query_words(q), text.ends_in_word(q)).agg(F.lit(form).alias("form"), F.count(F.lit(1)).alias("hits"))
    return part("prefix", "th").unionByName(part("whole", "th "))


@query("text_one_hit_per_asset", f"WITH {{speech}}, {_TOKENS} SELECT asset, max(id) AS id FROM tokens WHERE list_contains(w, 'the') GROUP BY asset")
def _(t):
    return first_per(_tokens(t).filter(text.matches(F.col("w"), ["the"], False)), "asset", F.desc("id")).select("asset", "id")


@query("text_score_rank", f"WITH {{speech}}, {_TOKENS}, h AS (SELECT asset, id, len(w) AS n, row_number() OVER (PARTITION BY asset ORDER BY len(w), id) AS k FROM tokens WHERE list_contains(w, 'the') AND list_contains(w, 'of')) SELECT asset, id, round(2.0 / n, 6) AS score FROM h WHERE k = 1")
def _(t):
    terms = ["the", "of"]
    hits = _tokens(t).filter(text.matches(F.col("w"), terms, False))
    return first_per(hits, "asset", F.size("w"), "id").select("asset", "id", F.round(text.lexical_score(F.col("w"), terms), 6).alias("score"))


@query("vocabulary_prefix", f"WITH {_DOCS} SELECT term, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term LIKE 'inh%' GROUP BY term")
def _(t):
    return _index(t).vocabulary("inh")


@query("scope_tokens", "WITH {files} SELECT asset, 'c' || sha256(camera) || ' d' || left(captured, 8) || ' m' || left(captured, 6) || ' y' || left(captured, 4) AS tokens FROM files WHERE captured <> ''")
def _(t):
    return t.files.filter("captured <> ''").select("asset", text.scope_tokens(F.col("camera"), F.col("captured")).alias("tokens"))


@query("speech_with_scope", f"WITH {{speech}}, {{files}}, {_TOKENS} SELECT s.id, s.asset, f.camera FROM tokens s JOIN files f ON s.asset = f.asset WHERE list_contains(s.w, 'the') AND f.kind = 'F'")
def _(t):
    hits = _tokens(t).filter(text.matches(F.col("w"), ["the"], False))
    return hits.join(t.files.filter("kind = 'F'").select("asset", "camera"), "asset").select("id", "asset", "camera")


@query("early_limit", f"WITH {{speech}}, {_TOKENS} SELECT asset, max(id) AS id FROM tokens WHERE list_contains(w, 'and') GROUP BY asset ORDER BY id DESC LIMIT 25")
def _(t):
    hits = first_per(_tokens(t).filter(text.matches(F.col("w"), ["and"], False)), "asset", F.desc("id"))
    return hits.select("asset", "id").orderBy(F.desc("id")).limit(25)


_NEAR = """c AS (SELECT asset, frame, secs FROM frames WHERE stage = 'click'), v AS (SELECT asset, frame, secs FROM frames WHERE stage = 'view'),
p AS (SELECT c.frame, v.frame AS nearest_id, row_number() OVER (PARTITION BY c.frame ORDER BY abs(v.secs - c.secs), v.secs) AS k FROM c JOIN v ON c.asset = v.asset)"""


@query("nearest_frame", f"WITH {{frames}}, {_NEAR} SELECT c.frame, p.nearest_id FROM c LEFT JOIN p ON c.frame = p.frame AND p.k = 1")
def _(t):
    clicks, views = (t.frames.filter(F.col("stage") == s).select("asset", "frame", "secs") for s in ("click", "view"))
    return nearest(clicks, views, "asset", "secs", "secs", "frame", bucket=86400.0).select("frame", "nearest_id")


@query("nearest_frame_null", "WITH {frames} SELECT asset, min(frame) AS frame FROM frames WHERE stage = 'view' GROUP BY asset")
def _(t):
    return t.frames.filter("stage = 'view'").groupBy("asset").agg(F.min("frame").alias("frame"))


@query("nearest_frame_memory", "SELECT * FROM (VALUES (1, 1), (2, 1), (3, 2), (4, 2)) AS x(id, nearest_id)")
def _(t):
    starts = t.rows("asset long, id int, secs double", (1, 1, 0.0), (1, 2, 5.0), (1, 3, 8.0), (1, 4, 20.0))
    frames = t.rows("asset long, frame int, secs double", (1, 1, 1.0), (1, 2, 9.0))
    return nearest(starts, frames, "asset", "secs", "secs", "frame").select("id", "nearest_id")


@query("nearest_index", f"WITH {{frames}}, {_NEAR} SELECT count(*) AS clicks, count(p.nearest_id) AS found FROM c LEFT JOIN p ON c.frame = p.frame AND p.k = 1")
def _(t):
    clicks, views = (t.frames.filter(F.col("stage") == s).select("asset", "frame", "secs") for s in ("click", "view"))
    return nearest(clicks, views, "asset", "secs", "secs", "frame").agg(F.count(F.lit(1)).alias("clicks"), F.count("nearest_id").alias("found"))


@query("capture_name_parse", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '20240229' || lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || '3000' ELSE NULL END AS captured FROM customer")
def _(t):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("DJI_20240229"), F.lpad((F.col("c_custkey") % 24).cast("string"), 2, "0"), F.lit("3000_0001_D.MP4"))).when(F.col("c_custkey") % 3 == 1, "DJI_20239999999999_0001_D.MP4").otherwise("clip.mp4")
    return t.customer.select(F.col("c_custkey").alias("id"), dates.captured_in_name(name).alias("captured"))


@query("date_phrase_parse", """SELECT * FROM (VALUES ('goats in September 2025', 'goats', '20250901', '20250930'), ('from 2024-01-05 to 2024-02-01', '', '20240105', '20240201'), ('sea between 2024-03-01 and 2024-03-09', 'sea', '20240301', '20240309'),
('dog on 2024-02-29', 'dog', '20240229', '20240229'), ('hills in 2023', 'hills', '20230101', '20231231'), ('no date here', 'no date here', NULL, NULL)) AS x(phrase, rest, start, through)""")
def _(t):
    phrases = t.rows("phrase string", ("goats in September 2025",), ("from 2024-01-05 to 2024-02-01",), ("sea between 2024-03-01 and 2024-03-09",), ("dog on 2024-02-29",), ("hills in 2023",), ("no date here",))
    return phrases.select("phrase", dates.parse_phrase(F.col("phrase")).alias("p")).select("phrase", "p.rest", "p.start", "p.through")


@query("date_cover", "SELECT * FROM (VALUES ('20240101', '20241231', 'y2024'), ('20240201', '20240229', 'm202402'), ('20240228', '20240302', 'd20240228 d20240229 d20240301 d20240302'), ('20240302', '20240228', '')) AS x(start, through, tokens)")
def _(t):
    spans = t.rows("start string, through string", ("20240101", "20241231"), ("20240201", "20240229"), ("20240228", "20240302"), ("20240302", "20240228"))
    day = lambda c: F.to_date(c, "yyyyMMdd")
    return spans.select("start", "through", F.concat_ws(" ", dates.cover_tokens(day("start"), day("through"))).alias("tokens"))


@query("date_presets", """SELECT strftime(d, '%Y%m%d') AS day, strftime(d - INTERVAL 1 DAY, '%Y%m%d') AS yesterday, strftime(d - INTERVAL 6 DAY, '%Y%m%d') AS week, strftime(d - INTERVAL 29 DAY, '%Y%m%d') AS month_days, strftime(date_trunc('month', d), '%Y%m%d') AS month_start, strftime(last_day(d), '%Y%m%d') AS month_end
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(t):
    return t.orders.select(F.col("o_orderdate").cast("date").alias("d")).distinct().select(*dates.presets(F.col("d")))


@query("date_period_select", "SELECT o_orderkey AS asset, strftime(date_trunc('week', o_orderdate), '%Y%m%d') AS week_start, strftime(date_trunc('year', o_orderdate), '%Y%m%d') AS year_start FROM orders")
def _(t):
    day = lambda unit: F.date_format(F.date_trunc(unit, "o_orderdate"), "yyyyMMdd")
    return t.orders.select(F.col("o_orderkey").alias("asset"), day("week").alias("week_start"), day("year").alias("year_start"))


@query("year_interval", "SELECT year(o_orderdate) AS year, count(*) AS files FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def _(t):
    low, high = F.lit("1994-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz")
    return t.orders.filter((F.col("o_orderdate") >= low) & (F.col("o_orderdate") < high)).groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("files"))


def _sort_dates(events):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.select("event_id", dates.sort_date(iso).alias("sort_date"), F.date_format(F.try_to_timestamp(iso), "yyyy-MM-dd HH:mm").alias("shown"))


@query("iso_to_sortdate_all", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS sort_date, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events")
def _(t):
    return _sort_dates(t.events)


@query("capture_time_fallback", "SELECT o_orderkey AS asset, CASE WHEN o_orderkey % 3 = 0 THEN 'media' WHEN o_orderkey % 3 = 1 THEN 'exif' ELSE 'file' END AS source, strftime(o_orderdate, '%Y%m%d') AS day FROM orders")
def _(t):
    when = F.col("o_orderdate")
    media_time, exif = F.when(F.col("o_orderkey") % 3 == 0, when), F.when(F.col("o_orderkey") % 3 <= 1, when)
    return t.orders.select(F.col("o_orderkey").alias("asset"), dates.first_time(("media", media_time), ("exif", exif), ("file", when)).alias("c")).select("asset", "c.source", F.date_format("c.at", "yyyyMMdd").alias("day"))


@query("request_log_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NULL AS bad FROM events")
def _(t):
    parsed = F.from_json("props", "k long")
    return t.events.select("event_id", parsed["k"].alias("k"), parsed["k"].isNull().alias("bad"))
