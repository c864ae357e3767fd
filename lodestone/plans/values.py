"""Scalar functions on constants and on columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import media
from lodestone.plans.registry import query


@query("sample_times", "SELECT CAST(seconds AS DOUBLE) AS seconds, CAST(times AS DOUBLE[]) AS times FROM (VALUES (2.2, [0.5, 1.5, 2.1]), (0.2, [0.1])) AS x(seconds, times)")
def _(t):
    return t.rows("seconds double", (2.2,), (0.2,)).select("seconds", media.sample_times(F.col("seconds")).alias("times"))


@query("coarse_ordinals", "SELECT * FROM (VALUES (3, [0, 1, 2]), (100, [0, 9, 18, 27, 36, 45, 54, 63, 72, 81, 90, 99])) AS x(frames, ordinals)")
def _(t):
    return t.rows("frames int", (3,), (100,)).select("frames", media.coarse_ordinals(F.col("frames")).alias("ordinals"))


@query("gps_label", "SELECT * FROM (VALUES (1, '12.500°S 45.250°W'), (2, NULL), (3, NULL)) AS x(id, label)")
def _(t):
    rows = t.rows("id int, lat array<double>, lon array<double>, status string", (1, [12.0, 30.0, 0.0], [45.0, 15.0, 0.0], "A"), (2, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], "A"), (3, [95.0, 0.0, 0.0], [1.0, 0.0, 0.0], "A"))
    return rows.select("id", media.gps_label(F.col("lat"), F.lit("S"), F.col("lon"), F.lit("W"), F.col("status")).alias("label"))


@query("frame_rate", "SELECT rate, CAST(fps AS DOUBLE) AS fps FROM (VALUES ('30000/1001', 29.97003), ('25', 25.0), ('0/0', 0.0), ('x', 0.0)) AS x(rate, fps)")
def _(t):
    return t.rows("rate string", ("30000/1001",), ("25",), ("0/0",), ("x",)).select("rate", F.round(media.frame_rate(F.col("rate")), 5).alias("fps"))


@query("video_metadata", "SELECT name, technical, CAST(duration AS DOUBLE) AS duration, CAST(last AS DOUBLE) AS last FROM (VALUES ('clip', '4K · 30 fps', 12.5, 12.466)) AS x(name, technical, duration, last)")
def _(t):
    probe = t.rows("probe string", ('{"format":{"duration":"12.5"},"streams":[{"codec_type":"video","width":3840,"height":2160,"avg_frame_rate":"30/1"}]}',))
    parsed = F.from_json("probe", "format struct<duration:string>, streams array<struct<codec_type:string,width:int,height:int,avg_frame_rate:string>>")
    video = F.filter(parsed["streams"], lambda s: s["codec_type"] == "video")[0]
    rate = media.frame_rate(video["avg_frame_rate"])
    size = F.when(F.greatest(video["width"], video["height"]) >= 3840, "4K").otherwise(F.concat(F.least(video["width"], video["height"]).cast("string"), F.lit("p")))
    duration = parsed["format"]["duration"].cast("double")
    return probe.select(F.lit("clip").alias("name"), F.concat_ws(" · ", size, F.format_string("%d fps", F.round(rate).cast("int"))).alias("technical"), duration.alias("duration"), F.round(media.last_frame_time(duration, rate), 3).alias("last"))


@query("speech_chunks", "SELECT CAST(seconds AS DOUBLE) AS seconds, audio, starts FROM (VALUES (61.0, true, [0, 30, 60]), (30.0, true, [0]), (10.0, false, CAST([] AS INTEGER[]))) AS x(seconds, audio, starts)")
def _(t):
    return t.rows("seconds double, audio boolean", (61.0, True), (30.0, True), (10.0, False)).select("seconds", "audio", media.speech_chunks(F.col("seconds"), F.col("audio")).alias("starts"))


@query("face_geometry", "SELECT vec_id AS face, round(sqrt(pow(CAST(embedding[1] AS DOUBLE) - embedding[3], 2) + pow(CAST(embedding[2] AS DOUBLE) - embedding[4], 2)), 5) AS eyes FROM embeddings")
def _(t):
    v = F.col("vector")
    return t.vectors.select(F.col("vec_id").alias("face"), F.round(F.sqrt(F.pow(v[0] - v[2], F.lit(2)) + F.pow(v[1] - v[3], F.lit(2))), 5).alias("eyes"))


@query("box_scale", "SELECT p_partkey AS id, round(least(1.0, 1920.0 / greatest(p_size * 100, 1)), 6) AS scale FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.round(F.least(F.lit(1.0), F.lit(1920.0) / F.greatest(F.col("p_size") * 100, F.lit(1))), 6).alias("scale"))


@query("resource_key", "SELECT event_id, sha256(CAST(user_id AS VARCHAR) || ':' || event_type || ':' || CAST(event_id AS VARCHAR) || ':' || 'name') AS resource FROM events")
def _(t):
    return t.events.select("event_id", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string"), F.lit("name")), 256).alias("resource"))


@query("id_validators", "SELECT doc_id, regexp_matches('sha256:' || sha256(text), '^sha256:[0-9a-f]{64}$') AS good, regexp_matches(source, '^[A-Za-z0-9._-]+$') AS safe FROM documents")
def _(t):
    return t.documents.select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).rlike("^sha256:[0-9a-f]{64}$").alias("good"), F.col("source").rlike("^[A-Za-z0-9._-]+$").alias("safe"))


@query("crop_valid", "SELECT p_partkey AS id, p_size - 5 >= 0 AND p_partkey % 50 > 0 AND p_size - 5 + p_partkey % 50 <= 60 AS ok FROM part")
def _(t):
    x, w = F.col("p_size") - 5, F.col("p_partkey") % 50
    return t.part.select(F.col("p_partkey").alias("id"), media.crop_valid(x, F.lit(0), w, F.lit(1), F.lit(60), F.lit(1)).alias("ok"))


@query("default_audio", "SELECT 2 AS stream")
def _(t):
    rows = t.rows("streams array<struct<i:int,codec:string,preferred:int>>", ([(0, "apac", 1), (1, "aac", 0), (2, "aac", 1)],))
    usable = F.filter("streams", lambda s: s["codec"] != "apac")
    return rows.select(F.array_max(F.transform(usable, lambda s: F.struct(s["preferred"], -s["i"], s["i"].alias("stream"))))["stream"].alias("stream"))


@query("backup_delay", "SELECT p_partkey AS id, greatest(2, 60 - p_size) AS seconds FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.greatest(F.lit(2), 60 - F.col("p_size")).alias("seconds"))


@query("face_seeds", "SELECT vec_id FROM embeddings WHERE label < 5 AND vec_id % 2 = 0")
def _(t):
    return t.vectors.filter("label < 5 AND vec_id % 2 = 0").orderBy("vec_id").select("vec_id")
