"""Rules of several steps: devices, edits, mirrors, imports, passes, receipts, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import media
from lodestone.operators import edits, identities, ledgers, queues
from lodestone.operators.ranking import normalised
from lodestone.plans.registry import query

_ITEMS = """items AS (SELECT c_custkey AS asset, CASE c_custkey % 6 WHEN 0 THEN 'file:///library/Originals/' || c_mktsegment || '%20cam/Originals/Phone%20' || c_nationkey || '/clip.mp4'
  WHEN 1 THEN 'file:///library/Originals/iCloud/' || c_custkey || '.heic' WHEN 2 THEN 'file:///library/Originals/iCloud-Photos/x.heic?v=1' WHEN 3 THEN 'https://host/Originals' WHEN 4 THEN 'file:///elsewhere/a+b.jpg' END AS url,
  CASE WHEN c_custkey % 7 = 0 THEN 'iCloud' END AS source, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN '' END AS camera,
  CASE c_custkey % 3 WHEN 0 THEN ['4K', c_name] WHEN 1 THEN ['4K'] ELSE [] END AS details FROM customer)"""


@query("capture_device", f"""WITH {_ITEMS}, p AS (SELECT *, list_reverse(list_filter(string_split(url_decode(replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '+', '%2B')), '/'), lambda x: x <> '')) AS parts FROM items),
q AS (SELECT *, list_position(parts, 'Originals') AS place FROM p), r AS (SELECT *, CASE WHEN place > 1 AND COALESCE(source, '') <> 'iCloud' AND parts[place - 1] NOT IN ('iCloud', 'iCloud-Photos') THEN parts[place - 1] END AS folder FROM q)
SELECT asset, COALESCE(folder, NULLIF(camera, ''), CASE WHEN camera IS NULL AND len(details) > 1 THEN details[len(details)] END, CASE WHEN source = 'iCloud' OR COALESCE(list_contains(parts, 'iCloud'), false) THEN 'iCloud · Device unavailable' ELSE 'Unknown device' END) AS device FROM r""")
def _(t):
    c = F.col
    key, of = c("c_custkey"), lambda n: c("c_custkey") % n
    url = F.when(of(6) == 0, F.concat(F.lit("file:///library/Originals/"), "c_mktsegment", F.lit("%20cam/Originals/Phone%20"), "c_nationkey", F.lit("/clip.mp4"))).when(of(6) == 1, F.concat(F.lit("file:///library/Originals/iCloud/"), key, F.lit(".heic")))
    url = url.when(of(6) == 2, "file:///library/Originals/iCloud-Photos/x.heic?v=1").when(of(6) == 3, "https://host/Originals").when(of(6) == 4, "file:///elsewhere/a+b.jpg")
    details = F.when(of(3) == 0, F.array(F.lit("4K"), c("c_name"))).when(of(3) == 1, F.array(F.lit("4K"))).otherwise(F.array().cast("array<string>"))
    return t.customer.select(key.alias("asset"), media.device_name(url, F.when(of(7) == 0, "iCloud"), F.when(of(4) == 0, c("c_mktsegment")).when(of(4) == 1, ""), details).alias("device"))


_LABELS = "l0 AS (SELECT l_orderkey || ':' || l_linenumber AS face_key, l_suppkey AS person, CASE l_returnflag WHEN 'A' THEN 'confirmed' ELSE 'rejected' END AS verdict FROM lineitem WHERE l_returnflag IN ('A', 'R'))"


@query("people_edits", f"""WITH {_LABELS}, f1 AS (SELECT DISTINCT l_orderkey || ':' || l_linenumber AS face_key FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 7 = 0), f2 AS (SELECT DISTINCT l_orderkey || ':' || l_linenumber AS face_key FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 11 = 0),
l1 AS (SELECT * FROM l0 WHERE NOT (face_key IN (SELECT face_key FROM f1) AND (verdict = 'confirmed' OR person = 1)) UNION ALL SELECT face_key, 1, 'confirmed' FROM f1),
l2 AS (SELECT * FROM l1 WHERE NOT (face_key IN (SELECT face_key FROM f2) AND person = 2) UNION ALL SELECT face_key, 2, 'rejected' FROM f2),
l3 AS (SELECT * FROM l2 WHERE person <> 2 AND NOT (person = 1 AND face_key IN (SELECT face_key FROM l2 WHERE person = 2)) UNION ALL SELECT face_key, 1, verdict FROM l2 WHERE person = 2),
n AS (SELECT s_suppkey AS person, CASE s_suppkey WHEN 5 THEN 'renamed' ELSE s_name END AS name FROM supplier WHERE s_suppkey NOT IN (2, 4) UNION ALL SELECT -1, 'new')
SELECT n.person, name, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'rejected') AS rejected FROM n LEFT JOIN (SELECT * FROM l3 WHERE person <> 4) l ON l.person = n.person GROUP BY n.person, name""")
def _(t):
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("face_key")
    person = F.col("l_suppkey").cast("long").alias("person")
    labels = t.lineitem.filter("l_returnflag IN ('A', 'R')").select(key, person, F.when(F.col("l_returnflag") == "A", "confirmed").otherwise("rejected").alias("verdict"))
    people = t.supplier.select(F.col("s_suppkey").cast("long").alias("person"), F.col("s_name").alias("name"))
    labels = edits.confirm(labels, t.lineitem.filter("l_linenumber = 1 AND l_orderkey % 7 = 0").select(key), 1)
    labels = edits.reject(labels, t.lineitem.filter("l_linenumber <= 2 AND l_orderkey % 11 = 0").select(key), 2)
    people, labels = edits.merge(people, labels, 2, 1)
    people, labels = edits.delete(people, labels, 4)
    people = edits.create(edits.rename(people, 5, "renamed"), -1, "new")
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    counts = labels.groupBy("person").agg(count("confirmed"), count("rejected"))
    return people.join(counts, "person", "left").fillna(0, ["confirmed", "rejected"])


_MIRROR = """CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'removed' WHEN o_custkey % 9 = 0 THEN 'origin' WHEN o_custkey % 10 = 0 OR o_custkey % 11 = 0 THEN 'requeued' WHEN o_custkey % 4 = 0 THEN 'moved' ELSE 'same' END"""


@query("job_sync_actions", f"SELECT o_orderkey AS asset, {_MIRROR} AS action FROM orders")
def _(t):
    rows = lambda place, signature, pipeline, origin: t.orders.select(F.col("o_orderkey").alias("asset"), F.expr(place).alias("path"), F.expr(signature).alias("signature"), F.expr(pipeline).alias("pipeline"), F.expr(origin).alias("origin"))
    old = rows("CAST(o_custkey AS STRING)", "o_clerk" if "o_clerk" in t.orders.columns else "o_orderpriority", "1", "CASE WHEN o_custkey % 2 = 0 THEN 'camera' END").filter("asset % 5 <> 0")
    new = rows("CASE WHEN o_custkey % 4 = 0 THEN 'moved' ELSE CAST(o_custkey AS STRING) END", f"CASE WHEN o_custkey % 10 = 0 THEN 'other' ELSE {'o_clerk' if 'o_clerk' in t.orders.columns else 'o_orderpriority'} END", "CASE WHEN o_custkey % 11 = 0 THEN 2 ELSE 1 END", "CASE WHEN o_custkey % 9 = 0 THEN 'screen' WHEN o_custkey % 2 = 0 THEN 'camera' END")
    return edits.sync_actions(old, new.filter("asset % 5 = 0 OR asset % 7 <> 0"))


@query("import_registered", """WITH i AS (SELECT 'new/' || c_custkey AS path, c_custkey // 2 AS digest, c_custkey % 3 AS signature FROM customer), m AS (SELECT CASE WHEN o_custkey % 5 = 0 THEN 'new/' || (2 * o_custkey) ELSE 'old/' || o_custkey END AS path, o_custkey AS digest, bool_or(o_custkey % 2 = 0) AS present FROM orders GROUP BY o_custkey),
j AS (SELECT o_custkey AS digest, o_custkey % 4 AS held FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey), a AS (SELECT i.*, j.held, m.path = i.path AS here, m.path <> i.path AS elsewhere, m.present, i.path = min(i.path) OVER (PARTITION BY i.digest) AS first FROM i LEFT JOIN m ON m.digest = i.digest LEFT JOIN j ON j.digest = i.digest),
b AS (SELECT *, CASE WHEN here THEN 'known' WHEN elsewhere AND present OR NOT first THEN 'copy' WHEN elsewhere THEN 'moved' ELSE 'new' END AS action FROM a)
SELECT path, digest, action, action = 'new' AND held IS NULL AS queues, action <> 'copy' AND COALESCE(held <> signature, false) AS requeues FROM b""")
def _(t):
    imports = t.customer.select(F.concat(F.lit("new/"), F.col("c_custkey").cast("string")).alias("path"), F.expr("c_custkey div 2").alias("digest"), (F.col("c_custkey") % 3).alias("signature"))
    path = F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("new/"), (2 * F.col("o_custkey")).cast("string"))).otherwise(F.concat(F.lit("old/"), F.col("o_custkey").cast("string")))
    media_ = t.orders.select(path.alias("path"), F.col("o_custkey").cast("long").alias("digest"), (F.col("o_custkey") % 2 == 0).alias("present")).distinct()
    jobs = t.orders.filter("o_custkey % 3 = 0").select(F.col("o_custkey").cast("long").alias("digest"), (F.col("o_custkey") % 4).alias("signature")).distinct()
    return edits.register(imports, media_, jobs)


@query("import_pass", """SELECT 'changes' AS pass, user_id AS asset FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) AND event_type <> 'error' GROUP BY user_id UNION ALL SELECT 'full', user_id FROM events GROUP BY user_id UNION ALL SELECT 'late', user_id FROM events GROUP BY user_id""")
def _(t):
    assets = t.events.select(F.col("user_id").alias("asset"))
    history = t.events.select(F.col("event_id").alias("sequence"), F.col("user_id").alias("asset"), F.when(F.col("event_type") == "error", "removed").otherwise("updated").alias("kind"))
    token = t.events.agg(F.max("event_id")).first()[0] // 2
    passes = {"changes": queues.assets_to_examine(assets, history, token, 1.0), "full": queues.assets_to_examine(assets, history, None, None), "late": queues.assets_to_examine(assets, history, token, 6.0)}
    out = None
    for name, found in passes.items():
        part = found.select(F.lit(name).alias("pass"), "asset")
        out = part if out is None else out.unionByName(part)
    return out


@query("compaction_policy", """WITH b AS (SELECT * FROM (VALUES ('first', NULL, 0.0), ('idle', (SELECT max(event_id) FROM events), 99.0), ('fresh', (SELECT max(event_id) - 3 FROM events), 1.0), ('old', (SELECT max(event_id) - 3 FROM events), 12.0), ('busy', -1, 1.0)) AS x(base, checkpoint, hours))
SELECT base, checkpoint IS NULL OR (SELECT count(DISTINCT user_id) FROM events WHERE event_id > checkpoint) >= 512 OR (SELECT count(*) FROM events WHERE event_id > checkpoint) >= 16384 OR (hours >= 12 AND (SELECT count(*) FROM events WHERE event_id > checkpoint) > 0) AS due FROM b""")
def _(t):
    last = t.events.agg(F.max("event_id")).first()[0]
    bases = t.rows("base string, checkpoint long, hours double", ("first", None, 0.0), ("idle", last, 99.0), ("fresh", last - 3, 1.0), ("old", last - 3, 12.0), ("busy", -1, 1.0))
    return queues.compaction_due(t.events.select(F.col("event_id").alias("sequence"), F.col("user_id").alias("asset")), bases)


@query("job_rounds", """WITH j AS (SELECT o_orderkey AS asset, CASE o_custkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' WHEN 2 THEN 'error' ELSE 'complete' END AS state, CAST(o_custkey % 5 AS INTEGER) AS attempts, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ok FROM orders)
SELECT asset, CASE WHEN state = 'running' AND ok THEN 'complete' WHEN state = 'running' AND NOT ok THEN CASE WHEN attempts + 1 < 3 THEN 'queued' ELSE 'error' END WHEN state = 'running' OR state = 'error' AND attempts < 3 THEN 'queued' ELSE state END AS state, CAST(attempts + CASE WHEN state = 'running' AND NOT ok THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM j""")
def _(t):
    of = F.col("o_custkey") % 4
    jobs = t.orders.select(F.col("o_orderkey").alias("asset"), F.when(of == 0, "running").when(of == 1, "queued").when(of == 2, "error").otherwise("complete").alias("state"), (F.col("o_custkey") % 5).cast("int").alias("attempts"))
    outcomes = t.orders.filter("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("asset"), (F.col("o_orderkey") % 3 == 0).alias("ok"))
    return queues.advanced(jobs, outcomes)


@query("units_in_force", """WITH s AS (SELECT l_orderkey AS asset, l_linenumber % 3 AS stage, l_linenumber AS ordinal, l_comment AS payload, l_returnflag AS f FROM (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_partkey AS VARCHAR) AS l_comment FROM lineitem))
SELECT asset, stage, ordinal, COALESCE(max(CASE WHEN f = 'N' THEN 'new ' || payload END), max(CASE WHEN f <> 'R' THEN payload END)) AS payload FROM s WHERE f = 'N' OR f <> 'R' GROUP BY asset, stage, ordinal""")
def _(t):
    units = t.lineitem.select(F.col("l_orderkey").alias("asset"), (F.col("l_linenumber") % 3).alias("stage"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").cast("string").alias("payload"), "l_returnflag")
    seeds, fresh = units.filter("l_returnflag <> 'R'").drop("l_returnflag"), units.filter("l_returnflag = 'N'").drop("l_returnflag")
    return queues.units_in_force(seeds, fresh.withColumn("payload", F.concat(F.lit("new "), "payload")))


@query("retention_receipts", """WITH s AS (SELECT event_id AS file, event_type AS identity, ts AS created, (SELECT max(ts) FROM events) - INTERVAL 10 DAY AS now FROM events), o AS (SELECT * FROM s WHERE identity = 'click'), p AS (SELECT * FROM o WHERE created <= now)
SELECT DISTINCT file FROM (SELECT file FROM s WHERE identity IS DISTINCT FROM 'click' OR created > now OR file = 17 UNION ALL SELECT file FROM (SELECT file, row_number() OVER (ORDER BY created DESC, file) AS n FROM p) WHERE n <= 3
UNION ALL SELECT file FROM (SELECT file, row_number() OVER (PARTITION BY date_trunc('hour', created) ORDER BY created DESC, file) AS n FROM p WHERE created >= now - INTERVAL 24 HOUR) WHERE n = 1
UNION ALL SELECT file FROM (SELECT file, row_number() OVER (PARTITION BY date_trunc('day', created) ORDER BY created DESC, file) AS n FROM p WHERE created >= now - INTERVAL 30 DAY) WHERE n = 1
UNION ALL SELECT file FROM (SELECT file, row_number() OVER (PARTITION BY date_trunc('month', created) ORDER BY created DESC, file) AS n FROM p WHERE created >= now - INTERVAL 12 MONTH) WHERE n = 1)""")
def _(t):
    now = t.events.agg(F.date_format(F.max("ts") - F.expr("INTERVAL 10 DAY"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    snapshots = t.events.select(F.col("event_id").alias("file"), F.col("event_type").alias("identity"), F.col("ts").cast("timestamp").alias("created"))
    return ledgers.retained(snapshots, now, identity="click", current=17)


@query("history_changes", """WITH h AS (SELECT o_custkey AS key, max_by(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY o_custkey), v AS (SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' END AS value FROM customer)
SELECT v.key, v.value FROM v LEFT JOIN h ON h.key = v.key WHERE h.key IS NULL OR h.value IS DISTINCT FROM v.value""")
def _(t):
    history = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("sequence"))
    return ledgers.new_history(history, t.customer.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "1-URGENT").when(F.col("c_custkey") % 3 == 1, "2-HIGH").alias("value")))


@query("receipt_ledger", """SELECT o_orderkey AS receipt, CASE WHEN o_custkey % 5 = 0 THEN 'recorded' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag <> 'N')) THEN 'complete' ELSE 'waiting' END AS state FROM orders""")
def _(t):
    receipts = t.orders.select(F.col("o_orderkey").alias("receipt"))
    files = t.lineitem.select(F.col("l_orderkey").alias("receipt"), (F.col("l_returnflag") != "N").alias("verified"))
    return ledgers.receipt_states(receipts, files, t.orders.filter("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("receipt")))


@query("attempts_since_disconnect", """WITH l AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT e.user_id, count(*) FILTER (event_type = 'error' AND (last IS NULL OR event_id > last)) AS attempts FROM events e LEFT JOIN l ON l.user_id = e.user_id GROUP BY e.user_id""")
def _(t):
    return queues.attempts_since(t.events, "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "signup")


@query("lanes_with_work", """SELECT o_orderstatus AS lane, max(o_orderkey) AS token FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 HAVING bool_or(o_custkey % 2 = 0)""")
def _(t):
    work = t.orders.select(F.col("o_orderstatus").alias("lane"), F.col("o_orderkey").alias("sequence"), (F.col("o_custkey") % 2 == 0).alias("ready"))
    return queues.lanes_with_work(work, work.filter("lane = 'F'").groupBy("lane").agg(F.max("sequence").alias("token")))


@query("labels_token", """WITH h AS (SELECT sha256(CAST(l_orderkey AS VARCHAR) || chr(31) || CAST(l_linenumber AS VARCHAR) || chr(31) || CAST(l_suppkey AS VARCHAR) || chr(31) || l_returnflag) AS d FROM lineitem)
SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(d, 1, 8)) AS BIGINT)) AS VARCHAR) AS part0, CAST(sum(CAST(('0x' || substr(d, 9, 8)) AS BIGINT)) AS VARCHAR) AS part1 FROM h""")
def _(t):
    return ledgers.digest(t.lineitem, "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")


@query("removed_assets", "SELECT o_custkey AS asset FROM orders GROUP BY o_custkey HAVING max(o_orderdate) < TIMESTAMP '1996-01-01'")
def _(t):
    middle = F.lit("1996-01-01").cast("timestamp_ntz")
    old, new = (t.orders.filter(c).select(F.col("o_custkey").alias("asset")).distinct() for c in (F.col("o_orderdate") < middle, F.col("o_orderdate") >= middle))
    return old.join(new, "asset", "left_anti")


@query("face_reference", "SELECT vec_id AS face, CAST(vec_id // 5 AS VARCHAR) || '|' || CASE WHEN vec_id % 2 = 0 THEN 'photo' ELSE printf('%.6f', vec_id / CAST(8 AS DOUBLE)) END || '|' || printf('%.6f', CAST(vec_id AS DOUBLE)) || ',' || printf('%.6f', vec_id / CAST(4 AS DOUBLE)) || ',1.000000,0.500000' AS key FROM embeddings")
def _(t):
    at = F.when(F.col("vec_id") % 2 == 1, F.col("vec_id") / F.lit(8.0))
    return t.embeddings.select(F.col("vec_id").alias("face"), media.face_reference(F.expr("CAST(vec_id div 5 AS STRING)"), at, [F.col("vec_id"), F.col("vec_id") / F.lit(4.0), F.lit(1.0), F.lit(0.5)]).alias("key"))


@query("packed_cells", """WITH n AS (SELECT user_id AS asset, event_id AS frame, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) - user_id % 40 AS frames FROM events), s AS (SELECT *, k // 32 AS sheet, least(32, frames - k // 32 * 32) AS held FROM n WHERE k < frames)
SELECT asset, frame, CAST(sheet AS INTEGER) AS sheet, CAST(k % 32 % least(8, held) * 256 AS INTEGER) AS x, CAST(k % 32 // least(8, held) * 256 AS INTEGER) AS y, CAST(least(8, held) * 256 AS INTEGER) AS width, CAST((held + least(8, held) - 1) // least(8, held) * 256 AS INTEGER) AS height FROM s""")
def _(t):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id")
    frames = t.events.select("user_id", "event_id", (F.row_number().over(own.orderBy("event_id")) - 1).alias("k"), (F.count(F.lit(1)).over(own) - F.col("user_id") % 40).alias("frames")).filter("k < frames")
    return frames.select(F.col("user_id").alias("asset"), F.col("event_id").alias("frame"), media.packed_cell(F.col("k"), F.col("frames")).alias("c")).select("asset", "frame", "c.*")


@query("segment_words", "SELECT conv_id AS asset, turn, turn * 30.0::DOUBLE + 1.5 AS start, turn * 30.0::DOUBLE + 4 AS stop, [turn * 30.0::DOUBLE + 1.5, turn * 30.0::DOUBLE + 2.25] AS words FROM conversations")
def _(t):
    part = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    segment = F.struct(F.lit(1.5).alias("start"), F.lit(4.0).alias("end"), F.col("text"), F.array(part(1.5, 2.0), part(2.25, 4.0)).alias("words"))
    moved = media.shifted_segments(F.array(segment), F.col("turn") * 30.0)[0]
    return t.conversations.select(F.col("conv_id").alias("asset"), "turn", moved.alias("s")).select("asset", "turn", "s.start", F.col("s.end").alias("stop"), F.col("s.words.start").alias("words"))


@query("video_sizes", """WITH v AS (SELECT p_partkey AS id, p_size * 77 + 1 AS w, p_partkey % 50 * 31 + 1 AS h, CASE p_partkey % 4 WHEN 0 THEN 90 WHEN 1 THEN -270 WHEN 2 THEN 180 END AS r FROM part), d AS (SELECT id, CASE WHEN COALESCE(abs(r) % 180 = 90, false) THEN h ELSE w END AS width, CASE WHEN COALESCE(abs(r) % 180 = 90, false) THEN w ELSE h END AS height FROM v)
SELECT id, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, CAST(greatest(2, CAST(round_even(width * least(1.0, CAST(1920 AS DOUBLE) / greatest(width, height)) / 2, 0) AS INTEGER) * 2) AS INTEGER) AS even_width, CAST(greatest(2, CAST(round_even(height * least(1.0, CAST(1920 AS DOUBLE) / greatest(width, height)) / 2, 0) AS INTEGER) * 2) AS INTEGER) AS even_height FROM d""")
def _(t):
    turn = F.when(F.col("p_partkey") % 4 == 0, 90).when(F.col("p_partkey") % 4 == 1, -270).when(F.col("p_partkey") % 4 == 2, 180)
    shown = t.part.select(F.col("p_partkey").alias("id"), media.display_size((F.col("p_size") * 77 + 1).cast("int"), (F.col("p_partkey") % 50 * 31 + 1).cast("int"), turn).alias("d")).select("id", "d.*")
    return shown.select("*", media.even_size(F.col("width"), F.col("height"), 1920).alias("e")).select("id", "width", "height", F.col("e.width").alias("even_width"), F.col("e.height").alias("even_height"))


@query("date_selection", """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 = 3 THEN CAST(date_trunc('month', o_orderdate - INTERVAL 70 DAY) AS DATE) ELSE CAST(o_orderdate + INTERVAL 9 DAY AS DATE) END END AS anchor, CASE o_orderkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'week' WHEN 2 THEN 'year' WHEN 3 THEN 'months' ELSE 'range' END AS mode FROM orders),
s AS (SELECT *, CASE mode WHEN 'months' THEN CAST(date_trunc('month', day) AS DATE) WHEN 'range' THEN day END AS start FROM o)
SELECT id, strftime(CASE mode WHEN 'day' THEN day WHEN 'week' THEN CAST(date_trunc('week', day) AS DATE) WHEN 'year' THEN CAST(date_trunc('year', day) AS DATE) ELSE least(COALESCE(anchor, start), start) END, '%Y%m%d') AS first,
  strftime(CASE mode WHEN 'day' THEN day WHEN 'week' THEN CAST(date_trunc('week', day) AS DATE) + 6 WHEN 'year' THEN make_date(year(day), 12, 31) WHEN 'months' THEN last_day(greatest(COALESCE(anchor, start), start)) ELSE greatest(COALESCE(anchor, start), start) END, '%Y%m%d') AS through, strftime(CASE WHEN anchor IS NULL THEN start END, '%Y%m%d') AS anchor FROM s""")
def _(t):
    from lodestone.functions import dates

    day, of = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    mode = F.when(of == 0, "day").when(of == 1, "week").when(of == 2, "year").when(of == 3, "months").otherwise("range")
    anchor = F.when(F.col("o_orderkey") % 2 == 0, F.when(of == 3, F.trunc(F.date_sub(day, 70), "month")).otherwise(F.date_add(day, 9)))
    text = lambda c: F.date_format(c, "yyyyMMdd")
    return t.orders.select(F.col("o_orderkey").alias("id"), dates.selected(mode, day, anchor).alias("s")).select("id", text(F.col("s.first")).alias("first"), text(F.col("s.through")).alias("through"), text(F.col("s.anchor")).alias("anchor"))


@query("generation_fates", """SELECT o_custkey AS asset, 'g/' || o_orderkey AS directory, CASE WHEN o_orderkey % 5 = 0 THEN 'current' WHEN o_orderstatus = 'F' THEN 'referenced' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) THEN 'review' ELSE 'remove' END AS fate FROM orders""")
def _(t):
    folder = F.concat(F.lit("g/"), F.col("o_orderkey").cast("string"))
    own = t.orders.select(F.col("o_custkey").alias("asset"), folder.alias("directory"), "o_orderkey", "o_orderstatus")
    frames = own.filter("o_orderstatus = 'F'").select("asset", F.concat("directory", F.lit("/0.jpg")).alias("frame"))
    files = t.lineitem.select(F.concat(F.lit("g/"), F.col("l_orderkey").cast("string")).alias("directory"), F.col("l_linenumber").cast("string").alias("name"), F.col("l_partkey").cast("string").alias("digest"), "l_quantity")
    return ledgers.generation_fates(own, own.filter("o_orderkey % 5 = 0"), frames, files, files.filter("l_quantity < 45"))


@query("video_cameras", """WITH v AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Apple Phone ' || c_nationkey WHEN 1 THEN 'Make' WHEN 2 THEN 'DJI Pocket 4P' WHEN 3 THEN '' ELSE 'Model' END AS camera, CASE WHEN c_custkey % 2 = 0 THEN 'here' WHEN c_custkey % 3 = 0 THEN '+1+2/' END AS location FROM customer) SELECT * FROM v""")
def _(t):
    of = F.col("c_custkey") % 5
    tag = lambda name, value: F.when(value.isNotNull(), F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.map_concat(
        tag("com.apple.quicktime.make", F.when(of == 0, F.lit(" Apple "))), tag("com.apple.quicktime.model", F.when(of == 0, F.concat(F.lit("Phone "), F.col("c_nationkey").cast("string")))),
        tag("make", F.when(of <= 1, F.lit("Make"))), tag("model", F.when(of == 4, F.lit("Model"))), tag("encoder", F.when(of == 2, F.lit("DJI OsmoPocket4P")).when(of == 3, F.lit("Lavf60"))),
        tag("location", F.when(F.col("c_custkey") % 2 == 0, F.lit("here"))), tag("com.apple.quicktime.location.ISO6709", F.when(F.col("c_custkey") % 3 == 0, F.lit("+1+2/"))),
    )
    return t.customer.select(F.col("c_custkey").alias("id"), media.video_camera(tags).alias("camera"), media.video_location(tags).alias("location"))


@query("visible_items", """WITH {files} SELECT asset, path FROM files WHERE kind = 'O' AND captured <> '' AND captured >= '19960101' AND asset NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) AND asset IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 3 = 1)
AND (asset % 3 = 0 AND (asset % 4 = 0 OR asset % 7 = 1))""")
def _(t):
    from lodestone.operators import browse
    from lodestone.operators.scope import Scope

    key = F.col("l_orderkey").alias("asset")
    notes = t.files.select("asset", (F.col("asset") % 3 == 0).alias("favorite"), F.when(F.col("asset") % 4 == 0, "home").alias("place"), F.when(F.col("asset") % 7 == 1, F.array(F.lit("x"), F.lit("sea"))).alias("tags"))
    scope = Scope(kind="O", start="19960101")
    return browse.visible(t.files, t.lineitem.filter("l_quantity >= 49").select(key), scope, notes, True, ["sea", "home"], t.lineitem.filter("l_suppkey % 3 = 1").select(key)).select("asset", "path")


@query("preview_order", """SELECT o_orderkey AS asset, o_custkey % 2 AS priority, o_custkey % 3 AS stage FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'P' AND o_custkey % 5 < 3 ORDER BY o_custkey % 2 DESC, o_custkey % 3, o_custkey % 11, o_orderdate DESC, o_orderkey LIMIT 16""")
def _(t):
    of = lambda n: F.col("o_custkey") % n
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "error").otherwise("complete")
    jobs = t.orders.select(F.col("o_orderkey").alias("asset"), of(2).alias("priority"), of(3).alias("stage"), of(11).alias("last_served"), F.col("o_orderdate").alias("captured"), state.alias("state"), of(5).alias("attempts"))
    return queues.preview_order(jobs, 16).select("asset", "priority", "stage")


@query("preview_requests", """WITH j AS (SELECT o_orderkey AS asset, o_custkey % 3 AS stage, o_custkey % 40 + 1 AS frames FROM orders)
SELECT asset, CAST(CASE stage WHEN 0 THEN [0] WHEN 1 THEN CASE WHEN frames <= 12 THEN range(frames) ELSE list_sort(list_distinct(list_transform(range(12), lambda i: CAST(round_even(i * (frames - 1) / 11.0::DOUBLE, 0) AS BIGINT)))) END ELSE list_filter(range(frames), lambda i: i % 3 <> 0)[1:16] END AS INTEGER[]) AS wanted,
CAST(CASE WHEN stage < 2 THEN stage + 1 WHEN len(list_filter(range(frames), lambda i: i % 3 <> 0)) <= 16 THEN 3 ELSE 2 END AS INTEGER) AS next_stage FROM j""")
def _(t):
    frames = (F.col("o_custkey") % 40 + 1).cast("int")
    jobs = t.orders.select(F.col("o_orderkey").alias("asset"), (F.col("o_custkey") % 3).alias("stage"), frames.alias("frames"), F.filter(F.sequence(F.lit(0), frames - 1), lambda i: i % 3 == 0).alias("done"))
    return queues.preview_requests(jobs).select("asset", "wanted", "next_stage")


_REVIEW = "g AS (SELECT l_partkey % 97 AS grp, count(*) AS size, count(DISTINCT l_orderkey) AS media, count(*) FILTER (l_returnflag = 'N') AS own FROM lineitem GROUP BY 1)"


@query("group_review_own", f"WITH {_REVIEW} SELECT grp, size, media, media >= 2 AND own * 2 >= size AS own_only FROM g WHERE media >= 2")
def _(t):
    from lodestone.operators import people

    faces = t.lineitem.select((F.col("l_partkey") % 97).alias("grp"), F.col("l_orderkey").alias("asset"), (F.col("l_returnflag") == "N").alias("own"))
    mine = people.review_groups(faces).select("grp", F.lit(True).alias("own_only"))
    return people.review_groups(faces, include_all=True).join(mine, "grp", "left").select("grp", "size", "media", F.coalesce("own_only", F.lit(False)).alias("own_only"))


@query("group_toggles", """WITH c AS (SELECT conv_id AS id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY 1), g AS (SELECT id, list_filter(turns, lambda x: x % 2 = 1) AS chosen, CASE id % 3 WHEN 0 THEN list_filter(turns, lambda x: x % 4 = 1) ELSE turns END AS grp FROM c)
SELECT id, CASE WHEN len(list_filter(grp, lambda x: NOT list_contains(chosen, x))) = 0 THEN list_filter(chosen, lambda x: NOT list_contains(grp, x)) ELSE list_concat(chosen, list_filter(grp, lambda x: NOT list_contains(chosen, x))) END AS chosen FROM g""")
def _(t):
    turns = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    group = F.when(F.col("id") % 3 == 0, F.filter("turns", lambda x: x % 4 == 1)).otherwise(F.col("turns"))
    return turns.select("id", media.toggled(F.filter("turns", lambda x: x % 2 == 1), group).alias("chosen"))


@query("identities")
def _(t):
    # every tenth face is labelled by its class, every seventeenth is said not to be of it
    x = F.col("ordinal").cast("double")
    video = F.col("asset") % 2 == 0
    faces = t.vectors.select(
        F.col("vec_id").alias("face"), "asset", F.when(video, x * 0.2).alias("at"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 1).alias("x2"), F.lit(1.0).alias("y2"),
        F.lit(20.0).alias("norm"), (F.col("ordinal") % 3).cast("int").alias("track"), F.lit(True).alias("representative"), (F.col("vec_id") % 13 != 0).alias("reliable"), normalised(F.col("vector")).alias("vector"), "label",
    )
    media_ = t.vectors.select("asset").distinct().select("asset", F.when(F.col("asset") % 2 == 0, "video").otherwise("image").alias("kind"), (F.col("asset") * 20.0).alias("captured"))
    labels = faces.filter("face % 10 = 0 OR face % 17 = 0").select(F.col("face").alias("label"), "asset", "at", "x1", "y1", "x2", "y2", F.col("label").cast("long").alias("person"), F.when(F.col("face") % 10 == 0, "confirmed").otherwise("rejected").alias("verdict"))
    made = identities.recompute(faces.drop("label"), media_, labels.select("person").distinct(), labels)
    return made.assignments.join(made.groups, "face", "full_outer").select("face", "person", "source", F.round("sim", 6).alias("sim"), "grp", F.round("typical", 6).alias("typical"))
