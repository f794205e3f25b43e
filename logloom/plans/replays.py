"""Queries of the sequential operators and of the picture kernels, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import masks, text
from logloom.operators import gate, lattice
from logloom.operators import replay as replays
from logloom.plans.queries import EV, HOUR, NAMES, ORACLES, query
from logloom.sources import rulesets
from logloom.streaming import replay as streams
from logloom.views import event_log, fixed, spread, table

#: Windows in hours, as the events are hours apart.
REPLAY = replays.ReplayConfig(duplicate_ms=6 * HOUR, candidate_ms=24 * HOUR, accepted_ms=12 * HOUR, names=4, moves=3)
LABELS = """nm AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS place FROM (SELECT DISTINCT p_name AS label FROM part)),
 mv AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS place FROM (SELECT DISTINCT p_type AS label FROM part))"""
#: A log of events with part names as names and part types as moves, some of them worn.
WORN = "CASE event_id % 7 WHEN 0 THEN 'xx' || substr({0}, 3) WHEN 1 THEN 'xxxx' || substr({0}, 5) WHEN 2 THEN substr({0}, 1, length({0}) - 1) WHEN 3 THEN 'xxx' || substr({0}, 4) ELSE {0} END"
LOG = f"""SELECT event_id, user_id AS battle_id, CAST(event_id AS STRING) AS id, CASE event_type WHEN 'purchase' THEN 'faint' WHEN 'click' THEN 'move' WHEN 'view' THEN 'switch_in' END AS event_type, event_type AS text,
  {WORN.format("nm.label")} AS name, CASE WHEN event_type = 'click' THEN {WORN.format("mv.label")} END AS move
 FROM events JOIN nm ON nm.place = (user_id + 13 * (event_id % 6)) % (SELECT count(*) FROM nm) JOIN mv ON mv.place = (user_id + event_id % 5) % (SELECT count(*) FROM mv)"""


def replay_log(spark, d):
    """Messages of the log above, as replay takes them."""
    for name in ("events", "part"):
        table(spark, d, name).createOrReplaceTempView(name)
    log = spark.sql(f"WITH {LABELS} {LOG}")
    at = event_log(spark, d).select(F.col("id").alias("event_id"), "timestamp_ms")
    rows = log.join(at, "event_id")
    keys = spark.sql(f"WITH {LABELS} SELECT 'name' AS kind, label AS entry_id, label, label AS key FROM nm UNION ALL SELECT 'move', label, label, label FROM mv")
    slot = lambda pos, kind: rows.where(F.col(kind).isNotNull() & F.col("event_type").isNotNull()).select("id", F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), F.col(kind).alias("text"))
    return replays.replay_messages(rows, slot(0, "name").unionByName(slot(1, "move")), keys, REPLAY)


def _pick(found: str, own: str, out: str) -> str:
    """SQL of status and label by the battle's own list, else by all: columns out_status, out_label, out_source."""
    cases = []
    for side, (accept, review, margin) in (("own", REPLAY.lenient), ("all", REPLAY.strict)):
        floor = replays.floor_of((accept, review, margin))
        mine = f" AND list_contains({own}, x.l)" if side == "own" else ""
        near = f"list_filter({found}, lambda x: x.s >= {floor}{mine})"
        lead = f"{near}[1].s - coalesce({near}[2].s, {floor})"
        status = f"CASE WHEN len({near}) = 0 THEN 'not_found' WHEN {near}[1].s >= 1 OR ({near}[1].s >= {accept} AND {lead} >= {margin} - 1e-9) THEN 'accepted' WHEN {near}[1].s >= {review} THEN 'review' ELSE 'not_found' END"
        cases.append((status, f"{near}[1].l"))
    (own_status, own_label), (all_status, all_label) = cases
    mine = f"({own_status}) = 'accepted'"
    return f"CASE WHEN {mine} THEN 'accepted' ELSE {all_status} END AS {out}_status, CASE WHEN {mine} THEN {own_label} ELSE {all_label} END AS {out}_label, CASE WHEN {mine} THEN 'session' ELSE 'global' END AS {out}_source"


SCORED = f"""sc AS MATERIALIZED (SELECT kind, text, list(struct_pack(s := s, l := l) ORDER BY s DESC, l) AS found FROM (SELECT t.kind, t.text, k.label AS l,
  CASE WHEN t.text = k.label THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(t.text, k.label)::DOUBLE / greatest(length(t.text), length(k.label)) - 0.08::DOUBLE * greatest(abs(length(t.text) - length(k.label)) - 1, 0) END AS s
  FROM (SELECT DISTINCT 'name' AS kind, name AS text FROM lg UNION ALL SELECT DISTINCT 'move', move FROM lg WHERE move IS NOT NULL) AS t JOIN (SELECT 'name' AS kind, label FROM nm UNION ALL SELECT 'move', label FROM mv) AS k ON t.kind = k.kind AND abs(length(t.text) - length(k.label)) <= 4)
  WHERE s >= {REPLAY.floor} GROUP BY kind, text)"""
HELD = "CAST([] AS STRUCT(k VARCHAR, t BIGINT)[])"
NONE = "CAST([] AS STRUCT(s DOUBLE, l VARCHAR)[])"
RENEW = "list_append(list_filter({0}, lambda x: x.k <> {1}), struct_pack(k := {1}, t := ts))"


@query(f"""WITH RECURSIVE {LABELS}, lg AS ({LOG.replace("STRING", "VARCHAR")}), {SCORED},
 m AS MATERIALIZED (SELECT lg.battle_id, lg.id, epoch_us(e.ts) // 1000 AS ts, lg.event_type AS kind, lg.text, lg.move IS NOT NULL AS has_move, coalesce(a.found, {NONE}) AS nf, coalesce(b.found, {NONE}) AS mf,
   row_number() OVER (PARTITION BY lg.battle_id ORDER BY epoch_us(e.ts) // 1000, lg.id) AS nth
  FROM lg JOIN events AS e USING (event_id) LEFT JOIN sc AS a ON a.kind = 'name' AND a.text = lg.name LEFT JOIN sc AS b ON b.kind = 'move' AND b.text = lg.move),
 f AS (SELECT DISTINCT battle_id, 0::BIGINT AS nth, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS moves, NULL::VARCHAR AS last_event, {HELD} AS seen, {HELD} AS cands, {HELD} AS acc,
   NULL::VARCHAR AS id, NULL::BIGINT AS ts, NULL::VARCHAR AS status, NULL::VARCHAR AS event_type, NULL::VARCHAR AS name, NULL::VARCHAR AS move, NULL::VARCHAR AS matched_in, NULL::BOOLEAN AS suppressed, NULL::VARCHAR AS after_event FROM m
  UNION ALL
  SELECT battle_id, nth, CASE WHEN known THEN list_concat([n_label], list_filter(names, lambda x: x <> n_label))[1:{REPLAY.names}] ELSE names END, CASE WHEN known AND has_move THEN list_concat([m_label], list_filter(moves, lambda x: x <> m_label))[1:{REPLAY.moves}] ELSE moves END,
   CASE WHEN known AND NOT gone THEN id ELSE last_event END, CASE WHEN status = 'noise' THEN seen ELSE {RENEW.format("seen", "identity")} END, CASE WHEN readable THEN {RENEW.format("cands", "reading")} ELSE cands END, CASE WHEN known AND NOT gone THEN {RENEW.format("acc", "actor")} ELSE acc END,
   id, ts, status, CASE WHEN known THEN kind END, CASE WHEN known THEN n_label END, CASE WHEN known AND has_move THEN m_label END, CASE WHEN known THEN n_source || CASE WHEN has_move THEN ',' || m_source ELSE '' END END, gone, last_event
  FROM (SELECT *, status IN ('event', 'promoted') AS known, CASE WHEN status IN ('event', 'promoted') THEN 'event:' || reading ELSE 'unknown:' || text END AS identity,
     status <> 'noise' AND len(list_filter(seen, lambda x: x.k = CASE WHEN status IN ('event', 'promoted') THEN 'event:' || reading ELSE 'unknown:' || text END)) > 0 AS gone
   FROM (SELECT *, CASE WHEN whole THEN 'event' WHEN readable AND len(list_filter(cands, lambda x: x.k = reading)) > 0 THEN 'promoted' WHEN kind IS NOT NULL AND len(list_filter(acc, lambda x: x.k = actor)) > 0 THEN 'noise' ELSE 'unknown' END AS status
    FROM (SELECT *, kind IS NOT NULL AND n_status = 'accepted' AND (NOT has_move OR m_status = 'accepted') AS whole, kind IS NOT NULL AND n_status <> 'not_found' AND (NOT has_move OR m_status <> 'not_found') AND NOT (n_status = 'accepted' AND (NOT has_move OR m_status = 'accepted')) AS readable,
       kind || ':' || coalesce(n_label, '') || CASE WHEN has_move THEN ':' || coalesce(m_label, '') ELSE '' END AS reading, kind || ':' || coalesce(n_label, '') AS actor
     FROM (SELECT m.*, f.names, f.moves, f.last_event, list_filter(f.seen, lambda x: m.ts - x.t <= {REPLAY.duplicate_ms}) AS seen, list_filter(f.cands, lambda x: m.ts - x.t <= {REPLAY.candidate_ms}) AS cands, list_filter(f.acc, lambda x: m.ts - x.t <= {REPLAY.accepted_ms}) AS acc,
        {_pick("m.nf", "f.names", "n")}, {_pick("m.mf", "f.moves", "m")}
      FROM f JOIN m ON m.battle_id = f.battle_id AND m.nth = f.nth + 1)))))
 SELECT battle_id, id, ts AS timestamp_ms, status, event_type, name, move, matched_in, suppressed, after_event FROM f WHERE nth > 0""")
def roster_replay(spark, d):
    """Every message of the log read with what its battle has shown before it."""
    return replays.replay(replay_log(spark, d), REPLAY)


NEAR = 30 * 60_000


@query(f"""WITH {EV}, s AS (SELECT * FROM ev WHERE type IN ('view', 'signup')), r AS (SELECT * FROM ev WHERE type = 'click')
 SELECT r.battle_id, r.id AS reading_id, r.timestamp_ms AS reading_ms, s.id AS sample_id, s.timestamp_ms AS sample_ms FROM r LEFT JOIN s ON s.battle_id = r.battle_id AND abs(s.timestamp_ms - r.timestamp_ms) <= {NEAR}""")
def two_clocks(spark, d):
    """Readings with the samples of another clock near them; the same call joins two streams."""
    e = event_log(spark, d)
    samples = e.where("type IN ('view', 'signup')").select("battle_id", F.col("id").alias("sample_id"), F.col("timestamp_ms").alias("sample_ms"))
    readings = e.where("type = 'click'").select("battle_id", F.col("id").alias("reading_id"), F.col("timestamp_ms").alias("reading_ms"))
    joined = streams.on_two_clocks(streams.clocked(samples, "sample_ms", "0 seconds"), streams.clocked(readings, "reading_ms", "0 seconds"), NEAR)
    return joined.select("battle_id", "reading_id", "reading_ms", "sample_id", "sample_ms")


GAPPED = """SELECT event_id AS id, event_type, n.label AS name, m.label AS move, event_id % 6 AS g, (event_id // 6) % 5 AS h,
  CASE event_type WHEN 'click' THEN '相手の' ELSE 'zzz' END || n.key || repeat('q', CAST(event_id % 6 AS INT)) || 'は' || repeat('v', CAST((event_id // 6) % 5 AS INT)) || m.key || 'を使った' AS text
 FROM events JOIN n ON n.place = user_id % (SELECT count(*) FROM n) JOIN m ON m.place = event_id % (SELECT count(*) FROM m)"""
GAP_RULES = [
    ("used", "move", 5, ["{name}は{move}を使った"], {}, None),
    ("used_theirs", "move", 5, ["相手の{name}は{move}を使った"], {"actor.side": "opponent"}, None),
    ("named", "seen", 1, ["{name}"], {}, 0.6),
]


@query(f"""WITH {NAMES}, s AS ({GAPPED}) SELECT id, CASE WHEN g > 3 OR h > 3 THEN 'named' WHEN event_type = 'click' THEN 'used_theirs' ELSE 'used' END AS rule_id, name AS actor, CASE WHEN g <= 3 AND h <= 3 AND event_type = 'click' THEN 'opponent' END AS actor_side,
  CASE WHEN g <= 3 AND h <= 3 THEN move END AS move, CASE WHEN g > 3 OR h > 3 THEN 0.6::DOUBLE ELSE floor((0.92::DOUBLE - 0.03::DOUBLE * (g + h)) * 1e6 + 0.5) / 1e6 END AS confidence FROM s""")
def gapped_templates(spark, d):
    """Templates walked through texts with noise before, between and behind their tokens."""
    for name in ("events", "part"):
        table(spark, d, name).createOrReplaceTempView(name)
    log = spark.sql(f"WITH {NAMES} {GAPPED.replace(' // ', ' div ')}")
    keys = spark.sql(f"WITH {NAMES} SELECT 'name' AS kind, label, key FROM n UNION ALL SELECT 'move', label, key FROM m")
    rules = spark.createDataFrame(GAP_RULES, "id string, event_type string, priority int, patterns array<string>, constants map<string,string>, confidence double")
    found = lattice.matched_templates(log.select("id", F.lit(0).alias("priority"), text.match_text("text").alias("match")), rules, keys)
    return found.select("id", "rule_id", "actor", "actor_side", "move", fixed(F.col("confidence"), 6).alias("confidence"))


@query("""WITH g AS (SELECT vec_id, i - 1 AS i FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE CAST(embedding[i] AS DOUBLE) > 0.05),
 p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x FROM g),
 link AS (SELECT a.vec_id, a.y * 8 + a.x AS a, b.y * 8 + b.x AS b FROM p AS a JOIN p AS b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1),
 reach AS (WITH RECURSIVE r AS (SELECT vec_id, a, b FROM link UNION SELECT r.vec_id, r.a, link.b FROM r JOIN link ON link.vec_id = r.vec_id AND link.a = r.b) SELECT vec_id, b AS cell, min(a) AS comp FROM r GROUP BY vec_id, b),
 c AS (SELECT vec_id, comp, count(*) AS n, max(cell % 8) - min(cell % 8) + 1 AS w, max(cell // 8) - min(cell // 8) + 1 AS h FROM reach GROUP BY vec_id, comp),
 m AS (SELECT vec_id, count(*) AS n_components, max(n) AS largest, max(n) / sum(n) AS share, count(*) FILTER (WHERE n >= 2 AND w >= 2 AND (w * h <= 6 OR n / (w * h) <= 0.92)) AS text_like FROM c GROUP BY vec_id)
 SELECT vec_id, coalesce(n_components, 0)::INT AS n_components, coalesce(largest, 0)::INT AS largest, floor(coalesce(share, 0) * 1e6 + 0.5) / 1e6 AS largest_share, coalesce(text_like, 0)::INT AS text_like FROM embeddings LEFT JOIN m USING (vec_id)""")
def picture_components(spark, d):
    """Connected components of masks made from vectors, eight cells in a row."""
    e = table(spark, d, "embeddings")
    found = e.select("vec_id", masks.mask_components(F.transform("embedding", lambda x: x.cast("double") > 0.05), F.lit(8)).alias("m"))
    return found.select("vec_id", F.col("m.count").alias("n_components"), "m.largest", fixed(F.col("m.largest_share"), 6).alias("largest_share"), "m.text_like")


@query("""WITH g AS (SELECT vec_id // 4 AS picture, (vec_id % 4) * 8 + (i - 1) // 8 AS r, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
 rows AS (SELECT picture, r, count(*) FILTER (WHERE v > CASE WHEN r % 14 < 2 THEN 0.12 WHEN r % 14 BETWEEN 5 AND 11 THEN 0.04 ELSE 9 END) AS n FROM g GROUP BY picture, r),
 act AS (SELECT picture, r, r - lag(r) OVER (PARTITION BY picture ORDER BY r) AS back FROM rows WHERE n > 0),
 isl AS (SELECT picture, r, sum(CASE WHEN back <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY picture ORDER BY r) AS k FROM act),
 pad AS (SELECT picture, k, greatest(0, min(r) - 2) AS top, least(32, max(r) + 3) AS stop FROM isl GROUP BY picture, k),
 b AS (SELECT pad.picture, k, top, stop - top AS height, sum(n) AS pixels, max(n) AS peak FROM pad JOIN rows ON rows.picture = pad.picture AND r >= top AND r < stop GROUP BY ALL),
 f AS (SELECT *, lead(top) OVER w AS top2, lead(height) OVER w AS height2, lead(pixels) OVER w AS pixels2 FROM b WHERE height >= 2 AND pixels >= 6 AND pixels / (height * 8) <= 0.36 WINDOW w AS (PARTITION BY picture ORDER BY top)),
 a AS (SELECT *, coalesce(height2 >= 6 AND pixels >= 8 AND height <= greatest(3, height2 * 0.62) AND pixels <= pixels2 * 0.45 AND peak >= 3 AND top2 - (top + height) <= greatest(4, ceil(height2 * 0.45)), false) AS small FROM f)
 SELECT picture, top::INT AS top, height::INT AS height, pixels::INT AS pixels, small FROM a""")
def picture_bands(spark, d):
    """Bands of rows of masks made from four vectors each, before annotations are merged."""
    e = table(spark, d, "embeddings").where("vec_id IS NOT NULL").select(F.expr("vec_id div 4").alias("picture"), F.posexplode("embedding").alias("i", "v"), (F.col("vec_id") % 4 * 8).alias("base"))
    r = F.col("base") + F.expr("i div 8")
    least = F.when(r % 14 < 2, 0.12).when((r % 14).between(5, 11), 0.04).otherwise(9.0)
    # A picture has 32 rows, also where vectors are missing.
    counts = e.groupBy("picture", r.cast("int").alias("r")).agg(F.count_if(F.col("v").cast("double") > least).alias("n")).where("r BETWEEN 0 AND 31")
    rows = counts.groupBy("picture").agg(F.map_from_entries(F.collect_list(F.struct("r", "n"))).alias("n"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.coalesce(F.element_at("n", k), F.lit(0)))
    found = rows.select("picture", F.explode(masks.row_raw_bands(whole, F.lit(8))).alias("b"))
    return found.select("picture", "b.top", "b.height", "b.pixels", F.col("b.annotated").alias("small"))


@query("""WITH g AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
 SELECT vec_id, sum(v)::BIGINT AS whole, coalesce(sum(v) FILTER (WHERE x < 4 AND y < 4), 0)::BIGINT AS corner, coalesce(sum(v) FILTER (WHERE x >= vec_id % 8 AND x < vec_id % 8 + 3 AND y >= 2 AND y < 12), 0)::BIGINT AS cut FROM g GROUP BY vec_id""")
def picture_regions(spark, d):
    """Sums of regions of grids made from vectors, by summed areas; one region reaches over the edge."""
    e = table(spark, d, "embeddings")
    box = lambda x, y, w, h: F.struct(*[v.cast("int").alias(n) for n, v in zip("xywh", (x, y, w, h), strict=True)])
    n = F.lit
    regions = F.array(box(n(0), n(0), n(8), n(8)), box(n(0), n(0), n(4), n(4)), box(F.col("vec_id") % 8, n(2), n(3), n(10)))
    sums = e.select("vec_id", masks.region_sums(F.transform("embedding", lambda x: F.floor(1024 * x.cast("double"))), F.lit(8), regions).alias("s"))
    return sums.select("vec_id", *[F.get("s", F.lit(k)).alias(c) for k, c in enumerate(("whole", "corner", "cut"))])


@query("""WITH t AS (SELECT p_brand AS file, p_partkey AS key, p_name AS text, p_size > 10 AS candidate, CASE WHEN p_size % 4 <> 0 THEN p_type END AS type FROM part),
 o AS (SELECT *, CASE WHEN candidate THEN type END AS event_type FROM t), n AS (SELECT *, event_type IS NOT NULL AND row_number() OVER (PARTITION BY event_type, text ORDER BY file, key) > 1 AS again FROM o)
 SELECT CASE grouping(file, event_type) WHEN 0 THEN 'file_type' WHEN 1 THEN 'file' WHEN 2 THEN 'type' ELSE 'all' END AS scope, file, event_type, count(*) AS extracted, count(*) FILTER (WHERE candidate) AS candidates, count(event_type) AS generated,
  count(*) FILTER (WHERE again) AS duplicates, count(*) FILTER (WHERE event_type IS NULL) AS skipped FROM n GROUP BY GROUPING SETS ((file, event_type), (file), (event_type), ())""")
def pack_statistics(spark, d):
    """What became of the texts of each file, by type and in all, in one pass."""
    p = table(spark, d, "part")
    return rulesets.pack_statistics(p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("key"), F.col("p_name").alias("text"), (F.col("p_size") > 10).alias("candidate"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("event_type")))


@query(f"""WITH {EV}, r AS (SELECT id, CASE type WHEN 'error' THEN 'ended' WHEN 'click' THEN 'message_candidate' WHEN 'view' THEN 'hud' ELSE 'unknown' END AS phase, timestamp_ms AS now, timestamp_ms - id % 900 AS opened, timestamp_ms - (id * 7) % 4000 + 500 AS closed, score > 25 AS strict FROM ev)
 SELECT id, opened + 500 AS deadline, CASE WHEN phase = 'ended' THEN 'reject' WHEN phase = 'message_candidate' THEN 'queue' WHEN phase = 'hud' AND now - closed BETWEEN 0 AND 1500 THEN 'queue' WHEN now < opened + 500 THEN 'defer' WHEN strict THEN 'queue' ELSE 'reject' END AS action FROM r""")
def admission_log(spark, d):
    """What is done with the pictures of a log, by phase, time and the strict test."""
    e = event_log(spark, d)
    phase = F.when(F.col("type") == "error", "ended").when(F.col("type") == "click", "message_candidate").when(F.col("type") == "view", "hud").otherwise("unknown")
    now, k = F.col("timestamp_ms"), F.col("id")
    return e.select("id", gate.admission(phase, now, now - k % 900, now - (k * 7) % 4000 + 500, F.col("score") > 25).alias("a")).select("id", "a.deadline", "a.action")


RULE_TEXT = "'相手の' || p_name || CASE p_size % 3 WHEN 0 THEN 'は倒れた' WHEN 1 THEN 'には効果がない' ELSE 'の{0}' END"


@query(f"""WITH t AS (SELECT p_brand AS file, p_type AS label, {RULE_TEXT} AS text, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)
 SELECT file, label, '$.lists[' || k || '].OriginalText' AS path, text, CASE p_size % 3 WHEN 0 THEN 'faint' WHEN 1 THEN 'immune' ELSE 'activate' END AS event_type FROM t""")
def rule_files(spark, d):
    """Texts out of JSON trees made from parts, one tree for each brand, and their types."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_type").alias("LabelName"), F.expr(RULE_TEXT).alias("OriginalText"))
    lists = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "LabelName", "OriginalText"))), lambda x: F.struct(x["LabelName"].alias("LabelName"), x["OriginalText"].alias("OriginalText")))
    files = p.groupBy(F.col("p_brand").alias("file")).agg(F.to_json(F.struct(lists.alias("lists"), F.lit("not a label").alias("Name"))).alias("json"))
    texts = rulesets.extracted_texts(files)
    return texts.select("file", "label", "path", "text", rulesets.keyword_type(F.col("text"), F.col("file"), F.col("label")).alias("event_type"))


BLANK = r"\x09-\x0D\x1C-\x20"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '\r\n?', chr(10), 'g') AS a FROM documents),
 j AS (SELECT doc_id, array_to_string(list_transform(string_split(a, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[{BLANK}]+', ''), '[{BLANK}]+$', '')), '') AS a FROM t),
 n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '[!/|]+', '!', 'g'), '[{BLANK}]+', ' ', 'g'), '^ ', ''), ' $', '') AS normalized FROM j)
 SELECT doc_id, normalized, lower(regexp_replace(normalized, '[!?.,/\\|:;"''`_\[\](){{}}<>{BLANK}]+', '', 'g')) AS match FROM n""")
def ascii_match_text(spark, d):
    """Normalised and match texts of all documents, other letters than ASCII replaced by question marks first."""
    docs = spread(table(spark, d, "documents")).select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    return docs.select("doc_id", text.both_texts("text").alias("t")).select("doc_id", "t.normalized", "t.match")


# The phase gate, sample by sample, for the query of the same name.
ORACLES["phase_gate"] = f"""WITH RECURSIVE {EV}, s AS MATERIALIZED (SELECT battle_id, nth * 200 AS ts, nth, type IN ('view', 'click') AS hud_now, CASE WHEN identity > 50 THEN identity > 75 END AS vs_now, type = 'signup' AS busy
  FROM (SELECT *, row_number() OVER (PARTITION BY battle_id ORDER BY timestamp_ms, id) AS nth FROM ev)),
 f AS (SELECT DISTINCT battle_id, 0::BIGINT AS nth, 0::BIGINT AS ts, 'unknown' AS phase, -1::BIGINT AS changed, -1::BIGINT AS active, -1 AS hud, 0 AS hud_streak, -1 AS vs, 0 AS vs_streak, false AS opened, CAST([] AS VARCHAR[]) AS said FROM s
  UNION ALL
  SELECT battle_id, nth, ts, CASE WHEN ends THEN 'unknown' ELSE phase2 END, CASE WHEN ends THEN ts ELSE changed2 END, active2, hud2, hud_streak, vs2, vs_streak, opened OR vs_falls, list_filter([CASE WHEN vs_falls THEN 'vs_fell' END, CASE WHEN opens1 THEN 'message_phase_opened' END,
    CASE WHEN rises THEN 'battle_hud_rose' WHEN falls THEN 'battle_hud_fell' END, CASE WHEN closes THEN 'message_phase_closed' WHEN opens2 THEN 'message_phase_opened' END, CASE WHEN ends THEN 'message_phase_expired' END], lambda x: x IS NOT NULL)
  FROM (SELECT *, phase2 = 'message_candidate' AND NOT busy AND CASE WHEN active2 >= 0 THEN active2 ELSE changed2 END >= 0 AND ts - CASE WHEN active2 >= 0 THEN active2 ELSE changed2 END >= 6000 AS ends
   FROM (SELECT *, CASE WHEN closes THEN 'hud' WHEN opens2 THEN 'message_candidate' ELSE phase1 END AS phase2, CASE WHEN closes OR opens2 THEN ts ELSE changed1 END AS changed2, CASE WHEN opens2 THEN ts ELSE active1 END AS active2
    FROM (SELECT *, rises AND phase1 <> 'hud' AS closes, falls AND phase1 <> 'message_candidate' AS opens2
     FROM (SELECT *, CASE WHEN vs_falls THEN 'message_candidate' ELSE phase END AS phase1, CASE WHEN opens1 THEN ts ELSE changed END AS changed1, CASE WHEN opens1 THEN ts ELSE active END AS active1,
        hud_streak >= 2 AND hud <> 1 AS rises, hud_streak <= -2 AND hud = 1 AS falls, CASE WHEN hud_streak >= 2 THEN 1 WHEN hud_streak <= -2 THEN 0 ELSE hud END AS hud2
      FROM (SELECT *, vs_falls AND phase <> 'message_candidate' AS opens1, CASE WHEN vs_now IS NULL THEN vs WHEN vs_streak >= 2 THEN 1 WHEN vs_falls THEN 0 ELSE vs END AS vs2
       FROM (SELECT *, vs_now IS NOT NULL AND vs_streak <= -2 AND vs = 1 AND NOT opened AS vs_falls
        FROM (SELECT s.*, f.phase, f.changed, f.active, f.hud, f.vs, f.opened, CASE WHEN s.hud_now THEN greatest(f.hud_streak, 0) + 1 ELSE least(f.hud_streak, 0) - 1 END AS hud_streak,
           CASE WHEN s.vs_now IS NULL THEN f.vs_streak WHEN s.vs_now THEN greatest(f.vs_streak, 0) + 1 ELSE least(f.vs_streak, 0) - 1 END AS vs_streak
         FROM f JOIN s ON s.battle_id = f.battle_id AND s.nth = f.nth + 1))))))))
 SELECT battle_id, ts AS timestamp_ms, unnest(said) AS transition, phase FROM f WHERE nth > 0"""
