"""One query for each operator over the stored tables, and the SQL that checks it.

events stand for typed log rows (battle = user), conversations for ordered messages,
documents for raw texts, part names for a dictionary, labels for a review overlay,
embeddings for numeric grids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import signals, text
from logloom.operators import aggregates, cascade, context, entities, gate, joins, lifecycle, readings, sessions, templates, timeline
from logloom.operators.shapes import effect_target_shape, shapes_of
from logloom.plans import fixtures
from logloom.sources import logs, reports, rulesets
from logloom.views import event_log, fixed, messages, spread, table

HOUR = 3_600_000
KINDS = ["click", "error", "purchase", "signup", "view"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The event log in SQL, put in front of each oracle that uses it.
EV = """ev AS (SELECT user_id AS battle_id, event_id AS id, epoch_us(ts) // 1000 AS timestamp_ms, event_type AS type,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS identity, value AS score FROM events)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its oracle if SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


@query(f"""
SELECT user_id AS battle_id, count(*) FILTER (WHERE event_type <> 'error') AS resolved,
  {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in KINDS)},
  count(*) FILTER (WHERE event_type = 'error') AS unknowns,
  floor(count(*) FILTER (WHERE event_type = 'error') / count(*) * 1e4 + 0.5) / 1e4 AS unknown_rate
FROM events GROUP BY user_id""")
def user_event_stats(spark, d):
    return aggregates.type_statistics(event_log(spark, d), "battle_id", "type", KINDS, "error")


@query("""
WITH e AS (SELECT user_id AS battle_id, event_type, CASE event_type WHEN 'click' THEN 'move' WHEN 'view' THEN 'switch_in' WHEN 'purchase' THEN 'faint' WHEN 'signup' THEN 'critical' END AS type FROM events)
SELECT battle_id, count(type) AS resolved, count(*) FILTER (WHERE type = 'move') AS observed_moves, count(*) FILTER (WHERE type = 'switch_in') AS switches,
  count(*) FILTER (WHERE type = 'faint') AS faints, count(*) FILTER (WHERE type = 'critical') AS criticals,
  0::BIGINT AS supereffective, 0::BIGINT AS resisted, 0::BIGINT AS immune, 0::BIGINT AS effective_total,
  count(*) FILTER (WHERE type IN ('move', 'switch_in')) AS actions, count(*) FILTER (WHERE event_type = 'error') AS unknowns,
  floor(count(*) FILTER (WHERE event_type = 'error') / count(*) * 1e4 + 0.5) / 1e4 AS unknown_rate
FROM e GROUP BY battle_id""")
def battle_statistics(spark, d):
    ev = event_log(spark, d)
    kinds = {"click": "move", "view": "switch_in", "purchase": "faint", "signup": "critical"}
    kind = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])
    known = ev.where(F.col("type") != "error").select("battle_id", F.element_at(kind, F.col("type")).alias("type"), F.col("identity").alias("actor"))
    found = aggregates.battle_statistics(known, ev.where(F.col("type") == "error"))
    return found.withColumn("unknown_rate", fixed(F.col("unknown_rate"), 4))


@query("""
WITH c AS (SELECT coalesce(CASE role WHEN 'system' THEN NULL ELSE role END, 'unknown') AS side, 'battle ' || (conv_id % 10) AS name FROM conversations)
SELECT side, name, count(*) AS n, side || ':' || name AS key FROM c GROUP BY side, name""")
def action_counts(spark, d):
    rows = messages(spark, d).select(
        F.when(F.col("side") != "system", F.col("side")).alias("side"),
        F.concat(F.lit("battle "), (F.col("battle_id") % 10).cast("string")).alias("name"),
        F.lit("move").alias("type"),
    )
    return aggregates.action_counts(rows)


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type")
def type_distribution(spark, d):
    return event_log(spark, d).groupBy("type").agg(F.count("*").alias("n"))


DEDUPE = f"""WITH {EV} SELECT id, battle_id, type, timestamp_ms,
  coalesce(timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY battle_id, type ORDER BY timestamp_ms, id) <= {6 * HOUR}, false) AS suppressed FROM ev"""


def deduped(spark, d):
    rows = event_log(spark, d).select("id", "battle_id", "type", "timestamp_ms")
    return timeline.sliding_dedupe_unique(rows, ["battle_id", "type"], "timestamp_ms", "id", 6 * HOUR)


@query(DEDUPE)
def sliding_dedupe(spark, d):
    return deduped(spark, d)


@query(f"SELECT id, battle_id, type, timestamp_ms FROM ({DEDUPE}) WHERE NOT suppressed")
def dedupe_kept_events(spark, d):
    return deduped(spark, d).where("NOT suppressed").drop("suppressed")


@query(f"""WITH {EV}, m AS (SELECT *, timestamp_ms // {HOUR} AS message FROM ev),
 g AS (SELECT DISTINCT battle_id, type, message FROM m),
 s AS (SELECT *, coalesce(message - lag(message) OVER (PARTITION BY battle_id, type ORDER BY message) <= 6, false) AS suppressed FROM g)
 SELECT m.id, m.battle_id, m.type, m.message, s.suppressed FROM m JOIN s USING (battle_id, type, message)""")
def sliding_dedupe_messages(spark, d):
    rows = event_log(spark, d).select("id", "battle_id", "type", F.floor(F.col("timestamp_ms") / HOUR).alias("message"))
    return timeline.sliding_dedupe(rows, ["battle_id", "type"], "message", ["message"], 6)


@query(f"""WITH {EV}, c AS (SELECT *, CASE WHEN type = lag(type) OVER w THEN 0 ELSE 1 END AS changed FROM ev WINDOW w AS (PARTITION BY battle_id ORDER BY timestamp_ms, id)),
 r AS (SELECT *, sum(changed) OVER (PARTITION BY battle_id ORDER BY timestamp_ms, id)::BIGINT AS run FROM c)
 SELECT battle_id, run, any_value(type) AS type, min(timestamp_ms) AS first_at, max(timestamp_ms) AS last_at, count(*) AS n FROM r GROUP BY battle_id, run""")
def run_length_groups(spark, d):
    return timeline.run_lengths(event_log(spark, d), "battle_id", ["timestamp_ms", "id"], "type")


@query(f"""WITH {EV}, f AS (SELECT *, type IN ('view', 'click') AS edge FROM ev),
 c AS (SELECT *, CASE WHEN edge = lag(edge) OVER w THEN 0 ELSE 1 END AS changed FROM f WINDOW w AS (PARTITION BY battle_id ORDER BY timestamp_ms, id)),
 r AS (SELECT *, sum(changed) OVER (PARTITION BY battle_id ORDER BY timestamp_ms, id) AS run FROM c),
 p AS (SELECT *, row_number() OVER (PARTITION BY battle_id, run ORDER BY timestamp_ms, id) AS place FROM r)
 SELECT battle_id, id, timestamp_ms, edge FROM p WHERE place = 2""")
def streak_edges(spark, d):
    found = timeline.streak_edges(event_log(spark, d), "battle_id", ["timestamp_ms", "id"], F.col("type").isin("view", "click"), 2)
    return found.select("battle_id", "id", "timestamp_ms", "edge")


@query(f"""WITH {EV}
 SELECT e.id, e.battle_id, e.timestamp_ms, arg_max(p.score, (p.timestamp_ms, p.id)) AS last_purchase
 FROM ev e LEFT JOIN ev p ON p.battle_id = e.battle_id AND p.type = 'purchase' AND p.timestamp_ms BETWEEN e.timestamp_ms - {24 * HOUR} AND e.timestamp_ms - 1
 GROUP BY ALL""")
def asof_last_purchase(spark, d):
    found = timeline.as_of_last(event_log(spark, d), "battle_id", "timestamp_ms", "id", F.when(F.col("type") == "purchase", F.col("score")), 24 * HOUR, "last_purchase")
    return found.select("id", "battle_id", "timestamp_ms", "last_purchase")


@query(f"""WITH {EV} SELECT id, battle_id, identity, coalesce(timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY battle_id, identity ORDER BY timestamp_ms, id) <= {24 * HOUR}, false) AS promoted FROM ev""")
def promotion_within_window(spark, d):
    return timeline.seen_before(event_log(spark, d), ["battle_id", "identity"], "timestamp_ms", "id", 24 * HOUR, "promoted").select("id", "battle_id", "identity", "promoted")


@query(f"""WITH {EV} SELECT e.id, e.battle_id, EXISTS (SELECT 1 FROM ev p WHERE p.battle_id = e.battle_id AND p.type = 'click'
 AND p.timestamp_ms BETWEEN e.timestamp_ms - {6 * HOUR} AND e.timestamp_ms - 1) AS recent FROM ev e""")
def recent_match_suppressed(spark, d):
    return timeline.exists_within(event_log(spark, d), ["battle_id"], "timestamp_ms", F.col("type") == "click", 6 * HOUR, "recent").select("id", "battle_id", "recent")


@query(f"""WITH {EV}, p AS (SELECT a.id, b.id AS near_id, b.type AS near_type, row_number() OVER (PARTITION BY a.id ORDER BY b.timestamp_ms, b.id) AS place
 FROM ev a JOIN ev b ON a.battle_id = b.battle_id AND abs(a.timestamp_ms - b.timestamp_ms) <= {3 * HOUR} WHERE a.type = 'error' AND b.type <> 'error')
 SELECT id, near_id, near_type, place FROM p WHERE place <= 4""")
def nearest_events(spark, d):
    ev = event_log(spark, d).select("battle_id", "id", "timestamp_ms", "type")
    found = joins.nearest_events(ev.where("type = 'error'"), ev.where("type <> 'error'"), ["battle_id"], "timestamp_ms", "id", 3 * HOUR, 4)
    return found.select("id", F.col("r_id").alias("near_id"), F.col("r_type").alias("near_type"), "place")


@query(f"""WITH {EV} SELECT id, battle_id, last_value(CASE WHEN type <> 'error' THEN id END IGNORE NULLS) OVER (PARTITION BY battle_id ORDER BY timestamp_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_event_id FROM ev""")
def after_event_pointer(spark, d):
    return timeline.last_pointer(event_log(spark, d), "battle_id", ["timestamp_ms", "id"], F.when(F.col("type") != "error", F.col("id")), "after_event_id").select("id", "battle_id", "after_event_id")


def order_views(spark, d):
    observations = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.col("o_orderkey") * 10 + 1)).otherwise(F.array().cast("array<bigint>")).alias("event_ids")
    )
    items = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") > 2, F.col("l_orderkey")).alias("observation_id")
    )
    return observations, items


ATTACHED = """WITH o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'),
 e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_linenumber FROM lineitem),
 a AS (SELECT o.id AS observation_id, e.id AS event_id FROM o JOIN e ON e.l_orderkey = o.id WHERE e.l_linenumber > 2 OR (o.id % 2 = 0 AND e.id = o.id * 10 + 1))"""


@query(f"{ATTACHED} SELECT observation_id, event_id FROM a GROUP BY ALL")
def attached_events(spark, d):
    return joins.attached(*order_views(spark, d))


@query(f"{ATTACHED} SELECT id FROM e WHERE id NOT IN (SELECT event_id FROM a)")
def unattached_events(spark, d):
    observations, items = order_views(spark, d)
    return joins.unattached(items, joins.attached(observations, items)).select("id")


@query(f"""WITH {EV}, o AS (SELECT battle_id, id, timestamp_ms AS opened, timestamp_ms + 600000 AS ended, type IN ('purchase', 'signup') AS resolved, identity % 3 AS ident, identity, score FROM ev),
 p AS (SELECT a.battle_id, a.id, b.id AS partner_id, greatest(0, greatest(a.opened, b.opened) - least(a.ended, b.ended)) AS gap_ms,
   1 - abs(a.identity - b.identity) / 100.0::DOUBLE AS text_similarity, 1 - abs(a.score - b.score) / (abs(a.score) + abs(b.score) + 1) AS visual_similarity, a.ident = b.ident AS same
   FROM o a JOIN o b ON a.battle_id = b.battle_id AND NOT a.resolved AND b.resolved
     AND NOT EXISTS (SELECT 1 FROM o c WHERE c.battle_id = a.battle_id AND c.resolved AND c.opened > least(a.opened, b.opened) AND c.opened < greatest(a.opened, b.opened))),
 s AS (SELECT *, least(1.0, 0.3 + 0.35 * text_similarity + 0.2 * visual_similarity + CASE WHEN same THEN 0.15 ELSE 0 END) AS score FROM p
   WHERE gap_ms <= {3 * HOUR} AND text_similarity >= 0.66 AND visual_similarity >= 0.58),
 r AS (SELECT *, row_number() OVER (PARTITION BY battle_id, id ORDER BY score DESC, partner_id) AS place FROM s WHERE score >= 0.72)
 SELECT battle_id, id, partner_id, gap_ms, floor(text_similarity * 1e6 + 0.5) / 1e6 AS text_similarity, floor(visual_similarity * 1e6 + 0.5) / 1e6 AS visual_similarity, floor(score * 1e6 + 0.5) / 1e6 AS score FROM r WHERE place = 1""")
def merge_candidates(spark, d):
    rows = event_log(spark, d).select(
        "battle_id", "id", F.col("timestamp_ms").alias("opened_ms"), (F.col("timestamp_ms") + 600_000).alias("end_ms"),
        F.col("type").isin("purchase", "signup").alias("resolved"), (F.col("identity") % 3).alias("identity"), F.col("identity").alias("word"), "score",
    )
    words = 1 - F.abs(F.col("word") - F.col("r_word")) / 100.0
    looks = 1 - F.abs(F.col("score") - F.col("r_score")) / (F.abs("score") + F.abs("r_score") + 1)
    found = joins.merge_candidates(rows, words, looks, max_gap_ms=3 * HOUR)
    return found.withColumns({c: fixed(F.col(c), 6) for c in ("text_similarity", "visual_similarity", "score")})


@query("""SELECT a.event_id AS id, least(epoch_us(a.ts) // 1000, epoch_us(b.ts) // 1000) AS opened_ms, CASE WHEN a.value < 20 OR b.value < 20 THEN NULL ELSE greatest(epoch_us(a.ts) // 1000, epoch_us(b.ts) // 1000) END AS closed_ms,
 a.value < 20 OR b.value < 20 AS active, greatest(a.value, b.value) AS presence, CASE WHEN b.value > a.value THEN b.event_id ELSE a.event_id END AS best_frame, 2::BIGINT AS attempts, 2::BIGINT AS n_events
 FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0""")
def merged_pairs(spark, d):
    e = event_log(spark, d)
    one = F.struct(
        F.col("timestamp_ms").alias("opened_ms"), F.when(F.col("score") >= 20, F.col("timestamp_ms")).alias("closed_ms"), F.col("score").alias("presence"),
        F.col("id").alias("best_frame"), F.lit(1).cast("bigint").alias("attempts"), F.array("id").alias("event_ids"),
    )
    a = e.where("id % 2 = 0").select("id", one.alias("target"))
    b = e.where("id % 2 = 1").select((F.col("id") - 1).alias("id"), one.alias("other"))
    merged = joins.union_of_pair(a.join(b, "id"))
    return merged.select("id", *[F.col(f"merged.{c}").alias(c) for c in ("opened_ms", "closed_ms", "active", "presence", "best_frame", "attempts")], F.size("merged.event_ids").cast("bigint").alias("n_events"))


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY battle_id ORDER BY timestamp_ms DESC, id DESC) AS place FROM ev) SELECT battle_id, id, timestamp_ms, place FROM r WHERE place <= 16""")
def newest_n_per_user(spark, d):
    return timeline.newest(event_log(spark, d), "battle_id", "timestamp_ms", "id", 16).select("battle_id", "id", "timestamp_ms", "place")


@query(f"""WITH {EV}, l AS (SELECT battle_id, identity, max((timestamp_ms, id)) AS seen FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY battle_id ORDER BY seen DESC) AS place FROM l)
 SELECT battle_id, identity, place, seen[1] AS timestamp_ms FROM r WHERE place <= 18""")
def recent_dictionary(spark, d):
    return timeline.recent_distinct(event_log(spark, d), "battle_id", "timestamp_ms", "id", "identity", 18)


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem)
 SELECT l_orderkey, l_linenumber, 'evt_' || l_orderkey || CASE WHEN n > 1 THEN '_' || k ELSE '' END AS slot_id FROM c""")
def slot_ids(spark, d):
    return timeline.numbered_slots(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", "slot_id")


@query(f"""WITH {EV} SELECT battle_id, id, timestamp_ms, CASE WHEN type = 'error' THEN 'unknown' ELSE 'event' END AS kind, CASE WHEN type <> 'error' THEN type END AS type, CASE WHEN type = 'error' THEN score END AS score FROM ev""")
def unified_timeline(spark, d):
    ev = event_log(spark, d)
    known = ev.where("type <> 'error'").select("battle_id", "id", "timestamp_ms", "type")
    return timeline.unified_timeline(known, ev.where("type = 'error'").select("battle_id", "id", "timestamp_ms", "score"), "timestamp_ms", "id", None)


@query(f"""WITH {EV} SELECT id, timestamp_ms, CASE WHEN type = 'error' THEN 'unknown' ELSE 'event' END AS kind FROM ev ORDER BY timestamp_ms DESC, id DESC LIMIT 48""")
def newest_timeline(spark, d):
    ev = event_log(spark, d).select("id", "timestamp_ms", "type")
    return timeline.unified_timeline(ev.where("type <> 'error'"), ev.where("type = 'error'"), "timestamp_ms", "id", 48).select("id", "timestamp_ms", "kind")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS place FROM part) SELECT p_partkey, p_name, p_brand, p_type FROM r WHERE place = 1""")
def keep_first_rules(spark, d):
    return aggregates.keep_first(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["p_name", "p_brand"], ["p_partkey"])


@query("""SELECT n.n_name, count(c.c_custkey) AS n FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal < 0 GROUP BY n.n_name""")
def zero_filled_stage_counts(spark, d):
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = table(spark, d, "customer").where("c_acctbal < 0").join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregates.zero_filled(names, "n_name", rows)


@query("""SELECT event_type AS type, count(*) AS samples, count(*) FILTER (WHERE value > 50) AS visible, floor(sum(value) * 1e2 + 0.5) / 1e2 AS score_total, max(value) AS score_max FROM events GROUP BY event_type""")
def signal_summary(spark, d):
    found = aggregates.signal_summary(event_log(spark, d), "type", "score", F.col("score") > 50)
    return found.withColumn("score_total", fixed(F.col("score_total"), 2))


@query(f"""WITH {EV}, s AS (SELECT *, (score > 30)::INT AS on_, coalesce(((score > 30) <> (lag(score) OVER w > 30))::INT, 0) AS step FROM ev WINDOW w AS (PARTITION BY battle_id ORDER BY timestamp_ms, id)),
 t AS (SELECT battle_id, id, sum(on_) OVER f / count(*) OVER f AS occupied_ratio, count(*) OVER f AS n, sum(step) OVER g AS steps FROM s
  WINDOW f AS (PARTITION BY battle_id ORDER BY timestamp_ms, id ROWS BETWEEN 35 PRECEDING AND CURRENT ROW), g AS (PARTITION BY battle_id ORDER BY timestamp_ms, id ROWS BETWEEN 34 PRECEDING AND CURRENT ROW))
 SELECT battle_id, id, floor(occupied_ratio * 1e6 + 0.5) / 1e6 AS occupied_ratio, floor(CASE WHEN n > 1 THEN steps / (n - 1) ELSE 0 END * 1e6 + 0.5) / 1e6 AS transition_ratio,
  occupied_ratio >= 0.8 AND CASE WHEN n > 1 THEN steps / (n - 1) ELSE 0 END <= 0.2 AS persistent FROM t""")
def rolling_occupancy(spark, d):
    found = timeline.rolling_occupancy(event_log(spark, d), ["battle_id"], ["timestamp_ms", "id"], F.col("score") > 30, 36)
    return found.select("battle_id", "id", fixed(F.col("occupied_ratio"), 6).alias("occupied_ratio"), fixed(F.col("transition_ratio"), 6).alias("transition_ratio"), "persistent")


@query(f"""WITH {EV} SELECT battle_id, id, count(*) FILTER (WHERE score > 40) OVER f >= 3 AND coalesce(max(timestamp_ms) FILTER (WHERE score > 40) OVER f - min(timestamp_ms) FILTER (WHERE score > 40) OVER f >= {HOUR}, false) AS confirmed
 FROM ev WINDOW f AS (PARTITION BY battle_id ORDER BY timestamp_ms, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def m_of_n_confirmed(spark, d):
    return timeline.m_of_n(event_log(spark, d), ["battle_id"], ["timestamp_ms", "id"], "timestamp_ms", F.col("score") > 40, 3, 5, HOUR).select("battle_id", "id", "confirmed")


@query(f"WITH {EV} SELECT battle_id, arg_max(id, (score, -id)) AS best_id, max(score) AS score FROM ev GROUP BY battle_id")
def best_evidence(spark, d):
    return aggregates.best_row(event_log(spark, d), "battle_id", "score", "id", "id", "best_id")


@query(f"""WITH {EV}, x AS (SELECT battle_id, CASE type WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN 5 ELSE 3 END AS pr, type, id FROM ev) SELECT battle_id, arg_max(type, (pr, id)) AS type FROM x GROUP BY battle_id""")
def highest_reason(spark, d):
    return aggregates.highest_reason(event_log(spark, d), "battle_id", "type", "id", {"click": 1, "view": 1, "error": 5, "purchase": 3, "signup": 3})


@query("""SELECT user_id AS battle_id, count(*) FILTER (WHERE NOT s) AS detected, count(*) FILTER (WHERE NOT s) AS committed, count(*) FILTER (WHERE NOT s AND event_type = 'purchase') AS resolved,
 count(*) FILTER (WHERE NOT s AND event_type = 'error') AS ocr_unknown, count(*) FILTER (WHERE NOT s AND event_type = 'view') AS unread, count(*) FILTER (WHERE NOT s AND event_type = 'click') AS pending,
 count(*) FILTER (WHERE s) AS suppressed, count(*) FILTER (WHERE NOT s AND value > 100) AS active, coalesce(sum(event_id % 3) FILTER (WHERE NOT s), 0)::BIGINT AS attempts
 FROM (SELECT *, value < 10 AS s FROM events) GROUP BY user_id""")
def observation_summary(spark, d):
    states = F.create_map(*[F.lit(x) for p in (("purchase", "resolved"), ("error", "ocr_unknown"), ("view", "unread"), ("click", "pending")) for x in p])
    rows = event_log(spark, d).select(
        "battle_id", (F.col("score") > 100).alias("active"), (F.col("score") < 10).alias("suppressed"), F.element_at(states, F.col("type")).alias("resolution"), (F.col("id") % 3).alias("attempts")
    )
    return aggregates.observation_summary(rows)


VALUE = "CASE event_type WHEN 'click' THEN 2.2 WHEN 'view' THEN 1.5 WHEN 'error' THEN 0.15 ELSE 0.75 END"
CLUSTERS = f"""WITH i AS (SELECT 'key ' || json_extract_string(props, '$.k') AS key, event_id AS id, {VALUE} AS worth, CASE WHEN value > 5 THEN value / 500 END AS confidence, user_id % 40 = 0 AS duplicate, event_id % 500 = 0 AS noted FROM events),
 n AS (SELECT key, max(duplicate::INT) AS near_existing, max(noted::INT) AS noted FROM i GROUP BY key),
 l AS (SELECT i.key, id, confidence, n.near_existing, n.noted, worth * greatest(0.35, least(1.15, 0.45 + coalesce(confidence, 0.6))) * CASE WHEN n.near_existing = 1 THEN 0.25 ELSE 1 END * CASE WHEN n.noted = 1 THEN 1.25 ELSE 1 END AS loss FROM i JOIN n USING (key)),
 c AS (SELECT key, count(*) AS n, list(id ORDER BY id)[1:6] AS first_ids, floor(avg(confidence) * 1e3 + 0.5) / 1e3 AS mean_confidence, floor(sum(loss::DOUBLE) * 1e3 + 0.5) / 1e3 AS weighted_loss, any_value(near_existing) AS near_existing, any_value(noted) AS noted FROM l GROUP BY key)"""


def clusters(spark, d):
    kinds = F.create_map(*[F.lit(x) for p in (("click", "move"), ("view", "boost"), ("error", "noise")) for x in p])
    items = event_log(spark, d).select(
        F.concat(F.lit("key "), F.col("identity").cast("string")).alias("key"), "id", F.element_at(kinds, F.col("type")).alias("kind"),
        F.when(F.col("score") > 5, F.col("score") / 500).alias("confidence"), (F.col("battle_id") % 40 == 0).alias("duplicate"), (F.col("id") % 500 == 0).alias("noted"),
    )
    return aggregates.coverage_clusters(items)


@query(f"{CLUSTERS} SELECT key, n, array_to_string(first_ids, ',') AS first_ids, mean_confidence, weighted_loss, near_existing, noted FROM c")
def coverage_clusters(spark, d):
    return clusters(spark, d).withColumn("first_ids", F.array_join(F.transform("first_ids", lambda x: x.cast("string")), ","))


@query(f"""{CLUSTERS}, k AS (SELECT key, n, weighted_loss, CASE WHEN near_existing = 1 THEN 'near_existing_event' WHEN noted = 1 THEN 'near_miss' ELSE 'unclassified' END AS cause FROM c),
 r AS (SELECT *, CASE cause WHEN 'near_existing_event' THEN 1 WHEN 'near_miss' THEN 2 ELSE 3 END AS risk FROM k)
 SELECT key, n, weighted_loss, cause AS kind, risk, CASE cause WHEN 'near_existing_event' THEN 'review_only' WHEN 'near_miss' THEN 'add_fixture,adjust_threshold' ELSE 'review_only' END AS actions,
  row_number() OVER (ORDER BY risk, weighted_loss DESC, n DESC, key) AS place, printf('unknown_cov_%03d', row_number() OVER (ORDER BY risk, weighted_loss DESC, n DESC, key)) AS proposal_id
 FROM r ORDER BY place LIMIT 12""")
def coverage_proposals(spark, d):
    rows = clusters(spark, d)
    causes = F.array_compact(F.array(F.when(F.col("near_existing") == 1, "near_existing_event"), F.when(F.col("noted") == 1, "near_miss")))
    rows = rows.withColumn("causes", causes).withColumn("cause", aggregates.classification(F.col("causes")))
    risk = F.when(F.col("cause") == "near_existing_event", 1).when(F.col("cause") == "near_miss", 2).otherwise(3)
    found = aggregates.ranked_proposals(rows, F.col("cause"), risk, 12)
    first = F.when(F.col("cause") == "unclassified", F.array().cast("array<string>")).otherwise(F.array("cause"))
    return found.select("key", "n", "weighted_loss", "kind", "risk", F.array_join(aggregates.actions_of(first), ",").alias("actions"), "place", "proposal_id")


@query("""WITH j AS (SELECT d.lang, d.n_chars < 400 AS before_unknown, d.n_chars < 400 AND coalesce(l.quality, 0) = 0 AS after_unknown FROM documents d LEFT JOIN labels l USING (doc_id))
 SELECT lang, count(*) AS n_before, floor(avg(before_unknown::INT) * 1e4 + 0.5) / 1e4 AS rate_before, count(*) AS n_after, floor(avg(after_unknown::INT) * 1e4 + 0.5) / 1e4 AS rate_after,
 floor((floor(avg(after_unknown::INT) * 1e4 + 0.5) / 1e4 - floor(avg(before_unknown::INT) * 1e4 + 0.5) / 1e4) * 1e4 + 0.5) / 1e4 AS delta FROM j GROUP BY lang""")
def before_after_rate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    short = F.col("n_chars") < 400
    return aggregates.before_after(docs.select("lang", short.alias("unknown")), docs.select("lang", (short & (F.coalesce("quality", F.lit(0)) == 0)).alias("unknown")), "lang")


@query("""SELECT coalesce(event_type, 'total') AS type, count(*) AS n, floor(sum(value) * 1e2 + 0.5) / 1e2 AS total FROM events GROUP BY ROLLUP (event_type)""")
def counts_with_total(spark, d):
    return aggregates.counts_with_total(event_log(spark, d), "type", {"n": F.count("*"), "total": fixed(F.sum("score"), 2)})


GATE_CONFIDENCE = "(doc_id % 100) / 100.0::DOUBLE"
GATE_MATCH = r"lower(regexp_replace(regexp_replace(text, '[!?.,:;()|*$%&#_]', '', 'g'), '\s+', '', 'g'))"


@query(rf"""WITH m AS (SELECT doc_id, {GATE_MATCH} AS match, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normal, {GATE_CONFIDENCE} AS sure FROM documents)
 SELECT doc_id, CASE WHEN length(match) = 0 THEN 'too_short' WHEN regexp_matches(normal, '(^|\D)\d{{1,2}}\s*[:：]\s*\d{{2}}(\D|$)') THEN 'timer'
  WHEN length(regexp_replace(match, '[A-Za-z0-9]', '', 'g')) / length(match) >= 0.3 THEN 'symbol_noise'
  WHEN length(regexp_replace(match, '[^0-9]', '', 'g')) >= 2 AND len(list_filter(string_split(normal, ' '), lambda t: t <> '')) >= 5
   AND len(list_filter(list_filter(string_split(normal, ' '), lambda t: t <> ''), lambda t: length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) <= 1)) / len(list_filter(string_split(normal, ' '), lambda t: t <> '')) >= 0.5 THEN 'other_noise'
  WHEN sure < 0.5 THEN 'low_confidence_no_action_signal' WHEN length(match) >= 6 AND sure >= 0.7 THEN 'accepted' WHEN length(match) < 3 THEN 'too_short' ELSE 'other_noise' END AS reason FROM m""")
def gate_decisions(spark, d):
    docs = spread(table(spark, d, "documents"))
    match = F.lower(F.regexp_replace(F.regexp_replace("text", r"[!?.,:;()|*$%&#_]", ""), r"\s+", ""))
    normal = F.trim(F.regexp_replace("text", r"\s+", " "))
    made = docs.select("doc_id", match.alias("match"), normal.alias("normal"))
    return made.select("doc_id", gate.gate_reason(F.col("match"), F.col("normal"), (F.col("doc_id") % 100) / 100.0, F.lit(None).cast("array<string>")).alias("reason"))


@query()
def gate_decisions_all(spark, d):
    docs = spread(table(spark, d, "documents")).select("doc_id", text.both_texts("text").alias("t")).select("doc_id", F.col("t.normalized").alias("normal"), F.col("t.match").alias("match"))
    return docs.select("doc_id", gate.gate_reason(F.col("match"), F.col("normal"), (F.col("doc_id") % 100) / 100.0, F.lit(None).cast("array<string>")).alias("reason"))


CELL = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query("SELECT conv_id, turn, " + " || ',' || ".join(CELL.format(f"coalesce({c}::VARCHAR, '')") for c in ("conv_id", "turn", "role", "text")) + " AS line FROM conversations")
def csv_rows(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.csv_row(*[F.col(c) for c in ("conv_id", "turn", "role", "text")]).alias("line"))


@query("""SELECT 'cor_' || d.doc_id AS id, d.doc_id::VARCHAR AS "targetId", CASE WHEN l.quality = 0 THEN 'low quality' ELSE '' END AS note, CASE WHEN l.toxic = 1 THEN 'reviewed' ELSE 'pending' END AS "reviewStatus"
 FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality = 0 OR l.toxic = 1""")
def corrections_join(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    key = F.col("doc_id").cast("string").alias("id")
    unknowns = rows.select(key, F.when(F.col("toxic") == 1, "reviewed").otherwise("pending").alias("reviewStatus"))
    return logs.corrections_of(unknowns, rows.where("quality IS NOT NULL").select(key, F.when(F.col("quality") == 0, " low quality ").otherwise(" ").alias("note")))


@query('SELECT d.n_chars AS "timestampMs", d.doc_id::VARCHAR AS id, ' + " || ',' || ".join(CELL.format(c) for c in ("d.doc_id::VARCHAR", "d.n_chars::VARCHAR", "''", "d.text", "d.text", "'0.5'", "(d.lang || ' | ' || d.source)", "'time:0'", "'pending'", "coalesce(l.quality::VARCHAR, '')")) + " AS line FROM documents d LEFT JOIN labels l USING (doc_id)")
def unknowns_csv(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("timestampMs"), F.lit(None).cast("string").alias("afterEventId"), F.col("text").alias("rawText"),
        F.col("text").alias("normalizedText"), F.lit(0.5).alias("ocrConfidence"), F.array("lang", "source").alias("candidateMatches"), F.lit("time:0").alias("sourceFrameRef"), F.lit("pending").alias("reviewStatus"),
    )
    notes = table(spark, d, "labels").select(F.concat(F.lit("cor_"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").cast("string").alias("targetId"), F.col("quality").cast("string").alias("note"))
    return logs.unknowns_csv(rows, notes)


FUZZY = """WITH k AS (SELECT DISTINCT p_name AS entry_id, p_name AS label FROM part),
 t AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN replace(p_name, 'e', 'a') ELSE substr(p_name, 2) END AS text FROM part),
 s AS (SELECT text, entry_id, label, CASE WHEN text = label THEN 1.0 ELSE 1.0 - levenshtein(text, label)::DOUBLE / greatest(length(text), length(label)) - 0.08 * greatest(abs(length(text) - length(label)) - 1, 0) END AS score
   FROM t JOIN k ON abs(length(text) - length(label)) <= 4),
 r AS (SELECT *, row_number() OVER w AS place, coalesce(lead(score) OVER w, 0.72) AS second FROM s WHERE score >= 0.72 WINDOW w AS (PARTITION BY text ORDER BY score DESC, entry_id))
 SELECT t.text, label, floor(r.score * 1e6 + 0.5) / 1e6 AS score, floor((r.score - second) * 1e6 + 0.5) / 1e6 AS margin,
  CASE WHEN r.score >= 1 THEN 'accepted' WHEN r.score >= 0.84 AND r.score - second >= 0.08 - 1e-9 THEN 'accepted' WHEN r.score >= 0.72 THEN 'review' ELSE 'not_found' END AS status
 FROM t LEFT JOIN r ON r.text = t.text AND r.place = 1"""


@query(FUZZY)
def fuzzy_part_match(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    names = part.select("p_name").distinct()
    entries = names.select(F.col("p_name").alias("id"), F.col("p_name").alias("label"), F.array().cast("array<string>").alias("aliases"))
    third = F.col("p_partkey") % 3
    noisy = F.when(third == 0, F.col("p_name")).when(third == 1, F.replace("p_name", F.lit("e"), F.lit("a"))).otherwise(F.expr("substr(p_name, 2)"))
    found = entities.match_entries(part.select(noisy.alias("text")), entities.dictionary_keys(entries))
    return found.select("text", "label", fixed(F.col("score"), 6).alias("score"), fixed(F.col("margin"), 6).alias("margin"), "status")


SPAN_WORDS = ["the", "than", "tion", "and", "ing", "reat", "for"]


@query(f"""WITH w AS (SELECT unnest({SPAN_WORDS}) AS key), t AS (SELECT conv_id || '-' || turn AS id, text FROM conversations),
 o AS (SELECT id, {{'o': -length(key), 's': p - 1, 'e': p - 1 + length(key), 'k': key}} AS x FROM t, w, unnest(range(1, length(text) - length(key) + 2)) r(p) WHERE substr(text, p, length(key)) = key),
 g AS (SELECT id, list_sort(list_distinct(list(x))) AS xs FROM o GROUP BY id),
 k AS (SELECT id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda got, x: CASE WHEN len(list_filter(got, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN got ELSE list_concat(got, x) END)) AS x FROM g)
 SELECT id, x.s::INT AS start, x.e::INT AS "end", x.k AS key FROM k""")
def dictionary_spans(spark, d):
    lines = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    keys = spark.createDataFrame([(w,) for w in SPAN_WORDS], "key string")
    return entities.dictionary_spans(lines, keys)


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
 v AS (SELECT doc_id, array_to_string(ls, '') AS text, 0 AS priority FROM l
  UNION ALL SELECT doc_id, ls[k + 1] || ls[k + 2], 12 + k FROM (SELECT doc_id, ls, unnest(range(len(ls) - 1)) AS k FROM l)
  UNION ALL SELECT doc_id, ls[k + 1] || ls[k + 2] || ls[k + 3], 13 + k FROM (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS k FROM l)
  UNION ALL SELECT doc_id, ls[k + 1], 20 + k FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS k FROM l))
 SELECT doc_id, md5(text) AS view_md5, min(priority)::INT AS priority FROM v GROUP BY doc_id, text""")
def line_windows(spark, d):
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), "text")
    return templates.surfaces_of(docs).select(F.col("id").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("view_md5"), "priority")


@query("""SELECT p_partkey, p_name, bool_or(p_name = x OR contains(p_name, x) ) AS held FROM part, (VALUES ('lace'), ('rose')) v(x) GROUP BY ALL""", name="contains_exactly")
def contains_exactly(spark, d):
    """With a threshold above 1 only containment word for word is left of the fuzzy one."""
    held = [text.contains_fuzzily(F.col("p_name"), F.lit(w), 1.1) for w in ("lace", "rose")]
    return table(spark, d, "part").select("p_partkey", "p_name", (held[0] | held[1]).alias("held"))


@query("""WITH p AS (SELECT p_partkey, p_name, length(p_name) AS n FROM part)
 SELECT p_partkey, p_name, contains(p_name, 'lavander') OR len(list_filter([7, 8, 9], lambda size: size <= n AND len(list_filter(range(1, n - size + 2), lambda s: 1.0 - levenshtein(substr(p_name, s, size), 'lavander')::DOUBLE / greatest(length(substr(p_name, s, size)), 8) >= 0.66)) > 0)) > 0 AS held FROM p""")
def similarity_contains(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", text.contains_fuzzily(F.col("p_name"), F.lit("lavander")).alias("held"))


@query()
def normalize_match_text(spark, d):
    docs = spread(table(spark, d, "documents"))
    return docs.select("doc_id", text.both_texts("text").alias("t")).select("doc_id", "t.normalized", "t.match")


@query()
def ocr_similarity(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    pairs = names.select(F.col("p_name").alias("a"), F.translate("p_name", "aeo", "eoa").alias("b"))
    return pairs.select("a", "b", text.ocr_similarity("a", "b").alias("score"))


@query("""SELECT p_partkey, lower(to_base(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_brand || chr(31) || p_name, ''), lambda c: ord(c)::BIGINT)),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295), 36)) AS rule_id FROM part""")
def rule_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", text.rule_hash(F.col("p_brand"), F.col("p_name")).alias("rule_id"))


GRID = "list_transform(embedding, lambda x: floor(least(1.0, abs(x) * 4) * 15)::INT)"


@query(f"""WITH e AS (SELECT vec_id, {GRID} AS c FROM embeddings),
 p AS (SELECT a.vec_id, list_filter(list_zip(a.c, b.c), lambda z: z[1] <> 0 OR z[2] <> 0) AS z FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
 q AS (SELECT vec_id, len(z) AS n, coalesce(list_sum(list_transform(z, lambda v: abs(v[1] - v[2]) / 15.0::DOUBLE)), 0) AS cells, len(list_filter(z, lambda v: (v[1] = 0) <> (v[2] = 0))) AS torn FROM p)
 SELECT vec_id, floor(least(1.0, CASE WHEN n = 0 THEN 0 ELSE cells / n * 0.65 + torn / n * 0.25 END) * 1e6 + 0.5) / 1e6 AS distance FROM q""")
def fingerprint_distance(spark, d):
    cells = F.transform("embedding", lambda x: F.floor(F.least(F.lit(1.0), F.abs(x) * 4) * 15).cast("int"))
    rows = table(spark, d, "embeddings").select("vec_id", cells.alias("a"))
    later = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return rows.join(later, "vec_id").select("vec_id", fixed(signals.fingerprint_distance(F.col("a"), F.col("b"), F.lit(0.1), F.lit(0.1)), 6).alias("distance"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0.05)::INT) AS c FROM embeddings),
 p AS (SELECT a.vec_id, list_sum(a.c) AS na, list_sum(b.c) AS nb, len(list_filter(list_zip(a.c, b.c), lambda z: z[1] = 1 AND z[2] = 1)) AS shared FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
 SELECT vec_id, shared::INT AS shared, (na + nb - shared)::INT AS "union", floor(CASE WHEN na = 0 THEN 0 ELSE shared / na END * 1e6 + 0.5) / 1e6 AS retained_before, floor(CASE WHEN nb = 0 THEN 0 ELSE shared / nb END * 1e6 + 0.5) / 1e6 AS retained_after,
  floor(CASE WHEN least(na, nb) = 0 THEN 0 ELSE shared / least(na, nb) END * 1e6 + 0.5) / 1e6 AS contained, floor(CASE WHEN na + nb - shared = 0 THEN 0 ELSE shared / (na + nb - shared) END * 1e6 + 0.5) / 1e6 AS iou FROM p""")
def signature_overlap(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0.05).cast("int")).alias("a"))
    later = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    found = rows.join(later, "vec_id").select("vec_id", signals.signature_overlap(F.col("a"), F.col("b")).alias("s")).select("vec_id", "s.*")
    return found.withColumns({c: fixed(F.col(c), 6) for c in ("retained_before", "retained_after", "contained", "iou")})


@query("""SELECT event_id, floor((0.45 * least(1, greatest(0, value / 100)) + 0.15 * least(1, (event_id % 4) / 2.0::DOUBLE) + 0.15 * least(1, (event_id % 9) / 6.0::DOUBLE) + 0.15 * least(1, (event_id % 10) / 10.0::DOUBLE) + 0.1 * (1 - (event_id % 5) / 5.0::DOUBLE)) * 1e6 + 0.5) / 1e6 AS score FROM events""")
def commit_score(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    return e.select("event_id", fixed(signals.commit_score(F.col("value") / 100, k % 4, k % 9, (k % 10) / 10.0, (k % 5) / 5.0), 6).alias("score"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Presence samples from the event log: one every 200 ms, in the order of its rows."""
    ev = event_log(spark, d)
    place = F.row_number().over(Window.partitionBy("battle_id").orderBy("timestamp_ms", "id"))
    return ev.select(
        "battle_id", (place * 200).cast("bigint").alias("timestamp_ms"), F.col("id").alias("seq"), F.when(F.col("type") != "error", F.col("type")).alias("picture"),
        F.least(F.lit(1.0), F.col("score") / 100).alias("presence"), F.least(F.lit(1.0), F.col("score") / 80).alias("score"), (F.col("identity") < 5).alias("fixed"),
        F.col("type").isin("view", "click").alias("hud"), F.when(F.col("identity") > 50, F.col("identity") > 75).alias("vs"), (F.col("type") == "signup").alias("busy"),
    )


@query()
def watcher_sessions(spark, d):
    return sessions.message_watcher(samples(spark, d))


@query()
def phase_gate(spark, d):
    return sessions.phase_gate(samples(spark, d))


@query()
def template_parse(spark, d):
    return templates.decoded(fixtures.surfaces(spark), fixtures.rules(spark), fixtures.keys(spark)).select("id", "rule_id", "event_type", "confidence", F.to_json("found").alias("slots"))


@query()
def replay_summary(spark, d):
    """Parse the bundled log, gate what is left, drop near repeats, and report coverage by battle."""
    log = fixtures.messages(spark)
    events = templates.decoded(fixtures.surfaces(spark), fixtures.rules(spark), fixtures.keys(spark))
    rows = log.join(events.select("id", "event_type", F.to_json("found").alias("slots")), "id", "left")
    rows = rows.withColumn("t", text.both_texts("text")).withColumns({"normal": F.col("t.normalized"), "match": F.col("t.match")}).drop("t")
    reason = gate.gate_reason(F.col("match"), F.col("normal"), F.col("confidence"), F.lit(None).cast("array<string>"))
    rows = rows.withColumn("reason", F.when(F.col("event_type").isNull(), reason))
    rows = rows.withColumn("key", F.when(F.col("event_type").isNotNull(), text.identity(F.lit("event"), F.col("event_type"), F.col("slots"))).otherwise(F.concat(F.lit("unknown:"), F.col("match"))))
    rows = timeline.sliding_dedupe_unique(rows, ["battle_id", "key"], "timestamp_ms", "id", 2500)
    return rows.groupBy("battle_id").agg(
        F.count("*").alias("messages"), aggregates.count_if(F.col("event_type").isNotNull() & ~F.col("suppressed")).alias("events"),
        aggregates.count_if((F.col("reason") == "accepted") & ~F.col("suppressed")).alias("unknowns"), aggregates.count_if(F.col("suppressed")).alias("duplicates"),
        aggregates.count_if(F.col("event_type").isNull() & (F.col("reason") != "accepted")).alias("noise"),
    )


@query(f"""WITH {EV}, r AS (SELECT id // 3 AS job_id, id AS reading_id, CASE WHEN type <> 'error' THEN type END AS event_type, identity % 3 AS slots, identity % 2 = 0 AS template, least(1.0, score / 100) AS confidence, identity % 30 AS length, type AS bundle FROM ev),
 s AS (SELECT *, CASE WHEN event_type IS NOT NULL THEN 100 + 24 * slots + CASE WHEN template THEN 18 ELSE 3 END + 10 * confidence + least(10.0, length / 3) ELSE least(30, length) + 5 * confidence END AS score,
  event_type IS NOT NULL AND slots >= 1 AND template AND confidence >= 0.6 AS strong FROM r),
 b AS (SELECT job_id, count(DISTINCT bundle) FILTER (WHERE strong) AS bundles FROM s GROUP BY job_id),
 p AS (SELECT s.*, bundles, row_number() OVER (PARTITION BY s.job_id ORDER BY score DESC, reading_id) AS place FROM s JOIN b USING (job_id))
 SELECT job_id, reading_id, score, CASE WHEN bundles > 1 THEN 'conflict' WHEN strong THEN 'event' WHEN event_type IS NOT NULL THEN 'held' ELSE 'unknown' END AS outcome FROM p WHERE place = 1""")
def reading_selection(spark, d):
    rows = event_log(spark, d).select(
        F.floor(F.col("id") / 3).alias("job_id"), F.col("id").alias("reading_id"), F.when(F.col("type") != "error", F.col("type")).alias("event_type"), (F.col("identity") % 3).cast("int").alias("slots"),
        F.when(F.col("identity") % 2 == 0, "template").otherwise("context").alias("method"), F.least(F.lit(1.0), F.col("score") / 100).alias("confidence"), (F.col("identity") % 30).cast("int").alias("length"), F.col("type").alias("bundle"),
    )
    return templates.select_reading(rows)


@query("""SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id % 3 = 0 THEN 'missing ocrMessages' WHEN conv_id % 3 = 1 THEN NULL ELSE 'unsupported version 9' END AS error,
 CASE WHEN conv_id % 3 = 1 THEN 2 ELSE 0 END AS n_warnings, (CASE WHEN conv_id % 3 = 1 THEN 1 ELSE 0 END) AS detected FROM conversations GROUP BY conv_id""")
def doc_schema_backfill(spark, d):
    third = F.col("battle_id") % 3
    body = F.concat(
        F.lit('{"schemaVersion":"'), F.when(third == 2, "9").otherwise(logs.VERSION), F.lit('","battle":{"id":"'), F.col("battle_id").cast("string"),
        F.lit('"},"events":[],"unknowns":[]'), F.when(third == 0, "").otherwise(',"ocrMessages":[]'), F.when(third == 1, ',"messageObservations":[{"id":"o1","openedAtMs":5}]').otherwise(""), F.lit("}"),
    )
    docs = messages(spark, d).select("battle_id").distinct().select(F.col("battle_id").cast("string").alias("key"), body.alias("json"))
    found = logs.parse_documents(docs, "json")
    return found.select(F.col("key").alias("id"), "error", F.size("warnings").alias("n_warnings"), F.when(F.col("ok"), F.col("summary.detected")).otherwise(0).alias("detected"))


@query("""SELECT conv_id AS battle_id, count(*)::INT AS n_messages, count(*) FILTER (WHERE role = 'assistant')::INT AS n_events, count(*) FILTER (WHERE role = 'user')::INT AS n_unknowns,
 coalesce(sum(turn) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS event_times, coalesce(sum(length(text)) FILTER (WHERE role = 'user'), 0)::BIGINT AS unknown_chars FROM conversations GROUP BY conv_id""")
def document_round_trip(spark, d):
    """Build a document for each conversation, parse it again, and count what came back."""
    rows = messages(spark, d).select("battle_id", "id", F.lit(None).cast("string").alias("observationId"), F.col("raw_text").alias("rawText"), F.lit(None).cast("double").alias("ocrConfidence"), F.col("seq").alias("timestampMs"))
    side = messages(spark, d).select(F.col("id").alias("of"), "side")
    told = rows.join(side, rows["id"] == side["of"])
    events = told.where("side = 'assistant'").select("battle_id", "id", F.lit("move").alias("type"), "timestampMs")
    unknowns = told.where("side = 'user'").select("battle_id", "id", "timestampMs", "rawText")
    docs = logs.build_documents(rows, events, unknowns)
    back = logs.parse_documents(docs, "json").where("ok")
    times = F.aggregate("events", F.lit(0).cast("bigint"), lambda a, e: a + e["timestampMs"])
    chars = F.aggregate("unknowns", F.lit(0).cast("bigint"), lambda a, u: a + F.length(u["rawText"]))
    return back.select("battle_id", F.size("ocrMessages").alias("n_messages"), F.size("events").alias("n_events"), F.size("unknowns").alias("n_unknowns"), times.alias("event_times"), chars.alias("unknown_chars"))


@query()
def rule_pack(spark, d):
    """Rules from texts hidden in JSON trees, classified, named and deduplicated."""
    return rulesets.created_rules(rulesets.extracted_texts(fixtures.rule_files(spark)), ["name", "move"])


@query("""SELECT phase || '-' || k AS id, CASE WHEN phase = 'ended' THEN 'reject' WHEN phase = 'message_candidate' THEN 'queue' WHEN phase = 'hud' AND k * 100 - 300 BETWEEN 0 AND 1500 THEN 'queue'
  WHEN k * 100 < 500 THEN 'defer' WHEN k % 2 = 0 THEN 'queue' ELSE 'reject' END AS action FROM (VALUES ('ended'), ('message_candidate'), ('hud'), ('unknown')) p(phase), range(0, 30) r(k)""")
def admission_decisions(spark, d):
    phases = F.explode(F.array(*map(F.lit, ("ended", "message_candidate", "hud", "unknown"))))
    rows = spark.range(30).select(phases.alias("phase"), F.col("id").alias("k"))
    decided = gate.admission(F.col("phase"), F.col("k") * 100, F.lit(0), F.lit(300), F.col("k") % 2 == 0)
    return rows.select(F.concat_ws("-", "phase", F.col("k").cast("string")).alias("id"), decided["action"].alias("action"))


CHANGES = """WITH c AS (SELECT user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS observation_id, event_id AS seq, epoch_us(ts) // 1000 AS ts,
  CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'closed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'message' ELSE 'attempt' END ELSE CASE WHEN event_id % 3 = 0 THEN 'event' WHEN event_id % 3 = 1 THEN 'unknown' ELSE 'suppressed' END END AS kind,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'ocr_busy' WHEN 1 THEN 'ocr_empty' ELSE 'ocr_timeout' END WHEN event_type = 'purchase' AND event_id % 3 = 2 THEN CASE WHEN event_id % 2 = 0 THEN 'phase_gate' ELSE 'transient' END ELSE event_id::VARCHAR END AS value FROM events),
 f AS (SELECT observation_id, min(ts) FILTER (WHERE kind = 'opened') AS opened_ms, max(ts) FILTER (WHERE kind = 'closed') AS closed_ms, count(*) FILTER (WHERE kind = 'attempt') AS attempts, count(*) FILTER (WHERE kind = 'message') AS messages,
  count(*) FILTER (WHERE kind = 'event') AS events, count(*) FILTER (WHERE kind = 'unknown') AS unknowns, arg_max(value, (CASE value WHEN 'ocr_busy' THEN 1 WHEN 'ocr_empty' THEN 4 ELSE 6 END, seq)) FILTER (WHERE kind = 'failed') AS failure,
  arg_max(value, seq) FILTER (WHERE kind = 'suppressed') AS suppression FROM c GROUP BY observation_id),
 u AS (SELECT *, closed_ms IS NOT NULL AND observation_id % 7 <> 0 AND events = 0 AND unknowns = 0 AS unread FROM f)"""


@query(f"""{CHANGES} SELECT observation_id, opened_ms, closed_ms, attempts, messages, events, unknowns, suppression,
 CASE WHEN events > 0 THEN 'resolved' WHEN unknowns > 0 THEN 'ocr_unknown' WHEN unread THEN 'unread' ELSE 'pending' END AS resolution,
 CASE WHEN events > 0 THEN 'primary' WHEN unknowns > 0 THEN 'review' WHEN unread AND messages > 0 AND observation_id % 2 = 0 THEN 'suppressed' WHEN unread AND messages = 0 AND coalesce(suppression = 'phase_gate', false) THEN 'suppressed' WHEN unread THEN 'primary' WHEN suppression IS NOT NULL THEN 'suppressed' ELSE 'primary' END AS disposition,
 CASE WHEN unread AND messages > 0 THEN 'parser_unknown' WHEN unread THEN coalesce(failure, CASE WHEN attempts > 0 THEN 'ocr_empty' ELSE 'no_ocr_attempt' END) ELSE failure END AS failure FROM u""")
def observation_lifecycle(spark, d):
    e = event_log(spark, d)
    k, third = F.col("id"), F.col("id") % 3
    kind = (
        F.when(F.col("type") == "view", "opened").when(F.col("type") == "click", "closed").when(F.col("type") == "error", "failed")
        .when(F.col("type") == "signup", F.when(k % 2 == 0, "message").otherwise("attempt"))
        .otherwise(F.when(third == 0, "event").when(third == 1, "unknown").otherwise("suppressed"))
    )
    value = F.when(F.col("type") == "error", F.when(third == 0, "ocr_busy").when(third == 1, "ocr_empty").otherwise("ocr_timeout")).when(
        (F.col("type") == "purchase") & (third == 2), F.when(k % 2 == 0, "phase_gate").otherwise("transient")
    ).otherwise(k.cast("string"))
    changes = e.select((F.col("battle_id") * 100 + F.col("identity")).alias("observation_id"), k.alias("seq"), kind.alias("kind"), value.alias("value"), F.col("timestamp_ms").alias("ts"))
    states = lifecycle.folded(changes)
    return lifecycle.settled(states, (F.col("observation_id") % 7 == 0).cast("int"), F.col("observation_id") % 2 == 1)


@query("""WITH p AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, string_split(p_name, ' ') AS ws FROM p)
 SELECT a.p_name, floor(list_max(flatten(list_transform(a.ws, lambda x: list_transform(['rose', 'lace'], lambda y: CASE WHEN x = y THEN 1.0 ELSE 1.0 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END)))) * 1e6 + 0.5) / 1e6 AS best FROM w a""")
def best_text_similarity(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    words = F.array(F.lit("rose"), F.lit("lace"))
    return names.select("p_name", fixed(lifecycle.best_text_similarity(F.split("p_name", " "), words), 6).alias("best"))


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag || ':' || l_linestatus))), chr(10)) AS signature FROM lineitem GROUP BY l_orderkey""")
def bundle_signatures(spark, d):
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat_ws(":", "l_returnflag", "l_linestatus")).alias("parts"))
    return parts.select("l_orderkey", lifecycle.bundle_signature(F.col("parts")).alias("signature"))


@query("""WITH m AS (SELECT DISTINCT p_name AS match FROM part UNION SELECT DISTINCT substr(p_type, p_size + 1, 1) FROM part WHERE p_size < length(p_type)), i AS (SELECT DISTINCT p_type AS source, length(p_type) % 3 AS priority, replace(p_type, 'E', 'e') AS skeleton FROM part UNION SELECT p_name, 1, substr(p_name, 1, length(p_name) - 2) FROM part UNION SELECT p_brand, 2, substr(p_brand, length(p_brand), 1) FROM part),
 s AS (SELECT match AS id, source, priority, CASE WHEN contains(match, skeleton) THEN 0.94 WHEN contains(skeleton, match) THEN 0.9 WHEN match = skeleton THEN 1.0 ELSE 1.0 - levenshtein(match, skeleton)::DOUBLE / greatest(length(match), length(skeleton)) END AS score FROM m, i),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, score DESC, source) AS place FROM s WHERE score >= 0.68)
 SELECT id, source, priority::INT AS priority, floor(score::DOUBLE * 1e6 + 0.5) / 1e6 AS score, place FROM r WHERE place <= 5""")
def coverage_candidates(spark, d):
    part = table(spark, d, "part")
    index = part.select(F.col("p_type").alias("source"), (F.length("p_type") % 3).alias("priority"), F.replace("p_type", F.lit("E"), F.lit("e")).alias("skeleton")).unionByName(
        part.select(F.col("p_name").alias("source"), F.lit(1).alias("priority"), F.expr("substr(p_name, 1, length(p_name) - 2)").alias("skeleton"))
    ).unionByName(part.select(F.col("p_brand").alias("source"), F.lit(2).alias("priority"), F.expr("substr(p_brand, length(p_brand), 1)").alias("skeleton"))).distinct()
    names = part.select(F.col("p_name").alias("match")).unionByName(part.where("p_size < length(p_type)").select(F.expr("substr(p_type, p_size + 1, 1)").alias("match")))
    names = names.distinct().select(F.col("match").alias("id"), "match")
    return lifecycle.coverage_candidates(names, index).withColumn("score", fixed(F.col("score"), 6))


PARSED_RULES = [
    ("entry", "switch_in", 90, ["ゆけっ{name}", "{name}を繰り出した"], {}),
    ("move", "move", 80, ["{name}の{move}"], {}),
    ("hurt", "damage", 90, ["{name}は反動でダメージを受けた"], {}),
]
#: A log in the words of the rules and keywords, about the parts as names and the types of parts as moves.
SPOKEN = """SELECT event_id AS id, event_type AS kind, n.label AS name, n.key AS name_key, m.label AS move, m.key AS move_key,
  CASE event_type WHEN 'click' THEN '相手の' || n.key || 'の' || m.key || '!' WHEN 'view' THEN 'ゆけっ!' || n.key || '!' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN '相手の' ELSE '' END || n.key || 'は倒れた!'
    WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN n.key || 'に 効果はバツグンだ!' WHEN 1 THEN n.key || 'の素早さが がくっと下がった!' WHEN 2 THEN n.key || 'は反動でダメージを受けた!' ELSE '急所に当たった!' END
    ELSE CASE WHEN event_id % 2 = 0 THEN '03:15' ELSE n.key || 'の' END END AS text
 FROM events JOIN n ON n.place = user_id % (SELECT count(*) FROM n) JOIN m ON m.place = event_id % (SELECT count(*) FROM m)"""
NAMES = """n AS (SELECT label, replace(label, ' ', '') AS key, dense_rank() OVER (ORDER BY label) - 1 AS place FROM (SELECT DISTINCT p_name AS label FROM part)),
 m AS (SELECT label, lower(replace(label, ' ', '')) AS key, dense_rank() OVER (ORDER BY label) - 1 AS place FROM (SELECT DISTINCT p_type AS label FROM part))"""


def spoken(spark, d):
    """The log in SPOKEN and the dictionary of its names and moves."""
    for name in ("events", "part"):
        table(spark, d, name).createOrReplaceTempView(name)
    log = spark.sql(f"WITH {NAMES} {SPOKEN}")
    keys = spark.sql(f"WITH {NAMES} SELECT 'name' AS kind, label AS entry_id, label, key FROM n UNION ALL SELECT 'move', label, label, key FROM m")
    return log.select("id", "text"), keys


@query(f"""WITH {NAMES}, s AS ({SPOKEN})
 SELECT id, CASE WHEN kind IN ('purchase') OR (kind = 'signup' AND id % 4 <> 2) THEN 'context' WHEN kind = 'signup' THEN 'constrained' WHEN kind = 'view' THEN 'constrained' WHEN kind = 'click' THEN 'move' ELSE 'unknown' END AS stage,
  CASE kind WHEN 'click' THEN 'move' WHEN 'view' THEN 'switch_in' WHEN 'purchase' THEN 'faint' WHEN 'signup' THEN CASE id % 4 WHEN 0 THEN 'supereffective' WHEN 1 THEN 'unboost' WHEN 2 THEN 'damage' ELSE 'critical' END END AS event_type,
  CASE WHEN kind IN ('click', 'view', 'purchase') OR (kind = 'signup' AND id % 4 IN (1, 2)) THEN name END AS actor, CASE WHEN kind = 'click' OR (kind = 'purchase' AND id % 2 = 0) THEN 'opponent' END AS side,
  CASE WHEN kind = 'click' THEN move END AS move, CASE WHEN kind = 'signup' AND id % 4 = 0 THEN name END AS target, CASE WHEN kind = 'signup' AND id % 4 = 1 THEN '素早さ' END AS stat,
  CASE kind WHEN 'click' THEN '相手の' || name || 'の ' || move || '!' WHEN 'view' THEN 'ゆけっ! ' || name || '!' WHEN 'purchase' THEN CASE WHEN id % 2 = 0 THEN '相手の' ELSE '' END || name || 'は たおれた!'
   WHEN 'signup' THEN CASE id % 4 WHEN 0 THEN name || 'に 効果は バツグンだ!' WHEN 1 THEN name || 'の 素早さが がくっと 下がった!' WHEN 2 THEN name || 'は ダメージを 受けた!' ELSE '急所に 当たった!' END END AS said
 FROM s""")
def message_parse(spark, d):
    """Every message of a log made from events and parts through the whole cascade, rendered in canonical words."""
    log, keys = spoken(spark, d)
    rules = spark.createDataFrame(PARSED_RULES, "id string, event_type string, priority int, patterns array<string>, constants map<string,string>")

    def parsed(texts: DataFrame) -> DataFrame:
        rows = texts.select("id", F.lit(0.9).alias("confidence"), text.both_texts("text").alias("t")).select("id", "confidence", F.col("t.normalized").alias("normal"), F.col("t.match").alias("match"))
        return cascade.cascade(rows, rows.select("id", F.lit(0).alias("priority"), "match"), rules, keys)

    read = cascade.once_each(log, parsed)
    evidence = F.array_join("evidence", ":")
    said = context.canonical_text(F.col("event_type"), F.col("actor"), F.col("side"), F.col("move"), F.col("target"), F.col("target_side"), evidence, context.stat_captured(evidence))
    stage = F.when((F.col("event_type") == "move") & F.col("stage").isin("constrained", "template", "move_split", "move_span"), "move").otherwise(F.col("stage"))
    return read.select("id", stage.alias("stage"), "event_type", "actor", "side", "move", "target", "stat", said.alias("said"))


@query(f"""WITH {NAMES}, s AS ({SPOKEN})
 SELECT id, CASE kind WHEN 'purchase' THEN 'faint' ELSE CASE id % 4 WHEN 0 THEN 'supereffective' WHEN 1 THEN 'unboost' ELSE 'critical' END END AS event_type,
  CASE WHEN kind = 'purchase' THEN 'faint' ELSE CASE id % 4 WHEN 0 THEN 'effect_supereffective' WHEN 1 THEN 'stat_unboost' ELSE 'critical_hit' END END AS reading,
  CASE WHEN kind = 'purchase' OR id % 4 = 1 THEN name END AS actor, CASE WHEN kind = 'signup' AND id % 4 = 0 THEN name END AS target, CASE WHEN kind = 'purchase' AND id % 2 = 0 THEN 'opponent' END AS side,
  CASE WHEN kind = 'signup' AND id % 4 = 1 THEN '素早さ' END AS stat, CASE WHEN kind = 'signup' AND id % 4 = 1 THEN 'がくっと' END AS degree
 FROM s WHERE kind = 'purchase' OR (kind = 'signup' AND id % 4 <> 2)""")
def context_events(spark, d):
    """Keyword readings of a log made from events and parts."""
    log, keys = spoken(spark, d)
    found = context.context_events(log.select("id", text.match_text("text").alias("match")), keys.where("kind = 'name'").drop("kind"))
    return found.drop("score")


@query(f"""WITH {NAMES}, s AS ({SPOKEN})
 SELECT id, CASE WHEN kind = 'click' THEN 'move' WHEN kind = 'purchase' THEN 'faint' WHEN kind = 'signup' AND id % 4 = 0 THEN 'supereffective' WHEN kind = 'signup' AND id % 4 = 1 THEN 'unboost' END AS shape,
  kind = 'signup' AND id % 4 = 0 AS aimed
 FROM s""")
def surface_shapes(spark, d):
    """The shapes that only one kind has, of a log made from events and parts."""
    log, _ = spoken(spark, d)
    rows = log.select("id", text.match_text("text").alias("text"))
    shapes = F.array_intersect(shapes_of(F.col("text")), F.array(*map(F.lit, ("faint", "supereffective", "unboost"))))
    theirs = F.startswith("text", F.lit(context.OPPONENT)) & ~F.contains("text", F.lit("倒れ"))
    return rows.select("id", F.when(theirs, "move").otherwise(F.get(shapes, F.lit(0))).alias("shape"), effect_target_shape(F.col("text")).alias("aimed"))


@query()
def bundled_parse(spark, d):
    """The bundled log, worn texts included, through the whole cascade; without oracle, see tests/test_cascade.py."""
    log = fixtures.messages(spark)
    rows = log.select("id", "confidence", text.both_texts("text").alias("t")).select("id", "confidence", F.col("t.normalized").alias("normal"), F.col("t.match").alias("match"))
    views = templates.match_surfaces(templates.surfaces_of(log.select("id", "text")))
    return cascade.cascade(rows, views, fixtures.rules(spark), fixtures.keys(spark))


CAUSE_BITS = ", ".join(f"CASE WHEN (k >> {i}) % 2 = 1 THEN '{c}' END" for i, c in enumerate(aggregates.CAUSES))
CAUSE_CASES = " ".join(f"WHEN list_contains(causes, '{c}') THEN '{c}'" for c in aggregates.CAUSES)
CAUSE_LISTS = " ".join(f"WHEN '{c}' THEN {a}" for c, a in aggregates.CAUSE_ACTIONS.items())


@query(f"""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
 c AS (SELECT event_id, list_filter([{CAUSE_BITS}], lambda x: x IS NOT NULL) AS causes FROM e),
 a AS (SELECT *, list_sort(list_distinct(flatten(list_transform(causes, lambda x: CASE x {CAUSE_LISTS} END)))) AS found FROM c)
 SELECT event_id, CASE {CAUSE_CASES} ELSE 'unclassified' END AS cause, array_to_string(CASE WHEN len(found) = 0 THEN ['review_only'] ELSE found END, ',') AS actions FROM a""")
def cause_actions(spark, d):
    """The first cause and the actions of sets of causes."""
    rows = event_log(spark, d)
    causes = F.array_compact(F.array(*[F.when(F.shiftright("identity", i) % 2 == 1, F.lit(c)) for i, c in enumerate(aggregates.CAUSES)]))
    rows = rows.select(F.col("id").alias("event_id"), causes.alias("causes"))
    return rows.select("event_id", aggregates.classification(F.col("causes")).alias("cause"), F.array_join(aggregates.actions_of(F.col("causes")), ",").alias("actions"))


@query("""SELECT event_id, event_id % 4 >= 1 AND event_id % 9 >= 2 AND (event_id % 10) / 10.0::DOUBLE <= 0.55 AND CASE WHEN event_id % 2 = 0
   THEN value / 60 >= 0.94 AND value / 50 >= 0.9 AND (event_id % 5) / 5.0::DOUBLE <= 0.35 AND (event_id % 7) / 7.0::DOUBLE >= 0.65 ELSE value / 60 >= 0.97 AND value / 50 >= 0.95 END AS strict,
  CASE WHEN event_type = 'view' THEN event_id % 3 = 0 AND event_id % 5 = 0 WHEN event_type = 'signup' THEN event_id % 3 = 0 WHEN event_type = 'purchase' THEN event_id % 3 = 0 OR event_id % 4 = 0 ELSE true END AS has_parts,
  value / 1000 BETWEEN 0.004 AND 0.18 AS dense,
  CASE WHEN event_type = 'view' THEN 'primary' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'suppressed' WHEN event_id % 3 = 0 THEN 'secondary' ELSE 'review' END AS shown
 FROM events""")
def picture_predicates(spark, d):
    """The strict visual test, required parts, density and disposition of rows made from events."""
    e, k = table(spark, d, "events"), F.col("event_id")
    strict = lifecycle.strict_fallback(k % 4, k % 9, (k % 10) / 10.0, k % 2 == 0, F.col("value") / 60, F.col("value") / 50, (k % 5) / 5.0, (k % 7) / 7.0)
    kind = F.when(F.col("event_type") == "view", "move").when(F.col("event_type") == "signup", "faint").when(F.col("event_type") == "purchase", "miss").otherwise("weather_start")
    part = lambda n: F.when(k % n == 0, "x")
    resolution = F.when(F.col("event_type") == "view", "resolved").when(F.col("event_type") == "click", "ocr_unknown").otherwise("unread")
    shown = gate.disposition(resolution, F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("m"))), F.when(k % 3 == 0, "secondary"))
    return e.select("event_id", strict.alias("strict"), gate.required_slots(kind, part(3), part(4), part(5)).alias("has_parts"), gate.dense_enough(F.col("value") / 1000).alias("dense"), shown.alias("shown"))


@query(r"""WITH p AS (SELECT p_partkey, p_name || ' {0} and {1}' AS pattern, replace(p_type || ' X ' || p_brand, ' ', '_') AS label FROM part)
 SELECT p_partkey, array_to_string(regexp_extract_all(pattern, '\{[^}]*\}'), ' ') AS signature, length(regexp_replace(pattern, '\{[^}]*\}', '', 'g'))::INT AS literal, array_to_string(string_split(label, '_')[1:3], '_') AS prefix,
  regexp_matches(label, 'BRASS|Brand#1|STEEL') AND NOT regexp_matches(label, 'LARGE|SMALL') AS allowed, CASE WHEN p_partkey % 2 = 0 THEN 'time:5' ELSE 'frame:' || p_partkey || ':5' END AS frame FROM p""")
def rule_shapes(spark, d):
    """What rules are grouped and filtered by, of patterns and labels made from parts."""
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" {0} and {1}")).alias("pattern"), F.replace(F.concat("p_type", F.lit(" X "), "p_brand"), F.lit(" "), F.lit("_")).alias("label"))
    return p.select(
        "p_partkey", text.placeholder_signature(F.col("pattern")).alias("signature"), text.literal_length(F.col("pattern")).alias("literal"), text.label_prefix(F.col("label")).alias("prefix"),
        gate.label_allowed(F.col("label"), ["BRASS", "Brand#1", "STEEL"], ["LARGE", "SMALL"]).alias("allowed"), text.frame_reference(F.when(F.col("p_partkey") % 2 == 1, F.col("p_partkey")), F.lit(5)).alias("frame"),
    )


@query(f"""WITH {NAMES}, s AS ({SPOKEN})
 SELECT id, CASE WHEN kind = 'view' THEN 'switch_in' WHEN kind = 'purchase' THEN 'faint' WHEN kind = 'signup' THEN CASE id % 4 WHEN 0 THEN 'supereffective' WHEN 1 THEN 'unboost' WHEN 2 THEN 'damage' ELSE 'critical' END ELSE 'activate' END AS event_type,
  id % 5 = 0 AS hidden, id % 5 <> 0 AND (id % 3 = 0 OR NOT (kind = 'error' OR (kind = 'click' AND false) OR (kind = 'signup' AND false))) AS battle,
  kind = 'error' AND (id % 2 = 0 OR length(name_key) BETWEEN 2 AND 14 OR length(name_key) < 5) AS fragment, kind = 'error' AND id % 2 = 0 AS noise FROM s""")
def rule_filters(spark, d):
    """Types, filters and noise tests of the texts of a log made from events and parts."""
    log, _ = spoken(spark, d)
    rows = log.select("id", text.both_texts("text").alias("t")).select("id", F.col("t.normalized").alias("normal"), F.col("t.match").alias("match"))
    label = F.when(F.col("id") % 5 == 0, "X_INFO_1").when(F.col("id") % 3 == 0, "BTL_MSG")
    return rows.select(
        "id", rulesets.keyword_type(F.col("match")).alias("event_type"), rulesets.non_live(label, F.col("match")).alias("hidden"), rulesets.battle_related(F.lit("a.json"), label, F.col("match")).alias("battle"),
        reports.likely_fragment(F.col("match")).alias("fragment"), reports.likely_ui_noise(F.lit(False), F.col("normal"), F.col("match")).alias("noise"),
    )


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)
 SELECT conv_id AS job_id, coalesce(string_agg(trim(text), chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> ''), '') AS text, floor(avg(CASE WHEN turn % 2 = 0 THEN (turn % 10) / 10.0::DOUBLE END) * 1e6 + 0.5) / 1e6 AS confidence,
  count(*)::INT AS n_lines FROM s WHERE nth <= 3 GROUP BY conv_id""")
def combined_readings(spark, d):
    """The first segments of each conversation as one reading."""
    turns = table(spark, d, "conversations")
    segments = turns.select(F.col("conv_id").alias("job_id"), F.lit("r").alias("reading_id"), F.col("turn").alias("nth"), "text", F.when(F.col("turn") % 2 == 0, (F.col("turn") % 10) / 10.0).alias("confidence"), F.array("role").alias("lines"))
    found = readings.combined_reading(readings.reading_candidates(segments))
    return found.select("job_id", "text", fixed(F.col("confidence"), 6).alias("confidence"), F.size("lines").alias("n_lines"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, replace(replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z', ':', '-'), '.', '-') AS stamp FROM events""")
def time_stamps(spark, d):
    return event_log(spark, d).select(F.col("id").alias("event_id"), readings.iso_time(F.col("timestamp_ms")).alias("iso"), readings.file_stamp(F.col("timestamp_ms")).alias("stamp"))


@query(f"""WITH {EV}, p AS (SELECT id, battle_id, type, 0 AS pack FROM ev WHERE type = 'view' UNION ALL SELECT id - 1, battle_id, type, 1 FROM ev UNION ALL SELECT id + 1, battle_id, type, 2 FROM ev WHERE type = 'click'),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pack) AS place FROM p) SELECT id, battle_id, type FROM r WHERE place = 1""")
def united_packs(spark, d):
    """Three overlapping packs; of one id the earliest holds."""
    ev = event_log(spark, d).select("id", "battle_id", "type")
    return rulesets.united_packs(ev.where("type = 'view'"), ev.withColumn("id", F.col("id") - 1), ev.where("type = 'click'").withColumn("id", F.col("id") + 1))


@query("""WITH r AS (SELECT p_brand AS file, p_type AS prefix, p_size % 3 AS signature, CASE WHEN p_size % 4 = 0 THEN 'activate' ELSE 'move' END AS event_type FROM part)
 SELECT file, count(*) AS rules, count(DISTINCT prefix) AS prefixes, count(DISTINCT signature) AS signatures, count(DISTINCT event_type) AS types, floor(avg((event_type = 'activate')::INT) * 1e6 + 0.5) / 1e6 AS untyped_share,
  CASE WHEN avg((event_type = 'activate')::INT) > 0.5 THEN 'hold' WHEN count(*) < 3 THEN 'review' ELSE 'enable' END AS advice FROM r GROUP BY file""")
def file_profiles(spark, d):
    rules = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("prefix"), (F.col("p_size") % 3).alias("signature"), F.when(F.col("p_size") % 4 == 0, "activate").otherwise("move").alias("event_type"))
    return rulesets.file_profile(rules).withColumn("untyped_share", fixed(F.col("untyped_share"), 6))


@query("""WITH s AS (SELECT event_id, least(1.0, value / 80) AS before, (event_id % 11) / 10.0::DOUBLE AS after, (event_id % 7) / 7.0::DOUBLE AS bounds, (event_id % 13) / 13.0::DOUBLE AS contained, (event_id % 17) / 20.0::DOUBLE AS apart, event_id % 3 AS lines FROM events),
 t AS (SELECT *, bounds >= 0.45 AND lines <= 1 AS structure FROM s)
 SELECT event_id, after <= before AND before >= 0.65 AND structure AS progressive, apart <= 0.22 OR (after <= before AND before >= 0.65 AND structure) OR (after > before AND after >= 0.65 AND structure) OR (contained >= 0.7 AND structure) AS same FROM t""")
def continued_pictures(spark, d):
    """Whether a later picture continues an earlier message, over overlaps made from events."""
    k = F.col("event_id")
    overlap = F.struct(F.least(F.lit(1.0), F.col("value") / 80).alias("retained_before"), ((k % 11) / 10.0).alias("retained_after"), ((k % 13) / 13.0).alias("contained"))
    rows = table(spark, d, "events").select("event_id", overlap.alias("overlap"), ((k % 7) / 7.0).alias("bounds"), ((k % 17) / 20.0).alias("apart"), (k % 3).alias("lines"))
    return rows.select("event_id", signals.same_message(F.col("apart"), F.col("overlap"), F.col("bounds"), F.col("lines")).alias("s")).select("event_id", "s.*")


@query("""WITH r AS (SELECT event_id, 100.0::DOUBLE + (event_id % 10) / 20.0::DOUBLE * 800 * least(1000 / 800.0::DOUBLE, 600 / (400.0::DOUBLE + event_id % 3 * 100)) - 100 + (1000 - 800 * least(1000 / 800.0::DOUBLE, 600 / (400.0::DOUBLE + event_id % 3 * 100))) / 2 AS x,
  greatest(0.0, least(0.5 + (event_id % 7) / 10.0::DOUBLE, 1.0) - greatest((event_id % 7) / 10.0::DOUBLE, 0.2)) * 0.5 / (0.5 * 0.5 + 0.8 * 0.5 - greatest(0.0, least(0.5 + (event_id % 7) / 10.0::DOUBLE, 1.0) - greatest((event_id % 7) / 10.0::DOUBLE, 0.2)) * 0.5) AS overlap FROM events) SELECT event_id, floor(x * 1e6 + 0.5) / 1e6 AS x, floor(overlap * 1e6 + 0.5) / 1e6 AS overlap FROM r""")
def placed_regions(spark, d):
    """Where regions lie in a letterboxed display, and how far two boxes overlap."""
    k, number = F.col("event_id"), lambda x: F.lit(float(x))
    roi = F.struct(((k % 10) / 20.0).alias("x"), number(0.1).alias("y"), number(0.5).alias("w"), number(0.2).alias("h"))
    box = signals.letterbox(roi, number(800), (400.0 + k % 3 * 100), number(1000), number(600))
    one = F.struct(((k % 7) / 10.0).alias("x"), number(0).alias("y"), number(0.5).alias("width"), number(0.5).alias("height"))
    two = F.struct(number(0.2).alias("x"), number(0).alias("y"), number(0.8).alias("width"), number(0.5).alias("height"))
    return table(spark, d, "events").select("event_id", fixed(box["x"], 6).alias("x"), fixed(signals.bounds_overlap(one, two), 6).alias("overlap"))


@query("""WITH e AS (SELECT 'p' || lpad(p_partkey::VARCHAR, 6, '0') AS id, p_name || CASE p_partkey % 3 WHEN 0 THEN '♀' WHEN 1 THEN '♂' ELSE '' END AS label FROM part),
 b AS (SELECT id, label, 1 AS part FROM e UNION ALL SELECT id, regexp_replace(label, '[♀♂]$', ''), 0 FROM e WHERE regexp_matches(label, '[♀♂]$')),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id, CASE WHEN regexp_matches(label, '[♀♂]$') OR part = 1 THEN part ELSE 0 END) AS n FROM b)
 SELECT id, label FROM r WHERE n = 1""")
def marked_names(spark, d):
    """Names with a gender mark also count without it, each name once."""
    part = table(spark, d, "part")
    mark = F.when(F.col("p_partkey") % 3 == 0, "♀").when(F.col("p_partkey") % 3 == 1, "♂").otherwise("")
    entries = part.select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("id"), F.concat("p_name", mark).alias("label"), F.array().cast("array<string>").alias("aliases"))
    return logs.expand_markers(entries).select("id", "label")


@query(f"""WITH {EV} SELECT battle_id, type AS event_type, timestamp_ms, CASE WHEN id % 2 = 0 THEN 'time:' || timestamp_ms ELSE 'frame:' || id || ':' || timestamp_ms END AS at FROM ev WHERE type <> 'error'""")
def context_records(spark, d):
    """The look-back rows of accepted events."""
    ev = event_log(spark, d).withColumn("event_type", F.when(F.col("type") != "error", F.col("type")))
    none = F.lit(None).cast("string")
    rows = ev.withColumns({"actor": none, "side": none, "reading": none, "frame": F.when(F.col("id") % 2 == 1, F.col("id"))})
    return readings.accepted_records(rows).select("battle_id", "event_type", "timestamp_ms", "at")


@query('SELECT epoch_us(ts) // 1000 AS "timestampMs", event_id::VARCHAR AS id, ' + " || ',' || ".join(CELL.format(c) for c in ("event_id::VARCHAR", "(epoch_us(ts) // 1000)::VARCHAR", "event_type", "''", "(user_id::VARCHAR || ', \"x\"')", "'player'", "''", "''", "''", "props", "props", "'0.5'", "'seed'", "''", "(event_id % 9)::VARCHAR")) + " AS line FROM events")
def events_csv(spark, d):
    e = event_log(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("id"), "props"), "id")
    none = F.lit(None).cast("string")
    rows = e.select(
        F.col("id").cast("string").alias("id"), F.col("timestamp_ms").alias("timestampMs"), "type", F.lit(None).cast("int").alias("turn"), F.struct(F.concat(F.col("battle_id").cast("string"), F.lit(', "x"')).alias("name"), F.lit("player").alias("side")).alias("actor"),
        none.alias("move"), F.struct(none.alias("name"), none.alias("side")).alias("target"), F.col("props").alias("rawText"), F.col("props").alias("normalizedText"), F.lit(0.5).alias("confidence"), F.lit("seed").alias("method"), none.alias("templateId"), (F.col("id") % 9).alias("frameIndex"),
    )
    return logs.events_csv(rows)
