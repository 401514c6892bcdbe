"""Queries of rows that depend on others in time or space: idle keys, versions, assignments, throttles, generations, recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import asof, assign, generations, recall, sessions, shifts, throttle, tiles
from ..streaming import versions
from .queries import _KEYS, _MS, _R, _rects, _table, _timed, query

_HOUR = 3_600_000


@query(f"""SELECT user_id, min(ms) AS start, max(ms) AS idle_since, count(*) AS n FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) < {6 * _HOUR} THEN 0 ELSE 1 END AS fresh FROM {_MS})) GROUP BY user_id, island""")
def idle_periods(spark, sf_dir):
    """After which stretches of its events a user was idle for six hours; the stream of the same is streaming.idle."""
    return sessions.idle_periods(_timed(spark, sf_dir), "user_id", "ms", 6 * _HOUR)


@query("""SELECT event_id, CASE WHEN event_type = 'signup' OR event_id * 7919 % 900 > 600 THEN 'late' WHEN event_id % 5 = 0 THEN 'stale' ELSE 'accepted' END AS verdict FROM events""")
def result_verdicts(spark, sf_dir):
    """Each event but sign-ups asks for something, and each has a result some minutes later, every fifth of another version."""
    e = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = e.where("event_type <> 'signup'").selectExpr("user_id AS key", "event_id AS request_id", "event_id % 4 AS version", "ts AS asked_at")
    done = e.selectExpr("user_id AS key", "event_id AS request_id", "CASE WHEN event_id % 5 = 0 THEN 9 ELSE event_id % 4 END AS version", "timestampadd(SECOND, int(event_id * 7919 % 900), ts) AS done_at")
    return versions.judged(asked, done).select(F.col("request_id").alias("event_id"), "verdict")


_VERSIONS = "(SELECT o_custkey % 150 AS user_id, 1704067200000 + (o_orderkey * 7919 % 2592000) * 1000 AS since, max(o_orderkey) AS rule FROM orders GROUP BY 1, 2)"


@query(f"SELECT event_id, rule FROM {_MS} e ASOF LEFT JOIN {_VERSIONS} v ON e.user_id = v.user_id AND e.ms >= v.since")
def rule_versions(spark, sf_dir):
    """The rule of a user that was valid at each event, from a table of changes."""
    changes = _table(spark, sf_dir, "orders").selectExpr("o_custkey % 150 AS user_id", "1704067200000 + (o_orderkey * 7919 % 2592000) * 1000 AS since", "o_orderkey AS rule")
    return asof.valid_at(_timed(spark, sf_dir), changes, "user_id", "ms", "since").select("event_id", "version.rule")


_DISTINCT_A = f"(SELECT l_partkey AS k, {{'x': ax, 'y': ay, 'w': aw, 'h': ah}} AS r, count(*) AS n FROM {_R} GROUP BY ALL)"


def _meet(a: str, b: str) -> str:
    return f"{a}.x < {b}.x + {b}.w AND {b}.x < {a}.x + {a}.w AND {a}.y < {b}.y + {b}.h AND {b}.y < {a}.y + {a}.h"


@query(f"""SELECT a.k AS l_partkey, a.r.x::INT AS ax, a.r.y::INT AS ay, a.r.w::INT AS aw, a.r.h::INT AS ah, b.r.x::INT AS bx, b.r.y::INT AS by_, b.r.w::INT AS bw, b.r.h::INT AS bh, a.n AS n_a, b.n AS n_b
FROM {_DISTINCT_A} a JOIN {_DISTINCT_A} b ON a.k = b.k AND a.r < b.r AND {_meet("a.r", "b.r")}""")
def overlapping_pairs(spark, sf_dir):
    """All pairs of different rectangles of a part that have a common area."""
    r = _rects(spark, sf_dir).select("l_partkey", F.col("a").alias("rect"))
    met = tiles.overlapping(r, r, "l_partkey", once=True)
    return met.select("l_partkey", *[F.col("a")[c].alias(f"a{c}") for c in "xywh"], *[F.col("b")[c].alias("by_" if c == "y" else f"b{c}") for c in "xywh"], "n_a", "n_b")


@query(f"""SELECT {_KEYS} FROM {_R} WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT l_suppkey AS k, bx AS x, by_ AS y, bw AS w, bh AS h FROM {_R} WHERE l_orderkey % 50 = 0) c
 WHERE c.k = r.l_suppkey AND ax < c.x + c.w AND c.x < ax + aw AND ay < c.y + c.h AND c.y < ay + ah)""")
def touched_rects(spark, sf_dir):
    """Remembered rectangles of a supplier that some changed area meets."""
    r = _rects(spark, sf_dir)
    areas = r.where("l_orderkey % 50 = 0").select("l_suppkey", F.col("b").alias("a"))
    return tiles.touched(r, areas, "l_suppkey", "a").select(*_KEYS.split(", "))


_BOXES = "(SELECT o_orderkey AS id, o_custkey % 500 AS k, o_orderstatus AS rule, o_orderkey * 31 % 40 AS x, o_custkey * 17 % 40 AS y, 5 + o_orderkey % 30 AS w, 5 + o_orderkey // 7 % 30 AS h FROM orders)"
_BW, _BH = "greatest(0, least(o.x + o.w, n.x + n.w) - greatest(o.x, n.x))", "greatest(0, least(o.y + o.h, n.y + n.h) - greatest(o.y, n.y))"


@query(f"""WITH RECURSIVE p AS (SELECT o.k, o.id AS a, n.id AS b, o.rule = n.rule AS same, ({_BW} * {_BH})::DOUBLE / (o.w * o.h + n.w * n.h - {_BW} * {_BH}) AS iou
 FROM (SELECT * FROM {_BOXES} WHERE id % 2 = 0) o JOIN (SELECT * FROM {_BOXES} WHERE id % 2 = 1) n ON o.k = n.k AND {_BW} * {_BH} > 0),
q AS (SELECT k, a, b, iou + same::INT AS score, row_number() OVER (PARTITION BY k ORDER BY iou + same::INT DESC, a, b) AS i FROM p WHERE same OR iou > 0.3),
t AS (SELECT k, 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS score FROM (SELECT DISTINCT k FROM q)
 UNION ALL SELECT q.k, q.i, CASE WHEN list_contains(taken, q.a) OR list_contains(taken, q.b) THEN taken ELSE list_concat(taken, [q.a, q.b]) END,
  CASE WHEN list_contains(taken, q.a) OR list_contains(taken, q.b) THEN NULL ELSE q.a END, q.b, q.score FROM t JOIN q ON q.k = t.k AND q.i = t.i + 1)
SELECT a, b, round(score, 9) AS score FROM t WHERE a IS NOT NULL""")
def assigned_boxes(spark, sf_dir):
    """Which box of an even order each odd order's box continues."""
    boxes = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 500).alias("k"), F.col("o_orderstatus").alias("rule"), G.rect(F.col("o_orderkey") * 31 % 40, F.col("o_custkey") * 17 % 40, 5 + F.col("o_orderkey") % 30, 5 + F.floor(F.col("o_orderkey") / 7) % 30).alias("rect"))
    pairs, _ = assign.assigned(boxes.where("id % 2 = 0"), boxes.where("id % 2 = 1"), "k")
    return pairs.select("a", "b", F.round("score", 9).alias("score"))


@query(f"""WITH RECURSIVE e AS {_MS}, f AS (SELECT user_id, ms, min(event_id) AS event_id FROM e GROUP BY user_id, ms),
s AS (SELECT e.user_id, e.event_id, arg_min(f.event_id, f.ms) AS following FROM e JOIN f ON e.user_id = f.user_id AND e.ms + {12 * _HOUR} <= f.ms GROUP BY ALL),
t AS (SELECT user_id, arg_min(event_id, ms) AS event_id FROM f GROUP BY user_id UNION ALL SELECT s.user_id, s.following FROM t JOIN s ON s.user_id = t.user_id AND s.event_id = t.event_id)
SELECT user_id, event_id FROM t""")
def throttled_events(spark, sf_dir):
    """Events of a user, each at least twelve hours after the one taken before it."""
    return throttle.throttled(_timed(spark, sf_dir), "user_id", "ms", "event_id", 12 * _HOUR).select("user_id", "event_id")


_BLOCKS = f"(SELECT event_type, ms // 86400000 AS day, user_id % 10 AS block, count(*) % 4 < 3 AS v FROM {_MS} GROUP BY ALL)"


@query(f"""WITH b AS {_BLOCKS}, d AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n FROM (SELECT DISTINCT event_type, day FROM b)),
w AS (SELECT b.event_type, d.n, b.block, b.v FROM b JOIN d ON b.event_type = d.event_type AND b.day = d.day),
o AS (SELECT w.event_type, w.n + 1 AS n, w.block, w.v FROM w JOIN (SELECT event_type, max(n) AS last FROM d GROUP BY 1) l ON l.event_type = w.event_type AND w.n < l.last),
m AS (SELECT coalesce(w.event_type, o.event_type) AS event_type, coalesce(w.n, o.n) AS n, coalesce(w.block, o.block) AS block,
      coalesce(w.n, o.n) > 1 AND NOT (w.n IS NOT NULL AND o.n IS NOT NULL AND w.v = o.v) AS changed FROM w FULL JOIN o ON w.event_type = o.event_type AND w.n = o.n AND w.block = o.block),
h AS (SELECT *, coalesce(sum(changed::INT) OVER (PARTITION BY event_type, block ORDER BY n RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) >= 3 AS hot FROM m),
c AS (SELECT event_type, n, count(*) FILTER (WHERE NOT hot) AS n_blocks, count(*) FILTER (WHERE changed AND NOT hot) AS n_changed, count(*) FILTER (WHERE hot) AS n_hot FROM h GROUP BY ALL)
SELECT c.event_type, d.day, n_blocks, n_changed, n_hot, round(CASE WHEN n_blocks > 0 THEN n_changed / n_blocks ELSE 0.0 END::DOUBLE, 6) AS share,
 (sum((c.n > 1 AND n_blocks > 0 AND n_changed / n_blocks >= 0.35)::INT) OVER (PARTITION BY c.event_type ORDER BY c.n))::BIGINT AS generation FROM c JOIN d ON d.event_type = c.event_type AND d.n = c.n""")
def page_generations(spark, sf_dir):
    """Days of an event type as snapshots of ten blocks of users."""
    e = _timed(spark, sf_dir).select("event_type", F.floor(F.col("ms") / 86_400_000).alias("day"), (F.col("user_id") % 10).alias("block"))
    blocks = e.groupBy("event_type", "day", "block").agg((F.count("*") % 4 < 3).alias("v"))
    return generations.generations(blocks, "event_type", "day", "block", "v").withColumn("share", F.round("share", 6))


@query(f"""SELECT event_type, user_id, ms AS seen, recency::INT AS recency FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ms DESC, user_id DESC) AS recency FROM (
 SELECT event_type, user_id, max(ms) AS ms FROM {_MS} GROUP BY ALL)) WHERE recency <= 32""")
def remembered_users(spark, sf_dir):
    """The users that a memory of 32 holds for each event type."""
    return recall.remembered(_timed(spark, sf_dir), "event_type", "user_id", "ms")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
q AS (SELECT vec_id, list_transform(v, lambda x, i: x + 0.2 * sqrt(list_sum(list_transform(v, lambda y: y * y)) / len(v)) * sin((i * vec_id + i)::DOUBLE)) AS v FROM v WHERE vec_id % 100 = 0)
SELECT query_id, item_id, round(c, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS item_id, (SELECT corr(x, y) FROM (SELECT unnest(q.v) AS x, unnest(v.v) AS y)) AS c FROM q, v) WHERE c >= 0.95""")
def recalled_items(spark, sf_dir):
    """For vectors of every hundredth id, seen again with some noise, those that they correlate with."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    spread = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y) / F.size("v"))
    again = F.transform("v", lambda x, i: x + F.lit(0.2) * spread * F.sin(((i + 1) * F.col("vec_id") + i + 1).cast("double")))
    found = recall.recalled(e.where("vec_id % 100 = 0").select("vec_id", again.alias("v")), e, "vec_id", "v")
    return found.select("query_id", "item_id", F.round("score", 6).alias("score"))


_SEQ = "(SELECT event_id // 1000 AS k, event_id % 1000 AS p, value AS v FROM events)"
_SEQ_B = "(SELECT event_id // 1000 AS k, event_id % 1000 + (event_id // 1000) % 9 - 4 AS p, CASE WHEN event_id % 6 = 0 THEN value + 1 ELSE value END AS v FROM events)"


@query(f"""WITH a AS {_SEQ}, b AS {_SEQ_B}, g AS (SELECT k, len(list(p)) AS n FROM a GROUP BY k), e AS (SELECT k, 1::BIGINT AS e FROM g WHERE k % 2 = 0),
t AS (SELECT a.k, b.p - a.p AS o, count(*) AS votes FROM (SELECT k, v, min(p) AS p FROM a GROUP BY k, v HAVING count(*) = 1) a JOIN (SELECT k, v, min(p) AS p FROM b GROUP BY k, v HAVING count(*) = 1) b ON a.k = b.k AND a.v = b.v GROUP BY ALL),
s AS (SELECT *, lag(o) OVER w AS lo, lag(votes) OVER w AS lv, lead(o) OVER w AS ho, lead(votes) OVER w AS hv FROM t WINDOW w AS (PARTITION BY k ORDER BY o)),
x AS (SELECT g.k, n, coalesce(e.e, 0) AS e FROM g LEFT JOIN e ON e.k = g.k),
c AS (SELECT k, o FROM (SELECT s.k, o, row_number() OVER (PARTITION BY s.k ORDER BY votes DESC, abs(o - x.e), o) AS i FROM s JOIN x ON x.k = s.k
  WHERE votes >= CASE WHEN o - lo = 1 THEN lv ELSE 0 END AND votes >= CASE WHEN ho - o = 1 THEN hv ELSE 0 END) WHERE i <= 40
 UNION SELECT k, unnest(list_append(range(e - 4, e + 5), 0)) FROM x),
r AS (SELECT c.k, c.o, avg(abs(a.v - b.v)) AS error, count(*) AS m FROM c JOIN a ON a.k = c.k JOIN b ON b.k = c.k AND b.p = a.p + c.o GROUP BY ALL),
y AS (SELECT r.k, min(error) FILTER (WHERE 2 * m >= n) AS least, max(error) FILTER (WHERE o = 0) AS still FROM r JOIN x ON x.k = r.k GROUP BY r.k),
z AS (SELECT r.k, r.o, r.error, still, row_number() OVER (PARTITION BY r.k ORDER BY abs(r.o - x.e), r.o) AS i FROM r JOIN x ON x.k = r.k JOIN y ON y.k = r.k WHERE 2 * m >= n AND r.error <= least * 1.01 + 0.01)
SELECT k, o AS shift, round(error, 6) AS error, round(still, 6) AS still_error, (o <> 0 AND coalesce(error < 0.5 * still, true)) AS moved FROM z WHERE i = 1""")
def sequence_shifts(spark, sf_dir):
    """By how much stretches of a thousand events were moved, with every sixth value changed."""
    e = _table(spark, sf_dir, "events")
    k, p = F.floor(F.col("event_id") / 1000), F.col("event_id") % 1000
    before = e.select(k.alias("k"), p.alias("p"), F.col("value").alias("v"))
    after = e.select(k.alias("k"), (p + k % 9 - 4).alias("p"), F.when(F.col("event_id") % 6 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("v"))
    told = before.select("k").distinct().where("k % 2 = 0").withColumn("shift", F.lit(1))
    found = shifts.shifts(before, after, "k", "p", "v", told)
    return found.select("k", "shift", F.round("error", 6).alias("error"), F.round("still_error", 6).alias("still_error"), "moved")
