"""Operators whose rows depend on others in time or space, against plain versions; in each a third of all rows share one key."""

import math
import random
from collections import Counter, OrderedDict, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.functions import geometry as G
from hushframe.operators import asof, assign, frames, generations, prefixes, recall, sequences, sessions, shifts, throttle, tiles


def keyed(rng, n, keys=8):
    """Rows (key, time, id), a third of them of key 0; times repeat."""
    return [(0 if i % 3 == 0 else rng.randrange(keys), rng.randrange(n * 2), i) for i in range(n)]


def test_running_values_in_parts(spark):
    rng = random.Random(1)
    rows = [(k if k != 5 else None, t if t % 17 else None, i, None if i % 11 == 0 else rng.randrange(100)) for k, t, i in keyed(rng, 600)]
    df = prefixes.with_part(spark.createDataFrame(rows, "k int, t int, i int, v int"), "t", 5)
    order = [F.col("t").asc_nulls_first(), F.col("i")]
    found = prefixes.running_sum(df, ["k"], order, F.col("v"), "s")
    found = prefixes.running_max(found, ["k"], order, F.col("v"), "m")
    found = prefixes.last_value(found, ["k"], order, F.col("v"), "l", F.struct(F.coalesce("t", F.lit(-1)), "i"))
    assert df.select(prefixes.PART).distinct().count() == 5 and found.count() == len(rows)
    got = {r["i"]: (r["s"], r["m"], r["l"]) for r in found.collect()}
    for k in {r[0] for r in rows}:
        total = most = last = None
        for _, _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1], r[2])):
            before = most
            if v is not None:
                total, most, last = (total or 0) + v, v if most is None else max(most, v), v
            assert got[i] == (total, before, last)


def test_versions_valid_at_a_time(spark):
    rng = random.Random(2)
    rows = keyed(rng, 500) + [(None, 5, 900), (1, None, 901), (1, 7, 902), (1, 7, 902), (99, 3, 903)]
    versions = [(rng.randrange(8), rng.randrange(1000), f"v{j}") for j in range(200)] + [(0, t, f"w{t}") for t in range(0, 1000, 5)] + [(1, 7, "a"), (1, 7, "b"), (None, 0, "n"), (2, None, "n")]
    df = spark.createDataFrame([(*r, "was") for r in rows], "k int, t int, i int, version string")
    found = asof.valid_at(df, spark.createDataFrame(versions, "k int, since int, name string"), "k", "t", "since", parts=6)
    assert found.columns == ["k", "t", "i", "version"] and found.count() == len(rows)
    want = Counter()
    for k, t, i in rows:
        fit = [(s, n) for kk, s, n in versions if kk == k and k is not None and t is not None and s is not None and s <= t]
        want[i, max(fit)[1] if fit else None] += 1
    assert Counter((r["i"], r["version"]["name"] if r["version"] else None) for r in found.collect()) == want
    none = spark.createDataFrame([], "k int, since int, name string")
    assert asof.valid_at(df, none, "k", "t", "since").where("version is not null").count() == 0
    assert asof.valid_at(df.limit(0), none, "k", "t", "since").count() == 0


def test_idle_periods(spark):
    rng = random.Random(3)
    rows = keyed(rng, 500) + [(None, 3, 1000), (4, None, 1001), (0, 5000, 1002), (0, 5000, 1003)]
    found = sessions.idle_periods(spark.createDataFrame(rows, "k int, t int, i int"), "k", "t", 9, parts=7)
    want = []
    for k in range(8):
        run = []
        for t in sorted(r[1] for r in rows if r[0] == k and r[1] is not None):
            if run and t - run[-1] >= 9:
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want += [(k, run[0], run[-1], len(run))] if run else []
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sessions.idle_periods(spark.createDataFrame([], "k int, t int"), "k", "t", 9).count() == 0


def plain_throttle(rows, gap):
    taken, last = set(), {}
    for k, t, i in sorted(r for r in rows if None not in r):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            taken.add((k, i))
    return taken


@pytest.mark.parametrize("gap", [1, 40, 100_000])
def test_throttle(spark, gap):
    rng = random.Random(4)
    rows = keyed(rng, 400) + [(7, 3, 800), (7, 3, 801)]
    df = spark.createDataFrame([*rows, (None, 1, 900), (1, None, 901)], "k int, t int, i int")
    found = {(r["k"], r["i"]) for r in throttle.throttled(df, "k", "t", "i", gap, parts=4).collect()}
    assert found == plain_throttle(rows, gap)


def test_throttle_of_nothing(spark):
    df = spark.createDataFrame([], "k int, t int, i int")
    assert throttle.throttled(df, "k", "t", "i", 5).count() == 0
    with pytest.raises(ValueError, match="positive"):
        throttle.throttled(df, "k", "t", "i", 0)


def meets(a, b):
    return a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]


def rect_rows(rng, n):
    """A third in one tile of one key, some equal, some large, thin, negative or empty."""
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append((0, (rng.randrange(8), rng.randrange(8), rng.randrange(1, 4), rng.randrange(1, 4))))
        else:
            side = rng.choice([1, 3, 20, 300])
            out.append((rng.randrange(3), (rng.randrange(-200, 200), rng.randrange(-200, 200), rng.randrange(side + 1), rng.choice([1, side]))))
    return out


def rect_table(spark, rows, extra=()):
    flat = [(i, k, *(r or (None,) * 4)) for i, (k, r) in enumerate([*rows, *extra])]
    df = spark.createDataFrame(flat, "i int, k int, x int, y int, w int, h int")
    return df.select("i", "k", F.when(F.col("x").isNotNull(), G.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).alias("rect"))


@pytest.mark.parametrize("crowd", [2000, 7])
def test_rectangles_that_meet(spark, monkeypatch, crowd):
    monkeypatch.setattr(tiles, "CROWD", crowd)
    rng = random.Random(5)
    left, right = rect_rows(rng, 240), rect_rows(rng, 200)
    a, b = rect_table(spark, left, [(None, (0, 0, 5, 5)), (0, None)]), rect_table(spark, right, [(None, (0, 0, 5, 5)), (0, None)])
    found = [(r["k"], tuple(r["a"]), tuple(r["b"]), r["n_a"], r["n_b"]) for r in tiles.overlapping(a, b, "k").collect()]
    na, nb = Counter(left), Counter(right)
    want = [(k, p, q, m, n) for (k, p), m in na.items() for (kk, q), n in nb.items() if k == kk and min(*p[2:], *q[2:]) > 0 and meets(p, q)]
    assert sorted(found) == sorted(want) and len(want) > 500
    hit = {(k, p) for k, p, *_ in want}
    assert sorted(r["i"] for r in tiles.touched(a, b, "k").collect()) == [i for i, row in enumerate(left) if row in hit]
    assert tiles.overlapping(a.limit(0), b.limit(0), "k").count() == 0 and tiles.overlapping(a, b.limit(0), "k").count() == 0


def plain_greedy(pairs):
    used_a, used_b, out = set(), set(), []
    for s, a, b in sorted(((-s, a, b) for a, b, s in set(pairs))):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b, -s))
    return sorted(out)


def test_greedy_pairs(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(40), rng.randrange(40), rng.choice([0.25, 0.5, 0.75, rng.random()])) for _ in range(300)]
    pairs += [(1000, j, 0.5) for j in range(150)] + pairs[:5]
    frame = lambda rows: spark.createDataFrame(rows, "a int, b int, score double")
    found, rounds = assign.greedy_pairs(frame([*pairs, (None, 1, 0.9), (1, None, 0.9), (1, 1, None)]))
    assert sorted(map(tuple, found.collect())) == plain_greedy(pairs) and 1 < rounds < 20
    chain = [(i // 2, (i + 1) // 2, 100.0 - i) for i in range(12)]
    found, rounds = assign.greedy_pairs(frame(chain))
    assert sorted(map(tuple, found.collect())) == plain_greedy(chain) and rounds == 6
    with pytest.raises(RuntimeError, match="left after 2 rounds"):
        assign.greedy_pairs(frame(chain), most_rounds=2)
    assert assign.greedy_pairs(frame([]))[1] == 0


def test_assigned_boxes(spark):
    rng = random.Random(7)
    boxes = [(i, i % 2, rng.randrange(3), rng.choice("rs"), (rng.randrange(30), rng.randrange(30), rng.randrange(1, 15), rng.randrange(1, 15))) for i in range(120)]
    table = spark.createDataFrame([(i, side, k, rule, *r) for i, side, k, rule, r in boxes], "id int, side int, k int, rule string, x int, y int, w int, h int")
    table = table.select("id", "side", "k", "rule", G.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("rect"))
    found, _ = assign.assigned(table.where("side = 0"), table.where("side = 1"), "k")

    def iou(p, q):
        w, h = min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]), min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1])
        return w * h / (p[2] * p[3] + q[2] * q[3] - w * h) if w > 0 and h > 0 else 0.0

    pairs = [(a[0], b[0], iou(a[4], b[4]) + (a[3] == b[3])) for a in boxes for b in boxes if a[1] == 0 and b[1] == 1 and a[2] == b[2] and iou(a[4], b[4]) > 0 and (a[3] == b[3] or iou(a[4], b[4]) > 0.3)]
    assert sorted(map(tuple, found.collect())) == plain_greedy(pairs)


def plain_generations(rows, share, hot_after):
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        shots = sorted({r[1] for r in rows if r[0] == k and r[1] is not None})
        at = [{b: max((v for kk, s, bb, v in rows if (kk, s, bb) == (k, shot, b)), key=lambda v: (v is not None, v)) for kk, s, b, _ in rows if (kk, s) == (k, shot)} for shot in shots]
        generation, changed = 0, defaultdict(set)
        for n, blocks in enumerate(at):
            seen = set(blocks) | (set(at[n - 1]) if n else set())
            for b in seen:
                if n and not (b in blocks and b in at[n - 1] and blocks[b] == at[n - 1][b]):
                    changed[b].add(n)
            hot = {b for b in seen if all(n - j in changed[b] for j in range(1, hot_after + 1))}
            cold = seen - hot
            part = sum(n in changed[b] for b in cold) / len(cold) if cold else 0.0
            generation += bool(n and part >= share)
            out[k, shots[n]] = (len(cold), sum(n in changed[b] for b in cold), len(hot), part, generation)
    return out


def test_generations(spark):
    rng = random.Random(8)
    rows = [(0 if i % 3 == 0 else rng.randrange(3), rng.randrange(12), rng.choice([None, *range(7)]), rng.choice([None, 1, 1, 1, 2])) for i in range(400)] + [(None, 1, 1, 1), (1, None, 1, 1), (5, 3, 1, 1)]
    for share, hot_after in ((0.35, 3), (0.6, 1)):
        found = generations.generations(spark.createDataFrame(rows, "k int, s int, b int, v int"), "k", "s", "b", "v", share, hot_after)
        got = {(r["k"], r["s"]): (r["n_blocks"], r["n_changed"], r["n_hot"], r["share"], r["generation"]) for r in found.collect()}
        assert got == plain_generations(rows, share, hot_after)
        assert any(g[2] for g in got.values()) and max(g[4] for g in got.values()) > 1


def test_memory_of_items(spark):
    rng = random.Random(9)
    rows = [(k, rng.randrange(25), t) for k, t, _ in keyed(rng, 500)]
    found = recall.remembered(spark.createDataFrame([*rows, (None, 1, 1), (1, None, 1), (1, 1, None)], "k int, i int, t int"), "k", "i", "t", most=6)
    for k in range(8):
        memory = OrderedDict()
        for _, t, i in sorted((k, t, i) for kk, i, t in rows if kk == k):
            memory.pop(i, None)
            memory[i] = t
            while len(memory) > 6:
                memory.popitem(last=False)
        want = [(i, t, n + 1) for n, (i, t) in enumerate(reversed(memory.items()))]
        assert [tuple(r)[1:] for r in found.where(f"k = {k}").orderBy("recency").collect()] == want


def test_recall_of_vectors(spark):
    """Pairs just above the limit; a third of the items are one vector; the candidates find at least nine in ten of what the exact way finds."""
    rng = np.random.default_rng(10)
    base = rng.standard_normal((60, 24))
    near = base + rng.uniform(0.1, 0.4, (60, 1)) * rng.standard_normal((60, 24))
    items = [(1000 + i, near[i].tolist()) for i in range(60)] + [(2000 + i, base[0].tolist()) for i in range(30)]
    odd = [(1, None), (2, []), (3, [1.0] * 24), (4, [None] * 24), (5, [1.0, 2.0]), (None, [1.0, 3.0])]
    schema = "id int, v array<double>"
    q, it = spark.createDataFrame([*enumerate(base.tolist()), (700, [5.0, 7.0])], schema), spark.createDataFrame(items + odd, schema)
    exact = {(r["query_id"], r["item_id"]): (r["score"], r["n_items"]) for r in recall.recalled_exactly(q, it, "id", "v").collect()}
    want = {(i, j): np.corrcoef(base[i], v)[0, 1] for i in range(60) for j, v in items[:61] if np.corrcoef(base[i], v)[0, 1] >= 0.95} | {(700, 5): 1.0}
    assert exact.keys() == want.keys() and all(math.isclose(exact[p][0], want[p], abs_tol=1e-9) for p in want)
    assert exact[0, 2000][1] == 30 and len(want) > 20
    found = {(r["query_id"], r["item_id"]) for r in recall.recalled(q, it, "id", "v").collect()}
    assert found <= exact.keys() and len(found) >= 0.9 * len(exact)


def test_recall_misses_nothing_at_any_level(spark):
    """Correlations of 0.5 share few planes; all pairs are found, and none leaves its task before it is checked."""
    v = np.random.default_rng(23).standard_normal((80, 12))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    want = {(i, j) for i in range(80) for j in range(80) if np.corrcoef(v[i], v[j])[0, 1] >= 0.5}
    found = recall.recalled(df, df, "id", "v", 0.5)
    assert {(r["query_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 200
    assert "Exchange" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("blocks", [1, 4])
def test_exact_recall_in_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(recall, "QUERY_BLOCK", -(-20 // blocks))
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(f"n{i}", rng.standard_normal(5).tolist()) for i in range(20)], "id string, v array<double>")
    found = {(r["query_id"], r["item_id"]) for r in recall.recalled_exactly(df, df, "id", "v", 0.99).collect()}
    assert {(f"n{i}", f"n{i}") for i in range(20)} <= found


@pytest.mark.parametrize("few", [3, 256])
def test_pairs_of_small_keys_need_no_tiles(spark, monkeypatch, few):
    monkeypatch.setattr(tiles, "FEW", few)
    monkeypatch.setattr(tiles, "CROWD", 7)
    levelled, tiled = tiles._levelled, []
    monkeypatch.setattr(tiles, "_levelled", lambda *x: tiled.append(1) or levelled(*x))
    rng = random.Random(24)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 30), (rng.randrange(60), rng.randrange(60), rng.randrange(25), rng.randrange(25))) for i in range(150)]
    r = rect_table(spark, rows, [(None, (0, 0, 5, 5)), (1, None)])
    meet = lambda a, b: min(a[0] + a[2], b[0] + b[2]) > max(a[0], b[0]) and min(a[1] + a[3], b[1] + b[3]) > max(a[1], b[1])
    solid = {(k, a) for k, a in rows if a[2] and a[3]}
    want = {(k, a, b) for k, a in solid for kk, b in solid if k == kk and a < b and meet(a, b)}
    found = [(x["k"], tuple(x["a"]), tuple(x["b"])) for x in tiles.overlapping(r, r, "k", once=True).collect()]
    assert len(found) == len(set(found)) and set(found) == want and bool(tiled) == (few == 3)


def test_shifts_of_sequences(spark):
    rng = random.Random(12)
    base = [rng.randrange(10_000) / 10 for _ in range(200)]
    rows_a, rows_b, told = [], [], [(3, 5), (4, 50)]
    for k, by in enumerate((0, 7, -13, 2, 50)):
        rows_a += [(k, p, v) for p, v in enumerate(base)]
        rows_b += [(k, p + by, v + (0.3 if p % 9 == 0 else 0)) for p, v in enumerate(base)]
    # A key that repeats every 10 rows: all shifts of whole periods tie, the nearest to the expected one counts.
    rows_a += [(9, p, float(p % 10)) for p in range(100)]
    rows_b += [(9, p, float((p + 2) % 10)) for p in range(100)]
    rows_a += [(8, 1, 1.0), (7, None, 1.0), (None, 1, 1.0)]
    frame = lambda rows: spark.createDataFrame(rows, "k int, p int, v double")
    found = {r["k"]: r for r in shifts.shifts(frame(rows_a), frame(rows_b), "k", "p", "v", spark.createDataFrame([*told, (9, 7)], "k int, shift int")).collect()}
    assert {k: r["shift"] for k, r in found.items()} == {0: 0, 1: 7, 2: -13, 3: 2, 4: 50, 9: 8}
    assert {k: r["moved"] for k, r in found.items()} == {0: False, 1: True, 2: True, 3: True, 4: True, 9: True}
    assert shifts.shifts(frame([]), frame([]), "k", "p", "v").count() == 0


def test_same_gaps_as_the_other_form(spark):
    """Stretches and the rows after which a key was quiet are two views of one thing."""
    rows = keyed(random.Random(13), 300)
    df = spark.createDataFrame(rows, "k int, t int, i int")
    ends = {(r["k"], r["idle_since"]) for r in sessions.idle_periods(df, "k", "t", 20).collect()}
    assert ends == {(r["k"], r["t"]) for r in sequences.debounced(df, "k", "t", "i", 20).collect()}


def test_areas_made_one(spark):
    """As the plain fold over all rectangles of a key, for groups that hang together and a third of all in one key."""
    rng = random.Random(14)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 6), (rng.randrange(120), rng.randrange(120), rng.choice([0, 1, 5, 12]), rng.choice([1, 4, 9]))) for i in range(260)]
    rows += [(7, (0, 0, 1, 1)), (7, (0, 0, 1, 1)), (8, (-5, -5, 3, 3)), (8, (-2, -5, 3, 3)), (8, (1, -5, 3, 3)), (8, (50, 50, 3, 3))]
    found = frames.merged_areas(rect_table(spark, rows, [(None, (0, 0, 5, 5)), (1, None)]), "k").collect()
    for k in {k for k, _ in rows}:
        want = frames.merge_touching(sorted({r for kk, r in rows if kk == k}))
        assert sorted(tuple(r["rect"]) for r in found if r["k"] == k) == sorted(want), k
        assert sorted(frames.merge_touching(sorted(r for kk, r in rows if kk == k))) == sorted(want), k
    assert frames.merged_areas(rect_table(spark, [(1, None)]), "k").count() == 0


def test_assigned_in_one_round_and_in_bands(spark, monkeypatch):
    """Boxes in a row, each nearer to the next one than to the one before, took a round each; ties, classes and bands of pairs."""
    row, at = [], 0
    for i in range(24):
        row.append((i, i % 2, "k", None, at, 0, 100, 10))
        at += 60 - i
    frame = spark.createDataFrame([*row, (99, 0, "k", None, 0, 0, 0, 5), (None, 1, "k", "r", 0, 0, 100, 10), (98, 1, None, "r", 0, 0, 100, 10), row[3]], "id long, side int, k string, rule string, x int, y int, w int, h int")
    frame = frame.select("id", "side", "k", "rule", G.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("rect"))
    found, rounds = assign.assigned(frame.where("side = 0"), frame.where("side = 1"), "k", 0.1)
    iou = lambda p, q: (100 - abs(p - q)) / (100 + abs(p - q)) if abs(p - q) < 100 else 0.0
    pairs = [(a[0], b[0], iou(a[4], b[4])) for a in row for b in row if a[1] == 0 and b[1] == 1 and iou(a[4], b[4]) > 0.1]
    assert sorted(map(tuple, found.collect())) == plain_greedy(pairs) and rounds == 1

    rng = np.random.default_rng(3)
    ids = rng.permutation(400)
    places = np.stack([rng.integers(0, 3, 400), rng.integers(0, 6, 400), rng.integers(0, 3, 400), rng.integers(3, 6, 400), rng.integers(3, 5, 400)], axis=1)
    sides = lambda: (assign._Side(ids[:200], places[:200]), assign._Side(ids[200:], places[200:]))
    one, scores = {}, assign._scores(places[:200], places[200:], 0.3)
    assert len(sides()[0].classes) < 200
    wanted = plain_greedy([(int(ids[i]), int(ids[200 + j]), float(scores[i, j])) for i, j in zip(*np.nonzero(scores > 0), strict=True)])
    for held in (1 << 20, 50):
        monkeypatch.setattr(assign, "HELD", held)
        monkeypatch.setattr(assign, "CHUNK", 16 * held)
        one[held] = sorted((int(a), int(b), s) for s, p, q in assign._assigned_in_key(*sides(), 0.3) for a, b in zip(p, q, strict=True))
        assert one[held] == wanted


def test_areas_of_small_keys_take_no_rounds(spark, monkeypatch):
    """Keys of a few rows are merged at once, as large ones are by their groups."""
    rng = random.Random(12)
    rows = [(k, (rng.randrange(40), rng.randrange(40), rng.choice([1, 5, 12]), rng.choice([1, 4, 9]))) for k in range(30) for _ in range(rng.randrange(1, 9))]
    table = rect_table(spark, rows, [(None, (0, 0, 5, 5)), (1, None)])
    grouped, told = frames._grouped, []
    monkeypatch.setattr(frames, "_grouped", lambda d, key: told.append(key) or grouped(d, key))
    shown = lambda: sorted((r["k"], tuple(r["rect"])) for r in frames.merged_areas(table, "k").collect())
    want = sorted((k, r) for k in range(30) for r in frames.merge_touching(sorted({r for kk, r in rows if kk == k})))
    assert shown() == want and not told
    monkeypatch.setattr(frames, "FEW", 4)
    assert shown() == want and told
