"""Geometry, windows, mapping, stores and the queries' SQL."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hushframe.functions import geometry as G
from hushframe.operators import frames, mapping, sequences, windows
from hushframe.operators.rules import Rule
from hushframe.sources import stores
from hushframe.streaming.counts import only_changes


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def cells(rects):
    return {(x, y) for r in rects for x in range(r["x"], r["x"] + r["w"]) for y in range(r["y"], r["y"] + r["h"])}


def test_rectangles_against_cells(spark):
    rng = random.Random(1)
    for _ in range(12):
        a, b, c = ([rng.randrange(12), rng.randrange(12), rng.randrange(9), rng.randrange(9)] for _ in range(3))
        ra, rb, rc = (G.rect(*x) for x in (a, b, c))
        row = spark.range(1).select(
            G.intersect(ra, rb).alias("i"), G.subtract_all(F.array(ra), F.array(rb, rc)).alias("s"), G.coverage(ra, F.array(rb, rc)).alias("c"), G.clip(ra, F.array(rb, rc)).alias("p"), G.iou(ra, rb).alias("u"),
        ).first()
        sa, sb, sc = (cells([dict(zip("xywh", x))]) for x in (a, b, c))
        assert cells([row["i"]]) == sa & sb
        assert cells(row["s"]) == sa - sb - sc and sum(r["w"] * r["h"] for r in row["s"]) == len(sa - sb - sc)
        assert row["c"] == pytest.approx(1 if not sa else len(sa & (sb | sc)) / len(sa))
        assert cells(row["p"]) == sa & (sb | sc)
        assert row["u"] == pytest.approx(len(sa & sb) / len(sa | sb) if sa & sb else 0)


def test_rectangle_rules(spark):
    empty, r = G.rect(5, 5, 0, 3), G.rect(1, 2, 3, 4)
    assert value(spark, G.union(empty, r)) == Row(x=1, y=2, w=3, h=4)
    assert value(spark, G.contains(r, empty)) is False and value(spark, G.coverage(empty, F.array(r))) == 1
    assert value(spark, G.scale_outward(G.rect(1, 1, 2, 2), 0.5)) == Row(x=0, y=0, w=2, h=2)
    assert value(spark, G.predict(r, F.lit(-1.0), F.lit(0.0), F.lit(16.0), F.lit(20.0)))["y"] == -18
    assert value(spark, G.predict(r, F.lit(-1.0), F.lit(0.0), F.lit(16.0), F.lit(500.0)))["y"] == 2


def test_colours(spark):
    got = [value(spark, G.colour(F.lit(t))) for t in ("#112233", "ABCDEF", " ##00ff00 ", "#12345", "red", "")]
    assert got == [0x112233, 0xABCDEF, 0xFF00, None, None, None]
    for c in (0x112233, 0xFF8000, 0x00FF00, 0xFFFFFF, 0):
        h = value(spark, G.hsv(F.lit(c)))
        assert value(spark, G.rgb(F.lit(h["h"]), F.lit(h["s"]), F.lit(h["v"]))) == c
    assert value(spark, G.ink(F.lit(0xFFFF00))) == "#1A1A1A" and value(spark, G.ink(F.lit(0x0000FF))) == "#FFFFFF"


def test_windows(spark):
    rows = [(1, 10, 0, (10, 10, 50, 50), True, "Chat", "app"), (1, 11, 1, (0, 0, 100, 100), True, "Mail", "mail"), (1, 12, 2, (20, 20, 20, 20), True, "x", "y")]
    df = spark.createDataFrame([Row(screen_id=s, window_id=w, z=z, rect=dict(zip("xywh", r)), opaque=o, title=t, process=p) for s, w, z, r, o, t, p in rows], f"screen_id long, window_id long, z int, rect {G.RECT}, opaque boolean, title string, process string")
    seen = windows.visible_regions(df, G.rect(0, 0, 80, 80))
    got = {r["window_id"]: cells(r["visible"]) for r in seen.collect()}
    full = lambda *r: cells([dict(zip("xywh", r))])
    assert got == {10: full(10, 10, 50, 50), 11: full(0, 0, 80, 80) - full(10, 10, 50, 50), 12: set()}
    kept = windows.watched(seen, [Rule("AppWindow", "chat")])
    assert {(r["window_id"], r["covered"]) for r in kept.collect()} == {(10, True), (11, False)}
    boxes = spark.createDataFrame([(11, (70, 70, 30, 30), 0.0, 0.0, 16.0)], f"window_id long, rect {G.RECT}, velocity double, frame_time_ms double, interval_ms double")
    shown = windows.compose(boxes, kept, F.lit(5.0)).collect()
    assert cells([r["rect"] for r in shown if r["window_id"] == 10]) == full(10, 10, 50, 50) and cells([r["rect"] for r in shown if r["window_id"] == 11]) == full(70, 70, 10, 10)


def test_mapping(spark):
    schema = "doc_id long, line int, word_ix int, text string, x double, y double, width double, height double"
    words = spark.createDataFrame([(1, 0, 0, "mail", 0.0, 0.0, 40.0, 10.0), (1, 0, 1, "a@b.", 50.0, 0.0, 40.0, 10.0), (1, 0, 2, "com", 91.0, 0.0, 30.0, 10.0), (1, 1, 0, "Jane", 0.0, 20.0, 40.0, 10.0), (2, 0, 0, "Mary", 0.0, 0.0, 40.0, 10.0), (2, 1, 0, "Jane", 0.0, 20.0, 40.0, 10.0)], schema)
    two = [Rule("BuiltIn", built_in="Email", id="e"), Rule("Regex", r"Mary\sJane", id="n"), Rule("Text", "ne", id="p")]
    got = {(r["doc_id"], r["rule_id"], tuple(r["rect"])) for r in mapping.map_to_boxes(words, two, 2.0, 1, 2).collect()}
    assert got == {(1, "e", (26, 2, 36, 5)), (1, "p", (11, 12, 10, 5)), (2, "n", (1, 2, 20, 5)), (2, "n", (1, 12, 20, 5)), (2, "p", (11, 12, 10, 5))}


def test_mapping_of_long_documents(spark, monkeypatch):
    """Words and matches meet in stretches of the text: as if each match were held against each word; a third of all is one document."""
    monkeypatch.setattr(mapping, "STRETCH", 16)
    rng = random.Random(3)
    words, matches = [], []
    for doc, n in ((0, 400), (1, 200), (2, 3), (3, 1)):
        at = 0
        for i in range(n):
            size = rng.choice([0, 1, 2, 5, 30])
            words.append((doc, i // 10, i % 10, at, at + size, float(i % 10 * 40), float(i // 10 * 20), 38.0, 14.0))
            at += size + 1
        matches += [(doc, f"r{j % 3}", rng.randrange(at), rng.choice([1, 3, 40, 200])) for j in range(n // 2)]
    w = spark.createDataFrame(words, "doc_id int, line int, word_ix int, start int, end int, x double, y double, width double, height double")
    m = spark.createDataFrame(matches, "doc_id int, rule_id string, start int, length int")
    want = {}
    for doc, rule, start, length in set(matches):
        for d, line, _, a, b, x, y, width, height in words:
            if d == doc and a < start + length and start < b:
                l, r = x + width * (max(a, start) - a) / max(1, b - a), x + width * (min(b, start + length) - a) / max(1, b - a)
                old = want.get((doc, rule, start, length, line), (l, y, r, y + height))
                want[doc, rule, start, length, line] = (min(old[0], l), min(old[1], y), max(old[2], r), max(old[3], y + height))
    got = {tuple(r)[:5]: tuple(r)[5:] for r in mapping.line_boxes(w, m).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_touching_areas():
    assert frames.merge_touching([(0, 0, 10, 10), (10, 0, 10, 10), (100, 100, 5, 5)]) == [(0, 0, 20, 10), (100, 100, 5, 5)]
    assert len(frames.merge_touching([(0, 0, 2, 100), (2, 0, 100, 2)])) == 2


def test_sequences(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([10.0, 20.0, 0.0])], "k int, i int, v double")
    assert sequences.ema(df, "k", "i", "v").first()["ema"] == pytest.approx((10 * 0.8 + 20 * 0.2) * 0.8)
    assert value(spark, sequences.decayed(F.lit(200), F.lit(250.0))) == 100
    assert value(spark, sequences.correlation(F.array(*map(F.lit, (1.0, 2.0))), F.array(*map(F.lit, (5.0, 5.0))))) == -1
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10)], "k int, lo int, hi int")
    assert sorted(map(tuple, sequences.interval_union(spans, "k", "lo", "hi").collect())) == [(1, 0, 7), (1, 9, 10)]
    assert list(map(tuple, sequences.interval_gaps(spans, "k", "lo", "hi").collect())) == [(1, 7, 9)]


def test_large_key_is_folded_in_several_tasks(spark, monkeypatch):
    rng = random.Random(4)
    t, rows = 0, []
    for i in range(3000):
        t += rng.choice([0, 1, 30, 90, 200, 1200])
        rows.append((rng.choice([7, 7, 7, 7, None, 1 << 60, rng.randrange(50)]), t if i > 9 else None, i, None if rng.random() < 0.003 else rng.random()))
    df = spark.createDataFrame(rows, "k long, t long, i long, v double").repartition(3)
    pieces, most = sequences._pieces, []

    def seen(*a):
        out = pieces(*a)
        most.append(max(r["n"] for r in out.where("k = 7").select(F.size("pieces").alias("n")).collect()))
        return out

    monkeypatch.setattr(sequences, "_pieces", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ema = {r["k"]: r["ema"] for r in sequences.ema(df, "k", "i", "v").collect()}
        heat = {gain: {r["k"]: (r["heat"], r["hot"]) for r in sequences.heat(df, "k", "t", "i", gain=gain, half_life_ms=800.0).collect()} for gain in (3, 48)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert min(most) >= 3
    for k in {r[0] for r in rows}:
        a = None
        for _, _, _, v in (r for r in rows if r[0] == k):
            a = v if a is None or v is None else a * 0.8 + v * 0.2
        assert ema[k] == (None if a is None else pytest.approx(a, rel=1e-12)), k
        for gain in heat:
            h, last = 0, None
            for _, t, _, _ in (r for r in rows if r[0] == k):
                h = min(255, (h * math.floor(256 * 0.5 ** ((t - last if t is not None and last is not None else 0) / 800)) >> 8) + gain)
                last = t
            assert heat[gain][k] == (h, h >= 120), (k, gain)
    assert len(ema) == len(heat[48]) == len({r[0] for r in rows})


def test_stores(spark, tmp_path):
    path, saved = str(tmp_path / "rules"), [Rule("Text", "päss", id="1"), Rule("Regex", r"\d", id="2")]
    assert stores.load_rules(spark, path, "k" * 16) == []
    stores.save_rules(spark, saved, path, "k" * 16)
    assert stores.load_rules(spark, path, "k" * 16) == saved
    assert "päss" not in "".join(p.read_text() for p in (tmp_path / "rules").glob("*.txt"))
    assert stores.load_rules(spark, path, "x" * 16) == [] and (tmp_path / "rules.unreadable").exists()
    where = str(tmp_path / "settings")
    assert stores.load_settings(spark, where) == stores.SETTINGS
    stores.save_settings(spark, stores.SETTINGS | {"Theme": "Dark", "CloseToTray": False}, where)
    assert stores.load_settings(spark, where) == stores.SETTINGS | {"Theme": "Dark", "CloseToTray": False}
    lines = "    SSID                   : Home Net \r\n    BSSID : aa:bb\n  SSID : x"
    assert value(spark, stores.network_names(F.lit(lines))) == ["Home Net", "x"]


def test_sink_skips_equal_snapshots(spark):
    written = []
    each = only_changes(["k"], lambda df, i: written.append(i))
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int")
    for i, df in enumerate((a, a, b, b, a)):
        each(df, i)
    assert written == [0, 2, 4]


def test_signatures_cover_the_whole_text(spark, tmp_path):
    from hushframe.plans.queries import QUERIES

    spark.createDataFrame([(1, "alike at first"), (2, "the same"), (3, "gone")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "alike at first, then not"), (2, "the same"), (4, "new")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["id"]: r["state"] for r in QUERIES["rule_signature_diff"](spark, str(tmp_path)).collect()}
    assert found == {1: "changed", 2: "unchanged", 3: "removed", 4: "added"}


def test_queries_match_their_sql(spark):
    import duckdb

    from hushframe.plans.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "conversations"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    shown = lambda v: round(v, 6) if isinstance(v, float) else v
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, sf)
        want = db.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns), name
        got = sorted(repr([shown(r[c]) for c in columns]) for r in df.collect())
        assert got == sorted(repr([shown(v) for v in r]) for r in want.fetchall()), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_mapping_shuffles_only_where_something_is_found(spark):
    """Rows give what words give, and words of documents without matches are not written."""
    docs = spark.createDataFrame([(1, " ".join(["plain"] * 40)), (2, "write to a@b.com " + "or not " * 20 + "x@y.org"), (3, None), (4, "")], "doc_id long, text string")
    rules = [Rule("BuiltIn", built_in="Email", id="e")]
    rows = stores.word_rows(docs)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    words = [r for r in stores.words(docs).where("doc_id = 2").collect()]
    assert [(r["line"], r["word_ix"], r["x"], r["y"], r["width"]) for r in words[11:14]] == [(0, 11, 360.0, 0.0, 16.0), (1, 0, 0.0, 20.0, 24.0), (1, 1, 32.0, 20.0, 16.0)]
    got = sorted(tuple(r["rect"]) for r in mapping.map_rows_to_boxes(rows, rules).collect())
    assert got == sorted(tuple(r["rect"]) for r in mapping.map_to_boxes(stores.words(docs), rules).collect()) and len(got) == 2


def test_covers_of_boxes_beside_their_windows_need_no_join(spark, tmp_path):
    """Two rows of one key keep a window each."""
    from hushframe.plans import queries as plain

    rows = [(1, 4, 1, 1, 30.0), (1, 4, 1, 1, 40.0), (20, 13, 2, 2, 50.0), (7, 5, 3, 1, 20.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, n in (("moving_covers", 3), ("composed_covers", 4)):
        found = plain.QUERIES[name](spark, str(tmp_path))
        assert found.count() == n and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
