"""Chat formatting, periodic runs and phrase collocations against plain versions of the same."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import chat_format, collocations, periodic_runs, queries
from hushframe.llm.chat_format import Machine, Template

TURNS = "conv_id long, turn long, role string, text string, turns string, segments int, n_ok long"


def formatted(spark, rows, template=Template(), machine=Machine()):  # noqa: B008
    turns = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)
    return chat_format.read_back(chat_format.format_conversations(turns, template, machine), template)


HARD = ["<|im_end|>", "<\\|im_end|>", "<\\\\|", "<", "|", "\\", "<|", "a<", "|im_sep|>b", "<<|im_start|>assistant<|im_sep|>", "line\nline", "", "é😀", "$1\\"]


@pytest.mark.parametrize("template", [Template(), Template("[/S]", "[/M]", "[/E]", ("user", "tool"))])
def test_round_trip_of_control_strings(spark, template):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "tool", "<|im_end|>", "a\nb"]), "".join(rng.choice([*HARD, template.begin, template.middle, template.end]) for _ in range(rng.randrange(6)))) for c in range(60) for t in range(4)]
    for r in formatted(spark, rows, template).collect():
        want = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["learnt"] == [text for role, text in want if role in template.learnt]
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        assert r["formatted"].count(template.end) == 4 and all(len(s["text"]) == 0 or not s["loss"] or template.begin[:2] not in s["text"] for s in r["segments"])


def test_order_of_roles(spark):
    orders = {"us": (1, False), "ua": (2, True), "sua": (3, True), "a": (0, False), "uau": (3, False), "uaua": (4, True), "uaa": (2, False), "ss": (1, False), "uata": (4, True), "ux": (1, False), "u-": (1, False)}
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool", "x": "USER", "-": None}
    rows = [(i, t, names[c], f"{t}") for i, order in enumerate(orders) for t, c in enumerate(order)]
    found = {r["conv_id"]: (r["n_ok"], r["valid"]) for r in formatted(spark, rows).collect()}
    assert found == dict(enumerate(orders.values()))
    pairs = Machine({"start": {"q": "asked"}, "asked": {"a": "start"}}, accepts=("start",))
    rows = [(0, 0, "q", ""), (0, 1, "a", ""), (1, 0, "q", ""), (2, 0, "a", "")]
    assert {r["conv_id"]: r["valid"] for r in formatted(spark, rows, Template(), pairs).collect()} == {0: True, 1: False, 2: False}


def test_odd_conversations(spark):
    """Nulls, ties, repeated rows, rows out of order, a large conversation beside small ones, no rows."""
    rows = [(1, 2, "user", "c"), (1, None, "user", "n"), (1, 1, "assistant", None), (None, 0, "user", "x"), (None, 0, "user", "x"), (2, 0, "b", "2"), (2, 0, "b", "1"), (2, 0, "a", "3"), (2, 0, None, None)]
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", f"{t} " * 50) for t in range(4000)]
    found = {r["conv_id"]: r for r in formatted(spark, rows).collect()}
    said = lambda c: [(t["role"], t["text"]) for t in found[c]["turns"]]
    assert said(1) == [("user", "n"), ("assistant", ""), ("user", "c")] and found[1]["n_ok"] == 3 and not found[1]["valid"]
    assert said(None) == [("user", "x"), ("user", "x")]
    assert said(2) == [("", ""), ("a", "3"), ("b", "1"), ("b", "2")] and found[2]["n_ok"] == 0
    assert len(said(3)) == 4000 and found[3]["valid"] and len(found[3]["learnt"]) == 2000
    assert formatted(spark, []).collect() == []


@pytest.mark.parametrize("marks", [("<|a|>", "<|a|>", "<|b|>"), ("<|a", "<|ab", "<|c|>"), ("<<a", "<<b", "<<c"), ("<|a<", "<|b|>", "<|c|>"), ("<|a|>", "[b]", "<|c|>"), ("<\\a", "<\\b", "<\\c"), ("a", "b", "c")])
def test_templates_that_cannot_be_read_back(marks):
    with pytest.raises(ValueError, match="cannot be told"):
        Template(*marks)


def plain_runs(words, least=12):
    """All periods, all stretches, the smallest period of each."""
    found, n = {}, len(words)
    for q in range(n // 2, 0, -1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(least, 2 * q):
                found[start, end] = q
            start = max(end - q, start) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=50), st.integers(1, 9), st.integers(0, 40))
def test_runs_of_any_words(words, period, more):
    words = words + [words[-period + i % period] for i in range(more)] if len(words) >= period else words
    assert periodic_runs.runs(np.array(words, np.int64)) == plain_runs(words)


@pytest.mark.parametrize("n, period", [(3000, 1), (3000, 7), (3000, 1000), (24, 12), (12, 6), (11, 1), (23, 12)])
def test_long_runs(n, period):
    found = periodic_runs.runs(np.arange(n) % period)
    assert found == ([(0, n, period)] if n >= max(12, 2 * period) else [])


def test_runs_far_apart_and_nested():
    rng = random.Random(8)
    lines = [[rng.randrange(1000) for _ in range(15)] for _ in range(6)]
    inner = [1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 5000]
    words = [w for i in (0, 1, 2, 0, 3, 1, 4, 5, 5, 0) for w in lines[i]] + inner * 3 + list(range(6000, 7000)) + lines[0] * 2
    assert periodic_runs.runs(np.array(words)) == plain_runs(words)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text, tails):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if tails and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    last = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *last, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12_against_plain_runs(spark, tmp_path):
    rng = random.Random(2)
    prose = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    texts = [prose(rng.randrange(120), rng.choice([2, 4, 30, 500])) for _ in range(90)] + ["a\tb\n" * 20, "é é " * 9, "x y " * 13, "one " * 2000, None, "", " \n\x0b\x0c\r\t ", "\x1c \x1c " * 8]
    rows = [(i, t, "en", "s", 0, "clash", 1) for i, t in enumerate(texts)] + [(None, "b a " * 9, None, None, None, None, None), (None, None, None, None, None, None, None), (3, texts[3], "en", "s", 0, "x", 2), (3, texts[3], "en", "s", 0, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start string, n_runs int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    want = [plain_row(r[0], r[1], True) for r in rows]
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 20
    whole = periodic_runs.periodic_runs(docs.where("text like 'one one%'")).collect()
    assert [r["collapsed"] for r in whole] == ["one"] and whole[0]["n_words"] == 2000
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op12_periodic_runs"](spark, f"{tmp_path}/none").count() == 0


def plain_phrases(rows, s):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, s.longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= s.least}
        held = Counter()
        for p, a in many.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        held[p[i:j]] = max(held[p[i:j]], a)
        best = []
        for p, a in many.items():
            if held[p] < a:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(best)[: s.best])]
    return sorted(out)


@pytest.mark.parametrize("s", [collocations.Settings(least=3, best=7, pending=50, pending_pairs=100, filter_bits=1 << 16), collocations.Settings(least=2, best=10_000, longest=3, salts=3), collocations.Settings(least=2, longest=2)])
def test_collocations_against_plain_counts(spark, s):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "C", "été", "dé", "e", "f g", "😀", "ü"]) + rng.choice(["", "", "x"])
    text = lambda: "".join(word() + rng.choice([" ", "  ", "\t", ". ", "\n", ",", " \x0b"]) for _ in range(rng.randrange(60)))
    rows = [(text(), rng.choice(["en", "de", None])) for _ in range(60)] + [("New York City is big. In New York City", "en")] * 30 + [(None, "en"), ("", "en"), (" \t.,", "fr"), ("alone", "it"), ("same same same same same same", None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n int")
    found = sorted(map(tuple, collocations.collocations(docs, s).collect()))
    assert found == plain_phrases(rows, s) and len(found) > 5


def test_collocation_scores_pass_64_bits(spark):
    f, n = 3 * 10**12, 5 * 10**13
    counts = spark.createDataFrame([("en", "p q", f), ("en", "p", f + 7), ("en", "q", 2 * f + 1)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", n)], "lang string, total long")
    row = collocations.scored(counts, totals).first()
    assert row["score"] == 1000 * f * n // ((f + 7) * (2 * f + 1)) and (row["l"], row["r"], row["k"]) == (f + 7, 2 * f + 1, 1)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([("rare words", "en")], "text string, lang string")).collect() == []


def test_counting_goes_to_disk(spark):
    """More n-grams than the memory of a bucket holds are counted all the same, and its scratch folder is gone."""
    import glob
    import tempfile

    grams = spark.range(0, 600_000, 1, 4).selectExpr("'en' AS lang", "concat('some rather long phrase to count ', id % 300000) AS phrase", "id AS n")
    found = collocations._counted(grams.coalesce(1), 0, "32MB")
    assert found.selectExpr("count(*)", "sum(n)").first()[:] == (300_000, 600_000 * 599_999 // 2)
    assert not glob.glob(f"{tempfile.gettempdir()}/grams-*")
