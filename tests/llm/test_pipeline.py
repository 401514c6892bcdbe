"""The corpus pipeline: what each stage takes out, and that it keeps the columns."""

import random
import re
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hushframe.llm import decontaminate, pu_ops, secret_scan, simhash
from hushframe.llm.common import cut, table

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, SF), "stage")
        counts.append(docs.count())
        if name == "quality":
            scored = pu_ops.classify_quality(before, table(spark, SF, "labels"))
            assert counts[-1] == scored.where("predicted = 1").count()
        elif name == "near duplicates":
            groups = simhash.simhash_components(before)
            assert {r["doc_id"] for r in docs.collect()} == {r["first_id"] for r in groups.collect()}
        elif name == "decontamination":
            dirty = decontaminate.contamination(before, table(spark, SF, "benchmark")).where("contaminated")
            assert counts[-1] == counts[-2] - dirty.count()
        elif name == "secrets":
            assert counts[-1] == counts[-2] and secret_scan.scan(docs).where("base <> ''").count() == 0
        else:
            assert set(columns) < set(docs.columns) and docs.where("taken > 2 * size or copies < 1").count() == 0
        assert docs.columns[: len(columns)] == columns
    assert all(counts)


def test_run(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r["taken"] == r["copies"] * r["size"] for r in rows)


CLASH = ["size", "Copies", "taken", "mix_size", "key", "__key", "place", "fingerprint", "contaminated", "score", "row", "pattern"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in all columns, empty and long texts, repeated rows, clashing names; and the same tables without rows."""
    folder, rng = tmp_path_factory.mktemp("odd"), random.Random(4)
    prose = lambda n: " ".join(rng.choice(("the", "of", "river", "stone", "light", "walks", "été")) + rng.choice(("", "s", "er")) for _ in range(n))
    passage = " ".join(f"w{i}" for i in range(20))
    texts = [prose(rng.randrange(5, 80)) for _ in range(40)]
    texts += [None, "", " \n\t ", "y " * 20_000, f"x {passage} y", "the password=abcdef1234 of it", texts[0], texts[0]]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(f"own {c}") for c in CLASH}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(0, 40, 2)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def plain_words(text):
    return [w for w in re.split(r"[ \t-\r]+", text or "") if w]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, name):
    """Each stage on its own: the columns stay with what they hold, and no row comes in that was not there."""
    docs, stage = table(spark, odd, "documents"), dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, docs, odd)
    new = found.columns[len(docs.columns) :]
    assert found.columns[: len(docs.columns)] == docs.columns
    assert new == (["mix_mix_size", "mix_copies", "mix_taken"] if name == "mix" else [])
    got, given = found.collect(), docs.collect()
    assert all(r[c] == f"own {c}" for r in got for c in CLASH)
    shown = lambda rows, columns: Counter(tuple(r[c] for c in columns) for r in rows)
    columns = ("doc_id", "lang", "source") + (("text", "n_chars") if name != "secrets" else ())
    assert not shown(got, columns) - shown(given, columns)
    if name == "secrets":
        assert len(got) == len(given) and not any("abcdef1234" in (r["text"] or "") for r in got)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
        assert [r["text"] for r in got if r["doc_id"] in (40, 41)].count(None) == 1
    elif name == "decontamination":
        assert {r["doc_id"] for r in given} - {r["doc_id"] for r in got} == {44} and len(got) == len(given) - 1
    elif name == "near duplicates":
        # One row for each text here: repeated ones once, and all without words once.
        assert len({tuple(plain_words(r["text"])) for r in got}) == len(got)
        assert {tuple(plain_words(r["text"])) for r in given} >= {tuple(plain_words(r["text"])) for r in got}
    elif name == "mix":
        assert all(r["mix_mix_size"] == len(plain_words(r["text"])) and r["mix_copies"] > 0 and r["mix_taken"] == r["mix_copies"] * r["mix_mix_size"] for r in got)
    assert stage(spark, docs.limit(0), odd).count() == 0
