"""Each stage of the pipeline on odd rows: nulls, empty and very long texts, ties, repeated rows, empty
tables, and columns with the names that the operators use for their own."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from graphloom.llm import toxicity

WORDS = [f"w{i}" for i in range(300)]
LINE = "a line that many documents share and that is long enough"
CLASH = ("score", "n_lines", "n_dropped", "spans", "size", "finish", "copies", "target", "component_id", "kept", "n", "bands", "piece", "length", "__size", "__k")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    rows = [(i, " ".join([*rng.choices(WORDS, k=40), *(["vile", "scummy"] * (i % 4 == 0))]), "en", f"s{i % 3}") for i in range(0, 300)]
    rows += [(400 + i, f"{LINE}\nown words {i} {rng.choice(WORDS)} {rng.choice(WORDS)}", "en", "s1") for i in range(8)]
    copy = " ".join(rng.choices(WORDS, k=80))
    rows += [(500 + i, copy if i < 3 else f"{copy} x{i}", "de", None) for i in range(6)]
    rows += [(600, None, None, None), (601, "", "en", "s0"), (602, " \n\t ", "en", "s0"), (603, "one", "en", "s0"), (None, "a row that has no id", "en", "s2"), (None, "another row that has no id", None, "s2")]
    rows += [(700, " ".join(rng.choices(WORDS, k=20000)), "en", "s2"), rows[1], rows[1]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    path = tmp_path_factory.mktemp("odd")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(300)] + [(9999, 1, 1), (None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def count(df):
    return Counter(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()))


def test_toxicity_stage(spark, folder):
    docs = documents(spark, folder)
    got = corpus_pipeline.toxic_out(spark, docs, folder)
    assert tuple(got.columns) == corpus_pipeline.COLUMNS
    kept = count(got)
    gone = count(docs) - kept
    assert kept <= count(docs) and all("vile" in r[1] for r in gone) and sum("vile" in (r[1] or "") for r in kept) < 8
    held = {r["doc_id"] for r in docs.filter(toxicity.held_out()).select("doc_id").distinct().collect()}
    assert any(r[0] in held for r in gone)


def test_line_stage(spark, folder):
    docs = documents(spark, folder)
    got = corpus_pipeline.repeated_lines_out(spark, docs, folder)
    assert tuple(got.columns) == corpus_pipeline.COLUMNS
    before, after = count(docs), count(got)
    plain = Counter()
    for (i, t, lang, source, _), n in before.items():
        t = t or ""
        if i is not None and 400 <= i < 407:
            t = t.replace(f"{LINE}\n", "")
        plain[i, t, lang, source, len(t)] += n
    assert after == plain


def test_near_copy_stage(spark, folder):
    docs = documents(spark, folder)
    got = corpus_pipeline.near_copies_out(spark, docs, folder)
    assert tuple(got.columns) == corpus_pipeline.COLUMNS
    before, after = count(docs), count(got)
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert gone == {501, 502, 503, 504, 505} and all(after[r] == before[r] for r in after)


def test_mixing_stage(spark, folder):
    docs = documents(spark, folder)
    got = corpus_pipeline.mixed(spark, docs, folder)
    assert tuple(got.columns) == corpus_pipeline.COLUMNS
    before, after = count(docs), count(got)
    words = lambda c: sum(len((r[1] or "").split()) * n for r, n in c.items())
    assert all(after[r] <= 2 * before[r] for r in after) and words(before) * 1.5 - 20000 <= words(after) <= words(before) * 1.5


def test_packing_stage(spark, folder):
    docs = documents(spark, folder)
    got = corpus_pipeline.packed(spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in count(docs).elements())
    room = Counter()
    for r in got:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048


def test_stages_of_empty_tables(spark, folder, tmp_path):
    none = documents(spark, folder).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, folder)
        assert got.count() == 0, name
        assert name == "packing" or tuple(got.columns) == corpus_pipeline.COLUMNS
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_over_odd_rows(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in got}
    assert {None, 500, 600, 601, 602, 603, 700} <= ids and not {501, 502, 503} & ids
