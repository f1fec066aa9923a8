"""The pipeline, stage by stage, against plain versions of the same decisions."""

from collections import Counter

import corpus_pipeline
from test_operators import plain_components, plain_lines, rows_of


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = corpus_pipeline.toxic_out(spark, docs, sf_dir).cache()
    assert toxic.columns == docs.columns and toxic.exceptAll(docs).count() == 0
    lines = corpus_pipeline.repeated_lines_out(spark, toxic, sf_dir).cache()
    assert lines.schema.names == docs.schema.names and lines.filter("n_chars <> char_length(text)").count() == 0
    dropped = {k[0] for k in plain_lines(rows_of(toxic)) if k[2]}
    before = {i: t for i, t, _ in rows_of(toxic)}
    after = {i: t for i, t, _ in rows_of(lines)}
    assert {i for i in before if after.get(i) != before[i]} == dropped
    near = corpus_pipeline.near_copies_out(spark, lines, sf_dir).cache()
    kept = {c for _, _, c in plain_components(rows_of(lines), 5)}
    assert {r["doc_id"] for r in near.collect()} == kept and near.count() == len(kept)
    mixed = corpus_pipeline.mixed(spark, near, sf_dir).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= kept
    packed = corpus_pipeline.packed(spark, mixed, sf_dir)
    assert Counter(r["doc_id"] for r in packed.filter("piece = 0").collect()) == Counter(r["doc_id"] for r in mixed.collect())


def test_run_is_the_stages_in_order(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    again = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert got and Counter(map(key, got)) == Counter(map(key, again))
