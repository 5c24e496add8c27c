"""The pipeline's stages, each against brute force on its own input."""

import duckdb
import numpy as np

from tests.llm.test_operators import brute_best_fit, brute_components, brute_hits


def test_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as pipeline
    from ligature.llm import line_dedup, registry

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, frames = docs.columns, [docs.toPandas()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        frames.append(docs.toPandas())
    start, good, lines, near, clean, packed = frames

    scores = {r.doc_id: r.predicted for r in registry.queries()["op2_quality_classifier"](spark, sf_dir).collect()}
    assert set(good.doc_id) == {i for i, p in scores.items() if p}

    documents = good  # noqa: F841  read by the SQL
    want = {r[0]: r for r in duckdb.sql(line_dedup.sql()).fetchall()}
    names = [c[0] for c in duckdb.sql(line_dedup.sql()).description]
    want = {i: dict(zip(names, r, strict=True)) for i, r in want.items()}
    assert dict(zip(lines.doc_id, lines.text, strict=True)) == {i: r["text"] for i, r in want.items() if not r["n_lines"] or r["n_removed"] < r["n_lines"]}
    assert (lines.n_chars == lines.text.str.len()).all()

    texts = list(zip(lines.doc_id.tolist(), lines.text.tolist(), strict=True))
    parts = brute_components(texts, pipeline.NEAR_WORDS, pipeline.NEAR_NUM, pipeline.NEAR_DEN)
    assert set(near.doc_id) == {i for component, i, n in parts if component == i or not n}

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    hits = brute_hits(list(zip(near.doc_id.tolist(), near.text.tolist(), strict=True)), [tuple(r) for r in items])
    assert set(clean.doc_id) == {h[0] for h in hits if not h[4]}
    assert len(start) > len(good) > len(near)

    assert set(packed.doc_id) == set(clean.doc_id)
    used = packed.groupby("sequence_id").length.sum()
    assert used.max() <= 1024 and len(used) == brute_best_fit(packed.length.tolist(), 1024)
    again = pipeline.run(spark, sf_dir).toPandas()
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert np.array_equal(again.sort_values(keys)[keys].to_numpy(), packed.sort_values(keys)[keys].to_numpy())


def write_tables(spark, path, docs, labels, items):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def awkward_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, shared ids, clashing and dotted names."""
    from tests.llm.test_operators import awkward

    rows = [(i, t, None if k % 3 else "en", None, None if t is None else len(t), "own", k, 0.5, "x") for k, (i, t, *_) in enumerate(awkward())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, set_key long, score double, `a.b` string")


def test_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = awkward_docs(spark).repartition(3)
    write_tables(spark, tmp_path, docs, [(1, 1, 0), (4, 0, 0), (5, 0, 0), (8, 0, 0), (11, 1, 0), (None, 1, 0), (7, None, 0)], [(1, " ".join(f"word{k}" for k in range(60))), (None, "a"), (2, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(pipeline.STAGES)
    for name in list(stages)[:4]:
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows = out.collect()
        assert all(r["row"] == "own" and r["a.b"] == "x" for r in rows), name
        none = stages[name](spark, docs.limit(0), str(tmp_path))
        assert none.columns == docs.columns and none.collect() == [], name
    assert stages["best_fit_packing"](spark, docs.limit(0), str(tmp_path)).collect() == []
    assert stages["best_fit_packing"](spark, docs, str(tmp_path)).where("piece = 0").count() == docs.count()

    lines = stages["line_dedup"](spark, docs, str(tmp_path)).collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines)
    assert {r.doc_id for r in lines} >= {4, 5, 6, None}

    near = sorted(((r.doc_id, r.text) for r in stages["ngram_jaccard_join"](spark, docs, str(tmp_path)).collect()), key=str)
    ids = [i for i, _ in near]
    assert [t for i, t in near if i == 15] == ["another text"] and ids.count(2) == 0 and ids.count(3) == 0 and ids.count(1) == 1 and ids.count(None) == 2
    assert {4, 5, 6} <= set(ids) and ids.count(19) == 0  # a copy of 11 but for its case

    clean = {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, str(tmp_path)).collect()}
    assert not clean & {11, 12, 13, 19} and {1, 2, 4, 5, 6, None} <= clean


def test_near_copies_of_one_id(spark):
    """Rows of one id: equal ones and near copies go but one, different ones stay."""
    import corpus_pipeline as pipeline

    def text(k, edit=None):
        own = [f"t{k}w{j}" for j in range(120)]
        if edit is not None:
            own[edit] = f"e{edit}"
        return " ".join(own)

    rows = [(1, text(0)), (1, text(0)), (1, text(0, 50)), (1, text(1)), (2, text(1)), (3, text(1, 9)), (4, text(2)), (4, text(3)), (5, text(3, 60)), (6, text(4)), (7, ""), (7, "")]
    got = pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    kept = sorted((r.doc_id, r.text[:3]) for r in got)
    assert kept == [(1, "t0w"), (1, "t1w"), (4, "t2w"), (4, "t3w"), (6, "t4w"), (7, ""), (7, "")]


def test_nothing_to_learn_from(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = awkward_docs(spark)
    write_tables(spark, tmp_path, docs, [(1, 1, 0)], [])
    assert pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == docs.count()
    assert pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).count() == docs.count()
    got = pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and got.columns[:3] == ["doc_id", "piece", "start"]
