"""The corpus pipeline on a small table whose outcome is worked out by hand."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    words = [a + b for a in "bdfgklmn" for b in ("a", "e", "i", "o", "u")]
    text = lambda k, n=80: " ".join(random.Random(k).choices(words, k=n))
    item = text(500, 30)
    secret = "0123456789abcdef" * 2
    rows = [(i, text(i)) for i in range(20)]
    rows += [(20, text(3)), (21, text(4) + " more"), (22, text(50) + " you idiot . you moron . stupid"), (23, text(60, 20) + " " + item), (24, text(70) + " token = " + secret), (25, None), (26, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i == 22)) for i in range(23)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "secret_scan", "byte_bpe"]
    left, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        left = stage(spark, left, str(tmp_path))
        if k < 4:
            assert left.columns == docs.columns
        kept.append({r.doc_id for r in left.select("doc_id").collect()})
        if k == 3:
            by = {r.doc_id: r for r in left.collect()}
            assert secret not in by[24].text and "<SECRET>" in by[24].text and by[24].n_chars == len(by[24].text) and by[25].text is None
    all_ = {i for i, _ in rows}
    assert kept == [all_ - {22}, all_ - {22, 20, 21}, all_ - {22, 20, 21, 23}, all_ - {22, 20, 21, 23}, all_ - {22, 20, 21, 23}]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == kept[-1]
    assert all(r.n_tokens == len(r.ids) for r in out)


def odd_tables(spark, folder, rows, items=()):
    """Tables with further columns, whose names clash with names inside the operators; the labels are empty."""
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x", [7]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, e_A int, component string, sigs array<int>")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Repeated ids and rows, null ids and texts, further columns, a very long text, no labels and no benchmark; then nothing at all."""
    words = [a + b for a in "bdfgklmn" for b in ("a", "e", "i", "o", "u")]
    text = lambda k, n=80: " ".join(random.Random(k).choices(words, k=n))
    rows = [(1, text(1)), (1, text(1)), (2, text(2)), (2, text(3)), (None, text(4)), (None, None), (5, None), (6, ""), (7, text(7, 60_000)), (8, text(7, 60_000)), (9, "you idiot"), (10, "token = " + "0123456789abcdef" * 2)]
    docs = odd_tables(spark, f"{tmp_path}/a", rows)
    left = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        left = stage(spark, left, f"{tmp_path}/a")
        if k < 4:
            assert left.columns == docs.columns
    want = [(None, 0), (None, 1), (1, 1), (2, 1), (5, 0), (6, 0), (7, 1), (10, 1)]
    got = left.collect()
    assert sorted(((r.doc_id, int(r.n_tokens > 0)) for r in got), key=str) == sorted(want, key=str)
    odd_tables(spark, f"{tmp_path}/b", [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_near_copies_with_maps(spark, tmp_path):
    """Rows that repeat a doc_id and have columns that can't be ordered: one stays, the same however rows are dealt."""
    rows = [(1, "a few words", {"k": j}, [{"x": 1}]) for j in range(4)] + [(2, "other words", None, None), (None, None, {"z": 1}, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>, deep array<map<string,int>>")
    got = [sorted(map(str, corpus_pipeline.drop_near_copies(spark, docs.repartition(n), str(tmp_path)).collect())) for n in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 3
