"""The corpus pipeline on the smallest tables: every stage keeps its contract."""

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        counts.append(docs.count())
        if name != "pack":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_near_dedup_keeps_rows_without_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (2, text(1)), (3, text(2)), (None, text(3)), (None, text(4)), (None, text(4)), (None, text(2)), (None, text(5)), (None, text(5) + " more"), (None, None), (None, ""), (4, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    found = [(r["doc_id"], r["text"]) for r in out.collect()]
    last = [t for d, t in found if t and t.startswith("w5x0")]
    assert len(last) == 1 and last[0] in (text(5), text(5) + " more")
    want = [(1, text(1)), (3, text(2)), (4, None), (None, text(3)), (None, text(4)), (None, None), (None, "")]
    assert sorted(map(str, found)) == sorted(map(str, [*want, (None, last[0])]))


def test_near_dedup_keeps_one_row_for_an_id_and_text(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1), "en"), (1, text(1), None), (1, text(1), "en"), (2, text(2), "en"), (3, text(2), "en"), (3, text(2), "en"), (4, None, "en"), (4, None, "en"), (5, text(5), "en"), (5, text(6), "en")]
    docs = spark.createDataFrame([(d, t, lang, "s", 1) for d, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert found == sorted([(1, text(1)), (2, text(2)), (4, None), (5, text(5)), (5, text(6))], key=str)
