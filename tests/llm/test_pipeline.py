import corpus_pipeline
from meterbook.llm import bpe, decontaminate, neardup, quality

FOLDER = "/root/testdata/sf0.001"


def test_stages_decide_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, tests = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, FOLDER).cache()
    scores = quality.score(docs, quality.fit(docs, labels))
    assert ids(good) == ids(scores.filter(f"score >= {quality.THRESHOLD}")) and good.columns == docs.columns
    single = stages["near duplicates"](spark, good, FOLDER).cache()
    assert ids(single) == ids(neardup.near_duplicates(good).filter("kept"))
    clean = stages["benchmark decontamination"](spark, single, FOLDER).cache()
    assert ids(clean) == ids(decontaminate.contamination(single, tests).filter("size(items) = 0"))
    private = stages["surrogates"](spark, clean, FOLDER).cache()
    assert ids(private) == ids(clean) and private.columns == docs.columns
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert sorted(out) == ids(private)
    with open(corpus_pipeline.TOKENIZER, encoding="utf-8") as f:
        own = bpe.Bpe(f.read())
    assert all(own.decode(list(out[r.doc_id].ids)) == r.text for r in private.collect())


def test_awkward_rows_go_through_every_stage(spark, tmp_path):
    good = "Mr Smith wrote to ann@x.com about the long history of the old harbour town and its many ships."
    leak = "one two three four five six seven eight nine ten eleven"
    rows = [(1, good), (2, good), (2, good), (None, good), (None, None), (3, None), (4, ""), (5, leak), (6, "x"), (7, "é 日本 " * 4000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, entities string, kept string, found string"
    full = [(i, t, None, "s", None if t is None else len(t), 0.1, "e", "k", "f") for i, t in rows]
    spark.createDataFrame(full, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 1), (7, 1), (None, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((r.doc_id for r in out), key=lambda i: -1 if i is None else i)
    assert ids == [None, None, 1, 3, 4, 6, 7]
    by_id = {r.doc_id: r for r in out}
    assert by_id[3].n_tokens == by_id[4].n_tokens == 0 and by_id[7].n_tokens > 10_000
    for table in ("labels", "benchmark", "documents"):
        empty = spark.read.parquet(str(tmp_path / f"{table}.parquet")).limit(0)
        folder = tmp_path / f"no-{table}"
        folder.mkdir()
        for other in ("labels", "benchmark", "documents"):
            frame = empty if other == table else spark.read.parquet(str(tmp_path / f"{other}.parquet"))
            frame.write.parquet(str(folder / f"{other}.parquet"))
        n = corpus_pipeline.run(spark, str(folder)).count()
        assert n == {"labels": 0, "benchmark": 8, "documents": 0}[table]
