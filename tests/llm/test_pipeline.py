import corpus_pipeline as pipeline
from servelog.llm import mixing, surrogates, toxicity
from servelog.llm.queries import toxicity_model
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    before = docs
    for name, stage in pipeline.STAGES:
        after = pipeline.cut(stage(spark, before, SF))
        rows = after.collect()
        if name != "packing":
            assert after.columns == columns
        if name == "toxicity":
            model = toxicity_model(docs, spark, SF)
            scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
            assert {r.doc_id for r in rows} == {i for i, s in scores.items() if s < pipeline.TOXIC}
        elif name == "near_duplicates":
            want = brute.near_documents({r.doc_id: r.text for r in before.collect()})
            assert sorted(r.doc_id for r in rows) == sorted({c for _, c in want.values()})
        elif name == "pii":
            assert len(rows) == before.count()
            for r in rows:
                new = surrogates.rewrite(texts[r.doc_id], surrogates._epoch(surrogates.KEY, 0))[0]
                assert r.text == new and (r.n_chars == len(new) or new == texts[r.doc_id])
        elif name == "mixing":
            taken = {r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken}
            words = {}
            for r in rows:
                words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
            assert words == taken
        else:
            assert sum(r.start == 0 for r in rows) == before.count()
        before = after
    assert sorted(map(str, pipeline.run(spark, SF).collect())) == sorted(map(str, rows))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", None, None), (1, None, "en", None, None), (None, "", None, "s", 0), (2, "a b c", "en", "s", 5),
            (2, "a b c", "en", "s", 5), (3, "mail me at x.y@example.org now", "en", None, 30)]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    model = [(n, f) for n, f in pipeline.STAGES if n != "toxicity"]
    before = docs
    for _, stage in model:
        before = pipeline.cut(stage(spark, before, sf))
    assert {r.doc_id for r in before.collect()} <= {2, 3} and before.count() > 0
    empty = docs.where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
