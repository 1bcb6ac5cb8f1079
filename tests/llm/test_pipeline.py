from pyspark.sql import functions as F

import corpus_pipeline
from verdigraph.llm import decontaminate, mixing, simhash, surrogates, toxicity

SF = "/root/testdata/sf0.001"


def test_every_stage_does_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, SF).cache()
        rows = {r.doc_id: r for r in after.collect()}
        assert after.count() == len(rows)
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.digest(docs, labels).collect() if r.predicted == 0}
        elif name == "near_duplicates":
            want = {r.component_id for r in simhash.digest(docs).collect()}
        elif name == "decontamination":
            want = {r.doc_id for r in decontaminate.digest(docs, benchmark).collect() if not r.contaminated}
        else:
            want = set(before)
        assert set(rows) == want
        if name == "personal_data":
            assert {i: r.text for i, r in rows.items()} == {r.doc_id: r.text for r in surrogates.digest(docs).collect()}
            assert any(r.text != before[i].text for i, r in rows.items())
        elif name == "mixing":
            assert sorted(after.collect()) == sorted(mixing.mixed(docs).collect())
            assert abs(sum(r.taken for r in rows.values()) / (1.5 * sum(r.size for r in rows.values())) - 1) < 0.02
        else:
            assert all(r == before[i] for i, r in rows.items())
        if name != "mixing":
            assert after.columns == columns
        docs = after
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(docs.collect())


def test_odd_rows_and_empty_tables(spark, tmp_path):
    prose = "One quiet river and a long garden walk make a letter that nobody has written before, number {} of many."
    rows = [(i, prose.format(i) + f" Mail the.{i}@mail.example.com now.", "en", "s1", 9) for i in range(12)]
    rows += [(3, rows[3][1], "en", "s1", 9), (50, None, None, None, None), (51, "", "en", None, 0), (None, "A text without an id by Mary Jones.", None, "s2", 1), (52, "word " * 30_000, "en", "s2", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    for name, docs in (("odd", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        df = spark.createDataFrame(docs, names)
        for c in ("toxic", "score", "digest", "size", "hit_ranges"):
            df = df.withColumn(c, F.lit("clash"))
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        ids = [r.doc_id for r in got]
        if name == "none":
            assert got == []
        else:
            assert {None, 50, 52} <= set(ids) and ids.count(3) <= 1 and len(ids) == len(set(ids))
            assert all(0 <= r.taken <= 2 * r.size for r in got)
