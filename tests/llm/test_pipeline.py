"""The pipeline over a given table, stage by stage, and the registry."""

import os

from edge_cases import P3, documents, table, with_clashes
from pyspark.sql import functions as F


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.count())
    assert seen[1] > 0.9 * seen[0] and seen[2] < seen[1] and seen[3] <= seen[2] and seen[5] == seen[4] > 0
    total = docs.selectExpr("sum(n_tokens) as n", "max(start + n_tokens) as stop").first()
    assert total.n == total.stop
    assert corpus_pipeline.run(spark, sf).count() == seen[5]


def test_pipeline_stages_with_awkward_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for rows in (documents(), []):
        docs = with_clashes(table(spark, rows))
        left = {r[:2] for r in rows}
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert k == 4 or out.columns == docs.columns
            got = [(r.doc_id, getattr(r, "text", None)) for r in out.collect()]
            if name == "language_id":
                # what has letters stays, whether it has a number or not
                assert set(got) == {(i, t) for i, t, *_ in rows if t and any(map(str.isalpha, t))}
                assert not rows or (None, P3 + " oh") in got
            elif name == "near_duplicates":
                assert len(got) == len(set(got)) and (not rows or {i for i, _ in got} == {1, 4, 6, 11, 13, 15, 16})
            assert k == 4 or set(got) <= left
            left = set(got)
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_the_network_decides_in_the_first_stage(spark):
    from readlens.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.train(docs)
    least = langid.rejection_score(docs, net)
    assert 0.25 < least < 1
    # mostly noise: letters are there, but no learned language scores high
    noise = docs.limit(5).select(F.lit(1).cast("long").alias("doc_id"), F.lit("ẞ " + "\u4e00\u0416\u05d0 \x01" * 500).alias("text"), "lang", "source", "n_chars")
    low = langid.identify(noise, net).select("language.score").first()[0]
    kept = langid.keep_identified(docs.unionByName(noise), net, least)
    clean = docs.where("text rlike '[A-Za-z]'").count()
    assert kept.where("doc_id <> 1 or text not like '%\u4e00%'").count() >= 0.995 * clean
    assert (low >= least) == (kept.where("text like '%\u4e00%'").count() > 0)
    assert langid.rejection_score(docs.limit(0), net) == 0.0


def test_a_run_leaves_only_its_result(spark):
    import corpus_pipeline
    from readlens.plans.materialize import checkpoint_dir

    base = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(os.listdir(base)) - before
    # the last stage's rows, and no checkpoint or file of the stages before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-token_ids-")
    assert out.count() > 0


def test_registry_is_complete():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
