"""The pipeline's stages on a small corpus, each judged on its own input."""

from __future__ import annotations

import corpus_pipeline as P
from pyspark.sql import functions as F

from pagewright.llm.decontamination import find_contamination
from pagewright.llm.jaccard_join import similar_documents
from pagewright.llm.quality_rules import judge_quality
from pagewright.llm.substring_dedup import drop_repeats

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_rest(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"text_key": F.lit("own"), "kept": F.lit(1)})
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(path := str(tmp_path / name))
        after = spark.read.parquet(path)
        old, new = {r.doc_id: r.text for r in before.collect()}, {}
        if k < 4:
            assert after.columns == columns
            new = {r.doc_id: r.text for r in after.collect()}
        if name == "quality_rules":
            assert set(new) == {r.doc_id for r in judge_quality(before, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
        if name == "near_duplicates":
            assert set(new) == {r.component_id for r in similar_documents(before).collect()}
        if name == "substring_dedup":
            judged = {r.doc_id: r for r in drop_repeats(before, with_text=True).collect()}
            assert new == {d: (t if judged[d].kept_text is None else judged[d].kept_text) for d, t in old.items() if judged[d].kept_text != ""}
        if name == "benchmark_decontamination":
            assert set(new) == {r.doc_id for r in find_contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if not r.contaminated}
        if k == 4:
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == set(old)
        before = after


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_duplicates_keeps_what_nothing_links(spark):
    words = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    alone = [(None, words("a")), (None, words("b")), (None, words("c")), (None, ""), (None, " "), (7, words("d")), (7, words("e")), (7, "")]
    linked = [[(None, words("f")), (None, words("f") + " x")], [(7, words("g")), (8, words("g") + " y")], [(None, words("h")), (9, words("h") + " z")], [(7, words("k")), (7, words("k") + " w")]]
    docs = spark.createDataFrame(alone + sum(linked, []), "doc_id long, text string")
    got = [tuple(r) for r in P.near_duplicates(spark, docs, SF).collect()]
    assert set(alone) <= set(got)
    assert [[r for r in group if r in got] for group in linked[1:3]] == [[linked[1][0]], [linked[2][1]]]
    assert [sum(r in got for r in group) for group in linked] == [1, 1, 1, 1]
    assert len(got) == len(alone) + len(linked)


def test_stages_with_odd_rows(spark):
    """Nulls, repeated rows and the stages' own names as columns: each row keeps its columns, and null and empty texts their defined fate."""
    good = lambda a: " ".join(f"{a}{i} and" for i in range(80)) + "."
    one = 10**6  # ids without labels: the base rule decides
    rows = [(one, good("a"), 1), (one, good("a"), 1), (None, good("b"), 2), (None, None, 3), (one + 5, "", 4), (one + 6, good("c"), 5), (None, good("d"), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _pipeline_key int").withColumns({"_pipeline_id": F.lit("i"), "_pipeline_of": F.lit("o"), "_pipeline_text": F.lit("t")})
    every = lambda df: sorted(map(str, df.collect()))
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and set(every(out)) <= set(every(docs))
        kept = out.select("_pipeline_key").distinct().count()
        assert kept == (4 if name == "quality_rules" else 6)
        assert out.filter("_pipeline_key = 1").count() == (1 if name == "near_duplicates" else 2)
    assert P.STAGES[4][1](spark, docs, SF).count() == 7
