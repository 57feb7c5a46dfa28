"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from lucidoc.llm import quality_rules

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicate removal", "benchmark decontamination", "secret scan", "packing"]
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        got = Counter(r.doc_id for r in out.collect())
        if k == 0:
            want = [d for d, t in rows if quality_rules.verdict(quality_rules.TextView(t), list(quality_rules.RULES))]
        elif k == 1:
            want = [d for (d, _), (n, c) in zip(rows, brute.components(rows, 5, 80)) if not n or d == c]
        elif k == 2:
            want = [d for d, t in rows if not brute.contamination(t, items)[3]]
        else:
            want = [d for d, _ in rows]
        if k < 4:
            assert got == Counter(want) and out.columns == columns
            docs = out
            rows = [(r.doc_id, r.text) for r in out.collect()]
        else:
            assert set(got) == set(want)
        if k == 3:
            assert not any(brute.secrets(t) for _, t in rows)
    assert sum(r.length for r in corpus_pipeline.run(spark, SF).collect()) == sum(r.length for r in out.collect())


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    near = text.replace("w40", "edit")
    rows = [(3, text), (3, text), (2, near), (2, near), (5, "other words " * 30), (7, None), (7, None), (8, ""), (None, text)]
    from lucidoc.llm import near_dup

    docs = brute.frame(spark, rows).withColumn("gone_id", F.lit(1)).withColumn("GONE_H", F.lit("x"))
    left = near_dup.deduplicated(docs)
    assert left.schema == docs.schema
    assert Counter(repr(r.doc_id) for r in left.collect()) == Counter(map(repr, [2, 5, 7, 7, 8]))
