"""The pipeline's stages against brute force on a small corpus."""

import re
from collections import Counter

import pytest

pytest.importorskip("shellcluster.llm")

from pyspark.sql import functions as F

import corpus_pipeline
from shellcluster.llm import pigeonhole

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    bench = [pigeonhole.normalize(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        seen.append(len(rows))
        texts = Counter(r["text"] for r in rows)
        if name == "n-gram Jaccard join":
            assert max(texts.values()) == 1
        if name == "benchmark decontamination":
            assert not any(b in pigeonhole.normalize(r["text"] or "") for r in rows for b in bench)
        if name == "mixing sources":
            assert max(Counter(r["doc_id"] for r in rows).values()) <= 2
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in docs.collect())
    assert [r["start"] for r in last][1:] == [sum(x["n_tokens"] for x in last[: i + 1]) for i in range(len(last) - 1)]
