"""The pipeline's stages against brute force, and registered queries against SQL, on the smallest tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck
from ridgewater.llm import cotraining
from test_operators import brute_components, brute_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", ["op2_mix_sources", "op10_exact_dedup"])
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, function in corpus_pipeline.STAGES:
        before = docs.collect()
        out = function(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = [tuple(r)[:2] for r in before]
        if name == "quality":
            kept = {r.doc_id for r in docs.collect()}
            assert sum((d in kept) == bool(q) for d, q in labels.items()) / len(labels) > 0.9
        elif name == "exact_dedup":
            assert {r.doc_id for r in docs.collect()} == {i for i, g in brute_groups(rows).items() if g[2]}
        elif name == "near_dedup":
            assert {r.doc_id for r in docs.collect()} == {i for i, c in brute_components(rows, corpus_pipeline.NEAR)[1].items() if i == c}
        elif name == "packing":
            assert {r.doc_id for r in docs.collect()} == {r[0] for r in rows}
        if name != "packing":
            assert set(docs.columns) == set(before[0].__fields__)
        seen.append(docs.count())
    assert len(corpus_pipeline.STAGES) == 5 and all(seen)


def test_near_stage_takes_pairs_from_four_fifths(spark):
    """Every second document is a copy with a similarity in [0.80, 0.85); those below 0.80 stay."""
    rows, gone, likes = [], set(), []
    for i in range(120):
        words = [f"d{i}w{j}" for j in range(304)]
        changed = list(words)
        for j in range(8, 8 + 8 * (5 + i % 3), 8):
            changed[j] = f"x{j}"
        sets = [{tuple(w[j : j + 5]) for j in range(300)} for w in (words, changed)]
        likes.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        if likes[-1] >= 0.8:
            gone.add(1000 + i)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(changed))]
    assert sum(0.8 <= x < 0.85 for x in likes) >= 80 and min(likes) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r[0] for r in rows} - {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()} == gone


def test_stages_take_any_column_names(spark, monkeypatch):
    """Columns named like the stages' own, in any case, come through as they were."""
    none = cotraining.Line(np.zeros(1), 0.0)
    monkeypatch.setattr(cotraining, "train", lambda docs, labels: cotraining.Model(none, none, none, none, none, 1.0))
    names = ["__id", "__DIGEST", "__row", "__words", "__text", "__score", "_wanted", "view", "label", "key"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(30)
    kinds = docs.columns
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF)
        assert out.columns == [*kinds, *names]
        rows = out.select("doc_id", *names).distinct().collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)
