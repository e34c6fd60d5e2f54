"""The pipeline's mixing stage on null and repeated ids."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing


def test_null_and_repeated_ids_are_mixed_by_row(spark):
    rnd = random.Random(4)
    text = lambda i: " ".join([f"t{i}", *(f"n{rnd.randrange(300)}" for _ in range(rnd.randint(20, 60)))])
    ids = [None] * 60 + [7] * 60 + list(range(100, 400))
    rows = [(i, text(k), ["a", "b"][k % 2]) for k, i in enumerate(ids)] + [(None, None, "a"), (7, "", "b"), (7, " ", "b"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.mix_to_weights(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter(tuple(r) for r in out.collect())
    assert max(got.values()) <= 2 and set(got) <= set(rows)
    assert [got[r] for r in rows[-4:]] == [1, 1, 1, 1]
    words = lambda rows: sum(n * len((t or "").split()) for (_, t, _), n in rows.items())
    for source in "ab":
        whole = Counter(r for r in rows if r[2] == source)
        taken = Counter({r: n for r, n in got.items() if r[2] == source})
        for some in ([None], [7], range(100, 400)):
            part = lambda c: Counter({r: n for r, n in c.items() if r[0] in some})
            rate = words(taken) / words(whole)
            assert abs(words(part(taken)) / words(part(whole)) - rate) < 0.45
    plan = {r.source_size: r for r in mixing.mix_sources(docs).where("size > 0").collect()}
    for source in "ab":
        whole = words(Counter(r for r in rows if r[2] == source))
        assert words(Counter({r: n for r, n in got.items() if r[2] == source})) == pytest.approx(plan[whole].target, rel=0.02)


def test_columns_may_have_any_names_and_tables_be_empty(spark):
    schema = "doc_id long, text string, source string, _n int, _k int, _id int, `_tidemark_row` int, rep int, `a.b` int"
    rows = [(i, " ".join(f"w{i * j % 91}" for j in range(40)), "ab"[i % 2], 1, 2, 3, 4, 5, i) for i in range(40)]
    docs = spark.createDataFrame(rows, schema)
    for stage in (corpus_pipeline.mix_to_weights, corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows) and out.count() > 0
        none = stage(spark, docs.limit(0), "")
        assert none.columns == docs.columns and none.count() == 0


def test_copies_are_dropped_by_row(spark):
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, "a x"), (2, "a  x"), (2, "b y"), (None, "b y"), (None, "c z"), (None, "c z"), (3, near), (3, near + " more"), (3, None), (4, ""), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_exact_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, "a x"), (2, "b y"), (None, "c z"), (3, near), (3, near + " more"), (3, None), (5, " ")], key=str)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)
    kept_near = [r for r in got if r[1] and r[1].startswith("n0 ")]
    assert len(kept_near) == 1 and kept_near[0][0] == 3
    assert len(got) == 7 and {(1, "a x"), (2, "b y"), (3, None), (4, ""), (5, " ")} <= set(got)
