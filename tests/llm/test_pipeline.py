"""The pipeline's stages, each against a plain version on what the one before it kept."""

import os
import random
from collections import Counter

import brute
import pytest

import corpus_pipeline
from tidemark.llm import mixing, pieces, registry

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.DEFAULT_MODEL), reason="needs the vocabulary file")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder, rnd = str(tmp_path_factory.mktemp("sf")), random.Random(12)
    word = lambda: f"n{rnd.randrange(500)}"
    texts = [" ".join(word() for _ in range(rnd.randint(15, 60))) for _ in range(260)]
    for i in range(0, 260, 4):
        texts[i] += " vileword"
    base = " ".join(word() for _ in range(80))
    texts += [base, base.replace(" ", "  "), base + " extra", base, None, "", "one"]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "mixing", "pieces"]
    columns, kept = docs.columns, {"": docs}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        step(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "pieces" or docs.columns == columns
    rows = {n: [(r.doc_id, r.text) for r in d.collect()] for n, d in kept.items() if n != "pieces"}
    assert sorted(rows["toxicity"], key=str) == sorted(((i, t) for i, t in rows[""] if "vileword" not in (t or "")), key=str)
    first = {}
    for i, t in sorted(rows["toxicity"]):
        first.setdefault(brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    assert sorted(rows["exact_dedup"], key=str) == sorted(first.values(), key=str)
    near = brute.near(dict(rows["exact_dedup"]))
    assert sorted(i for i, _ in rows["minhash_dedup"]) == sorted(i for i, (_, c) in near.items() if i == c)
    plan = {r.doc_id: r for r in mixing.mix_sources(kept["minhash_dedup"]).collect()}
    times = Counter(i for i, _ in rows["mixing"])
    for i, r in plan.items():
        share = r.taken / r.size if r.size else 1
        assert int(share) <= times[i] <= -(-share // 1)
    assert abs(sum(times[i] * r.size for i, r in plan.items()) - sum(r.taken for r in plan.values())) < 0.1 * sum(r.taken for r in plan.values())
    assert Counter(r.doc_id for r in docs.collect()) == times and docs.where("not round_trip").count() == 0


def test_run_equals_the_stages_and_all_queries_are_registered(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("round_trip").count() > 100
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
