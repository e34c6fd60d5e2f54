"""The pipeline's near-dedup stage against a plain version of its rule: five words, similarity 0.8."""

import random

import brute

import corpus_pipeline


def _shingles(text):
    w = brute.words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_stage_links_at_five_words(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: f"n{rnd.randrange(100000)}"
    texts = []
    for i in range(12):
        base = [word() for _ in range(100)]
        texts += [" ".join(base), " ".join(base + [word() for _ in range(14 + i)])]
        for changes in (1, 2, 3):
            w = list(base)
            for k in rnd.sample(range(100), changes):
                w[k] = word()
            texts.append(" ".join(w))
    texts += ["a b c", "a b c", "", None]
    sets, group = [_shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    assert len(_shingles(texts[0]) & _shingles(texts[1])) == 96
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [i for i, g in enumerate(group) if i == g]
