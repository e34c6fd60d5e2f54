"""Toxicity, importance resampling, quality rules, mixing, PII and pieces."""

import os
import random
import time

import brute
import numpy as np
import pytest

from tidemark.llm import importance, mixing, pieces, pii, quality_rules, toxicity

BAD = ["vileword", "badword", "awfulword"]


def _labelled(spark, n=400):
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        w = [f"n{rnd.randrange(300)}" for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        for _ in range(toxic * rnd.randint(1, 3)):
            w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_held_out_accuracy(spark):
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs, model).join(labels.where("toxic is not null"), "doc_id").where(toxicity.held_out()).collect()
    assert len(got) > 40 and all((r.score >= 0.5) == bool(r.toxic) for r in got)
    assert all((len(r.passages) > 0) == bool(r.toxic) for r in got)
    assert toxicity.clean(docs, model).count() == 300
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "badword"), (2, "n1 " * 5000 + "vileword")], "doc_id long, text string")
    scores = {(r.doc_id, i): r.score for i, r in enumerate(toxicity.score(odd, model).collect())}
    assert all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score(odd.limit(0), model).count() == 0
    alone = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(odd, alone).where("score between 0 and 1").count() == 4


def test_toxicity_scores_equal_a_plain_version(spark):
    docs, labels = _labelled(spark, 160)
    texts, of = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.where("doc_id is not null and toxic is not null").collect()}
    model = toxicity.fit(docs, labels.where("doc_id < 120"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = brute.toxicity([(texts[i], of[i]) for i in sorted(of) if i < 120], [texts[i] for i in sorted(texts)])
    assert [got[i] for i in sorted(texts)] == pytest.approx(want, abs=1e-6)
    assert len(model.keys) > 3 and len({round(x, 3) for x in want}) > 3
    both = labels.unionAll(spark.createDataFrame([(1, 1), (4, 0)], labels.schema))  # an id with both labels is toxic
    again = [toxicity.fit(docs, both.repartition(n)) for n in (1, 3)]
    assert (again[0].scores == again[1].scores).all() and again[0].bias == again[1].bias


def test_segments_are_all_maximal_ones():
    rnd = random.Random(2)

    def maximal(s):
        """By definition: the best, earliest, shortest segment; then the same to its left and right."""
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
        if best[0] <= 1e-9:
            return []
        i, j = best[3:]
        return maximal(s[:i]) + [(i, j - 1, best[0])] + [(a + j, b + j, v) for a, b, v in maximal(s[j:])]

    for _ in range(200):
        s = [rnd.choice([-1.0, 2.0, 3.5, -2.5]) for _ in range(rnd.randint(1, 10))]
        at = np.array([i for i, x in enumerate(s) if x != -1.0], int)
        got = toxicity.segments(at, np.array([s[i] for i in at]), -1.0)
        assert sum(v for *_, v in got) == pytest.approx(sum(v for *_, v in maximal(s)))


def test_importance(spark, empty):
    rnd = random.Random(4)
    good = [" ".join(f"g{rnd.randrange(50)}" for _ in range(40)) for _ in range(200)]
    junk = ["### $$$ " * 20 + f"j{i}" for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    target = spark.createDataFrame([(t,) for t in good[:80]], "text string")
    got = importance.importance_sample(docs, target, 0.8).collect()
    assert sum(r.kept for r in got) == 200 and all(r.kept == (r.doc_id < 200) for r in got)
    again = importance.importance_sample(docs, target, 0.8).collect()
    assert {r.doc_id: r.log_weight for r in got} == pytest.approx({r.doc_id: r.log_weight for r in again})
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert [r.log_weight for r in importance.importance_sample(odd, target, 1.0).collect()] == [0, 0, 0]
    assert importance.importance_sample(empty, target, 0.5).count() == 0


def test_importance_weights_equal_a_plain_version(spark):
    rnd = random.Random(7)
    raw = [" ".join(rnd.choice(["alpha", "beta", "gamma", "x1", "...", "a a a", "end.\n"]) for _ in range(rnd.randint(0, 30))) for _ in range(60)] + [""]
    target = raw[:15]
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string")
    got = importance.importance_sample(docs, spark.createDataFrame([(t,) for t in target], "text string"), 0.5, strength=4.0).collect()
    want = brute.importance(raw, target, importance.BUCKETS, importance.PRIOR, 4.0)
    assert [r.log_weight for r in sorted(got, key=lambda r: r.doc_id)] == pytest.approx(want)


def test_inclusion_follows_the_weights(spark):
    from pyspark.sql import functions as F

    weights = [0.0, 1.0, 2.5]
    keys = spark.range(6000).select("id", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("doc"), F.lit(w).alias("w")) for i, w in enumerate(weights)))).alias("d"))
    first = keys.groupBy("id").agg(F.max_by("d.doc", F.col("d.w") + importance.gumbel(F.col("d.doc"), F.col("id"))).alias("doc")).groupBy("doc").count().collect()
    got, total = {r.doc: r["count"] / 6000 for r in first}, sum(np.exp(weights))
    assert all(abs(got[i] - np.exp(w) / total) < 0.02 for i, w in enumerate(weights))


def test_a_hashed_sample_is_bounded_and_repeats(spark):
    from tidemark.llm.common import hashed_sample

    rows = spark.range(100_000).withColumnRenamed("id", "k")
    got = [r.k for r in hashed_sample(rows, "k", 500).collect()]
    assert len(set(got)) == 500 and got == [r.k for r in hashed_sample(rows.repartition(7), "k", 500).collect()]
    assert hashed_sample(rows.limit(30), "k", 500).count() == 30


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_threshold_is_the_kth_key(spark, k):
    rnd = random.Random(k)
    keys = [rnd.gauss(0, 1) ** 3 for _ in range(990)] + [1.5] * 10
    df = spark.createDataFrame([(x,) for x in keys], "key double")
    assert importance.threshold(df, k, few=20) == sorted(keys, reverse=True)[k - 1]


def test_quality_counts_and_outliers(spark, documents, corpus, doubled, empty):
    got = quality_rules.quality_rules(documents).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [brute.quality(t) for t in corpus]
    lines = ["a b\na b\n\n a b\r\na b", "x#y*z |\n\nx#y*z |", "1 2 3 4 5 6 1 2 3 4 5", "z " * 9]
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(lines)], "doc_id long, text string, lang string, source string")
    got = quality_rules.quality_rules(table).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [brute.quality(t) for t in lines]
    rnd = random.Random(8)
    clean = [" ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(20, 300))) + "." for _ in range(300)]
    junk = [" ".join(f"$$${rnd.randrange(10**6)}###" for _ in range(100)) for _ in range(20)]
    table = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    got = quality_rules.quality_rules(table).collect()
    assert all(r.kept == (r.doc_id < 300) for r in got)
    assert quality_rules.quality_rules(doubled).count() == 7 and quality_rules.quality_rules(empty).count() == 0


def test_mcd_equals_a_plain_version(spark):
    rnd, names = np.random.default_rng(7), list(quality_rules.FEATURES)
    shape = rnd.normal(size=(6, 6)) * 0.4
    groups = {}
    for g, n in {("en", "a"): 300, ("en", None): 7, ("de", "a"): 120, (None, "b"): 1}.items():
        x = rnd.normal(size=(n, 6)) @ shape + (1.0 if g[0] == "de" else 0.0)
        x[: n // 8] += 9
        groups[g] = x
    key = lambda v: "" if v is None else "=" + v
    rows = spark.createDataFrame([(key(la), key(so), *map(float, r)) for (la, so), x in groups.items() for r in x], "lk string, sk string, " + ", ".join(f"{n} double" for n in names))
    got = {(r.lk, r.sk): r for r in quality_rules.estimate(rows).collect()}
    assert len(got) == 4
    quartiles = {}
    for g, x in groups.items():
        o = np.sort(x, axis=0)
        quartiles[g] = [o[max(0, int(np.ceil(p * len(x))) - 1)] for p in (0.25, 0.5, 0.75)]
    want = brute.mcd(groups, 0.75, 10, 1e-3, quality_rules.FLOOR, quality_rules.PRIOR, quality_rules.BINS, quartiles)
    for (la, so), (mu, s) in want.items():
        r = got[key(la), key(so)]
        assert r.n == len(groups[la, so]) and np.allclose(r.mu, mu, atol=1e-6)
        assert np.allclose(np.linalg.inv(np.array(r.p).reshape(6, 6)), s, atol=1e-6)
    clean = want["en", "a"]
    assert np.abs(clean[0]).max() < 0.35  # the shifted eighth has no part in it
    assert quality_rules.consistency(np.array([0.999999]))[0] == pytest.approx(1, abs=1e-3)


def test_apportionment_is_by_highest_quotients():
    rnd = random.Random(6)
    for _ in range(50):
        votes = [rnd.randint(0, 100) / 2 for _ in range(rnd.randint(1, 8))]
        caps = [rnd.randint(0, 9) for _ in votes]
        seats = rnd.randint(0, 30)
        got = mixing.sainte_lague(votes, seats, caps)
        want = [0] * len(votes)
        for _ in range(min(seats, sum(caps)) if sum(votes) else 0):
            open_ = [i for i in range(len(votes)) if want[i] < caps[i]]
            want[min(open_, key=lambda i: (-votes[i] / (2 * want[i] + 1), i))] += 1
        assert got == want
    assert mixing.water_fill([10, 100, 100], [5, 2, 1], 315) == pytest.approx([20, 590 / 3, 295 / 3])


def test_mixing(spark, documents, corpus, doubled, empty):
    got = mixing.mix_sources(documents).collect()
    size = {i: len(brute.words(t)) for i, t in enumerate(corpus)}
    assert {r.doc_id: r.size for r in got} == size
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r.source_size, [r.target, 0])
        t[1] += r.taken
    assert sum(t for t, _ in by.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken - target) <= 0.05 * target for target, taken in by.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(documents.repartition(2)).collect()))
    assert mixing.mix_sources(doubled).count() == 7 and mixing.mix_sources(empty).count() == 0
    sources = {r.doc_id: r.source for r in documents.collect()}
    assert {r.doc_id: r.taken for r in got} == brute.mixed([(i, sources[i], t) for i, t in enumerate(corpus)])
    rnd = random.Random(5)
    more = [(i, rnd.choice(["x", "y", "z", None]), " ".join(["w"] * rnd.choice([0, 1, 30, 400, 5000]))) for i in range(200)]
    table = spark.createDataFrame(more, "doc_id long, source string, text string")
    assert {r.doc_id: r.taken for r in mixing.mix_sources(table).collect()} == brute.mixed(more)
    sharded = mixing.mix_sources(table, shard_words=50_000).collect()
    assert sum(r.taken for r in sharded) == pytest.approx(1.5 * sum(r.size for r in sharded), rel=0.03) and all(r.taken <= 2 * r.size for r in sharded)
    assert sorted(map(tuple, mixing.mix_sources(table, shard_words=50_000, most_broadcast=0).collect())) == sorted(map(tuple, sharded))
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns and mixed.groupBy("doc_id").count().where("count > 2").count() == 0


def test_pii(spark, empty):
    lines = [
        "a@b.c", "x a.b@c-d.e.f. 1.2.3.4.5 999.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112 +1 (222) 333-4444 +1-", "é" * 5 + " a@b@c.d 0001.255.256.1 00255.1.1.1",
        "", None, "+12 3", "++44 20 7946 0958.", "joe [at] site [dot] com", "a@" + "b." * 3000 + "c", "1" * 3000, "4" * 16, "日本 joe@site.org 4111111111111111", "card: 4111.1111.1111.1111 x",
    ]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = pii.find_pii(docs)
    for r in found.collect():
        assert [f"{pii.KINDS[s.k]}:{s.s}:{s.e}" for s in r.base] == brute.pii(lines[r.doc_id])
        assert not any(a.s < b.e and b.s < a.e for a in r.base for b in r.extra)
    clear = {r.doc_id: r.text for r in pii.redact(docs, found).collect()}
    assert clear[11] == "日本 [email] [card]" and clear[3] == clear[4] == ""
    assert pii.find_pii(empty).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "the", "of", "as", "and"]) for _ in range(60)),) for _ in range(1500)], "text string")
    return pii.train(docs)


def test_pii_extras_on_items_the_model_has_not_seen(spark, model):
    for kind, (recall, precision, n) in model.held_out.items():
        assert n > 50 and recall >= 0.9 and precision >= 0.95, (kind, model.held_out)
    rnd = random.Random(99)
    contexts = [" ".join(rnd.choice(["we", "met", "him", "in", "town", "two", "days", "ago", "it", "was"]) for _ in range(40)) for _ in range(500)]
    items = pii.planted(contexts, copies=2, seed=77)
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame([(i, t) for i, _, t, *_ in items], "doc_id long, text string"), model=model).collect()}
    right, extras, wrong, good_items, only_extra = 0, 0, 0, 0, 0
    for i, _, text, k, s, e, good in items:
        base = {(b.k, b.s, b.e) for b in found[i].base}
        assert [f"{pii.KINDS[a]}:{b}:{c}" for a, b, c in sorted(base)] == sorted(brute.pii(text), key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))
        hit = lambda x: x[0] == k and 10 * (min(x[2], e) - max(x[1], s)) >= 9 * (max(x[2], e) - min(x[1], s))
        more = [(x.k, x.s, x.e) for x in found[i].extra]
        assert all(a[2] <= b[1] for a, b in zip(more, more[1:])) and not any(x[1] < b[2] and b[1] < x[2] for x in more for b in base)
        extras += len(more)
        wrong += sum(not (good and hit(x)) for x in more)
        good_items += good
        right += good and any(hit(x) for x in [*base, *more])
        only_extra += good and any(hit(x) for x in more)
    assert only_extra > 150 and right >= 0.9 * good_items and wrong <= 0.05 * extras


def test_pii_is_linear_in_long_runs(spark, model):
    lines = ["a" * 1_000_000 + " x@y.org", "1" * 1_000_000 + " 1.2.3.4", "x@" + "y." * 500_000 + "z", "1 " * 500_000, "a@b.c " * 5_000, "+1" + "(" * 1_000_000, "4111-1111-1111-1111 " * 5_000]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: [f"{pii.KINDS[x.k]}:{x.s}:{x.e}" for x in r.base] for r in pii.find_pii(docs, model=model).collect()}
    assert time.monotonic() - began < 100
    assert got[0] == ["email:1000001:1000008"] and got[1] == ["ip:1000001:1000008"] and got[2] == [f"email:0:{len(lines[2])}"]
    assert got[3] == [] and got[5] == [] and len(got[4]) == 5000
    assert got[6] == brute.pii(lines[6])


def test_boosting_learns_an_interaction():
    x = np.array([[a, b] for a in range(2) for b in range(2)])
    _, p = pii.boost(x, np.array([40.0, 0, 0, 30]), np.array([0, 50.0, 45, 0]), rounds=60)
    assert (p > 0.5).tolist() == [True, False, False, True]


@pytest.fixture(scope="session")
def toy():
    names = ["a", "b", "ab", "abc", " ", " a", " ab", "  ", "é", "éa", "日"]
    table = {t.encode(): (i + 256, -1.0 - (i * 37 % 11) / 3) for i, t in enumerate(names)}
    return pieces.Pieces.of(table, np.arange(256, dtype=np.int32), [bytes([i]) for i in range(256)] + [t.encode() for t in names])


def _best(text, model):
    score = [0.0] + [-np.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            got = model.table.get(text[s:e].encode())
            cost = got[1] if got else model.unknown if e - s == 1 else None
            if cost is not None:
                score[e] = max(score[e], score[s] + cost)
    return score[-1]


def _cost(ids, model):
    known = {i: s for i, s in model.table.values()}
    return sum(known[i] if i >= 256 else model.unknown * ((i & 0xC0) != 0x80) for i in ids)


def test_pieces_are_the_best_segmentation(toy):
    rnd, encoder = random.Random(9), pieces.Encoder(toy)
    for _ in range(150):
        text = "".join(rnd.choice("aabbc é日▁x\n") for _ in range(rnd.randint(0, 60)))
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, _ = encoder.encode(raw, np.array([0, len(raw)]))
        want = _best(" " + text, toy) if text else 0
        assert _cost(ids.tolist(), toy) == pytest.approx(want)
        stream, out = pieces.StreamingViterbi(toy), []
        data = (" " + text).encode() if text else b""
        for i in range(0, len(data), 5):
            out += stream.feed(data[i : i + 5], last=False)
        out += stream.feed(b"")
        assert _cost(out, toy) == pytest.approx(want)


def test_streaming_commits_early(toy):
    stream, most = pieces.StreamingViterbi(toy), 0
    for _ in range(2000):
        stream.feed(b"ab c", last=False)
        most = max(most, len(stream.text))
    assert most < 100


needs_model = pytest.mark.skipif(not os.path.exists(pieces.DEFAULT_MODEL), reason="needs the vocabulary file")


@needs_model
def test_ids_are_those_of_the_library():
    import sentencepiece

    sp, encoder = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL), pieces.Encoder(pieces.Pieces.read(pieces.DEFAULT_MODEL))
    rnd = random.Random(3)
    lines = ["", " ", "  two  spaces   ", "tabs\tand\nlines\n\n", "größer naïve façade", "日本語のテキスト", "emoji 😀😀 end", "aaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "(" * 50 + ")" * 31, "0123456789" * 30, "https://a.example.com/x?y=1&z=2"]
    lines += ["".join(rnd.choice("etaoinshrdlu  ,.éü\n0") for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    for line in lines:
        raw = np.frombuffer(line.encode(), np.uint8)
        ids, _ = encoder.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == sp.encode(line), line


@needs_model
def test_a_text_of_megabytes_keeps_a_small_window():
    model, rnd, most, out = pieces.Pieces.read(pieces.DEFAULT_MODEL), random.Random(4), 0, []
    part = "".join(rnd.choice("etaoinshrdlu") for _ in range(5000)).encode()
    stream = pieces.StreamingViterbi(model)
    for i in range(0, 300_000, 1000):
        out += stream.feed(part[i % 5000 : i % 5000 + 1000], last=False)
        most = max(most, len(stream.text))
    out += stream.feed(b"")
    assert most < 2000 and b"".join(model.by_id[i] for i in out) == part * 60
    encoder = pieces.Encoder(model)
    text = np.frombuffer(((" " + part.decode()[:40]) * 125_000).encode(), np.uint8)
    ids, bounds = encoder.encode(text, np.array([0, len(text)]))
    back, _ = encoder.decode(ids, bounds)
    assert len(text) > 5_000_000 and back.tobytes() == text.tobytes()


def test_round_trip(spark, toy, documents, corpus, empty):
    got = pieces.encode(documents, toy)
    assert got.where("not round_trip").count() == 0 and got.count() == len(corpus)
    back = {r.doc_id: r.text for r in pieces.decode(got, toy).collect()}
    assert back == {i: t or "" for i, t in enumerate(corpus)}
    assert pieces.encode(empty, toy).count() == 0
