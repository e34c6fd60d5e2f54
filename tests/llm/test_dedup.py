"""Substring, suffix-array, exact and near dedup against plain versions."""

import random

import brute
import pyarrow as pa
import pytest

from tidemark.llm import exact_dedup, minhash_dedup, repeats, substring_dedup, suffix_dedup


@pytest.mark.parametrize(("many", "batches"), [(256, 3), (1, 1)])
def test_substring(documents, corpus, monkeypatch, many, batches):
    monkeypatch.setattr(repeats, "MANY", many)
    got = substring_dedup.substring_dedup(documents, batches=batches, max_runs=1, with_text=True).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == brute.substring(corpus)
    assert all(brute.sha(r.kept) == r.kept_sha256 for r in got)


@pytest.mark.parametrize("many", [2000, 1])
def test_suffix(documents, corpus, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    got = suffix_dedup.suffix_dedup(documents, with_text=True).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute.suffix(corpus)
    assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 for r in got)


@pytest.mark.parametrize("operator", ["substring", "suffix"])
def test_triggers_with_many_rows_are_salted(documents, corpus, monkeypatch, operator):
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "HOT", 2)
    if operator == "substring":
        got = substring_dedup.substring_dedup(documents).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == brute.substring(corpus)
    else:
        got = suffix_dedup.suffix_dedup(documents).orderBy("doc_id").collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute.suffix(corpus)


def test_texts_of_megabytes(spark):
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(50_000)}"
    long = [word() for _ in range(300_000)]
    texts = [" ".join(long), " ".join(long[1000:90_000]), " ".join(word() for _ in range(100)) + " " + " ".join(long[250_000:250_060]), " ".join(long[::-1][:200])]
    assert len(texts[0]) > 1_700_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.substring_dedup(docs).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == brute.substring(texts)
    short = [t[:600_000] for t in texts]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute.suffix(short)
    five = " ".join([*(word() for _ in range(700_000)), *["again"] * 200_000])
    more = spark.createDataFrame([(1, five), (2, five.replace(" ", "\n")), (3, five + " end")], "doc_id long, text string")
    assert len(five) > 5_000_000
    assert [(r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(more).orderBy("doc_id").collect()] == [(1, 2), (1, 2), (3, 1)]
    assert [r.component_id for r in minhash_dedup.minhash_dedup(more).orderBy("doc_id").collect()] == [1, 1, 1]


def test_shared_ids_are_documents_in_order_of_text(doubled, empty):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(doubled).collect()]
    assert sorted(got, key=str) == sorted([(1, 70, 0), (1, 70, 70), (2, 140, 70), (2, 70, 70), (3, 0, 0), (None, 70, 70), (None, 0, 0)], key=str)
    assert sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(doubled).collect())[-1] == (539, 538)
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_incremental_batches_see_history(spark, documents, corpus, tmp_path):
    folder = f"file://{tmp_path}/index"
    index = substring_dedup.FingerprintIndex(spark, folder, max_runs=2, buckets=3)
    rows = repeats.identified(documents, "doc_id", "text")
    got, fewest = {}, 9
    for k in range(5):
        if k == 2:  # another process goes on with it
            index = substring_dedup.FingerprintIndex(spark, folder, rows.where("doc % 5 < 2").select("doc", "text"), max_runs=2)
            assert index.buckets == 3 and len(index.runs) == 2
        part = index.add(rows.where(f"doc % 5 = {k}")).collect()
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in part}
        fewest = min(fewest, len(index.runs)) if k > 2 else fewest
        assert len(index.runs) <= 3
    assert fewest == 2  # the runs were merged
    order = sorted(range(len(corpus)), key=lambda i: (i % 5, i))
    assert [got[i] for i in order] == brute.substring([corpus[i] for i in order])


def test_runs_stay_where_they_are(spark, documents):
    index = substring_dedup.FingerprintIndex(spark, buckets=3)
    rows = repeats.identified(documents, "doc_id", "text")
    index.add(rows.where("doc < 20"))
    plan = index.known(repeats.phrase_table(rows.where("doc >= 20"), repeats.WORDS).where("g is not null"))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "tidemark_run" in line)
    assert "SortMergeJoin" in plan and "Bucketed: true" in lines[scan]
    assert not any("Exchange" in line for line in lines[:scan]) and plan.count("Exchange hashpartitioning") == 1  # the batch alone is shuffled
    index.add(rows.where("doc >= 20"))
    assert len(index.runs) == 2 and "Exchange" not in index.merged()._jdf.queryExecution().executedPlan().toString()
    before = sorted(map(tuple, index.runs[0].unionAll(index.runs[1]).select("g", "c").collect()))
    index.compact()
    assert sorted(map(tuple, index.runs[0].select("g", "c").collect())) == before and len(index.runs) == 1


def test_exact(documents, corpus, doubled, empty):
    normal = [brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in corpus]
    got = exact_dedup.exact_dedup(documents).orderBy("doc_id").collect()
    for r in got:
        same = [i for i, t in enumerate(normal) if t == normal[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (same[0], len(same), r.doc_id == same[0], brute.sha(normal[r.doc_id]))
    assert len(got) == len(corpus)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(doubled).collect()), key=str) == sorted(
        [(1, 1, 2, True), (1, 1, 2, True), (2, 2, 2, True), (2, 2, 1, True), (None, 2, 2, False), (None, 3, 2, False), (3, 3, 2, True)], key=str
    )
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize(("memory", "many"), [(1, 0), (2000, 1000)])
def test_exact_in_little_memory_and_salted(documents, memory, many):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(exact_dedup.exact_dedup(documents, memory=memory, many=many)) == rows(exact_dedup.exact_dedup(documents))


def test_patricia_keeps_strings_apart():
    trie = exact_dedup.Patricia()
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abcxzz", b"abcxyz"] * 2
    for i, k in enumerate(keys):
        owner = trie.insert(k, i, 1)
    assert (owner.least, owner.rows) == (7, 2) and trie.forks == 1
    owner = trie.insert(b"abc", None, 1)
    assert (owner.least, owner.rows) == (3, 3)
    assert len(list(trie.owners())) == len(set(keys))


@pytest.mark.parametrize("memory", [0, 3000, 1 << 30])
def test_a_partition_shares_one_trie_and_spills_its_finished_subtrees(memory):
    rnd, tries, init = random.Random(3), [], exact_dedup.Patricia.__init__

    def watched(self):
        init(self)
        tries.append(self)

    keys = sorted(b"common " * rnd.randint(0, 2) + bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(400))
    table = pa.Table.from_pylist([{"place": 1, "sha": b"s", "n_bytes": len(k), "rep": i, "least": 400 - i, "rows": 2, "body": k} for i, k in enumerate(keys)])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(exact_dedup.Patricia, "__init__", watched)
        got = [r for b in exact_dedup._owners(memory)(iter(table.to_batches(37))) for r in b.to_pylist()]
    assert sorted(r["rep"] for r in got) == list(range(400))
    for r in got:
        same = [i for i, k in enumerate(keys) if k == keys[r["rep"]]]
        assert (r["keep_id"], r["group_size"]) == (400 - same[-1], 2 * len(same))
    used = [t for t in tries if t.forks]
    assert len(used) == 1 and used[0].forks > 20 and (used[0].spills > 0) == (memory < 1 << 30)


@pytest.mark.parametrize("second", [0, 8])
def test_near(documents, corpus, second):
    want = brute.near(dict(enumerate(corpus)))
    got = {r.doc_id: r for r in minhash_dedup.minhash_dedup(documents, second_pivot=second).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_chains_and_odd_rows(spark, doubled, empty):
    w = [f"c{i}" for i in range(100)]
    chain = {}
    for i in range(8):  # each is near its neighbours, the ends are far apart
        chain[i] = " ".join(w)
        w[i * 7 : i * 7 + 2] = [f"new{i}", f"newer{i}"]
    want = brute.near(chain)
    assert len({c for _, c in want.values()}) < 8
    got = minhash_dedup.minhash_dedup(spark.createDataFrame(list(chain.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    odd = [(r.doc_id, r.component_id) for r in minhash_dedup.minhash_dedup(doubled).collect()]
    assert sorted(odd, key=str) == sorted([(1, 1), (1, 1), (2, 2), (2, 2), (3, 3), (None, 2), (None, None)], key=str)
    assert minhash_dedup.minhash_dedup(empty).count() == 0


def test_a_large_bucket_of_texts_that_are_near_but_not_linked(spark):
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(5000):  # of 118 shingles of the base, each lacks about 18
        at = rnd.randrange(104)
        texts.append(base[:at] + [f"t{i}_{k}" for k in range(16)] + base[at + 16 :])
    linked = {5000 + k: 97 * k for k in range(30)}
    for i in linked.values():
        w = list(texts[i])
        w[0] = w[0] + "x"
        texts.append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash_dedup.minhash_dedup(docs).collect()}
    assert got == {i: linked.get(i, i) for i in range(len(texts))}


def test_components_of_long_paths(spark):
    rnd = random.Random(3)
    names = rnd.sample(range(10_000), 700)
    edges = list(zip(names[:300], names[1:301])) + [(names[400], x) for x in names[401:600]] + list(zip(names[600:], names[601:]))
    rnd.shuffle(edges)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.doc: r.comp for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(40)).collect()}
    assert got == {x: find(x) for x in names if find(x) != x}
    assert minhash_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0
