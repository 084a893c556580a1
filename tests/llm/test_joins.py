import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from invoicelake.llm import set_join, vector_join
from invoicelake.llm.common import Scratch, hot_keys, salted_join
from invoicelake.llm.components import components
from invoicelake.llm.partenum import signatures, sketch, folded
from invoicelake.llm.shingles import mix

PERCENT = [80, 85, 95]


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def classes(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("percent", PERCENT)
def test_similar_sets_share_a_signature_and_sketches_never_lie(percent):
    r = np.random.default_rng(percent)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = mix(r.integers(0, 2**63, n).astype(np.uint64))
        drop, add = (int(r.integers(0, max(1, n // 6) + 1)) for _ in range(2))
        b = np.unique(np.concatenate([a[drop:], mix(r.integers(0, 2**63, add).astype(np.uint64))]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        union = len(a) + len(b) - both
        words = min(len(sketch(a)), len(sketch(b)))
        assert np.bitwise_count(folded(sketch(a), words) ^ folded(sketch(b), words)).sum() <= union - both
        if len(b) and 100 * both >= percent * union:
            assert len(np.intersect1d(signatures(a, percent), signatures(b, percent)))


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_classes_are_those_of_all_pairs(docs, size, percent):
    rows = docs.collect()
    sets = [shingles(r["text"], size) for r in rows]
    known = [k for k, r in enumerate(rows) if r["doc_id"] is not None and sets[k]]
    linked = [(a, b) for i, a in enumerate(known) for b in known[:i] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = classes(len(rows), linked)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root[k]].append(r["doc_id"])
    want = Counter((r["doc_id"], len(sets[k]), min(least[root[k]]) if r["doc_id"] is not None else None) for k, r in enumerate(rows))
    got = Counter(map(tuple, set_join.near_duplicate_classes(docs, size=size, percent=percent).collect()))
    assert got == want


def test_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(400):
        t = list(base)
        for _ in range(k % 4):
            t[r.randrange(60)] = f"z{r.randrange(10**6)}"
        rows.append((k, " ".join(t)))
    got = dict((x["doc_id"], x["component_id"]) for x in set_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect())
    sets = [shingles(t, 4) for _, t in rows]
    linked = [(a, b) for a in range(400) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert [got[k] for k in range(400)] == classes(400, linked)


def test_hot_keys_are_dealt_out(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as x")
    table = spark.range(4000).selectExpr("id as k", "id * 2 as y")
    hot = hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), ["k"], 5000)
    assert hot.collect() == [(0, 9)]
    for how in ("inner", "left"):
        got, want = (j.orderBy("x").collect() for j in (salted_join(rows, table, ["k"], hot, F.xxhash64("x"), how).select("k", "x", "y"), rows.join(table, "k", how).select("k", "x", "y")))
        assert got == want
    assert hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), ["k"], 100_000_000).collect() == [(0, 2)]


def test_components_of_a_hub(spark):
    star = spark.range(1, 1500).selectExpr("id as a", "0L as b").union(spark.range(1, 1400).selectExpr("id as a", "id + 10000 as b"))
    got = components(star, Scratch(spark, "t"))
    assert got.count() == 1500 + 1399 and got.filter("component <> 0").count() == 0


def test_exact_copies_null_ids_and_one_foreign_component(spark):
    """A third of all rows is one text, a third near copies of another, with a few texts that share passages with them."""
    r = random.Random(7)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, "one text that is here very many times over") for k in range(600)]
    for k in range(600, 1200):
        t = list(base)
        t[r.randrange(80)] = f"z{k}"
        rows.append((k, " ".join(t)))
    rows += [(k, " ".join([*base[:75], *[f"y{k}_{j}" for j in range(12)]])) for k in range(1200, 1206)]
    rows += [(None, "one text that is here very many times over")] * 300 + [(2000 + k, None) for k in range(300)]
    got = set_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()
    comp = {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None}
    sets = {k: shingles(t, 4) for k, t in rows if k is not None and k < 1206 and k >= 600}
    ids = sorted(sets)
    linked = [(i, j) for i, a in enumerate(ids) for j, b in enumerate(ids[:i]) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = classes(len(ids), linked)
    assert [comp[k] for k in ids] == [ids[root[i]] for i in range(len(ids))]
    assert len(got) == len(rows) and all(comp[k] == 0 for k in range(600)) and all(comp[k] == k for k in range(2000, 2300))
    assert sum(x["doc_id"] is None and x["component_id"] is None for x in got) == 300


def test_without_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, _gone string")
    assert {x["_gone"] for x in set_join.without(df, spark.createDataFrame([(2,), (None,)], "doc_id long")).collect()} == {"a", "c"}


def test_join_of_nothing(nothing):
    assert set_join.near_duplicate_classes(nothing).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    got = dict(map(tuple, components(spark.createDataFrame(links or [(None, None)], "a long, b long"), Scratch(spark, "t")).collect()))
    root = classes(31, [(a, b) for a, b in links if a != b])
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: root[k] for k in touched}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    vecs = [base[k % 60] + rng.standard_normal(16) * (0.02 if k % 3 else 0.12) for k in range(400)] + [base[0]] * 30
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(vecs)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] * 8, 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], None), (None, [1.0, 2.0], None), (906, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int")
    x = np.array(vecs)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    got = {r["vec_id"]: r for r in vector_join.near_duplicate_vectors(df).collect()}
    links = np.array([got[k]["n_links"] for k in range(430)])
    want = close.sum(1) - 1
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum()
    root = classes(430, [(a, b) for a in range(430) for b in range(a) if close[a, b]])
    assert np.mean([got[k]["component_id"] == root[k] for k in range(430)]) > 0.98
    assert [(got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) for k in (900, 901, 902, 903, 906)] == [(0, k, True) for k in (900, 901, 902, 903, 906)]
    assert got[904]["n_links"] == got[905]["n_links"] == 1 and got[905]["component_id"] == 904
    assert got[None]["component_id"] is None and got[None]["n_links"] == 0
    assert vector_join.near_duplicate_vectors(df.limit(0)).count() == 0
    assert vector_join.plan(50_000, 0.95, 0.99, 2.0) == (18, 11) and vector_join.plan(10**10, 0.95, 0.99, 2.0)[1] > 25
    assert all(vector_join.recall(0.95, *vector_join.plan(n, 0.95, 0.995, 2.0), 2.0) >= 0.995 for n in (0, 1, 10, 10**5, 10**9))


def vectors(spark, *vecs):
    got = vector_join.near_duplicate_vectors(spark.createDataFrame([(k, v) for k, v in enumerate(vecs)], "vec_id long, embedding array<double>"))
    return [tuple(r) for r in got.orderBy("vec_id").collect()]


def test_vectors_of_any_finite_length(spark):
    assert vectors(spark, [1e200, 1e200], [1.01e200, 1e200]) == [(0, 1, 0, True), (1, 1, 0, False)]
    assert vectors(spark, [1e-200, 2e-200], [2e-200, 1e-200]) == [(0, 0, 0, True), (1, 0, 1, True)]
    assert vectors(spark, [5e-324, 0.0], [1.7e308, 0.0], [0.0, 1.0]) == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]


def test_repeated_ids_of_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.01])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vector_join.near_duplicate_vectors(df).collect())
    assert got == [(1, 1, 1, True)] * 3 + [(2, 1, 1, False)]


def test_links_close_to_the_threshold(spark):
    """Pairs of cosine 0.95 to 0.97, a large group of near copies, and one vector many times over."""
    rng = np.random.default_rng(4)
    dim = 24
    base = rng.standard_normal((900, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.standard_normal((900, dim))
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.9505, 0.97, (900, 1))
    near = base[:1] + 0.02 * rng.standard_normal((1300, dim))
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * away, near, np.repeat(base[1:2], 900, 0)])
    got = {r["vec_id"]: r for r in vector_join.near_duplicate_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    want = close.sum(1) - 1
    links = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (links <= want).all()
    assert links[:1800].sum() >= 0.99 * want[:1800].sum() and links.sum() >= 0.999 * want.sum()


def linked_by_hand(rows, size, percent):
    """(doc_id, n) -> component of every row, a doc_id's texts being one document."""
    sets = [shingles(t, size) if i is not None else frozenset() for i, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    links += [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and rows[i][0] == rows[j][0]]
    comp = classes(len(rows), links)
    least = {}
    for k, c in enumerate(comp):
        if rows[k][0] is not None:
            least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted((str(i), len(shingles(t, size)), str(None if i is None else least[comp[k]])) for k, (i, t) in enumerate(rows))


def test_documents_with_several_texts_lose_no_link(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    base = [r.choice(words) for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    other = [r.choice(words) for _ in range(90)]
    rows = [(1, " ".join(other)), (1, " ".join(base)), (5, " ".join(near)), (7, " ".join(other)), (3, "a b c"), (3, None), (None, " ".join(base)), (9, "x y z u v w"), (8, "x y z u v w"), (8, "q q q q q q q")]
    for k in range(4):
        shuffled = rows[:]
        random.Random(k).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(k + 1)
        got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in set_join.near_duplicate_classes(df, size=4, percent=85).collect())
        assert got == linked_by_hand(rows, 4, 85)


def test_common_signatures_that_are_thinly_spread(spark):
    """150 partitions with 7 near copies each of one text: every one is linked, and no task gets them all."""
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(base[:40] + [f"own{k}"] + base[41:])) for k in range(1050)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(150, "doc_id")
    got = set_join.near_duplicate_classes(df, size=4, percent=80).collect()
    assert len(got) == 1050 and {r["component_id"] for r in got} == {0}


def test_thinly_spread_vectors_meet_in_bounded_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    monkeypatch.setattr(vector_join, "BLOCK", 64)
    centre = r.normal(size=16)
    rows = [(k, [float(x) for x in centre + 0.01 * r.normal(size=16)]) for k in range(1050)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(150, "vec_id")
    got = vector_join.near_duplicate_vectors(df).collect()
    assert len(got) == 1050 and {x["component_id"] for x in got} == {0} and {x["n_links"] for x in got} == {1049}
