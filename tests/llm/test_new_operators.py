import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from invoicelake.llm import divergence, piece_codec, queries, whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# Source divergence audit ------------------------------------------------------------------------------------------------
def divergence_by_hand(rows, min_docs, top):
    """rows of (text, lang, source) -> the whole result, straight from the definitions."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(lower))
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)
        total = Counter()
        for s in sources:
            total.update(n[lang, s])

        def p_of(c):
            size = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // size for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        ps, q = {s: p_of(n[lang, s]) for s in sources}, p_of(total)
        for s in sources:
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(ps[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s][t] and ps[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def some_rows(seed, n, sources=6):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghik") for _ in range(r.randint(1, 3))) for _ in range(120)] + ["Ünï", "ÉTÉ", "été", "日本", "z9z", "It's"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for k in range(n):
        lang = r.choice(["en", "de", None, ""])
        source = f"s{r.randrange(sources)}" if r.random() > 0.35 else "s0"
        rows.append((" ".join(w.upper() if r.random() < 0.2 else w for w in r.choices(words, weights, k=r.randint(0, 60))), lang, source))
    return [*rows, (None, "en", "silent"), ("", None, None), ("1 2 3 . !", "xx", "a"), ("only one", "xx", "b"), rows[0], rows[0]]


def audited(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as n", "'x' as term", "2 as p", "3 as v").repartition(5)
    return sorted(tuple(r) for r in divergence.audit(df, **how).collect())


@pytest.mark.parametrize("min_docs, top", [(10, 10), (1, 3), (2, 1), (10_000, 10)])
def test_divergence_equals_the_definitions(spark, min_docs, top):
    rows = some_rows(min_docs, 160)
    assert audited(spark, rows, min_docs=min_docs, top=top) == divergence_by_hand(rows, min_docs, top)


def test_divergence_of_ties_hot_sources_and_nothing(spark):
    tied = [("aa bb cc dd ee ff gg hh", "en", s) for s in ("one", "two") for _ in range(12)] + [("aa zz", "en", "three")] * 11
    assert audited(spark, tied, min_docs=10, top=3) == divergence_by_hand(tied, 10, 3)
    assert audited(spark, [], min_docs=1) == []


def test_divergence_without_broadcasts_and_with_small_counts(spark, monkeypatch):
    rows = some_rows(8, 150)
    expected = divergence_by_hand(rows, 3, 10)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "HELD", 20)
    assert audited(spark, rows, min_docs=3) == expected


def test_whole_numbers_of_a_large_corpus(spark):
    n, size = 9_000_000_000_000_000, 9_100_000_000_000_000
    got = spark.range(1).select(divergence.chance(F.lit(n), F.lit(size)).alias("p")).first()["p"]
    assert got == 1 + 1_000_000_000 * (n + 2) // size
    counts = [1, 2, 3, 7, 8, 9, 1023, 1024, 10**15]
    buckets = [r[0] for r in spark.createDataFrame([(c,) for c in counts], "c long").select(divergence.bucket_of(F.col("c"))).collect()]
    assert buckets == sorted(buckets) and all(b == c.bit_length() * 8 + ((c << 3) >> (c.bit_length() - 1)) % 8 for b, c in zip(buckets, counts))


# SentencePiece ----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def codec():
    out = piece_codec.Codec(MODEL)
    out.encode("")
    return out


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_ids_equal_the_librarys(codec):
    r = random.Random(5)
    entries = [p.replace("▁", " ") for p in codec.ids]
    signs = [*"abcdesst  \n\t▁0", "é", "日", "本", "한", "\U0001f600", "́", "\x00", "=", "-", "."]
    for k in range(20_000):
        text = "".join(r.choice(entries) for _ in range(r.randint(1, 7))) if k % 2 else "".join(r.choice(signs) for _ in range(r.randint(1, 30)))
        assert ids_of(codec, text) == codec.library.encode(text), repr(text)


def test_runs_of_spaces_long_words_and_literals(codec):
    for n in range(70):
        for tail in ("", "a", "中", "\n", "� x", "the"):
            assert ids_of(codec, " " * n + tail) == codec.library.encode(" " * n + tail)
            assert ids_of(codec, "x" + " " * n + tail) == codec.library.encode("x" + " " * n + tail)
    for text in ("", " ", "▁", "<s> </s> <unk> <0x0A>", "a" * 3000, "ab" * 5000, "=" * 4001, "日" * 2000, "\n" * 50, "word " * 5000):
        assert ids_of(codec, text) == codec.library.encode(text)


def test_every_entry_is_its_own_or_is_never_made(codec):
    for piece, k in codec.ids.items():
        if "▁" not in piece:
            got = codec.library.encode("\n" + piece)[2:]  # behind a sign that joins nothing
            assert (got == [k]) == (k in codec.usable)


def test_encoding_and_decoding_of_a_table(spark, docs, nothing):
    texts = [(None, None), (1, ""), (1, "Twice"), (1, "Twice"), (2, "  two  spaces "), (3, "Ü日\U0001f600\x00 é"), (4, "long " * 40_000 + "x" * 100_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'old' as ids", "7 as decoded", "map('a', 1) as other")
    out = piece_codec.decode(piece_codec.encode(df, MODEL), MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(out) == len(texts)
    for row in out:
        expected = library.encode(row["text"] or "")
        assert row["ids"] == expected and row["decoded"] == library.decode(expected) and row["other"] == {"a": 1}
    assert {r["decoded"] for r in out} >= {"  two  spaces ", "", "Twice"}
    assert piece_codec.encode(nothing, MODEL).count() == 0
    assert piece_codec.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), MODEL).select("decoded").collect() == [("",), ("",)]


def test_the_piece_query_by_the_library(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        expected.append((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [(str(r["doc_id"]), *r[1:]) for r in queries.op12_sentencepiece(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(expected)


def test_kept_words_are_bounded(codec, monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT_SIGNS", 2_000)
    monkeypatch.setattr(piece_codec, "KEPT_PAIRS", 10)
    for k in range(600):
        assert ids_of(codec, f"w{k} x{k} " + "y" * 60) == codec.library.encode(f"w{k} x{k} " + "y" * 60)
        assert codec.signs <= 2_000 and "y" * 60 not in codec.kept and len(codec.kept) < 300 and len(codec.pair) <= 10


# Embedding whitening ----------------------------------------------------------------------------------------------------
def whitened_by_hand(vectors, most):
    """Exact sums and numpy on the driver: (deviations, explained, whitened up to signs)."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    order = order[values[order] > values.max() * 1e-10][:most]
    return deviations, values[order] / values.sum(), centred @ basis[:, order] / np.sqrt(values[order])


def odd_vectors(seed, n, dim):
    r = np.random.default_rng(seed)
    base = (r.normal(size=(n, dim)) @ r.normal(size=(dim, dim))).astype(np.float32)
    rows = [(k if k % 9 else None, [float(c) for c in v], "x") for k, v in enumerate(base)]
    rows += [rows[3], rows[3], (900, None, "x"), (901, [], "x"), (902, [None] * dim, "x"), (903, [float("nan")] * dim, "x"), (904, [float("inf")] * dim, "x"), (905, [1.0] * (dim + 1), "x"), (906, [1e30] * dim, "x"), (907, [0.0] * dim, "x")]
    good = [v for k, v, _ in rows if k not in range(900, 907)]
    return rows, good


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_equals_numpy(spark, kind):
    rows, good = odd_vectors(4, 300, 12)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n string").selectExpr("*", "1 as component", "2 as id", "3 as vector").repartition(7)
    white = whitening.whiten(df, most=8)
    out = whitening.components(white)
    assert out.count() == 8 * len(good) and white.count() == len(good)
    deviations, explained, values = whitened_by_hand(good, 8)
    first = out.filter("component = 1").first()
    assert first["n"] == len(good) and 0 <= first["identity_error"] < 1e-9
    assert sorted(r["deviation"] for r in white.collect()) == sorted(deviations)
    got = {r["component"]: r["explained"] for r in out.collect()}
    assert np.allclose([got[k + 1] for k in range(8)], explained, rtol=1e-9)
    by_deviation = {}
    for d, v in zip(deviations, values):
        by_deviation.setdefault(d, v)
    rows_out = white.collect()
    sign = np.sign([a * b for a, b in zip(rows_out[0]["whitened"], by_deviation[int(rows_out[0]["deviation"])])])
    for r in rows_out:
        assert np.allclose(np.array(r["whitened"]) * sign, by_deviation[int(r["deviation"])], atol=1e-7)


def test_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)], [(1, []), (2, [])]):
        assert whitening.components(whitening.whiten(spark.createDataFrame(rows, schema))).count() == 0
    line = [(k, [float(k), 2.0 * k, 5.0]) for k in range(20)]  # one direction alone varies
    out = whitening.components(whitening.whiten(spark.createDataFrame(line, schema))).collect()
    assert len(out) == 20 and {r["component"] for r in out} == {1} and all(abs(r["explained"] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in out)


def test_exact_numbers_beyond_64_bits():
    x = np.array([[1 << 45, -(1 << 45)], [3, 5], [(1 << 50) + 1, 7]], np.int64)
    sums = whitening._sum(x)
    assert sums == [int(x[:, 0].astype(object).sum()), int(x[:, 1].astype(object).sum())]
    for n in (3, 10**6):
        d = whitening._numerators(x, n, sums)
        exact = [[int(c) * n - s for c, s in zip(row, sums)] for row in x.tolist()]
        assert [[int(c) for c in row] for row in d.tolist()] == exact
        assert whitening._deviations(d) == [sum(c * c for c in row) for row in exact]
    wide = np.array([[(1 << 58) + 12345, -(1 << 57) - 1, 0]], np.int64)
    assert whitening._deviations(wide) == [((1 << 58) + 12345) ** 2 + ((1 << 57) + 1) ** 2]


def test_merged_moments_are_those_of_all_rows():
    r = np.random.default_rng(1)
    parts = [r.normal(5, 2, (k, 3)) for k in (1, 40, 7, 0, 300)]
    total = (0, np.zeros(3), np.zeros((3, 3)))
    for p in parts:
        mean = p.mean(0) if len(p) else np.zeros(3)
        total = whitening.merged(total, (len(p), mean, (p - mean).T @ (p - mean)))
    every = np.vstack(parts)
    assert total[0] == len(every) and np.allclose(total[1], every.mean(0)) and np.allclose(total[2] / total[0], np.cov(every.T, bias=True))
