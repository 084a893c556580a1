"""Indexed rules, the join of names, the suffix scan and joins that stay even: against plain Python, skewed and odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from invoicelake import joins
from invoicelake.operators import incidents, name_join, rule_index


def plan_of(df):
    return df._jdf.queryExecution().toString()


# Rules in a table --------------------------------------------------------------------------------------------------------
def rules_by_hand(texts, rules, default):
    out = {}
    for i, t in texts:
        hits = [(p, c) for p, c, k in rules if k is not None and k in (t or "").lower()]
        out[i] = min([*hits, *([out[i]] if i in out and out[i] else [])], default=None)
    return {i: h[1] if h else default for i, h in out.items()}


def some_rules(seed, n, signs="abc d"):
    r = random.Random(seed)
    rules = [(r.randrange(40), f"c{r.randrange(9)}", "".join(r.choice(signs) for _ in range(r.choice([1, 2, 3, 3, 4, 5, 7])))) for _ in range(n)]
    texts = [(k, "".join(r.choice("abc d") for _ in range(r.choice([0, 1, 2, 3, 5, 40])))) for k in range(150)]
    return rules, [*texts, (900, None), (901, ""), (902, "ABC D"), (None, "abc"), (3, "d" * 3000), (903, "日本語 \U0001f600\U0001f600 x")]


@pytest.mark.parametrize("broadcast", [100_000, 0])
@pytest.mark.parametrize("extra", [[], [(5, "all", "")], [(1, "x", None), (2, "z", "本"), (3, "y", "\U0001f600\U0001f600 "), (3, "w", "語 \U0001f600")]])
def test_indexed_rules_equal_every_rule(spark, monkeypatch, broadcast, extra):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    rules, texts = some_rules(len(extra), 60, "abc dxyz")
    rules = [*rules, *extra]
    table = spark.createDataFrame(rules, "prio int, codigo string, clave string")
    df = spark.createDataFrame(texts, "id long, texto string").selectExpr("*", "'x' as clave", "1 as prio", "'g' as gram").repartition(5)
    out = rule_index.by_index(df, "id", F.col("texto"), table, "none")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len({g[0] for g in got}) and dict(got) == rules_by_hand(texts, rules, "none")


def test_no_rules_and_no_texts(spark):
    none = spark.createDataFrame([], "prio int, codigo string, clave string")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, texto string")
    assert sorted(map(tuple, rule_index.by_index(df, "id", F.col("texto"), none, None).collect())) == [(1, None), (2, None)]
    assert rule_index.by_index(df.limit(0), "id", F.col("texto"), none, "d").count() == 0


def test_a_keyword_is_indexed_at_its_rarest_gram(spark):
    rules = spark.createDataFrame([(0, "the xq"), (1, "the"), (2, "z"), (3, "the x")], "rango long, clave string")
    common = spark.createDataFrame([("the x", 90), ("he xq", 80)], "gram string, n long")
    expected = {"the xq": "he xq", "the": "the", "z": "z", "the x": "the x"}
    assert {r["clave"]: r["gram"] for r in rule_index.index(rules, common).collect()} == expected
    assert {r["clave"]: r["gram"] for r in rule_index.index(rules).collect()} == expected


def test_long_texts_take_linear_time(spark):
    df = spark.range(2).select("id", F.repeat(F.lit("abcdefgh "), 200_000).alias("texto"))
    rules = spark.createDataFrame([(0, "x", "h abcd"), (1, "y", "zzz")], "prio int, codigo string, clave string")
    assert {r["codigo"] for r in rule_index.by_index(df, "id", F.col("texto"), rules, "-").collect()} == {"x"}


# Names -------------------------------------------------------------------------------------------------------------------
def same(a, b):
    a, b = set(a), set(b)
    return len(a & b) >= 2 and len(a & b) / max(min(len(a), len(b)), 1) >= 0.6


def some_names(seed, n):
    r = random.Random(seed)
    words = [f"PALABRA{chr(65 + k)}" for k in range(20)]
    out = []
    for k in range(n):
        own = [r.choice(words) for _ in range(r.choice([0, 1, 2, 2, 3, 3, 4, 5, 6, 9]))]
        if k % 3 == 0:
            own.insert(0, "SUMINISTROS")  # a third of all names have it
        if k % 6 == 0:
            own.insert(0, "INDUSTRIALES")
        out.append((k * 7 % 1009, " ".join(own)))
    return [*out, (5000, None), (5001, ""), (5002, "SL SA"), (5003, "Suministros Industriales, S.L."), (5004, "SUMINISTROS INDUSTRIALES")]


def words_of(name):
    import re

    t = (name or "").upper()
    for piece in (",", ".", "(", ")", " SL", " S L", " SLU", " SA", " SAU", " CB"):
        t = t.replace(piece, " ")
    return sorted({w for w in re.split(r"\s+", t) if len(w) >= 3})


@pytest.mark.parametrize("hot", [1_000, 3])
def test_partners_within_a_table(spark, monkeypatch, hot):
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    names = some_names(2, 240)
    df = spark.createDataFrame(names, "id long, nombre string").selectExpr("*", "'x' as words", "1 as n", "2 as clase").repartition(6)
    out = name_join.within(df)
    got = {r["id"]: (r["partners"], r["least_partner"]) for r in out.collect()}
    tokens = {i: words_of(n) for i, n in names}
    expected = {}
    for i in tokens:
        found = [j for j in tokens if j != i and same(tokens[i], tokens[j])]
        expected[i] = (len(found), min(found, default=None))
    assert got == expected


def test_partners_across_tables(spark):
    left, right = some_names(3, 90), some_names(4, 120)
    schema = "id long, nombre string"
    got = {r["id"]: (r["partners"], r["least_partner"]) for r in name_join.across(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    expected = {}
    for i, n in left:
        found = [j for j, m in right if same(words_of(n), words_of(m))]
        expected[i] = (len(found), min(found, default=None))
    assert got == expected
    none = spark.createDataFrame([], schema)
    assert name_join.within(none).count() == 0
    assert {tuple(r)[1:] for r in name_join.across(spark.createDataFrame(left, schema), none).collect()} == {(0, None)}


def test_a_common_word_meets_nobody(spark):
    """A third of all names share one word: no two of them meet on it."""
    names = [(k, f"SUMINISTROS ALFA{k:05d}X" if k % 3 == 0 else f"BETA{k:05d}X GAMMA{k:05d}X") for k in range(3000)]
    classes = spark.createDataFrame([(str(k), words_of(n)) for k, n in names], "clase string, words array<string>")
    assert name_join.class_pairs(classes).count() == 0
    assert "CartesianProduct" not in plan_of(name_join.class_pairs(classes)) and "NestedLoop" not in plan_of(name_join.class_pairs(classes))


# Next incidents ----------------------------------------------------------------------------------------------------------
def next_by_hand(rows):
    bad = sorted({f for f, s in rows if f is not None and s is not None and s != "ok"})
    return sorted((f, next((b for b in bad if b > f), bad[0] if bad else None)) for f, _ in rows if f is not None)


def filled(rows):
    return sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0], -1 if x[1] is None else x[1]))


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_next_incidents(spark, aqe, share):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        r = random.Random(share)
        rows = [(k, r.choice(["error", "revisar"]) if r.random() < share else "ok") for k in range(500)]
        rows += [(3, "ok"), (3, "error"), (None, "error"), (7, None), (499, "ok")] if share else []
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "fila long, estado string").selectExpr("*", "1 as at", "2 as range", "3 as local").repartition(3)
        for parts in (1, 7, 40):
            assert filled(incidents.next_incidents(df, partitions=parts).collect()) == filled(next_by_hand(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_next_incidents_of_few_lines(spark):
    for rows in ([], [(1, "ok")], [(1, "error")], [(None, "error")], [(5, "ok"), (5, "error"), (5, "ok")]):
        assert filled(incidents.next_incidents(spark.createDataFrame(rows, "fila long, estado string")).collect()) == filled(next_by_hand(rows))


def test_batches_carry_the_last_incident():
    import pyarrow as pa

    at = list(range(99, -1, -1))
    for bad in ([], [50], [0], [99], [50, 49, 10], list(range(100))):
        whole = None
        for size in (1, 2, 7, 100):
            batches = [pa.RecordBatch.from_arrays([pa.array(at[k : k + size], pa.int64()), pa.array([x in bad for x in at[k : k + size]])], names=["at", "bad"]) for k in range(0, 100, size)]
            got = [x for b in incidents._scan(iter(batches)) for x in b.column(1).to_pylist()]
            assert whole in (None, got)
            whole = got
        assert whole == [min((b for b in bad if b > x), default=None) for x in at]


# Even joins --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_equals_a_plain_join(spark, how):
    r = random.Random(1)
    rows = [(k, None if k % 10 == 0 else 1 if k % 3 == 0 else r.randrange(30)) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, k long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 30, 2)] + [(1, "one"), (1, "uno"), (None, "null")], "k long, v string")
    plain = sorted(map(str, df.join(table, "k", how).collect()))
    assert sorted(map(str, joins.lookup(df, table, ["k"], how, spread=F.col("id"), hot_rows=20).collect())) == plain
    assert joins.lookup(df.limit(0), table, ["k"], how, spread=F.col("id")).count() == 0


def test_a_third_of_all_rows_is_no_large_task(spark):
    n = 60_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    table = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = joins.lookup(df, table, ["k"], spread=F.xxhash64("id"), hot_rows=500)
        sizes = sorted(r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect())
        assert sum(sizes) == n and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stored_rows_are_no_broadcast(spark):
    """Stored tables are small in files and large in memory."""
    from invoicelake.operators import fill, replaced
    from invoicelake.stages import stage

    lines = spark.range(20_000).select(
        F.col("id").alias("doc_seq"), F.lit(0).alias("line_no"), F.concat(F.lit("NOMBRE LARGO "), F.col("id") % 5).alias("nombre"), F.when(F.col("id") % 7 == 0, "12345678Z").alias("nif"),
        F.concat(F.lit("F-"), "id").alias("num_factura"), F.concat(F.lit("F-"), F.col("id") - 1).alias("sustituye_a"), F.lit("").alias("aviso"), F.lit(None).cast("string").alias("sustituida_por"),
    )
    lines = stage(lines)
    for out in (fill.from_siblings(lines), replaced.mark(lines)):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 20_000


def test_names_of_two_common_words_are_no_pairs(spark):
    """All of 5000 names are partners: 12.5 million pairs, of which no row is made."""
    names = spark.range(5000).select("id", F.concat(F.lit("ALFA BETA Z"), F.md5(F.col("id").cast("string")), F.when(F.col("id") % 9 == 0, " GAMMA").otherwise("")).alias("nombre"))
    seen = []
    stored = name_join.stage
    name_join.stage = lambda df, *done: seen.append(out := stored(df, *done)) or seen.append(out.count()) or out
    try:
        out = {tuple(r)[1:] for r in name_join.within(names).collect()}
    finally:
        name_join.stage = stored
    assert out == {(4999, 0), (4999, 1)} and max(n for n in seen if isinstance(n, int)) <= 12 * 5000


@pytest.mark.parametrize("broadcast", [100_000, 7, 0])
def test_keywords_within_words_meet_the_vocabulary(spark, monkeypatch, broadcast):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    monkeypatch.setattr(rule_index, "FEW", 0)
    cut = []
    plainly = rule_index._cut
    monkeypatch.setattr(rule_index, "_cut", lambda texts, *a: cut.append(texts.count()) or plainly(texts, *a))
    rules, texts = some_rules(7, 150, "abcdx")
    table = lambda r: spark.createDataFrame(r, "prio int, codigo string, clave string")
    df = spark.createDataFrame(texts * 3, "id long, texto string").repartition(5)
    assert {r["id"]: r["codigo"] for r in rule_index.by_index(df, "id", F.col("texto"), table(rules), "none").collect()} == rules_by_hand(texts, rules, "none")
    vocabulary = len({w for _, t in texts for w in (t or "").lower().split()})
    assert cut == [vocabulary]  # each distinct word once, however many texts have it
    rules += [(0, "two", "b c"), (1, "sign", "\U0001f600 x"), (2, "capital", "A"), (3, "tab", "\t"), (4, "word", "本語")]
    assert {r["id"]: r["codigo"] for r in rule_index.by_index(df, "id", F.col("texto"), table(rules), None).collect()} == rules_by_hand(texts, rules, None)
