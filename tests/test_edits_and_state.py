"""The log of edits, validation anew of what changed, the memory as keyed state, canonical decomposition: each against a plain replay."""

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from invoicelake import joins
from invoicelake.functions import names, nfd
from invoicelake.operators import duplicates, edit_log, edits, memory, revalidate, validate
from invoicelake.stages import stage
from invoicelake.streaming import keyed

CELLS = ("concepto", "nombre", "num_factura", "base_iva", "tipo")


# Log of edits ------------------------------------------------------------------------------------------------------------
def some_lines(spark, n, partitions=3):
    rows = [(k // 2, k % 2, "gasto" if k % 3 else "venta", f"F-{k // 4}", "04/06/2026", "B86561412" if k % 5 else None, f"NOMBRE {k % 7}", "600", 100.0 + k % 6, 21.0, round((100.0 + k % 6) * 0.21, 2), None, None, None, 2, None, "") for k in range(n)]
    schema = "doc_seq long, line_no int, tipo string, num_factura string, fecha string, nif string, nombre string, concepto string, base_iva double, pct_iva double, cuota_iva double, base_irpf double, pct_irpf double, cuota_irpf double, lineas_factura int, total_impreso double, aviso string"
    return spark.createDataFrame(rows, schema).withColumn("cuota_requiv", F.lit(None).cast("double")).repartition(partitions)


def some_log(seed, n, lines):
    r = random.Random(seed)
    log = []
    for seq in range(1, n + 1):
        kind = r.random()
        doc, line = r.randrange(lines // 2 + 1), r.randrange(2)
        if kind < 0.5 or seq < 4:
            log.append((seq, "edita", doc, line, c := r.choice(CELLS), "venta" if c == "tipo" else f"{seq},5", None))
        elif kind < 0.6:
            log.append((seq, "borra", doc, line, None, None, None))
        else:
            log.append((seq, "deshace", None, None, None, None, r.randint(max(1, seq - 6), seq + 1)))
    return log


def replayed(log, version):
    """Entries that count: the latest undo first, as a later one decides on it."""
    entries = [e for e in log if e[0] <= version]
    counts = {e[0]: True for e in entries}
    for e in sorted(entries, reverse=True):
        if e[1] == "deshace" and counts[e[0]] and e[6] in counts and e[6] < e[0]:
            counts[e[6]] = False
    cells, gone = {}, set()
    for e in sorted(entries):
        if counts[e[0]] and e[1] == "edita":
            cells[e[2], e[3], e[4]] = e[5]
        elif counts[e[0]] and e[1] == "borra":
            gone.add((e[2], e[3]))
    return cells, gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_random_log_equals_a_plain_replay(spark, tmp_path, seed):
    n, path = 30, f"file://{tmp_path}/log"
    lines = some_lines(spark, n)
    log = some_log(seed, 80, n)
    assert edit_log.read(spark, path).count() == 0
    for k in range(0, 80, 30):
        edit_log.append(spark.createDataFrame(log[k : k + 30], edit_log.LOG), path)
    edit_log.append(spark.createDataFrame(log[10:14], edit_log.LOG), path)  # written twice
    whole = edit_log.read(spark, path)
    plain = {(r["doc_seq"], r["line_no"]): r.asDict() for r in lines.collect()}
    for version in (0, 25, 80):
        cells, gone = replayed(log, version)
        got = {(r["doc_seq"], r["line_no"]): r.asDict() for r in edit_log.at_version(lines, whole, version).collect()}
        assert set(got) == set(plain) - gone
        for key, row in got.items():
            expected = dict(plain[key])
            for (doc, line, c), v in cells.items():
                if (doc, line) == key:
                    expected[c] = float(v.replace(",", ".")) if c == "base_iva" else v
            assert row == expected


def test_undo_of_undo_and_what_changed(spark):
    log = [(1, "edita", 0, 0, "nombre", "A", None), (2, "edita", 0, 0, "nombre", "B", None), (3, "deshace", None, None, None, None, 2), (4, "deshace", None, None, None, None, 3), (5, "borra", 0, 1, None, None, None), (6, "deshace", None, None, None, None, 5), (7, "deshace", None, None, None, None, 99), (8, "deshace", None, None, None, None, 8), (9, "edita", 77, 0, "nombre", "none", None)]
    df, lines = spark.createDataFrame(log, edit_log.LOG), some_lines(spark, 4)
    shown = lambda v: {(r["doc_seq"], r["line_no"]): r["nombre"] for r in edit_log.at_version(lines, df, v).collect()}
    assert [shown(v)[0, 0] for v in (0, 1, 2, 3, 4)] == ["NOMBRE 0", "A", "B", "A", "B"] and (0, 1) not in shown(5) and (0, 1) in shown(6) and shown(9)[0, 0] == "B"
    assert sorted(map(tuple, edit_log.changes(df, 1, 5).collect())) == [(0, 0, "nombre", "A", "B"), (0, 1, "borra", "no", "sí")]
    assert edit_log.changes(df, 4, 4).count() == 0
    chain = [(1, "borra", 0, 0, None, None, None)] + [(k, "deshace", None, None, None, None, k - 1) for k in range(2, 12)]
    assert edit_log.counting(spark.createDataFrame(chain, edit_log.LOG)).count() == 1 and edit_log.counting(spark.createDataFrame(chain[:-1], edit_log.LOG)).count() == 0


# Validation anew ---------------------------------------------------------------------------------------------------------
PERIOD = 20262


def whole_run(lines):
    out = validate.final_state(duplicates.mark(stage(validate.validate(lines, F.lit(PERIOD).cast("long")))))
    return sorted(map(str, out.select(*sorted(out.columns)).collect()))


def stored(results):
    out = results.lines()
    return sorted(map(str, out.select(*sorted(out.columns)).collect()))


def test_edits_give_what_the_whole_run_gives(spark):
    r = random.Random(4)
    lines = stage(some_lines(spark, 240))
    results = revalidate.Results(lines, PERIOD, buckets=32)
    assert stored(results) == whole_run(lines)
    for k in range(4):
        typed = [(r.randrange(125), r.randrange(2), c, {"num_factura": f"F-{r.randrange(60)}", "base_iva": f"{100 + r.randrange(6)},00", "nif": r.choice(["B86561412", "", "X"]), "fecha": "31/12/2026"}[c], j) for j, c in enumerate(r.choices(["num_factura", "base_iva", "nif", "fecha"], k=3))]
        changes = spark.createDataFrame(typed, "doc_seq long, line_no int, campo string, valor string, orden int")
        gone = spark.createDataFrame([(r.randrange(120), 0)] if k % 2 else [], "doc_seq long, line_no int")
        lines = stage(edits.without_rows(edits.apply(lines, changes), gone))
        results.apply(changes, gone)
        assert stored(results) == whole_run(lines)
        assert 0 < results.read_rows < 240 * 0.7  # a few buckets of 32


def test_no_edits_and_edits_of_nothing(spark):
    lines = stage(some_lines(spark, 20))
    results = revalidate.Results(lines, PERIOD)
    none = spark.createDataFrame([], "doc_seq long, line_no int, campo string, valor string, orden int")
    assert results.apply(none) == set() and results.apply(spark.createDataFrame([(999, 0, "nif", "x", 1)], none.schema)) == set()
    assert stored(results) == whole_run(lines)
    results.apply(none, lines.select("doc_seq", "line_no"))
    assert results.lines().count() == 0


@pytest.mark.parametrize("broadcast", [100_000, 1])
def test_groups_of_buckets_and_equal_hashes(spark, monkeypatch, broadcast):
    """Edits in many buckets, which are computed anew group by group; all keys with one hash, so that only the keys tell lines apart."""
    monkeypatch.setattr(revalidate, "GROUP", 3)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    lines = stage(some_lines(spark, 120))
    typed = lines.filter("line_no = 0 and doc_seq % 3 = 0").selectExpr("doc_seq", "line_no", "'num_factura' as campo", "concat('F-', doc_seq % 5) as valor", "1 as orden")
    gone = lines.filter("doc_seq % 7 = 0 and line_no = 1")
    expected = whole_run(stage(edits.without_rows(edits.apply(lines, typed), gone)))
    results = revalidate.Results(lines, PERIOD, buckets=8)
    assert len(results.apply(typed, gone)) > 3 and stored(results) == expected
    monkeypatch.setattr(duplicates, "digest", lambda k: F.lit(7).cast("long"))
    results = revalidate.Results(lines, PERIOD, buckets=8)
    results.apply(typed, gone)
    assert stored(results) == expected


def test_results_shuffle_whole_lines_once_and_store_no_messages(spark):
    results = revalidate.Results(stage(some_lines(spark, 40)), PERIOD, buckets=4)
    kept = spark.read.parquet(*results.folders.values()).columns
    assert "issues" not in kept and "issues" in results.lines().columns
    hashed = results._hashed(stage(some_lines(spark, 40)))
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = duplicates.mark_in_place(hashed.withColumn("_bucket", results._bucket()), "_hash", 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # that of the lines, and where it isn't broadcast that of the few keys that several lines have
    assert 1 <= plan.count("Exchange hashpartitioning(_hash") <= 2


# Keyed state -------------------------------------------------------------------------------------------------------------
@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, keyed._ROCKS)
    yield
    spark.conf.set(key, before)


def taught(seed):
    r = random.Random(seed)
    held = [(f"K{k}", f"OLD{k}", "" if k % 4 == 0 else f"name {k}", k % 3 == 0) for k in range(12)]
    news = [(f"K{r.randrange(16)}", f"ID{r.randrange(5)}", r.choice(["", f"n{s}"]), s) for s in range(60)]
    return held, news


@pytest.mark.parametrize("cuts", [[], [1], [5, 20, 21, 50]])
def test_any_micro_batches_give_the_memory_of_one_batch(spark, rocks, tmp_path, cuts):
    held, news = taught(len(cuts))
    expected = memory.upsert_providers(spark.createDataFrame(held, "clave string, nif string, nombre string, manual boolean"), spark.createDataFrame(news, "clave string, nif string, nombre string, seq long"))
    arriving = [(c, i, n, -1, m) for c, i, n, m in held] + [(*x, False) for x in news]
    random.Random(1).shuffle(arriving)
    arriving += arriving[:7] + [("", "x", "x", 1, False), (None, "x", "x", 1, False), ("K1", "", "x", 999, False)]  # repeats, and what is left out
    bounds = [0, *cuts, len(arriving)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):  # each part is a stream of its own run: a restart in between
        spark.createDataFrame(arriving[a:b], keyed.READING).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(keyed.READING).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        keyed.learn(stream, f"file://{tmp_path}/memory", f"file://{tmp_path}/checkpoint").awaitTermination(300)
    assert sorted(map(str, keyed.read(spark, f"file://{tmp_path}/memory").collect())) == sorted(map(str, expected.collect()))


def test_a_store_that_keeps_no_such_state_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError, match="RocksDB"):
        keyed.learn(spark.readStream.schema(keyed.READING).json(f"{tmp_path}/in"), f"{tmp_path}/m", f"{tmp_path}/c")
    assert keyed.read(spark, f"file://{tmp_path}/none").count() == 0


# Canonical decomposition -------------------------------------------------------------------------------------------------
def test_every_code_point_and_random_texts(spark):
    points = [chr(n) for n in range(1, sys.maxunicode + 1) if not 0xD800 <= n <= 0xDFFF]
    r = random.Random(6)
    marks = [c for c in points if unicodedata.combining(c)]
    whole = [c for c in points if unicodedata.normalize("NFD", c) != c]
    texts = ["".join(points[k : k + 64]) for k in range(0, len(points), 64)]
    texts += ["".join(r.choice([r.choice("aeno "), r.choice(marks), r.choice(whole), r.choice(points)]) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    texts += ["", "plain", "가각힣", "ạ̇", "ạ̇", "̣̇", "Å\ṇx\ṛ̇", chr(0xF0000), chr(0xF0001) + "é"]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "k int, t string").repartition(8)
    for row in df.select("k", "t", nfd.nfd(F.col("t")).alias("d"), nfd.without_marks(F.col("t")).alias("w")).collect():
        if row["t"] is None:
            assert row["d"] is None and row["w"] is None
        else:
            d = unicodedata.normalize("NFD", row["t"])
            assert row["d"] == d, (row["t"], row["d"], d)
            if all(unicodedata.category(c) != "Cn" for c in d):
                assert row["w"] == "".join(c for c in d if unicodedata.category(c) != "Mn")


def test_names_are_compared_without_any_marks(spark):
    df = spark.createDataFrame([("ŠKODA Ťažké Stroje", "SKODA TAZKE STROJE"), ("Ṿ̃ictor Ệmile", "VICTOR EMILE"), ("Ｐ", "Ｐ")], "a string, b string")
    assert all(r[0] == r[1] for r in df.select(names.strip_accents(F.upper("a")), F.col("b")).collect())
