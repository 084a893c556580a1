"""What the queries over lines and records share: tables read once, steps computed once, arithmetic that equals text."""

from pyspark.sql import functions as F

from invoicelake.functions import json_text, numbers
from invoicelake.plans import batch, catalog, projection
from invoicelake.schema import PROVIDER_MEMORY
from invoicelake.sources import records

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_read_each_table_once(spark):
    assert plan_of(projection.lines(spark, SF)).count("Relation [l_orderkey") == 1


def test_states_store_no_messages(spark):
    assert "issues" not in catalog._marked(spark, SF).columns


def test_repair_computes_each_step_once(spark):
    texts = [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1, }\n```', '{"a": 1}'), ('Here it is: {"a": 1 ,}', '{"a": 1 }'), ("none", None), (None, None), ("", None)]
    df = json_text.with_repaired(spark.createDataFrame(texts, "t string, expected string"), "t", "got")
    assert plan_of(df).count("regexp_extract(") == 1
    assert df.filter("not (got <=> expected)").count() == 0


def test_rounding_by_arithmetic_equals_text(spark):
    values = [0.0, -0.0, -0.001, 0.005, 0.015, 1.005, 2.675, -2.675, 1234.565, 0.994999, 99.995, 123456789.125, 1e12 + 0.125, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    text = lambda c: F.col(c).cast("string")
    out = df.select(numbers.round2(F.col("x")).alias("a"), numbers.fixed2(F.col("x")).cast("double").alias("b"))
    assert out.filter(~text("a").eqNullSafe(text("b"))).count() == 0
    # random remainders too: every cent value a little off a half
    out = spark.range(20_000).select((F.col("id") / 1000.0 - 7).alias("x")).select(numbers.round2(F.col("x")).alias("a"), numbers.fixed2(F.col("x")).cast("double").alias("b"))
    assert out.filter(~text("a").eqNullSafe(text("b"))).count() == 0


def test_a_batch_does_what_is_asked_for(spark, monkeypatch):
    stored = []
    plain = batch.stage
    monkeypatch.setattr(batch, "stage", lambda df, *done: (stored.append(df.columns), plain(df, *done))[1])
    party = {"receptor_nombre": "CLIENTE DE PRUEBA SL", "receptor_nif": "B86561412", "fecha": "04/06/2026"}
    recs = [party | {"emisor_nombre": "PROVEEDOR UNO", "emisor_nif": nif, "num_factura": f"F-{k}", "lineas_iva": [{"base": "100", "tipo_iva": "21", "cuota_iva": "21"}] * 2} for k, nif in enumerate(["B30048276", None])]
    done = batch.run(records.literal(spark, recs), spark.createDataFrame([], PROVIDER_MEMORY))
    assert done.memory.count() == 1 and done.counts.first()["copiadas"] == 1
    assert not any("base_iva" in c for c in stored)  # no lines for the counts and the memory
    assert [r["nif"] for r in done.lines.collect()] == ["B30048276"] * 4
    assert sum("base_iva" in c for c in stored) == 1 and not any("issues" in c for c in stored)
    assert sum("lineas_iva" in c for c in stored) == 1  # records are read once
    done.close()
