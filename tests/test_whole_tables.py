from pyspark.sql import functions as F

from invoicelake.operators import rules


def test_rules_beyond_ten_thousand(spark):
    table = spark.range(10_050).select(F.col("id").cast("int").alias("prio"), F.lit("629").alias("codigo"), F.concat(F.lit("clave"), F.col("id"), F.lit(";")).alias("clave"))
    df = spark.createDataFrame([(k, f"x clave{k}; y") for k in (0, 9_999, 10_000, 10_049, 20_000)], "id long, text string")
    got = {r["id"]: r["codigo"] for r in rules.by_join(df, "id", F.col("text"), table, "600").collect()}
    assert got == {0: "629", 9_999: "629", 10_000: "629", 10_049: "629", 20_000: "600"}
