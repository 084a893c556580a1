"""Many rows of one id, or of none, and of one size: dealt out like any others, and the same whatever the partitions."""

import time
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from invoicelake.llm import mixing, token_store
from invoicelake.llm.common import fresh_path


def equal_rows(spark, n, null_part):
    """A third or all of n rows have no id; every text has five words."""
    return spark.range(n, numPartitions=4).select(
        F.when(F.col("id") % 3 >= null_part, F.col("id")).alias("doc_id"), F.concat(F.lit("a b c d "), (F.col("id") % 50).cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("source")
    )


@pytest.mark.parametrize("null_part", [1, 3])
def test_mixing_rounds_equal_rows_apart(spark, monkeypatch, null_part):
    monkeypatch.setattr(mixing, "RUN", 500)
    docs = equal_rows(spark, 6000, null_part)
    first = mixing.mix(docs)
    rows = first.collect()
    assert len(rows) == 6000 and Counter(r["taken"] for r in rows).keys() <= {0, 5, 10}
    for source in "st":
        of = [r for r in rows if r["source"] == source]
        assert len(of) == 3000 and abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 5 and of[0]["source_size"] == 15000
    again = mixing.mix(docs.repartition(7, "text"))
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again.collect()))
    kept = mixing.mixed_documents(docs).groupBy("source").count().collect()
    assert {r["source"]: 5 * r["count"] for r in kept} == {s: sum(r["taken"] for r in rows if r["source"] == s) for s in "st"}


def test_mixing_takes_time_in_proportion(spark):
    seconds = {}
    for null_part in (0, 3):
        docs = equal_rows(spark, 32_000, null_part)
        began = time.perf_counter()
        assert mixing.mix(docs).count() == 32_000
        seconds[null_part] = time.perf_counter() - began
    assert seconds[3] < 2 * seconds[0] + 2


def test_token_files_order_rows_of_one_id_by_their_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = equal_rows(spark, 900, 1)
    got = []
    for df in (docs, docs.repartition(5, "text")):
        files = fresh_path(spark, "t")
        token_store.write_token_files(df, files, path, shard_ids=500)
        got.append(sorted(map(tuple, token_store.read_token_files(spark, files).select("start", "doc_id", "n_tokens", "ids_crc32").collect())))
    assert got[0] == got[1] and len(got[0]) == 900
    starts = [s for s, *_ in got[0]]
    assert starts == [sum(n for _, _, n, _ in got[0][:k]) for k in range(900)]
    assert [d for _, d, _, _ in got[0]] == sorted((d for _, d, _, _ in got[0]), key=lambda d: (d is not None, d))
