"""Decomposition of long texts: signs that become several, marks that change places, private signs, and what it costs."""

import random
import time
import unicodedata

from pyspark.sql import functions as F

from invoicelake.functions import names, nfd

_POOLS = {
    "syllables": [chr(n) for n in range(0xAC00, 0xD7A4, 5)] + [" ", "é", "́"],
    "several signs": list("ொோௌொ ൊොේ\U0001D15E\U0001D164\U0001D1BB"),
    "marks that stay": list("aḅ᭄꧀〮〯́\U0001D165\U0001D16E\U0001D15Eైྲ़ྀ̈́"),
    "private signs": ["\U000F0000", "\U000F0001", "\U000F0029", "\U000F0FFF", "\U000F1000", "", "é", "ạ", "가", "ொ"],
    "zero and line ends": ["\0", "\n", "\r\n", "é", "가", "¿", "a"],
}


def test_signs_that_need_more_than_one_lookup(spark):
    r = random.Random(20)
    texts = [(name, "".join(r.choices(pool, k=k))) for name, pool in _POOLS.items() for k in (1, 2, 3, 5, 8, 40, 3000) for _ in range(12)]
    texts += [("comma", ","), ("comma", "각,é,ொ"), ("one byte", "abc"), ("latin", "¿qué?"), ("none", ""), ("null", None)]
    df = spark.createDataFrame(texts, "name string, t string").repartition(4)
    for name, t, d, w in df.select("name", "t", nfd.nfd(F.col("t")), nfd.without_marks(F.col("t"))).collect():
        if t is None:
            assert d is None and w is None
            continue
        whole = unicodedata.normalize("NFD", t)
        assert d == whole, (name, t)
        assert w == "".join(c for c in whole if unicodedata.category(c) != "Mn"), (name, t)


def test_a_long_text_costs_little_more_than_one_translation(spark):
    """Its time beyond that of a small table is a few times that of translating the signs and dropping marks, not some dozens of times."""
    accented = "Año único, où l'été naît à Nîmes; größer, señal y acción. "
    few, many = (spark.createDataFrame([(accented * n,)] * 16, "t string").repartition(4).cache() for n in (1, 3000))

    def seconds(f) -> float:
        took = []
        for df in (few, many):
            each = []
            for _ in range(3):
                began = time.perf_counter()
                df.select(F.md5(f(F.col("t"))).alias("m")).agg(F.max("m")).collect()
                each.append(time.perf_counter() - began)
            took.append(min(each))
        return took[1] - took[0]

    few.count(), many.count()
    translating = seconds(names.strip_accents)
    taken = seconds(nfd.without_marks)
    few.unpersist(), many.unpersist()
    assert taken < 8 * max(translating, 0.05), (taken, translating)
