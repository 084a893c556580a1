"""Ordered keyword rules in a table, found by an index of q-grams: no text is compared with all keywords.

A text holds a keyword only if it holds each of the keyword's q-grams, so one of them will do as its index entry: the one that fewest keywords
have. The q-grams of the texts are joined with the index by equality, and only the pairs that meet there are tested. Keywords of fewer than q signs are their
own entries among runs of their length, and need no test; the empty keyword is in every text. Rules are numbered by priority, so a text's first
rule is the least number it meets.

A keyword of letters and digits alone is in a text only if it is in one of the text's words. So such keywords meet the vocabulary, each distinct word once,
and a text takes the least number of its words; only keywords that reach over several words meet the runs of whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import joins
from ..functions.names import strip_accents
from ..stages import release, row_numbers, stage

#: Signs of an index entry. Longer ones meet fewer texts in vain.
Q = 5
#: Up to so many keywords are tested one by one.
FEW = 100
#: What stands between words: ASCII signs but small letters and digits (plain texts have no capitals).
_BETWEEN = r"[\x00-/:-`{-\x7F]"


def plain(text: Column) -> Column:
    """How texts are compared: lower case, no accents; null is empty."""
    return strip_accents(F.lower(F.coalesce(text, F.lit(""))))


def grams(text: Column, q: int) -> Column:
    """The runs of q signs. A look-ahead takes them in one pass; cutting the text at each place would start from its beginning
    each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def _cut(texts: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """texts (keep, _t) with ``gram``: all runs of these sizes. One pass along a text gives the longest at each place, and the others are their
    beginnings; what is cut short by the text's end is in the text all the same."""
    if not sizes:
        return texts.limit(0).select(*keep, F.lit("").alias("gram"))
    runs = texts.select(*keep, F.explode(F.regexp_extract_all("_t", F.lit(f"(?s)(?=(.{{1,{max(sizes)}}}))"), F.lit(1))).alias("_run"))
    return runs.select(*keep, F.explode(F.array(*(F.substring("_run", 1, q) for q in sizes))).alias("gram"))


def _sizes(rules: DataFrame) -> list[int]:
    return sorted(r[0] for r in rules.select(F.least(F.length("clave"), F.lit(Q)).alias("q")).filter("q > 0").distinct().collect())


def index(rules: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """rules (clave, rango) -> (gram, clave, rango): each keyword at its rarest q-gram, by ``frequency`` (gram, n); one that isn't there counts as the rarest.
    Without, by how many keywords have it. Of equally rare ones the first by code point. Of one keyword's rules the first is kept."""
    best = rules.filter("clave <> ''").groupBy("clave").agg(F.min("rango").alias("rango"))
    own = F.when(F.length("clave") < Q, F.array("clave")).otherwise(F.array_distinct(grams(F.col("clave"), Q)))
    each = best.select("clave", "rango", F.explode(own).alias("gram"))
    if frequency is None:
        frequency = each.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(frequency, "gram", "left").groupBy("clave").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"), F.first("rango").alias("rango"))
    return rarest.select("g.gram", "clave", "rango")


def _hits(texts: DataFrame, ranked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """texts (_id, _t), keywords (clave, rango) -> (_id, _hit), the least number of a keyword in the text, where there is one; and the stored tables it is read from.
    ``texts`` are read twice where the index is too large to be sent."""
    if ranked.count() <= FEW:
        tested = texts.join(F.broadcast(ranked), F.contains("_t", "clave"))
        return tested.groupBy("_id").agg(F.min("rango").alias("_hit")), []
    placed, sizes = stage(index(ranked)), _sizes(ranked)
    found = (F.col("gram") == F.col("clave")) | F.contains("_t", "clave")
    if placed.count() <= joins.BROADCAST_ROWS:
        tested = _cut(texts, sizes, "_id", "_t").join(F.broadcast(placed), "gram").filter(found)
        return tested.groupBy("_id").agg(F.min("rango").alias("_hit")), [placed]
    each = stage(_cut(texts, sizes, "_id").join(placed.select("gram").distinct(), "gram", "left_semi").distinct())
    pairs = stage(joins.lookup(each, placed, ["gram"], spread=F.xxhash64("_id")).select("_id", "gram", "clave", "rango").distinct(), each)
    tested = joins.lookup(pairs, texts, ["_id"], spread=F.xxhash64("clave")).filter(found)
    return tested.groupBy("_id").agg(F.min("rango").alias("_hit")), [placed, pairs]


def _by_words(texts: DataFrame, ranked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``_hits`` for keywords within words. The commonest words, as many as may be broadcast, are looked up where the texts are; of the others each has
    few texts, so a shuffle of them stays even."""
    words = texts.select("_id", F.explode(F.array_distinct(F.split("_t", f"{_BETWEEN}+"))).alias("word")).filter("word <> ''")
    vocabulary = stage(words.groupBy("word").agg(F.count("*").alias("n")).withColumn("_w", F.monotonically_increasing_id()))
    found, parts = _hits(vocabulary.select(F.struct("_w").alias("_id"), F.col("word").alias("_t")), ranked)
    found = found.select("_id._w", "_hit")
    known = stage(vocabulary.join(found, "_w", "left").select("word", "_hit", F.floor(F.log2("n")).alias("size")), *parts, vocabulary)
    common, least = 0, 64
    for size, n in sorted(map(tuple, known.groupBy("size").count().collect()), reverse=True):  # at most 64 rows
        common += n
        if common > joins.BROADCAST_ROWS:
            break
        least = size
    near = known.filter(F.col("size") >= least).select("word", F.col("_hit").alias("_near"), F.lit(True).alias("_known"))
    met = words.join(F.broadcast(near), "word", "left").select("_id", F.when(F.col("_known").isNull(), F.col("word")).alias("word"), F.col("_near").alias("_hit"))
    met = stage(met.filter("word is not null or _hit is not null").groupBy("_id", "word").agg(F.min("_hit").alias("_hit")))
    far = known.filter((F.col("size") < least) & F.col("_hit").isNotNull()).select("word", "_hit")
    rare = met.filter("word is not null").select("_id", "word").join(far.hint("merge"), "word").select("_id", "_hit")
    return met.filter("_hit is not null").select("_id", "_hit").unionByName(rare), [known, met]


def by_index(df: DataFrame, id_col: str, text: Column, rules: DataFrame, default: str | None) -> DataFrame:
    """(id, codigo): the code of the first rule (prio, codigo, clave) with a keyword in the text, by prio and then code; else ``default``. Keywords match
    within words, as they are written in the table. Rows that repeat an id are one text in parts; null texts count as empty, null keywords
    match nothing. ``df`` is read once.

    Up to ``joins.BROADCAST_ROWS`` keywords are sent to every executor. A larger index is joined by a shuffle of q-grams and ids that deals out common
    q-grams; what is cut into q-grams is the vocabulary, and whole texts only for keywords that reach over several words.
    """
    named = rules.select(F.struct(F.col("prio").cast("int").alias("prio"), F.col("codigo").cast("string").alias("codigo")).alias("regla"), F.col("clave").cast("string").alias("clave"))
    named = stage(named.filter("clave is not null"))
    ranks = row_numbers(named.select("regla").distinct(), ["regla"], "rango")
    ranked = stage(named.join(ranks, "regla").groupBy("clave").agg(F.min("rango").alias("rango")))
    always = ranked.filter("clave = ''").agg(F.min("rango")).first()[0]
    filled = ranked.filter("clave <> ''")
    texts = stage(df.select(F.struct(F.col(id_col).alias("id")).alias("_id"), plain(text).alias("_t")))  # an id that isn't null
    over = F.col("clave").rlike(_BETWEEN)
    if filled.count() <= FEW:
        hits, parts = _hits(texts, filled)
    else:
        hits, parts = _by_words(texts, filled.filter(~over))
        if filled.filter(over).limit(1).count():
            across, more = _hits(texts, filled.filter(over))
            hits, parts = hits.unionByName(across), parts + more
    hits = hits.groupBy("_id").agg(F.min("_hit").alias("_hit"))
    first = F.col("_hit") if always is None else F.least("_hit", F.lit(always))
    met = stage(texts.select("_id").distinct().join(hits, "_id", "left").select("_id", first.alias("rango")), *parts, texts)
    codes = joins.lookup(met, ranks, ["rango"], "left", spread=F.xxhash64("_id"))
    return stage(codes.select(F.col("_id.id").alias(id_col), F.when(F.col("rango").isNull(), F.lit(default)).otherwise(F.col("regla.codigo")).alias("codigo")), met, named, ranked, ranks)
