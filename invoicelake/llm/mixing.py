"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Sources, by code point and null last, have weights that repeat; together they get a share of all words. A target stops at ``most`` times
its source's words, and the excess is dealt again by weight. A document's copies then have the mean target / source
words: a whole part that each document gets, and a fraction, which the pivotal method rounds.

Two documents of one source are paired, and word mass moves from one to the other, in either direction at random, until the
fraction of one becomes 0 or 1; the chances make both means stay what they were, and the words of the pair stay exactly the
same. The other goes on to meet the next. So a source's words miss its target by less than one document.

The tree: documents are dealt by a hash of their ids and numbers into buckets of about ``bucket``; one task row folds a bucket and leaves one
residual. Residuals of a source are dealt again until one is left, which a last coin rounds. Levels number log(rows) / log(bucket),
each is written to the shared folder, and no group is larger than a bucket whatever the size of a source.

All random numbers are hashes of seed, level, document and, of equal rows, their number, so reruns agree, whatever the partitioning. Null and empty texts have no
words: size 0, taken 0. A null source is a source of its own. Rows that repeat a doc_id are rounded each on its own. An
empty table gives no rows. Other columns are kept by ``mixed_documents`` and left out by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_names, hot_keys, salted_join


def n_words(text: Column | str) -> Column:
    """Words of a text; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float, scratch: Scratch) -> DataFrame:
    """sizes (source, source_size, n) -> with ``target``. One row per source throughout.

    The place of a source is its rank by code point, found through a range partitioning: ranks within a partition plus the rows
    of the partitions before it. Each round gives what is left by weight to the sources still open and closes those above
    their bound, until none is.
    """
    spark = sizes.sparkSession
    dealt = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = scratch.store(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("long"))))
    parts = placed.groupBy("part").agg(F.count("*").alias("rows")).selectExpr("part", "coalesce(sum(rows) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("at") + F.col("before")) % len(weights) + 1).cast("int"))
    open_ = placed.join(parts, "part").select("source", "source_size", "n", cycle.alias("weight"), (F.col("source_size") * float(most)).alias("bound"))
    state = scratch.store(open_.withColumn("closed", F.col("bound") <= 0))
    total = state.agg(F.sum("source_size")).first()[0] or 0
    while True:
        left = state.agg(F.coalesce(F.sum(F.when(F.col("closed"), F.col("bound"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("closed"), F.col("weight"))), F.lit(0.0))).first()
        rate = (share * total - left[0]) / left[1] if left[1] else 0.0
        above = ~F.col("closed") & (F.col("weight") * rate > F.col("bound"))
        if not state.filter(above).limit(1).count():
            break
        state = scratch.store(state.withColumn("closed", F.col("closed") | above))
    return scratch.store(state.select("source", "source_size", "n", F.when(F.col("closed"), F.col("bound")).otherwise(F.col("weight") * rate).alias("target")))


#: Size comes first: buckets are folded from their largest document down, so that what is left over in the end is small.
_UNIT = "struct<size:bigint,key:bigint,doc:bigint,p:double,bit:int>"


def _fold(units: str, seed: int, level: int) -> str:
    """SQL that folds an array of units, in order, into (held, done). A unit has its document, key, size, fraction p and, once done, bit.

    m1 is the most mass that can move to the held unit, m2 the most that can move to the next one. Mass moves to the held unit with
    the chance m2 / (m1 + m2), else to the next; one of the two is then 0 or 1, and done.
    """
    m1 = "least(acc.held.size * (1 - acc.held.p), x.size * x.p)"
    m2 = "least(acc.held.size * acc.held.p, x.size * (1 - x.p))"
    to_held = f"({_draw(f'{seed}L, {level}L, acc.held.key, x.key')} * ({m1} + {m2}) < {m2})"
    held_done = f"if({to_held}, acc.held.size * (1 - acc.held.p) <= x.size * x.p, acc.held.size * acc.held.p <= x.size * (1 - x.p))"
    next_p = f"if({to_held}, greatest(0D, x.p - {m1} / x.size), least(1D, x.p + {m2} / x.size))"
    held_p = f"if({to_held}, least(1D, acc.held.p + {m1} / acc.held.size), greatest(0D, acc.held.p - {m2} / acc.held.size))"

    def unit(of: str, p: str, bit: str) -> str:
        return f"struct({of}.size as size, {of}.key as key, {of}.doc as doc, {p} as p, {bit} as bit)"

    return f"""
    aggregate(
      slice({units}, 2, size({units})),
      struct({units}[0] as held, cast(array() as array<{_UNIT}>) as done),
      (acc, x) -> if({held_done},
        struct({unit("x", next_p, "0")} as held, array_append(acc.done, {unit("acc.held", "0D", f"if({to_held}, 1, 0)")}) as done),
        struct({unit("acc.held", held_p, "0")} as held, array_append(acc.done, {unit("x", "0D", f"if({to_held}, 0, 1)")}) as done)))
    """


def _draw(of: str) -> str:
    """A uniform number in [0, 1) from a hash."""
    return f"((xxhash64({of}) & 9007199254740991L) / 9007199254740992D)"


def _rounded(units: DataFrame, scratch: Scratch, bucket: int, seed: int) -> DataFrame:
    """units (doc_id, source, n, size, copy, p), 0 < p < 1, size > 0, n units in the source -> (doc_id, source, size, bit)."""
    level, done = 0, None
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63))), "copy")
    unit = F.struct("size", key.alias("key"), F.col("doc_id").cast("long").alias("doc"), "p", F.lit(0).alias("bit"))
    state = units.select("source", F.col("n").alias("left"), unit.alias("unit"))
    while True:
        dealt = state.withColumn("buckets", F.expr(f"(left + {bucket - 1}) div {bucket}")).withColumn("at", F.expr(f"pmod(xxhash64({seed}L, {level}L, unit.key, unit.size), buckets)"))
        groups = dealt.groupBy("source", "buckets", "at").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        folded = scratch.store(groups.select("source", "buckets", F.expr(_fold("units", seed, level)).alias("f")))
        ended = folded.select("source", F.explode("f.done").alias("unit"))
        done = ended if done is None else done.unionByName(ended)
        state = folded.select("source", F.col("buckets").alias("left"), F.col("f.held").alias("unit"))
        level += 1
        if not folded.filter("buckets > 1").limit(1).count():
            break
    last = state.select("source", F.expr(f"named_struct('size', unit.size, 'key', unit.key, 'doc', unit.doc, 'p', 0D, 'bit', if({_draw(f'{seed}L, -1L, unit.key')} < unit.p, 1, 0))").alias("unit"))
    return done.unionByName(last).select(F.col("unit.doc").alias("doc_id"), "source", F.col("unit.size").alias("size"), F.col("unit.bit").alias("bit"))


#: Up to so many sources are sent to every executor; more are joined by a shuffle that deals out large ones.
BROADCAST_SOURCES = 100_000


def _with_source(rows: DataFrame, sources: DataFrame, few: bool, total: int) -> DataFrame:
    """rows (of, ...) with their source's row."""
    if few:
        return rows.join(F.broadcast(sources), "of")
    return salted_join(rows, sources, ["of"], hot_keys(sources, ["of"], total, "rows"), F.xxhash64("doc_id", "size"))


#: Equal rows that one task numbers.
RUN = 10_000


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size) with ``copy``, which tells rows apart that are equal: they are counted, and each count is dealt out again. Long runs are
    dealt to several tasks."""
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    run = lambda first, last: F.explode(F.sequence(first, last)).alias("copy")
    short = counted.filter(F.col("n") <= RUN).select("doc_id", "source", "size", run(F.lit(1).cast("long"), F.col("n")))
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RUN).cast("long"))).alias("first")
    runs = counted.filter(F.col("n") > RUN).select("doc_id", "source", "size", "n", first).repartition("doc_id", "source", "size", "first")
    return short.unionByName(runs.select("doc_id", "source", "size", run(F.col("first"), F.least(F.col("n"), F.col("first") + (RUN - 1)))))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, bucket: int = 96, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.store(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.struct(F.count_if(F.col("size") > 0).alias("worded"), F.count("*").alias("rows")).alias("n"))
    sources = targets(sizes, weights, share, most, scratch)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    of = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("of")
    sources = sources.select(of, "source_size", "n.worded", "n.rows", "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"))
    few, total = sources.count() <= BROADCAST_SOURCES, rows.count()

    keyed = _with_source(_numbered(rows).select("*", of), sources, few, total).withColumn("open", (F.col("p") > 0) & (F.col("size") > 0))
    bits = _rounded(keyed.filter("open").select("doc_id", "source", F.col("worded").alias("n"), "size", "copy", "p"), scratch, bucket, seed)
    fixed = keyed.filter("not open").select("doc_id", "source", "size", F.lit(0).alias("bit"))
    out = _with_source(fixed.unionByName(bits).select("*", of), sources, few, total)
    copies = (F.col("whole") + F.col("bit")).cast("long")
    out = scratch.store(out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")))
    scratch.keep(out)
    return out


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as it is taken. Rows without words are taken as their source's are
    at least."""
    chosen = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    words, doc, source, size, least, more, own, again = free_names(docs.columns, "_words", "_doc", "_source", "_size", "_least", "_more", "_own", "_again")
    chosen = chosen.groupBy(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size)).agg(F.min("copies").alias(least), (F.sum("copies") - F.min("copies") * F.count("*")).alias(more))
    keyed = docs.withColumn(words, n_words(text_col))
    match = keyed[id_col].cast("long").eqNullSafe(F.col(doc)) & keyed[source_col].cast("string").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    place = f"row_number() over (partition by {doc}, {source}, {size} order by 1)"
    with_copies = keyed.join(chosen, match).withColumn(own, F.col(least) + F.when(F.expr(place) <= F.col(more), 1).otherwise(0))
    return with_copies.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(own, F.lit(1).cast("long"))))).filter(F.col(again) <= F.col(own)).select(*docs.columns)
