"""Tables of names joined where two names are the same firm's: two words in common at least, and 60 % of the shorter name's.

Names of equal words are one class. What is asked for is how many partners a name has and which is the least, so nothing needs pairs, of which there
may be as many as the square of the names: of three words, all names that share two are each other's partners. Instead every class gives its sets of
two words and more, and sets are counted. With S(j) the sum of the counts of a name's sets of j words, those that have at least t words
in common with it are the sum over j >= t of (-1)**(j - t) * C(j - 1, t - 1) * S(j), exactly (inclusion and exclusion). t depends on the shorter name, so sets are
counted apart by the sizes of the names they come from.

A name of w words has 2**w - w - 1 such sets. Names of more than MOST_WORDS, and theirs alone, are met in pairs. For these words are
ordered by how many classes have them, rarest first. The shorter of two names, of a words, needs t = max(2, 60 % of a) in common, so one of its first a - t + 1 words is in the other, and, as two words are needed at
least, not only as the other's last. Classes meet on such prefix words alone; the commonest word of a name is never one. A pair
that meets on several words is tested at the first of them, so no list of pairs is sorted out.

What comes out is summed up for each class, then joined with its names.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import joins
from ..functions import names
from ..stages import release, stage

#: Names of up to so many words are met by their sets of words: 247 for 8.
MOST_WORDS = 8


def needed(words: Column) -> Column:
    """The least number of common words for a shorter name of so many words."""
    return F.greatest(F.lit(2), F.call_function("div", words * 3 + 4, F.lit(5)).cast("int"))


def class_pairs(classes: DataFrame, longer: int = 0) -> DataFrame:
    """classes (clase, words array<string>, distinct words; clase is unique) -> (a, b), a < b: each two classes that are the same firm's, once; of these, pairs with
    a class of more than ``longer`` words. The input is read three times: store it first."""
    each = stage(classes.filter("size(words) >= 2").select("clase", F.explode("words").alias("word")))
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    ranked = joins.lookup(each, counts, ["word"], spread=F.xxhash64("clase")).groupBy("clase").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
    ordered = stage(ranked.select("clase", F.transform("ranked", lambda w: w["word"]).alias("words")), each)
    size = F.size("words")
    prefix = ordered.select("clase", "words", size.alias("size"), (size - needed(size) + 1).alias("short"), F.posexplode(F.slice("words", F.lit(1), size - 1)).alias("at", "word"))
    prefix = stage(prefix)
    # the rows of a common prefix word are dealt out on one side and repeated for each share on the other
    hot = stage(joins.hot_keys(prefix, ["word"]))
    left = prefix.join(F.broadcast(hot), "word", "left").withColumn("way", F.pmod(F.xxhash64("clase"), F.coalesce("_ways", F.lit(1))).cast("int")).drop("_ways")
    right = prefix.join(F.broadcast(hot), "word", "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))).drop("_ways")
    l = left.filter(F.col("size") > longer).select("word", "way", *(F.col(c).alias(f"{c}_l") for c in ("clase", "words", "size", "short", "at")))  # noqa: E741
    r = right.select("word", "way", *(F.col(c).alias(f"{c}_r") for c in ("clase", "words", "size", "short", "at")))
    met = l.join(r, ["word", "way"]).filter((F.col("clase_l") < F.col("clase_r")) | (F.col("size_r") <= longer))
    # the shorter one's word is in its short prefix; of two as long, the left one counts as the shorter
    reach_l, reach_r = F.when(F.col("size_l") <= F.col("size_r"), F.col("short_l")).otherwise(F.col("size_l") - 1), F.when(F.col("size_l") > F.col("size_r"), F.col("short_r")).otherwise(F.col("size_r") - 1)
    met = met.withColumns({"reach_l": reach_l, "reach_r": reach_r}).filter("at_l < reach_l and at_r < reach_r")
    first = F.element_at(F.array_intersect(F.slice("words_l", F.lit(1), F.col("reach_l")), F.slice("words_r", F.lit(1), F.col("reach_r"))), 1)
    both = F.size(F.array_intersect("words_l", "words_r"))
    same = met.filter((first == F.col("word")) & (both >= needed(F.least("size_l", "size_r"))))
    out = stage(same.select(F.least("clase_l", "clase_r").alias("a"), F.greatest("clase_l", "clase_r").alias("b")), prefix, hot)
    release(ordered)
    return out


def _classes(rows: DataFrame) -> DataFrame:
    """rows (id, words, mine, theirs) by equal words: how many are on either side, and the two least ids of the other side."""
    key = F.array_join("words", " ")
    per = rows.groupBy(key.alias("clase")).agg(
        F.first("words").alias("words"), F.count_if("theirs").alias("n"), F.min(F.when(F.col("theirs"), F.col("id"))).alias("least"), F.count_if("mine").alias("asking")
    )
    return stage(per)


def _word_sets(words: Column) -> Column:
    """All sets of two of the words and more: array<struct<set, j>>, j the number of words. Words are ascending and have no spaces."""
    masks = F.filter(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(words)) - 1), lambda m: F.bit_count(m) >= 2)
    chosen = lambda m: F.filter(words, lambda w, k: m.bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0)
    return F.transform(masks, lambda m: F.struct(F.array_join(chosen(m), " ").alias("set"), F.bit_count(m).cast("int").alias("j")))


def _weight(j: Column, t: Column) -> Column:
    """(-1)**(j - t) * C(j - 1, t - 1), 0 for j < t."""
    table = [[(-1) ** (b - a) * comb(b - 1, a - 1) if b >= a else 0 for a in range(1, MOST_WORDS + 1)] for b in range(1, MOST_WORDS + 1)]
    return F.element_at(F.element_at(F.array(*(F.array(*map(F.lit, row)) for row in table)), j), t).cast("long")


def _by_sets(classes: DataFrame) -> DataFrame:
    """classes of up to MOST_WORDS words -> (clase, n, l1, l2) in parts to be added up: partners, the least id among them, and the least but for the class's own least."""
    short = classes.filter(F.size("words").between(2, MOST_WORDS)).select("clase", "n", "least", "next", "asking", F.size("words").alias("size"), F.explode(_word_sets(F.col("words"))).alias("s"))
    sets = stage(short.select("clase", "n", "least", "next", "asking", "size", "s.set", "s.j"))
    theirs = sets.filter("n > 0").select("set", F.col("size").alias("size_r"), "n", "least", "next")
    sums = theirs.groupBy("set", "size_r").agg(F.sum("n").alias("n_r"))
    # the two least ids of a set: a common set's rows are cut down to two in each task before they are shuffled
    firsts = theirs.withColumn("at", F.row_number().over(W.partitionBy("set", "size_r").orderBy("least"))).filter("at <= 2")
    firsts = firsts.groupBy("set", "size_r").agg(F.min("least").alias("l1"), F.min(F.when(F.col("at") == 1, F.col("next")).otherwise(F.col("least"))).alias("l2"))
    there = stage(sums.join(firsts, ["set", "size_r"]))
    asking = sets.filter("asking > 0").select("clase", "size", "set", "j", F.col("least").alias("own"))
    met = joins.lookup(asking, there.hint("merge"), ["set"], spread=F.xxhash64("clase"))
    t = needed(F.least("size", "size_r"))
    met = met.filter(F.col("j") >= t).select("clase", (_weight(F.col("j"), t) * F.col("n_r")).alias("n"), "l1", F.when(F.col("l1") == F.col("own"), F.col("l2")).otherwise(F.col("l1")).alias("l2"))
    return stage(met.groupBy("clase").agg(F.sum("n").alias("n"), F.min("l1").alias("l1"), F.min("l2").alias("l2")), sets, there)


def _by_pairs(classes: DataFrame) -> DataFrame:
    """The same parts for pairs with a class of more than MOST_WORDS words, and for such a class with itself."""
    pairs = class_pairs(classes, MOST_WORDS)
    ways = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), pairs)
    there = classes.filter("n > 0").select(F.col("clase").alias("b"), "n", "least")
    others = joins.lookup(ways, there.hint("merge"), ["b"], spread=F.xxhash64("a")).groupBy(F.col("a").alias("clase")).agg(F.sum("n").alias("n"), F.min("least").alias("l1"), F.min("least").alias("l2"))
    own = classes.filter((F.size("words") > MOST_WORDS) & (F.col("n") > 0)).select("clase", "n", F.col("least").alias("l1"), F.col("next").alias("l2"))
    return stage(others.unionByName(own), ways)


def _partners(rows: DataFrame, itself: bool) -> DataFrame:
    """rows (id, words, mine, theirs), stored -> id, partners, least_partner for those that are mine."""
    classes = _classes(rows)
    asked = stage(rows.filter("mine").select("id", F.array_join("words", " ").alias("clase")))
    if itself:  # the least of a class has the next one for a partner
        several = classes.filter("n > 1").select("clase", "least")
        later = joins.lookup(asked, several.hint("merge"), ["clase"], spread=F.xxhash64("id")).filter("id > least").groupBy("clase").agg(F.min("id").alias("next"))
        classes = stage(classes.join(later, "clase", "left"), classes)
    else:
        classes = stage(classes.withColumn("next", F.lit(None).cast(classes.schema["least"].dataType)), classes)
    sets = _by_sets(classes)
    parts, done = sets, [sets]
    if not classes.filter(F.size("words") > MOST_WORDS).isEmpty():
        done.append(_by_pairs(classes))
        parts = sets.unionByName(done[-1])
    found = parts.groupBy("clase").agg(F.sum("n").alias("n"), F.min("l1").alias("l1"), F.min("l2").alias("l2"))
    asking = classes.filter("asking > 0").select("clase", F.col("least").alias("own"))
    found = stage(asking.join(found, "clase"), classes, *done)
    out = joins.lookup(asked, found.hint("merge"), ["clase"], "left", spread=F.xxhash64("id"))
    least = F.when(F.col("id") == F.col("own"), F.col("l2")).otherwise(F.col("l1")) if itself else F.col("l1")
    return stage(out.select("id", F.coalesce(F.col("n") - int(itself), F.lit(0)).alias("partners"), least.alias("least_partner")), asked, found)


def _worded(df: DataFrame, id_col: str, name_col: str, mine: bool, theirs: bool) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), names.tokens(F.col(name_col)).alias("words"), F.lit(mine).alias("mine"), F.lit(theirs).alias("theirs"))


def within(df: DataFrame, *, id_col: str = "id", name_col: str = "nombre") -> DataFrame:
    """id, partners, least_partner: for each name of a table, how many others of it are the same firm's, and the least id of these (null: none). Ids are
    unique and not null. Null names and names of fewer than two words have no partners."""
    rows = stage(_worded(df, id_col, name_col, True, True))
    out = _partners(rows, True)
    release(rows)
    return out.withColumnRenamed("id", id_col)


def across(left: DataFrame, right: DataFrame, *, id_col: str = "id", name_col: str = "nombre") -> DataFrame:
    """The same for each name of ``left`` among those of ``right``, both with (id, nombre): clients against the parties of a batch, for instance. Ids are unique in
    each table."""
    rows = stage(_worded(left, id_col, name_col, True, False).unionByName(_worded(right, id_col, name_col, False, True)))
    out = _partners(rows, False)
    release(rows)
    return out.withColumnRenamed("id", id_col)
