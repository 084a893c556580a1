"""Source divergence audit: how each source's words differ from its language's and from other sources', in exact whole numbers.

Terms are runs of letters A-Z and of characters beyond ASCII; only A-Z are lower-cased. Of each language those in at least ``min_docs``
of its documents are kept, V of them. A group (a language's source) or a language has p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)) for
each kept term, N being its occurrences of kept terms; f(p, q) = floor((p - q) ** 2 / (p + q)).

``pair``: f summed over all kept terms, for each two sources of a language. Postings compute it: a term that neither source has adds
f(p0, q0) of the two smallest p, one that only one has is in that source's histogram of counts, and one that both have is met in its posting
list, where all that is kept of it is its pair of counts. So a language's kept terms never meet its pairs of sources:

    value = V * f(p0, q0) + sum over a's terms of f(p, q0) - f(p0, q0) + sum over b's terms of f(p0, q) - f(p0, q0)
            + sum over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

``term``: the ``top`` terms of a group with p > q, q being the language's. f grows with p and falls with q, so that f(highest p, lowest q)
bounds all terms of a bucket of counts. Buckets are evaluated best first, in two waves: those of the highest bounds that hold ``top``
terms, then those whose bounds aren't strictly below the last of these. What is left can't enter, nor tie. Stored terms are sorted by
bucket, so a wave's filter skips the rest of each file.

Words are counted within tasks, then by partial aggregates on (language, source, term): a group with a third of all rows is no large
task. A posting list has at most one entry for each source of the language; as many sources as the result has rows for each group.

Null text, lang and source count as ''. Texts without terms make groups without terms: their pairs are there, at what p0 gives. Rows that
repeat a doc_id are documents of their own. A language without kept terms has pairs of value 0. An empty table gives no rows. Other
columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch_columns, hot_keys, salted_join

SCALE = 1_000_000_000
#: Up to so many groups (some 50 bytes each) are sent to every executor; more are joined by a shuffle that deals out large ones.
BROADCAST_GROUPS = 100_000
#: Entries that a task's counts hold before they are passed on.
HELD = 400_000
#: All bytes but letters and those of characters beyond ASCII become spaces, A-Z become a-z.
_TO_TERMS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(utf8: bytes) -> list[bytes]:
    """The terms of a text, in its order. UTF-8 bytes of characters beyond ASCII are all above 127, so bytes will do."""
    return utf8.translate(_TO_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows, in part sums; the empty term marks a group that occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [[lang] * len(terms), [source] * len(terms), terms, n.values(), [docs[t] for t in terms]]
            table = pa.table([pa.array(list(c), t) for c, t in zip(columns, _COUNTED.types)], schema=_COUNTED)
            yield from table.to_batches(max_chunksize=50_000)
        held.clear()

    for langs, sources, texts in batch_columns(batches, "lang", "source", "utf8"):
        rows: dict[tuple[str, str], list[list[bytes]]] = {}
        for lang, source, utf8 in zip(langs, sources, texts):
            rows.setdefault((lang, source), []).append(terms_of(utf8))
        for key, found in rows.items():
            n, docs = held.setdefault(key, (Counter({b"": 0}), Counter({b"": 0})))
            n.update(chain.from_iterable(found))
            docs.update(chain.from_iterable(map(set, found)))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def chance(count: Column | str, size: Column | str) -> Column:
    """p of a count in a group of size N + 2 * V; decimals, so that counts of any corpus fit."""
    c, s = (F.col(x) if isinstance(x, str) else x for x in (count, size))
    share = F.call_function("div", (c.cast("decimal(19,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)"), F.when(s > 0, s).cast("decimal(19,0)"))
    return (share + 1).cast("long")


def distance(p: Column | str, q: Column | str) -> Column:
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def bucket_of(count: Column) -> Column:
    """Eight buckets for each doubling of the count, by whole numbers alone: the bit length and the three bits behind the first."""
    length = F.length(F.bin(count))
    behind = F.call_function("shiftright", F.call_function("shiftleft", count, F.lit(3)), (length - 1).cast("int")).bitwiseAND(F.lit(7).cast("long"))
    return (length * 8 + behind).cast("int")


class Audit:
    """One run: ``groups`` (lang, source, n, v, size, p0, lang_size) and ``postings`` (lang, term, n, postings), both stored; from
    them the results of ``pairs`` and ``terms``."""

    def __init__(self, docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10):
        self.work = Scratch(docs.sparkSession, "divergence")
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), as_bytes(F.col(text_col)).alias("utf8"))
        counted = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
        counted = counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        counted = self.work.store(counted)
        kept = counted.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("postings"))
        self.postings = self.work.store(kept.filter(F.col("docs") >= min_docs).select("lang", "term", "n", "postings"))
        present = counted.filter("term = ''").select("lang", "source")
        sizes = self.postings.select("lang", F.explode("postings").alias("p")).groupBy("lang", "p.source").agg(F.sum("p.n").alias("n"))
        langs = self.postings.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
        groups = present.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "lang_n")))
        groups = groups.select("lang", "source", "n", "v", F.expr("n + 2 * v").alias("size"), F.expr("lang_n + 2 * v").alias("lang_size"))
        self.groups = self.work.store(groups.withColumn("p0", chance(F.lit(0), "size")))
        self.work.drop(counted)
        self.n_groups = self.groups.count()

    def _join(self, rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
        """rows with what ``groups`` has for their keys."""
        if self.n_groups <= BROADCAST_GROUPS:
            return rows.join(F.broadcast(groups), keys)
        rows = self.work.store(rows)
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        return salted_join(rows, groups, keys, hot_keys(counts, keys, rows.count()), F.xxhash64(*rows.columns))

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the lang), value: both ways round."""
        g = self.groups
        one = g.select("lang", F.col("source").alias("a"), F.col("size").alias("size_a"), F.col("p0").alias("p0_a"))
        other = g.select("lang", F.col("source").alias("b"), F.col("size").alias("size_b"), F.col("p0").alias("p0_b"))
        # what a source's own terms add, for each other source: its histogram of counts meets the others' p0
        counts = self.postings.select("lang", F.explode("postings").alias("p")).groupBy("lang", F.col("p.source").alias("a"), F.col("p.n").alias("c")).agg(F.count("*").alias("k"))
        own = self._join(self._join(counts, one, ["lang", "a"]).withColumn("p", chance("c", "size_a")), other, ["lang"]).filter("a <> b")
        own = own.groupBy("lang", "a", "b").agg(F.sum(F.col("k") * (distance("p", "p0_b") - distance("p0_a", "p0_b"))).alias("own"))
        # what terms of both sources change: posting lists give pairs of counts, which are summed up before they are evaluated
        met = self.postings.filter("size(postings) > 1").select("lang", F.explode("postings").alias("x"), "postings")
        met = met.select("lang", "x", F.explode(F.filter("postings", lambda y: y["source"] > F.col("x.source"))).alias("y"))
        met = met.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("c_a"), F.col("y.n").alias("c_b")).agg(F.count("*").alias("k"))
        met = self._join(self._join(met, one, ["lang", "a"]), other, ["lang", "b"]).withColumn("p", chance("c_a", "size_a")).withColumn("q", chance("c_b", "size_b"))
        both = distance("p", "q") - distance("p", "p0_b") - distance("p0_a", "q") + distance("p0_a", "p0_b")
        met = met.groupBy("lang", "a", "b").agg(F.sum(F.col("k") * both).alias("met"))
        met = met.unionByName(met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "met"))

        every = self._join(g.select("lang", F.col("source").alias("a"), "v", "p0"), other, ["lang"]).filter("a <> b")
        turned = own.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("own").alias("theirs"))
        for part in (own, turned, met):
            every = every.join(part, ["lang", "a", "b"], "left")
        value = F.col("v") * distance("p0", "p0_b") + sum((F.coalesce(c, F.lit(0)) for c in ("own", "theirs", "met")), F.lit(0))
        return every.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.when(F.col("v") > 0, value).otherwise(0).cast("long").alias("value"))

    def terms(self, top: int = 10) -> DataFrame:
        """lang, source, item, value, rank: the ``top`` terms of each group with p > q."""
        entries = self.postings.select("lang", "term", F.col("n").alias("lang_n"), F.explode("postings").alias("x")).select("lang", F.col("x.source").alias("source"), "term", F.col("x.n").alias("n"), "lang_n")
        entries = self._join(entries, self.groups.select("lang", "source", "size", "lang_size"), ["lang", "source"])
        entries = entries.select("lang", "source", "term", chance("n", "size").alias("p"), chance("lang_n", "lang_size").alias("q"), bucket_of(F.col("n")).alias("bucket")).filter("p > q")
        entries = self.work.store(entries.sortWithinPartitions("bucket"))
        buckets = entries.groupBy("lang", "source", "bucket").agg(F.count("*").alias("k"), F.max("p").alias("p"), F.min("q").alias("q"))
        buckets = self.work.store(buckets.withColumn("bound", distance("p", "q")))
        best = W.partitionBy("lang", "source").orderBy(F.desc("bound"), F.desc("bucket"))  # at most eight buckets for each doubling of counts
        ahead = buckets.withColumn("ahead", F.coalesce(F.sum("k").over(best.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        first = self.work.store(ahead.filter(F.col("ahead") < top).select("lang", "source", "bucket"))
        found = self.work.store(self._best(self._evaluated(entries, first), top))
        least = found.groupBy("lang", "source").agg(F.min("value").alias("kth"), F.count("*").alias("have"))
        second = buckets.join(first, ["lang", "source", "bucket"], "left_anti").join(least, ["lang", "source"]).filter((F.col("have") < top) | (F.col("bound") >= F.col("kth")))
        second = self.work.store(second.select("lang", "source", "bucket"))
        both = found.select("lang", "source", "item", "value").unionByName(self._evaluated(entries, second))
        return self._best(both, top)

    def _evaluated(self, entries: DataFrame, chosen: DataFrame) -> DataFrame:
        """The terms of the chosen buckets, with their values. Files are sorted by bucket: rows below the least chosen one aren't read."""
        least = chosen.agg(F.min("bucket")).first()[0]
        rows = entries.filter(F.col("bucket") >= F.lit(1 << 30 if least is None else least))
        if chosen.count() <= BROADCAST_GROUPS:
            rows = rows.join(F.broadcast(chosen), ["lang", "source", "bucket"])
        else:
            counts = rows.groupBy("lang", "source", "bucket").agg(F.count("*").alias("n"))
            rows = salted_join(rows, chosen, ["lang", "source", "bucket"], hot_keys(counts, ["lang", "source", "bucket"], rows.count()), F.xxhash64("term"))
        return rows.select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))

    @staticmethod
    def _best(values: DataFrame, top: int) -> DataFrame:
        """The ``top`` values of each group; each task passes on its own best alone."""
        order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return values.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: from 1 for each group and part, by value descending, then item."""
    run = Audit(docs, text_col=text_col, lang_col=lang_col, source_col=source_col, min_docs=min_docs)
    pairs = run.pairs().withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = ("lang", "source", "part", "item", "value", "rank")
    out = run.work.store(pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(run.terms(top).withColumn("part", F.lit("term")).select(*columns)))
    run.work.keep(out)
    return out
