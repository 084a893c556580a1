"""Near-duplicate classes by the Jaccard similarity of word n-grams: an exact PartEnum join.

1. One pass over the texts gives each document's set size, a 128-bit fingerprint of its set, a parity sketch and its PartEnum
   signatures. Documents of equal sets form a class, whose number is its least doc_id from here on; signatures are told once for each class.
2. Signatures that two classes share make buckets. In each, members are paired with the bucket's least member only; pairs that size and
   sketch don't rule out are checked exactly, and those that hold are links.
3. Buckets whose members still lie in several components are searched for further links between different components. Their
   members are dealt in blocks, and a task compares two blocks' sizes and sketches with vector operations and gives only the
   pairs that survive, which are checked exactly in turn.

So a class of thousands of near copies costs one check for each member, yet no link between different components is
lost: the components are those of the full join. Exact checks read the sets of surviving documents alone.

Null texts and texts without words: an empty set, linked with nothing. Texts with fewer words than ``size``: the whole sequence is the one
shingle. Rows that repeat a doc_id are one document, whose texts may differ: what any of them is linked to, all are; each row is
returned. Rows with a null doc_id are returned with a null component and linked with nothing. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_HOT_KEYS, Scratch, as_bytes, batch_columns, hot_keys, n_shuffle, salted_join, seen_twice
from .components import components
from .grouping import groups, sorted_groups
from .partenum import folded, signatures, sketch
from .shingles import mix, shingle_set

#: Members of one block in step 3.
BLOCK = 1024
#: Up to so many documents or signatures (8 to 24 bytes each) are sent to every executor to pick out their rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _print(s: np.ndarray) -> tuple[int, int]:
    """A set's fingerprint."""
    return tuple(int(mix(s ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (0x51, 0xA7C3))


def _fingerprints(size: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.binary()), ("sigs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for doc_ids, texts in batch_columns(batches, "doc_id", "utf8"):
            rows = []
            for doc_id, utf8 in zip(doc_ids, texts):
                s = shingle_set(utf8, size)
                h1, h2 = _print(s)
                new = len(s) > 0 and doc_id is not None and (h1, h2) not in seen
                if new:
                    seen.add((h1, h2))
                    if len(seen) > 1_000_000:
                        seen.clear()
                rows.append((doc_id, len(s), h1, h2, sketch(s).tobytes(), signatures(s, percent).view(np.int64) if new else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _sets(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int, int]] = set()  # rows may repeat
        for doc_ids, texts in batch_columns(batches, "doc_id", "utf8"):
            rows = []
            for doc_id, utf8 in zip(doc_ids, texts):
                s = shingle_set(utf8, size)
                key = (doc_id, *_print(s))
                if key not in told:
                    told.add(key)
                    rows.append((*key, s.tobytes()))
            if len(told) > 500_000:
                told.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _exact(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, x, y in batch_columns(batches, "a", "b", "set_a", "set_b"):
            keep = []
            for k in range(len(a)):
                s, t = np.frombuffer(x[k], np.uint64), np.frombuffer(y[k], np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for k in keep], pa.int64()) for v in (a, b)], schema=schema)

    return run


def _open_pairs(percent: int, lo: np.ndarray, hi: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether sizes and differing sketch bits leave a pair open."""
    return (100 * lo >= percent * hi) & (bits * (100 + percent) <= (100 - percent) * (lo + hi))


def _sift(percent: int):
    """Pairs (a, b, sizes, sketches) that stay open."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, n_a, n_b, s_a, s_b in batch_columns(batches, "a", "b", "n_a", "n_b", "sketch_a", "sketch_b"):
            keep = []
            for k in range(len(a)):
                lo, hi = sorted((n_a[k], n_b[k]))
                if 100 * lo >= percent * hi:
                    x, y = np.frombuffer(s_a[k], "<u8"), np.frombuffer(s_b[k], "<u8")
                    words = min(len(x), len(y))
                    if _open_pairs(percent, lo, hi, int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())):
                        keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for k in keep], pa.int64()) for v in (a, b)], schema=schema)

    return run


def _block_pairs(percent: int):
    """Groups are (bucket, block, block): pairs of different components that stay open."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()  # many buckets hold the same pair
        for g in groups(batches, ["sig", "bi", "bj"]):
            if g.num_rows < 2:
                continue
            side, doc, comp, n = (g.column(g.schema.get_field_index(c)).to_numpy() for c in ("side", "doc", "comp", "n"))
            raw = g.column(g.schema.get_field_index("sketch")).to_pylist()
            words = min(map(len, raw)) // 8
            sk = np.array([folded(np.frombuffer(x, "<u8"), words) for x in raw])
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for i in left:
                to = right[comp[right] != comp[i]]
                if len(to):
                    bits = np.bitwise_count(sk[to] ^ sk[i]).sum(1, dtype=np.int64)
                    told.update((min(d, int(doc[i])), max(d, int(doc[i]))) for d in doc[to[_open_pairs(percent, np.minimum(n[to], n[i]), np.maximum(n[to], n[i]), bits)]].tolist())
            if len(told) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told)], schema=schema)
                told = set()
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told)], schema=schema)

    return run


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Links documents with 100 * |A and B| >= percent * |A or B| and returns doc_id, n_shingles, component_id for each."""
    spark = docs.sparkSession
    work = Scratch(spark, "setjoin")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("utf8"))

    prints = work.store(source.mapInArrow(_fingerprints(size, percent), "doc_id long, n long, h1 long, h2 long, sketch binary, sigs array<long>"))
    total = prints.count()
    worded = prints.filter("n > 0 and doc_id is not null")
    classes = worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("sigs", ignorenulls=True).alias("sigs"))
    classes = _numbered(work.store(classes), work)
    hot = hot_keys(classes, ["h1", "h2"], total, "copies")
    found = salted_join(worded.select("doc_id", "n", "h1", "h2"), classes.select("h1", "h2", "doc"), ["h1", "h2"], hot, F.xxhash64("doc_id")).select("doc_id", "n", "doc")
    rest = prints.filter("not (n > 0 and doc_id is not null)").select("doc_id", "n", F.lit(None).cast("long").alias("doc"))
    known = work.store(found.unionByName(rest))
    work.drop(prints)
    members = _members(classes, work)
    nodes = classes.select("doc", "n", "sketch")

    first = work.store(members.filter("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct())
    both = salted_join(first, nodes.toDF("a", "n_a", "sketch_a"), ["a"], _often(first, "a"), F.xxhash64("b")).join(nodes.toDF("b", "n_b", "sketch_b"), "b")
    links = _checked(source, both.mapInArrow(_sift(percent), "a long, b long"), classes, size, percent, work)
    work.drop(first)
    comp = components(links, work)
    more = _checked(source, _further_pairs(members, nodes, comp, percent, work), classes, size, percent, work)
    work.drop(members, comp)
    final = components(links.unionByName(more).unionByName(_of_one_document(known)), work)
    named = work.store(_least_documents(classes.select("doc", "rep", "copies"), final))
    work.keep(known, named)
    hot = hot_keys(named, ["doc"], total, "copies")
    out = salted_join(known, named.drop("copies"), ["doc"], hot, F.xxhash64("doc_id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _of_one_document(known: DataFrame) -> DataFrame:
    """Links between the classes of documents with several different texts."""
    ends = known.filter("doc is not null").groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a <> z")
    return known.filter("doc is not null").select("doc_id", F.col("doc").alias("b")).join(ends, "doc_id").filter("a <> b").select("a", "b").distinct()


def _least_documents(classes: DataFrame, final: DataFrame) -> DataFrame:
    """classes (doc, rep, copies) with component_id: the least doc_id of all classes of a component. A component may have a large part of all classes."""
    both = classes.join(final.withColumnRenamed("node", "doc"), "doc", "left")
    linked = both.filter("component is not null")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    hot = hot_keys(least, ["component"], final.count(), "size")
    out = salted_join(linked, least.drop("size"), ["component"], hot, F.xxhash64("doc"))
    columns = ("doc", "copies", "component_id")
    return out.select(*columns).unionByName(both.filter("component is null").select("doc", "copies", F.col("rep").alias("component_id")))


def _often(rows: DataFrame, key: str) -> DataFrame:
    """The keys that more rows have than one task should get. ``rows`` are stored."""
    return hot_keys(rows.groupBy(key).agg(F.count("*").alias("n")), [key], rows.count())


def _members(classes: DataFrame, work: Scratch) -> DataFrame:
    """Members (sig, doc, pivot, c) of the signatures that several classes share, stored: the least member and the number of all.

    A signature with many rows would be one task's window: the commonest, and all that a task sees twice up to MOST_HOT_KEYS, are summed up by partial
    aggregates. Any other has one row in a task at most, or one part in MOST_HOT_KEYS of all rows.
    """
    seen = classes.select("sigs").mapInArrow(seen_twice, "value long, n long").groupBy(F.col("value").alias("sig")).agg(F.sum("n").alias("n"))
    common = work.store(seen.orderBy(F.desc("n"), "sig").limit(MOST_HOT_KEYS).select("sig"))
    shared = classes.select(F.explode(F.array_distinct("sigs")).alias("sig"), "doc")
    rare = shared.join(F.broadcast(common), "sig", "left_anti").selectExpr("sig", "doc", "min(doc) over (partition by sig) as pivot", "count(*) over (partition by sig) as c")
    often = shared.join(F.broadcast(common), "sig")
    sums = often.groupBy("sig").agg(F.min("doc").alias("pivot"), F.count("*").alias("c"))
    out = work.store(rare.unionByName(often.join(F.broadcast(sums), "sig").select("sig", "doc", "pivot", "c")).filter("c > 1"))
    work.drop(common)
    return out


def _numbered(classes: DataFrame, work: Scratch) -> DataFrame:
    """classes, stored, with ``doc``, a number of their own: the least doc_id. Documents with several texts are the least of several classes: all
    but one of these get hashes, which are tried until no two numbers are equal."""
    shared = work.store(classes.groupBy("rep").agg(F.count("*").alias("k"), F.min(F.struct("h1", "h2")).alias("own")).filter("k > 1"))
    if not shared.limit(1).count():
        return classes.withColumn("doc", F.col("rep"))
    total = classes.count()
    both = salted_join(classes, shared, ["rep"], hot_keys(shared, ["rep"], total, "k"), F.xxhash64("h1", "h2"), "left")
    again = F.col("own").isNotNull() & (F.struct("h1", "h2") != F.col("own"))
    attempt = 0
    while True:
        numbered = work.store(both.withColumn("doc", F.when(again, F.xxhash64("h1", "h2", F.lit(attempt))).otherwise(F.col("rep"))).drop("k", "own"))
        if not numbered.groupBy("doc").count().filter("count > 1").limit(1).count():
            break
        work.drop(numbered)
        attempt += 1
    work.drop(classes)
    return numbered


def _further_pairs(members: DataFrame, nodes: DataFrame, comp: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """Open pairs of different components in one bucket, but for those with the bucket's pivot, which were checked.

    A pair of different components has a member outside the bucket's largest component. Blocks of such members meet blocks of all, so
    a large component with a few others in its bucket is sent once for each block of the others, not of its own.
    """
    many = members.filter("c > 2 and doc <> pivot").select("sig", "doc", "c").join(comp.withColumnRenamed("node", "doc"), "doc", "left")
    many = work.store(many.select("sig", "doc", F.coalesce("component", "doc").alias("comp"), "c"))
    sizes = many.groupBy("sig", "comp").agg(F.count("*").alias("m"))
    blocks = lambda n: F.expr(f"cast(({n} + {BLOCK - 1}) div {BLOCK} as int)")
    open_ = sizes.groupBy("sig").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("top"), F.sum("m").alias("every")).filter("every > top")
    open_ = open_.select("sig", "main", blocks("(every - top)").alias("b_few"), blocks("every").alias("b_all"))
    hot = hot_keys(many.groupBy("sig").agg(F.max("c").alias("n")), ["sig"], many.count())
    rest = salted_join(many.drop("c"), open_, ["sig"], hot, F.xxhash64("doc"))
    own = lambda n: F.expr(f"cast(pmod(xxhash64(doc), {n}) as int)")
    few = rest.filter("comp <> main").select("sig", "doc", "comp", F.lit(0).alias("side"), own("b_few").alias("bi"), F.explode(F.sequence(F.lit(0), F.col("b_all") - 1)).alias("bj"))
    every = rest.select("sig", "doc", "comp", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("b_few") - 1)).alias("bi"), own("b_all").alias("bj"))
    dealt = few.unionByName(every).join(nodes, "doc")
    return sorted_groups(dealt, ["sig", "bi", "bj"], n_shuffle(members.sparkSession)).mapInArrow(_block_pairs(percent), "a long, b long").distinct()


def _checked(source: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int, work: Scratch) -> DataFrame:
    """The pairs of classes whose sets are similar enough; reads the sets of one document of each class in some pair only. A document with several texts
    is told apart by the set's fingerprint."""
    pairs = work.store(pairs)
    asked = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    wanted = work.store(asked.join(classes.select("doc", F.col("rep").alias("doc_id"), "h1", "h2"), "doc"))
    few, ids = wanted.count() <= BROADCAST_IDS, wanted.select("doc_id").distinct()
    texts = source.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(size), "doc_id long, h1 long, h2 long, set binary")
    sets = work.store(sets.join(F.broadcast(wanted) if few else wanted, ["doc_id", "h1", "h2"]).select("doc", "set").dropDuplicates(["doc"]))
    both = pairs
    for one, other in ("ab", "ba"):
        both = salted_join(both, sets.toDF(one, f"set_{one}"), [one], _often(pairs, one), F.xxhash64(other))
    links = work.store(both.select("a", "b", "set_a", "set_b").mapInArrow(_exact(percent), "a long, b long"))
    work.drop(pairs, wanted, sets)
    return links


def without(docs: DataFrame, ids: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, whose id isn't in ``ids`` (doc_id). A list of at most BROADCAST_IDS is sent to the rows, a longer one
    is joined by a shuffle."""
    gone = Scratch(docs.sparkSession, "gone").store(ids.filter("doc_id is not null").distinct().select(F.col("doc_id").alias(id_col)))
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)
