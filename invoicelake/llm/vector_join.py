"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, then exact cosine.

A unit vector x falls, in table t, into the bucket of floor((a_j . x + b_j) / width), j = 1..bits, with Gaussian a_j and uniform
b_j. Unit vectors of cosine c lie sqrt(2 - 2 c) apart, so the chance of a shared bucket is known (``meeting``). ``plan`` takes as many
bits as leave a bucket of unrelated vectors no more than a few members whatever the number of rows, and as many tables as find a pair at
the threshold with the chance ``recall``; closer pairs are found nearly always.

Equal vectors are one class with a weight, found by a 128-bit fingerprint, so a third of all rows being one vector costs nothing.
Only class ids, bucket keys and sketches (the signs of 128 projections) are shuffled once for each table. A member whose sketch is
far from all others of its bucket meets nobody there; of the buckets that are left, near copies share most, and of buckets with the same
members that of the first table alone is kept. Vectors are fetched for these. Buckets of two are compared many pairs at a time. Larger ones
are dealt out in blocks of members, and a task compares two blocks by one matrix product in double precision. A pair counts in
the first table in which it meets, so no table of pairs is written: a task gives each vector's number of links and a spanning forest
of the links for the components. The limit on sketches lies seven deviations from what a pair at the threshold has (one such pair in
10**9 is lost to it).

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors of different
lengths with each other. Vectors of any finite length are compared: they are scaled by their largest component before the norm is
taken. Rows that repeat an id: n_links is that of each row's own vector, and all of them are one node of the components. Null ids are kept, link
with nothing and have a null component. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_HOT_KEYS, Scratch, hot_keys, n_shuffle, salted_join
from .components import components
from .grouping import Forest, groups, sorted_groups
from .shingles import mix

BLOCK = 512
SKETCH = 128
#: Members that a bucket of unrelated vectors has on average.
STRANGERS = 32


def meeting(cosine: float, width: float) -> float:
    """The chance that two unit vectors of this cosine agree in one quantised projection."""
    r = width / max(math.sqrt(2 - 2 * cosine), 1e-9)
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def recall(cosine: float, tables: int, bits: int, width: float) -> float:
    """The chance that two unit vectors of this cosine meet in some table."""
    return 1 - (1 - meeting(cosine, width) ** bits) ** tables


def plan(rows: int, threshold: float, at_least: float, width: float) -> tuple[int, int]:
    """(tables, bits) for so many vectors."""
    bits = max(8, math.ceil(math.log(max(rows, 1) / STRANGERS) / -math.log(meeting(0.0, width))))
    tables = 1
    while recall(threshold, tables, bits, width) < at_least:
        tables += 1
    return tables, bits


def sketch_limit(threshold: float) -> int:
    """Signs in which two vectors at the threshold differ at most."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + 7 * math.sqrt(SKETCH * p * (1 - p)))


def _projections(dim: int, tables: int, bits: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * bits)), rng.uniform(0, width, tables * bits), rng.standard_normal((dim, SKETCH))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; no finite row's norm overflows or vanishes."""
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def _hash_all(tables: int, bits: int, width: float, seed: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("rep", pa.int64()), ("weight", pa.int64()), ("vec", pa.binary()), ("cells", pa.binary()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            lists = b.column(4)
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = unit(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim))
                if dim not in held:
                    held[dim] = _projections(dim, tables, bits, width, seed)
                a, shift, signs = held[dim]
                cell = np.floor((x @ a + shift) / width).astype(np.int64).view(np.uint64).reshape(len(at), tables, bits)
                key = np.broadcast_to(mix(np.arange(tables, dtype=np.uint64) + np.uint64(dim << 20)), (len(at), tables)).copy()
                for j in range(bits):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, j])
                low = (key >> np.uint64(32)).astype("<u4")
                key = key & ~np.uint64(0xFFF) | np.arange(tables, dtype=np.uint64)  # a key tells its table
                sketch = np.packbits(x @ signs > 0, axis=1)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, tables, dtype=np.int32)), pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in range(4)), _blobs(x), _blobs(low), _blobs(sketch), keys], schema=schema)

    return run


def _blobs(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows(blobs: pa.Array, kind: str) -> np.ndarray:
    """Equally long blobs as rows of numbers."""
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(len(blobs), -1)


def _active(limit: int):
    """Groups are (bucket, block, block): members that are close to another one by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64()) for x in (keys, ids)], names=["key", "cid"])

        for g in groups(batches, ["key", "bi", "bj"]):
            if g.num_rows < 2:
                continue
            key, cid, bi, bj, side = (g.column(g.schema.get_field_index(c)).to_numpy() for c in ("key", "cid", "bi", "bj", "side"))
            sk = _rows(g.column(g.schema.get_field_index("sketch")), "<u8")
            left = np.flatnonzero(side == 0)
            inner = bi[0] == bj[0]
            right = left if inner else np.flatnonzero(side == 1)
            near = np.zeros((len(left), len(right)), np.int16)
            for w in range(sk.shape[1]):
                near += np.bitwise_count(sk[left, w][:, None] ^ sk[right, w][None, :])
            near = near <= limit
            if inner:
                np.fill_diagonal(near, False)
            at = np.unique(np.concatenate([left[near.any(1)], right[near.any(0)]]))
            keys.append(key[at])
            ids.append(cid[at])
            if len(keys) > 5000:
                yield told()
                keys, ids = [], []
        yield told()

    return run


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_FOUND_DDL = "node long, links long, a long, b long"


def _counted(node: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    """Classes with numbers of links."""
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.nulls(len(node), pa.int64()), pa.nulls(len(node), pa.int64())], schema=_FOUND)


def _linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links between ids."""
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_FOUND)


def _compare_pairs(threshold: float):
    """Rows are pairs that are alone in a bucket of table ``tab``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            sizes = pc.binary_length(col("vec_a")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():  # pairs of a bucket have one length
                at = pa.array(np.flatnonzero(sizes == size))
                u, v = _rows(col("vec_a").take(at), "<f8"), _rows(col("vec_b").take(at), "<f8")
                c, d = _rows(col("cells_a").take(at), "<u4"), _rows(col("cells_b").take(at), "<u4")
                one, other, r_one, r_other, w_one, w_other, tab = (col(x).take(at).to_numpy() for x in ("a", "b", "rep_a", "rep_b", "weight_a", "weight_b", "tab"))
                before = ((c == d) & (np.arange(c.shape[1]) < tab[:, None])).any(1)
                good = (np.einsum("ij,ij->i", u, v) >= threshold) & ~before
                yield _counted(one[good], w_other[good])
                yield _counted(other[good], w_one[good])
                yield _linked(r_one[good], r_other[good])

    return run


def _compare(threshold: float):
    """Groups are (bucket, block, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["key", "bi", "bj"]):
            node, rep, weight, side, table = (g.column(g.schema.get_field_index(c)).to_numpy() for c in ("cid", "rep", "weight", "side", "tab"))
            x, cells = (_rows(g.column(g.schema.get_field_index(c)), t) for c, t in (("vec", "<f8"), ("cells", "<u4")))
            t = int(table[0])
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            inner = g.column(g.schema.get_field_index("bi"))[0].as_py() == g.column(g.schema.get_field_index("bj"))[0].as_py()
            right = left if inner else right
            i, j = np.nonzero(x[left] @ x[right].T >= threshold)
            i, j = left[i], right[j]
            if inner:
                i, j = i[i < j], j[i < j]
            for lo in range(0, len(i), 1 << 16):  # a pair that met in an earlier table was counted there
                a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                new = ~(cells[a, :t] == cells[b, :t]).any(1)
                a, b = a[new], b[new]
                if len(a):
                    links = np.bincount(a, weight[b], len(rep)) + np.bincount(b, weight[a], len(rep))
                    some = np.flatnonzero(links)
                    yield _counted(node[some], links[some].astype(np.int64))
                    trees = Forest(len(rep))
                    kept = np.array([trees.join(p, q) for p, q in zip(a.tolist(), b.tolist())])
                    yield _linked(rep[a[kept]], rep[b[kept]])

    return run


#: Up to so many bucket keys (8 bytes each) are sent to every executor to pick out their members; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def near_duplicate_vectors(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, at_least: float = 0.995, width: float = 2.0, seed: int = 20) -> DataFrame:
    """vec_id, n_links (other vectors of cosine >= threshold found), component_id (least id reachable), kept. ``at_least``: the chance
    that a pair at the threshold is found."""
    spark = df.sparkSession
    work = Scratch(spark, "vectors")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = F.expr("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    keyed = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumns({"h1": F.when(F.col("ok"), F.xxhash64("v")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(7), F.col("v")))})
    grouped = keyed.filter("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    tables, bits = plan(keyed.filter("ok").count(), threshold, at_least, width)
    hashed = grouped.mapInArrow(_hash_all(tables, bits, width, seed), "h1 long, h2 long, rep long, weight long, vec binary, cells binary, sketch binary, keys array<long>")
    vecs = work.store(hashed.withColumn("cid", F.monotonically_increasing_id()))  # a class's id, fixed by being stored
    links, comp = _links(vecs, threshold, work)

    total = vecs.agg(F.sum("weight")).first()[0] or 0
    per_class = vecs.select("cid", "h1", "h2", "rep", "weight").join(links.withColumnRenamed("node", "cid"), "cid", "left")
    often = hot_keys(vecs.groupBy("rep").agg(F.count("*").alias("n")), ["rep"], total)
    per_class = salted_join(per_class, comp.withColumnRenamed("node", "rep"), ["rep"], often, F.xxhash64("cid"), "left")
    per_class = work.store(per_class.select("h1", "h2", "rep", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    work.keep(per_class)
    single = per_class.filter("weight = 1").select(F.col("rep").alias("vec_id"), "n_links", "component_id")
    several = per_class.filter("weight > 1")
    equal = salted_join(keyed.filter("ok").select("vec_id", "h1", "h2"), several.select("h1", "h2", "n_links", "component_id"), ["h1", "h2"], hot_keys(several, ["h1", "h2"], total, "weight"), F.xxhash64("vec_id"))
    odd = keyed.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return single.unionByName(equal.select("vec_id", "n_links", "component_id")).unionByName(odd).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _dealt(members: DataFrame, *more: str | Column) -> DataFrame:
    """members (key, cid, blocks), each in a block of its bucket and once for each pair of that block with another."""
    own = members.withColumn("own", F.expr("cast(pmod(xxhash64(cid), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.select("key", "cid", *more, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))


def _links(vecs: DataFrame, threshold: float, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, links) of the classes of equal vectors, and (node, component) of their ids."""
    spark = vecs.sparkSession
    members = vecs.select("cid", "sketch", F.explode("keys").alias("key"))
    counts = members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)  # exact, however thinly a bucket's members are spread
    often = work.store(counts.select("key", "n", F.expr(f"cast((n + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks")))
    if often.count() <= MOST_HOT_KEYS:
        placed = members.join(F.broadcast(often.select("key", "blocks")), "key", "left")
    else:
        placed = salted_join(members, often.select("key", "blocks"), ["key"], hot_keys(often, ["key"], often.agg(F.sum("n")).first()[0]), F.xxhash64("cid"), "left")
    dealt = _dealt(placed.withColumn("blocks", F.coalesce("blocks", F.lit(1))), "sketch")
    active = work.store(sorted_groups(dealt, ["key", "bi", "bj"], n_shuffle(spark)).mapInArrow(_active(sketch_limit(threshold)), "key long, cid long").distinct())
    sums = active.groupBy("key").agg(F.count("*").alias("c"), F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.expr("bit_xor(xxhash64(cid))").alias("x1"), F.expr("bit_xor(xxhash64(7, cid))").alias("x2"))
    tab = (F.col("key").bitwiseAND(F.lit(0xFFF))).cast("int")
    buckets = sums.groupBy("c", "lo", "hi", "x1", "x2").agg(F.min(F.struct(tab.alias("tab"), "key")).alias("first"))
    buckets = work.store(buckets.select("c", "lo", "hi", "first.tab", "first.key"))

    side = lambda s: vecs.select(F.col("cid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "weight", "vec", "cells")))
    pairs = buckets.filter("c = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"), "tab")
    for s, other in ("ab", "ba"):
        hot = hot_keys(pairs.groupBy(s).agg(F.count("*").alias("n")), [s], buckets.count())
        pairs = salted_join(pairs, side(s), [s], hot, F.xxhash64(other))
    found = pairs.select("a", "b", "tab", *(f"{c}_{s}" for s in "ab" for c in ("rep", "weight", "vec", "cells"))).mapInArrow(_compare_pairs(threshold), _FOUND_DDL)

    large = work.store(buckets.filter("c > 2").select("key", "c"))
    n_large = large.count()
    if n_large <= BROADCAST_KEYS:
        met = active.join(F.broadcast(large), "key")
    else:
        met = salted_join(active, large, ["key"], hot_keys(large, ["key"], active.count(), "c"), F.xxhash64("cid"))
    dealt = _dealt(met.withColumn("blocks", F.expr(f"cast((c + {BLOCK - 1}) div {BLOCK} as int)")), tab.alias("tab"))
    dealt = dealt.join(vecs.select("cid", "rep", "weight", "vec", "cells"), "cid")
    found = work.store(found.unionByName(sorted_groups(dealt, ["key", "bi", "bj"], n_shuffle(spark)).mapInArrow(_compare(threshold), _FOUND_DDL)))
    work.drop(often, active, buckets, large)
    comp = components(found.filter("a is not null").select("a", "b"), work)
    return found.filter("node is not null").groupBy("node").agg(F.sum("links").alias("links")), comp
