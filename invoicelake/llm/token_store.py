"""Token-id files: patched frame-of-reference blocks.

A shard is one file. Ids of whole documents, in ascending order of doc_id, are cut into blocks of 4096. A block stores its
minimum, its other ids' distances from it at a width that a percentile of the distances chooses, and an exception list of
(position, whole id) for those that need more bits. All numbers are little-endian:

    magic "PFB1" | part u32, shard u32, first u64 (ids of this part before the shard), docs u32, ids u64, blocks u32
    doc_id i64[docs], known u8[docs] (0: the doc_id is null), n_tokens u64[docs]
    block starts u64[blocks + 1], from the file's beginning; the last is the end of the blocks
    per block: minimum u32, count u16, exceptions u16, width u8, 64*width u64-words/64 of distances, positions u16[], ids u32[]
    crc32 of all before u32 | line feed

Distances are packed vertically: 64 lanes of 64 values, so a block takes ``width`` rows of 64 words and is packed and
unpacked with ``64`` vector operations. Part numbers ascend with doc_id, and so does the shard number within a part.

Nulls and empty texts: a document of its end id alone. Null doc_ids come first. Rows that repeat a doc_id are kept each. An
empty table gives no file and no rows. Other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch_columns, n_shuffle, read_blobs, slices, write_blobs
from .tokens import tokenizer

BLOCK = 4096
LANES = 64
#: Percentiles of a block's distances that may choose its width; the cheapest one does.
PERCENTILES = (90, 95, 98, 100)
_HEAD = struct.Struct("<4sIIQIQI")
_BLOCK_HEAD = struct.Struct("<IHHB")
MAGIC = b"PFB1"


def pack_words(v: np.ndarray, width: int) -> np.ndarray:
    """Blocks of 4096 unsigned values below 2**width, (n, 4096), into (n, width, 64) words."""
    out = np.zeros((len(v), width, LANES), "<u8")
    rows = v.reshape(-1, LANES, LANES)
    for k in range(LANES if width else 0):
        word, shift = divmod(k * width, 64)
        out[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return out


def unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    """(n, width, 64) words into (n, 4096) values."""
    out, mask = np.zeros((len(words), LANES, LANES), "<u8"), np.uint64((1 << width) - 1)
    for k in range(LANES if width else 0):
        word, shift = divmod(k * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = x & mask
    return out.reshape(-1, BLOCK)


def _width(d: np.ndarray) -> int:
    """The cheapest of the percentiles' widths."""
    upto = np.cumsum(np.bincount(np.frexp(d.astype(np.float64))[1], minlength=33))  # values of at most so many bits
    best = (1 << 62, 0)
    for p in PERCENTILES:
        width = int(np.searchsorted(upto, (len(d) * p + 99) // 100))
        best = min(best, (BLOCK * width + int(len(d) - upto[width]) * 48, width))
    return best[1]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of one width are packed together."""
    lows, widths, overs, fits = [], [], [], np.zeros((-(-len(ids) // BLOCK), BLOCK), "<u8")
    for k in range(len(fits)):
        block = ids[k * BLOCK : (k + 1) * BLOCK]
        low = block.min()
        d = (block - low).astype("<u8")
        width = _width(d)
        over = np.flatnonzero(d >> np.uint64(width))
        fits[k, : len(d)] = d
        fits[k, over] = 0
        lows.append(int(low)), widths.append(width), overs.append(over)
    packed: dict[int, bytes] = {}
    for width in set(widths):
        at = [k for k, w in enumerate(widths) if w == width]
        packed |= dict(zip(at, (x.tobytes() for x in pack_words(fits[at], width))))
    out = []
    for k, over in enumerate(overs):
        block = ids[k * BLOCK : (k + 1) * BLOCK]
        out.append(_BLOCK_HEAD.pack(lows[k], len(block) - 1, len(over), widths[k]) + packed[k] + over.astype("<u2").tobytes() + block[over].tobytes())
    return out


def decode_blocks(blocks: list[memoryview]) -> list[np.ndarray]:
    heads = [_BLOCK_HEAD.unpack_from(b) for b in blocks]
    out: list[np.ndarray] = [np.empty(0, "<u4")] * len(blocks)
    for width in {h[3] for h in heads}:
        at = [k for k, h in enumerate(heads) if h[3] == width]
        words = np.stack([np.frombuffer(blocks[k], "<u8", width * LANES, _BLOCK_HEAD.size).reshape(width, LANES) for k in at])
        for k, values in zip(at, unpack_words(words, width).astype("<u4")):
            low, last, n_over, _ = heads[k]
            x = values[: last + 1] + np.uint32(low)
            place = _BLOCK_HEAD.size + width * LANES * 8
            over = np.frombuffer(blocks[k], "<u2", n_over, place)
            x[over] = np.frombuffer(blocks[k], "<u4", n_over, place + 2 * n_over)
            out[k] = x
    return out


def encode_shard(part: int, shard: int, first: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    every = np.concatenate(ids).astype("<u4", copy=False)
    blocks = encode_blocks(every)
    head = _HEAD.pack(MAGIC, part, shard, first, len(ids), len(every), len(blocks))
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is not None for d in doc_ids], "u1").tobytes() + np.array([len(x) for x in ids], "<u8").tobytes()
    begin = len(head) + len(table) + 8 * (len(blocks) + 1)
    starts = np.cumsum([begin, *map(len, blocks)]).astype("<u8").tobytes()
    body = b"".join([head, table, starts, *blocks])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_shard(b: bytes) -> tuple[int, int, int, list[int | None], list[np.ndarray]]:
    """part, shard, first, doc_ids, ids of each document."""
    magic, part, shard, first, n_docs, n_ids, n_blocks = _HEAD.unpack_from(b)
    at = _HEAD.size
    doc_ids = np.frombuffer(b, "<i8", n_docs, at)
    known = np.frombuffer(b, "u1", n_docs, at + 8 * n_docs)
    counts = np.frombuffer(b, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    starts = np.frombuffer(b, "<u8", n_blocks + 1, at + 17 * n_docs).astype(np.int64)
    end = int(starts[-1])
    if magic != MAGIC or struct.unpack_from("<I", b, end)[0] != zlib.crc32(memoryview(b)[:end]):
        raise ValueError("not a whole shard")
    view = memoryview(b)
    every = np.concatenate(decode_blocks([view[i:j] for i, j in zip(starts[:-1], starts[1:])]))
    if len(every) != n_ids:
        raise ValueError("not a whole shard")
    return part, shard, first, [int(d) if k else None for d, k in zip(doc_ids, known)], np.split(every, np.cumsum(counts)[:-1])


def read_document(b: bytes, position: int) -> np.ndarray:
    """The ids of one document of a shard, by the block index alone."""
    _, _, _, _, n_docs, _, n_blocks = _HEAD.unpack_from(b)
    counts = np.frombuffer(b, "<u8", n_docs, _HEAD.size + 9 * n_docs).astype(np.int64)
    starts = np.frombuffer(b, "<u8", n_blocks + 1, _HEAD.size + 17 * n_docs).astype(np.int64)
    lo = int(counts[:position].sum())
    hi = lo + int(counts[position])
    got = np.concatenate(decode_blocks([memoryview(b)[starts[k] : starts[k + 1]] for k in range(lo // BLOCK, (hi - 1) // BLOCK + 1)]))
    return got[lo - lo // BLOCK * BLOCK :][: hi - lo]


def _shards(path: str, special: bool, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk, part = tokenizer(path, special), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = shard = first = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_shard(part, shard, first, names, held)], pa.binary())], names=["shard"])

        for b in slices(batches):
            doc_ids = iter(b.column(0).to_pylist())
            for ids, bounds in tk.many(b.column(1), end_id):
                for x in np.split(ids, bounds[1:-1]):
                    held.append(x)
                    names.append(next(doc_ids))
                    size += len(x)
                    if size >= shard_ids:
                        yield out()
                        shard, first, held, names, size = shard + 1, first + size, [], [], 0
        if held:
            yield out()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = 1 << 21, special: bool = True) -> None:
    """Writes the ids of all documents below ``path``, in ascending order of doc_id, rows of one id by their text's hash, in shards of about ``shard_ids``. ``special``:
    literals of added tokens become their ids, as the library has it."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("utf8"))
    order = F.asc_nulls_first("doc_id"), F.xxhash64("utf8")  # rows of one id are dealt out too, and keep their order
    ordered = source.repartitionByRange(n_shuffle(spark, source), *order).sortWithinPartitions(*order)
    write_blobs(ordered.mapInArrow(_shards(tokenizer_path, special, end_id, shard_ids), "shard binary"), path, "shard")


_READ = "part long, shard long, position long, doc_id long, part_start long, n_tokens long, ids_crc32 long"
_READ_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _READ.split(", ")])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (contents,) in batch_columns(batches, "content"):
        for b in contents:
            part, shard, first, doc_ids, ids = decode_shard(b)
            rows = []
            for k, (doc_id, x) in enumerate(zip(doc_ids, ids)):
                rows.append((part, shard, k, doc_id, first, len(x), zlib.crc32(x.astype("<u4").tobytes())))
                first += len(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_READ_ARROW)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Reads every shard and returns, per document, doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A part's own running count is in its shards; what stands before the part comes from one sum per part, whose number is that
    of the writing tasks.
    """
    docs = Scratch(spark, "tokens").store(read_blobs(spark, path).select("content").mapInArrow(_read, _READ))
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = parts.selectExpr("part", "sum(ids) over (order by part rows between unbounded preceding and 1 preceding) as before")
    return docs.join(before, "part").select("doc_id", (F.coalesce("before", F.lit(0)) + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
