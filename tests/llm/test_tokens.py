import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from invoicelake.llm import packing, token_store
from invoicelake.llm.common import fresh_path
from invoicelake.llm.tokens import CachedTokenizer
from tokenizers import Tokenizer

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
CACHED = {p: CachedTokenizer(p, cache_bytes=20_000) for p in (WORD, BYTE)}
#: Tokenizers of their own, as they come from the file.
PLAIN = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
PIECES = st.sampled_from([*"abAzé ÉßI.,!?'s12 \n\t\r\x0b\x1c\x85\xa0\u2003\u3000\u0301ıİ日×÷Ā<|>&%-\0\1", "\n\n", "  ", "it's", "word", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext"])


def plain_ids(path, text):
    return PLAIN[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=40).map("".join), min_size=1, max_size=4))
def test_cached_ids_are_the_librarys(path, texts):
    got = [(x, b) for x, b in CACHED[path].many(pa.array([t.encode() for t in texts], pa.binary()), 7)]
    ids = [x[i:j].tolist() for x, b in got for i, j in zip(b, b[1:])]
    assert ids == [[*plain_ids(path, t), 7] for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_literals_of_added_tokens(path):
    text = "a <|endoftext|>b<|endoftext|>"
    plain = Tokenizer.from_file(path)
    assert CachedTokenizer(path).ids(text.encode()).tolist() == plain_ids(path, text) == CachedTokenizer(path).whole_ids(text.encode()).tolist()
    plain.encode_special_tokens = True
    assert CachedTokenizer(path, special=False).ids(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids != plain_ids(path, text)


def test_groups_hold_all_texts(monkeypatch):
    monkeypatch.setattr("invoicelake.llm.tokens.GROUP_BYTES", 30)
    monkeypatch.setattr("invoicelake.llm.tokens.RUN_WORDS", 3)
    texts = ["", "one two", "x " * 50, "", "three\n\nfour", "five six seven"] * 3
    got = list(CachedTokenizer(BYTE).many(pa.array([t.encode() for t in texts], pa.binary())))
    assert len(got) > 3 and [x[i:j].tolist() for x, b in got for i, j in zip(b, b[1:])] == [plain_ids(BYTE, t) for t in texts]


def brute(rows, path, end_id):
    return {(r["doc_id"], r["text"]): np.array([*plain_ids(path, r["text"] or ""), end_id], "<u4") for r in rows}


def test_packing_holds_each_id_once(spark, docs):
    rows = docs.collect()
    want = brute(rows, WORD, 1)
    by_id = {k[0]: v for k, v in want.items()}
    pieces = packing.pack(docs, WORD, seq_len=128, open_windows=8, with_ids=True).collect()
    held, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] and p["doc_tokens"] == len(by_id[p["doc_id"]])
        held[p["doc_id"]].append((p["start"], np.frombuffer(p["ids"], "<u4")))
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc_id, parts in held.items():
        n = sum(r["doc_id"] == doc_id for r in rows)
        assert sorted(i for s, x in parts for i in range(s, s + len(x))) == sorted(list(range(len(by_id[doc_id]))) * n)
        assert all((by_id[doc_id][s : s + len(x)] == x).all() for s, x in parts)
    assert set(held) == set(by_id)
    total = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
        total += at
    assert total >= 0.9 * 128 * (len(windows) - 8)


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=5000), min_size=1, max_size=4))
def test_shard_round_trip(parts):
    ids = [np.array(p, "<u4") for p in parts]
    names = [None if k == 0 else k - 5 for k in range(len(ids))]
    data = token_store.encode_shard(3, 4, 5, names, ids) + b"\n"
    part, shard, first, got_names, got = token_store.decode_shard(data)
    assert (part, shard, first, got_names) == (3, 4, 5, names) and all((a == b).all() for a, b in zip(ids, got))
    assert all((token_store.read_document(data, k) == x).all() for k, x in enumerate(ids))


def test_broken_shard_is_refused():
    data = bytearray(token_store.encode_shard(0, 0, 0, [1], [np.arange(100, dtype="<u4")]))
    data[60] ^= 1
    with pytest.raises(ValueError):
        token_store.decode_shard(bytes(data))


def test_token_files_by_order_of_ids(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    path = fresh_path(spark, "t")
    token_store.write_token_files(docs, path, BYTE, shard_ids=700)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_token_files(spark, path).collect()))
    want, start = [], 0
    ids = brute(rows, BYTE, 2)
    for r in rows:
        x = ids[r["doc_id"], r["text"]]
        want.append((start, r["doc_id"], len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert got == want
    assert spark.read.format("binaryFile").load(path).count() > 4


def test_token_files_of_nothing(spark, nothing):
    path = fresh_path(spark, "t")
    token_store.write_token_files(nothing, path, BYTE)
    assert token_store.read_token_files(spark, path).filter(F.lit(True)).count() == 0
