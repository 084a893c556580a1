"""Token ids by the ``tokenizers`` library, with a cache of pieces in front of it.

A BPE vocabulary splits a text before any merge, and never joins what stands on both sides of certain points. Texts are
cut at some of those points, each distinct piece is encoded once with the library, and joined cached ids are exactly
the ids of the whole text, at a fraction of the time. Batches are cut and joined by Arrow and numpy, so Python touches
distinct pieces alone. New pieces of known letters, figures and signs are cut further into what the vocabulary's split leaves whole, and
many such parts go to the library's BPE model in one string, kept apart by a letter that no merge of the vocabulary holds
(where words have an end mark, by a space). All other pieces go to the library as they are. ``whole_ids`` is the plain path; tests hold
one against the other.

A literal of an added token in a text becomes that token's id, as the library does by default; with ``special=False`` it is text like
any other. Texts are cut at such literals before anything else.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

#: White space in the sense of the vocabulary's split pattern.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: A space or line feed after other white space, or (by their beginnings in UTF-8) white space outside ASCII.
_RUN = re.compile(rb"[ \n\t\r\x0b\x0c][ \n]")
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80")
#: Texts are cut and joined in groups of about so many bytes, words in runs of so many.
GROUP_BYTES = 4 << 20
RUN_WORDS = 1 << 18
#: Words that go to the model in one string.
JOINED = 100
#: What a piece takes in a cache besides itself and its ids.
_ENTRY = 180
#: A piece is the text behind a space, or one that begins with its line feed. Two bytes that UTF-8 has not begin others: a text as it
#: stands, an added token's number.
_AS_IT_IS, _ADDED = b"\xff", b"\xfe"
_LETTER, _FIGURE, _SIGN, _SPACE, _FEED, _END, _OTHER = range(1, 8)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_TO_LETTERS = _byte_letters()
_LETTER_CODES = np.array([ord(_TO_LETTERS[b]) for b in range(256)], "<u4")


def _kinds(lowered: bool) -> np.ndarray:
    """What each byte of a piece is. Letters outside ASCII are those of two bytes that begin with c3; the apostrophe begins contractions."""
    out = np.full(256, _OTHER)
    out[[*(range(97, 123)), *(() if lowered else range(65, 91)), 0xC3, *range(0x80, 0xC0)]] = _LETTER
    out[48:58] = _FIGURE
    out[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = _SIGN
    out[0] = _END
    if not lowered:
        out[32], out[10] = _SPACE, _FEED
    return out


def _spans(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """ids[start : start + length] of all, one after the other."""
    before = np.cumsum(lengths) - lengths
    return ids[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class _Arena:
    """Pieces and their ids, all in one growing array."""

    def __init__(self, dtype: np.dtype):
        self.slot: dict[bytes, int] = {}
        self.ids, self.bounds, self.held = np.empty(1 << 16, dtype), np.zeros(1 << 12, np.int64), 0

    def add(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m, at = len(self.slot), len(pieces), int(self.bounds[len(self.slot)])
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.empty(at + 2 * len(ids), self.ids.dtype)])
        if n + m >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds[: n + 1], np.zeros(n + 2 * m + 1, np.int64)])
        self.ids[at : at + len(ids)] = ids
        self.bounds[n + 1 : n + m + 1] = at + np.cumsum(lengths)
        self.slot.update(zip(pieces, range(n, n + m)))
        self.held += sum(map(len, pieces)) + ids.nbytes + _ENTRY * m

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths."""
        starts = self.bounds[slots]
        return starts, self.bounds[slots + 1] - starts


class CachedTokenizer:
    """many(texts) gives the ids of a batch of texts. ``cache_bytes`` bounds each of two generations of pieces: once the newer one is
    full, it becomes the older one, and what is used again moves over."""

    def __init__(self, path: str, cache_bytes: int = 64 << 20, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.special, self.cache_bytes = path, special, cache_bytes
        self.tk = Tokenizer.from_file(path)
        self.tk.encode_special_tokens = True  # such literals are cut off before
        self.dtype = np.dtype("<u2" if self.tk.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.now, self.old = _Arena(self.dtype), _Arena(self.dtype)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.added = {t["content"].encode(): t["id"] for t in described["added_tokens"]} if special else {}
        self._added = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        self.lowered = self.tk.normalizer is not None
        self.kinds = _kinds(self.lowered)
        self.bare = Tokenizer(self.tk.model)
        vocab, merges = described["model"]["vocab"], described["model"]["merges"]
        if self.lowered:
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
            self.between = " "
        else:
            merged = set("".join(x if isinstance(x, str) else "".join(x) for x in merges))
            self.between = next(c for c in _TO_LETTERS.values() if c not in merged)
            self.between_id = vocab[self.between]

    def whole_ids(self, utf8: bytes) -> np.ndarray:
        """The plain path: the library, as it comes, over the whole text."""
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(self.path)
        tk.encode_special_tokens = not self.special
        return np.array(tk.encode(utf8.decode(), add_special_tokens=False).ids, "<u4")

    def ids(self, utf8: bytes) -> np.ndarray:
        return np.concatenate([x for x, _ in self.many(pa.array([utf8], pa.binary()))])

    def many(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds) of the texts, group by group: the k-th text of a group has ids[bounds[k] : bounds[k + 1]], ``end_id`` included.
        Memory is bounded by GROUP_BYTES or the longest text."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES)))
            ids, bounds = self._group(texts[at:upto])
            if end_id is not None:
                ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
            yield ids, bounds
            at = upto

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.now.held > self.cache_bytes:
            self.old, self.now = self.now, _Arena(self.dtype)
        raw = texts.to_pylist()
        odd = [k for k, x in enumerate(raw) if self._is_odd(x)]
        if not odd:
            return self._joined(self._cut_all(texts))
        even = sorted(set(range(len(raw))) - set(odd))
        got: list = [None] * len(raw)
        for at, cut in ((even, self._cut_all(texts.take(pa.array(even, pa.int64())))), (odd, pa.array([self._cut_one(raw[k]) for k in odd], pa.list_(pa.binary())))):
            ids, bounds = self._joined(cut)
            for j, k in enumerate(at):
                got[k] = ids[bounds[j] : bounds[j + 1]]
        return np.concatenate(got), np.append(0, np.cumsum([len(x) for x in got]))

    # Cutting
    def _is_odd(self, utf8: bytes) -> bool:
        if self._added and b"<|" in utf8 and self._added.search(utf8):
            return True
        return not self.lowered and bool(_RUN.search(utf8) or not utf8.isascii() and _WIDE.search(utf8))

    def _cut_all(self, texts: pa.Array) -> pa.ListArray:
        """Lower-casing vocabularies drop white space: words between ASCII white space are independent. Others have the space before a
        word as part of it; a line's first word has its line feed instead, a text's first one nothing."""
        if self.lowered:
            return pa.array([x.lower().split() for x in texts.to_pylist()], pa.list_(pa.binary()))
        lines = pc.replace_substring(texts, b"\n", b" \n")
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_AS_IT_IS, pa.binary()), lines, pa.scalar(b"", pa.binary())), b" ")

    def _cut_one(self, utf8: bytes) -> list[bytes]:
        """Any text."""
        out: list[bytes] = []
        for k, part in enumerate(self._added.split(utf8) if self._added else [utf8]):
            if k % 2:
                out.append(_ADDED + str(self.added[part]).encode())
            elif self.lowered:
                out += part.lower().split()
            else:
                out += [x[1:].encode() if x[0] == " " and len(x) > 1 and x[1] not in "\t\n\x0b\x0c\r " else _AS_IT_IS + x.encode() for x in _CHUNK.findall(part.decode())]
        return out

    # Joining
    def _joined(self, cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        found = cut.flatten().dictionary_encode()
        slots = self._slots(found.dictionary.to_pylist())[found.indices.to_numpy()] if len(found) else np.empty(0, np.int64)
        starts, lengths = self.now.of(slots)
        words = np.append(0, np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False)))
        ids = [_spans(self.now.ids, starts[k : k + RUN_WORDS], lengths[k : k + RUN_WORDS]) for k in range(0, len(slots), RUN_WORDS)]
        return np.concatenate([np.empty(0, self.dtype), *ids]).astype("<u4"), np.append(0, np.cumsum(lengths))[words]

    def _slots(self, pieces: list[bytes]) -> np.ndarray:
        have = self.now.slot
        new = [p for p in pieces if p not in have]
        if new and self.old.slot:
            old = self.old.slot
            back = [p for p in new if p in old]
            starts, lengths = self.old.of(np.fromiter(map(old.__getitem__, back), np.int64, len(back)))
            self.now.add(back, _spans(self.old.ids, starts, lengths), lengths)
            new = [p for p in new if p not in old]
        if new:
            self._learn(new)
        return np.fromiter(map(have.__getitem__, pieces), np.int64, len(pieces))

    # Encoding
    def _text(self, piece: bytes) -> bytes:
        if self.lowered or piece[:1] == b"\n":
            return piece
        return piece[1:] if piece[:1] == _AS_IT_IS else b" " + piece

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces of known letters, figures and signs by their parts, all others by the library as they are."""
        added = [p for p in pieces if p[:1] == _ADDED]
        if added:
            self.now.add(added, np.array([int(p[1:]) for p in added], self.dtype), np.ones(len(added), np.int64))
            pieces = [p for p in pieces if p[:1] != _ADDED]
        if not pieces:
            return
        texts = [self._text(p) for p in pieces]
        raw = np.frombuffer(b"\0".join([x if b"\0" not in x else b"\1" for x in texts]) + b"\0", np.uint8)
        kind = self.kinds[raw]
        word = np.cumsum(kind == _END) - (kind == _END)
        bad = kind == _OTHER
        after = np.append(kind[1:], _END)
        first = np.append(True, kind[:-1] == _END)
        white = (kind == _SPACE) | (kind == _FEED)
        bad |= white & (~first | (after == _SPACE) | (after == _FEED) | (after == _END))
        bad |= first & (kind == _END)
        tail = np.append(raw[1:], 0)
        foreign = (tail < 0x9F) | (tail == 0xB7) if self.lowered else (tail == 0x97) | (tail == 0xB7)
        bad |= (raw == 0xC3) & foreign
        as_is = np.zeros(len(texts), bool)
        as_is[word[bad]] = True
        keep = ~as_is[word]
        known = [p for p, x in zip(pieces, as_is) if not x]
        if known:
            self.now.add(known, *self._encode_parts(raw[keep], kind[keep]))
        rest = np.flatnonzero(as_is).tolist()
        if rest:
            got = [np.array(e.ids, self.dtype) for e in self.tk.encode_batch_fast([texts[k].decode() for k in rest], add_special_tokens=False)]
            self.now.add([pieces[k] for k in rest], np.concatenate(got), np.array([len(x) for x in got], np.int64))

    def _encode_parts(self, raw: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of words, each with a zero byte behind it, and how many each has. A word is cut where the kind changes, but behind its
        space; figures stand alone in lower-casing vocabularies."""
        after, ends = np.append(kind[1:], _END), kind == _END
        cut = (kind != after) & (kind != _SPACE) & ~ends & (after != _END)
        if self.lowered:
            cut |= (kind == _FIGURE) & (after == _FIGURE)
        parts = np.diff(np.append(0, np.cumsum(cut)[ends])) + 1
        codes = np.where(ends, np.uint32(ord(self.between)), _LETTER_CODES[raw])
        shift = np.cumsum(cut) - cut
        text = np.full(len(codes) + int(cut.sum()), ord(self.between), "<u4")
        text[np.arange(len(codes)) + shift] = codes
        stops = (np.arange(len(codes)) + shift)[ends][JOINED - 1 :: JOINED]
        strings = [x.tobytes().decode("utf-32-le") for x in np.split(text, stops + 1) if len(x)]
        ids: list[int] = []
        for e in self.bare.encode_batch_fast(strings, add_special_tokens=False):
            ids += e.ids
        every = np.array(ids, np.int64)
        if self.lowered:
            counts = np.diff(np.append(0, np.flatnonzero(self.last[every]) + 1))
        else:
            apart = every == self.between_id
            counts = np.diff(np.append(-1, np.flatnonzero(apart))) - 1
            every = every[~apart]
        if len(counts) != parts.sum():
            raise ValueError("a part was split in another way than expected")
        return every.astype(self.dtype), np.add.reduceat(counts, np.cumsum(parts) - parts)


def tokenizer(path: str, special: bool = True) -> CachedTokenizer:
    """One per worker process and vocabulary; workers are used again, so its caches stay warm."""
    return worker_cache(f"tokenizer {path} {special}", lambda: CachedTokenizer(path, special=special))
