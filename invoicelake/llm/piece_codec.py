"""SentencePiece encoding and decoding by a merge-type prefix table, equal to the library's.

A model of type BPE joins, again and again, the two neighbours whose joined piece has the best score. Every prefix of a text then has
one last token: the only vocabulary entry that ends there, whose beginning is a prefix with a last token of its own that is compatible with
it. So one pass along the text fills a table: an automaton gives the entries that end at each place, the pair test picks the one, and the
ids are recovered backwards. Time is linear in the text, however long, and nothing is merged.

The pair test asks whether two entries, written side by side, stay as they are: it takes them apart along the border, always at
that side whose last merge came later, and fails where a merge across the border would have come before.

Texts are cut where no entry can reach across: in front of a space, since no entry has one behind another sign. Words between cuts are met
again and again, so a worker keeps their ids, at most so many; longer ones are encoded anew. Signs that the vocabulary lacks become
their UTF-8 bytes; no entry reaches across them either. Runs of spaces are entries of one score and so are joined from the left, last of all.

Null and empty texts have no ids and decode to ''. Null lists of ids decode as empty ones. Rows may repeat. Columns of the input are kept;
one that has the name of the result is replaced. Models are refused that normalise, drop spaces, have user-defined or unused entries, or no
byte entries: for them the result would not be the library's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, slices, worker_cache

SPACE = "▁"
#: Between words that are encoded together; no entry may have it.
SEPARATOR = "\n"
#: Longest word whose ids are kept, the most signs of the words of one generation of two, and of pairs of entries that were tested.
KEPT_LENGTH, KEPT_SIGNS, KEPT_PAIRS = 48, 4_500_000, 300_000
#: In the table: no token ends here; a text begins here, or a sign that the vocabulary lacks ends here.
NOTHING, BORDER = -1, -2


class Codec:
    """The tables of one model."""

    def __init__(self, model_path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.model_path, self.rank = model_path, None

    def _build(self) -> None:
        """What encoding needs and decoding doesn't."""
        self._entries(self.model_path)
        self._merges()
        self.kept: dict[str, bytes] = {}  # words of late, and those before them that weren't met since
        self.before: dict[str, bytes] = {}
        self.signs = 0

    def _entries(self, model_path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        t, n = model.trainer_spec, model.normalizer_spec
        plain = not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not t.treat_whitespace_as_suffix
        if t.model_type != t.BPE or not plain or not t.byte_fallback or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("a BPE model is needed that takes texts as they are, with byte entries and without user-defined or unused ones")
        self.byte_ids = [0] * 256
        normal = []
        for k, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = k
            elif p.type == kinds.NORMAL:
                normal.append((p.piece, p.score, k))
        self.runs = {p: k for p, _, k in normal if set(p) == {SPACE}}
        if any(SEPARATOR in p for p, _, _ in normal):
            raise ValueError("no entry may have a line feed")
        words = [(p, s, k) for p, s, k in normal if p == SPACE or p not in self.runs]
        joined = [s for p, s, _ in words if len(p) > 1]
        if any(SPACE in p[1:] for p, _, _ in words) or len(set(joined)) < len(joined) or {s for p, s, _ in normal if p in self.runs and p != SPACE} & set(joined):
            raise ValueError("entries need scores of their own, and spaces at their beginnings only")
        if any(s >= min(joined, default=0) for p, s, _ in normal if p in self.runs and p != SPACE) or len({s for p, s, _ in normal if p in self.runs and p != SPACE}) > 1:
            raise ValueError("runs of spaces need one score, below all others")
        self.ids = {p: k for p, _, k in words}
        self.rank = {k: r for r, (_, _, k) in enumerate(sorted(words, key=lambda x: (len(x[0]) > 1, -x[1])))}  # single signs first, then by merge
        self.text = {k: p for p, _, k in words}

    def _merges(self) -> None:
        """The last merge of each entry, found with the table itself: entries of lower rank are known when one is taken apart. An entry that
        merging never gives is left out."""
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.pair: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.single = {p: k for p, k in self.ids.items() if len(p) == 1}
        self.size = {k: len(p) for p, k in self.ids.items()}
        self.split.update((k, (k, k)) for k in self.single.values())
        made: list[int] = []
        entries = sorted((k for k, p in self.text.items() if len(p) > 1), key=self.rank.__getitem__)
        every = ahocorasick.Automaton()
        for piece, k in self.ids.items():
            every.add_word(piece, (k, len(piece)))
        every.make_automaton()
        for k in entries:
            parts = self._parts(self.text[k], every)
            if len(parts) == 2:  # else its parts never meet as two
                self.split[k] = tuple(parts)
                self.joined[tuple(parts)] = k
                made.append(k)
        for k in made:
            self.automaton.add_word(self.text[k], (k, len(self.text[k])))
        self.automaton.make_automaton()
        self.usable, self.pair = set(self.split), {}
        self.unknown = re.compile("[^" + "".join(map(re.escape, self.single)) + "]")

    def _parts(self, entry: str, every: ahocorasick.Automaton) -> list[int]:
        """An entry's tokens before its own last merge: those that are known so far, by the same table."""
        last, length = [BORDER] + [NOTHING] * len(entry), [0] * (len(entry) + 1)
        for end, (k, size) in every.iter(entry):
            before = last[end + 1 - size]
            if k in self.split and not length[end + 1] and (before == BORDER or before >= 0 and self.compatible(before, k)):
                last[end + 1], length[end + 1] = k, size
        out, at = [], len(entry)
        while at > 0:
            out.insert(0, last[at])
            at -= length[at]
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two entries side by side stay two."""
        rank, split, joined = self.rank, self.split, self.joined
        limit = len(rank) + 1  # merges from here on would come after what is taken apart already
        while True:
            across = joined.get((left, right))
            if across is not None and rank[across] < limit:
                return False
            single_left, single_right = split[left] == (left, left), split[right] == (right, right)
            if single_left and single_right:
                return True
            # of the two sides' last merges the later one is undone; of equal ones the right side's, as merging goes from the left
            if not single_left and (single_right or rank[left] > rank[right]):
                limit, left = rank[left], split[left][1]
            else:
                limit, right = rank[right] + 1, split[right][0]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids, as 32-bit numbers, of words without spaces, each behind one space. They are written one behind the other with a sign between that no
        entry has, so that the automaton runs once; the table has a place for each sign."""
        joined = SEPARATOR + SEPARATOR.join([SPACE + w for w in words])
        last = [NOTHING] * len(joined)
        for lacking in self.unknown.finditer(joined):
            last[lacking.start()] = BORDER
        self._fill(joined, last)
        size, single = self.size, self.single
        out: list[int] = []
        counts: list[int] = []
        end = len(joined) - 1
        for w in reversed(words):  # ids are recovered backwards
            begin, at, before = end - len(w) - 1, end, len(out)
            while at > begin:
                k = last[at]
                if k == BORDER:
                    out += [self.byte_ids[b] for b in reversed(joined[at].encode())]
                    at -= 1
                elif k == NOTHING:
                    out.append(single[joined[at]])
                    at -= 1
                else:
                    out.append(k)
                    at -= size[k]
            counts.append(len(out) - before)
            end = begin - 1
        ids = np.array(out[::-1], "<u4").tobytes()
        ends = np.cumsum([0] + counts[::-1]) * 4
        return [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _fill(self, text: str, last: list[int]) -> None:
        """Puts last tokens into the table; places are those of last signs. Of the entries that end at a place one at most fits; where none of
        two signs or more does, it is the sign itself, which is put there once it is asked for. The text begins with a border."""
        pair, single, compatible = self.pair, self.single, self.compatible
        for end, (k, size) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            begin = end - size
            before = last[begin]
            if before < 0:
                if before == BORDER:
                    last[end] = k
                    continue
                before = last[begin] = single[text[begin]]
            key = before << 20 | k
            fits = pair.get(key)
            if fits is None:
                if len(pair) >= KEPT_PAIRS:
                    pair.clear()
                fits = pair[key] = compatible(before, k)
            if fits:
                last[end] = k

    def spaces(self, n: int) -> bytes:
        """Ids of a run of single spaces: as all longer runs have one score, the leftmost two that make an entry are joined, time and again."""
        got: list[int] = []
        todo = [1] * n
        todo.reverse()
        while todo:
            got.append(todo.pop())
            while True:
                if len(got) > 1 and SPACE * (got[-2] + got[-1]) in self.runs:
                    got[-2:] = [got[-2] + got[-1]]
                elif todo and SPACE * (got[-1] + todo[-1]) in self.runs:
                    got[-1] += todo.pop()
                else:
                    break
        return np.array([self.runs[SPACE * k] for k in got], "<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as 32-bit numbers. Words that weren't met before are encoded together."""
        if self.rank is None:
            self._build()
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        kept, before = self.kept, self.before
        new = set().union(*split).difference(kept)
        new.discard("")
        for w in before.keys() & new:
            kept[w] = before[w]
        self.signs += sum(map(len, new)) + 8 * len(new)
        new = list(new.difference(kept))
        kept.update(zip(new, self.words(new)))
        out = [b"".join(map(kept.__getitem__, words)) if "" not in words else self._spaced(words) for words in split]
        for w in new:
            if len(w) > KEPT_LENGTH:
                del kept[w]
                self.signs -= len(w) + 8
        if self.signs > KEPT_SIGNS:
            self.kept, self.before, self.signs = {}, kept, 0
        return out

    def _spaced(self, words: list[str]) -> bytes:
        """Ids of a text with runs of spaces: an empty word has another space behind its own."""
        lone = np.array([self.runs[SPACE]], "<u4").tobytes()
        out, run = [], 0
        for word in words:
            run += 1
            if word:
                ids = self.kept[word]
                if ids[:4] == lone:
                    ids = ids[4:]
                else:
                    run -= 1
                if run:
                    out.append(self.spaces(run))
                out.append(ids)
                run = 0
        if run:
            out.append(self.spaces(run))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _codec(model_path: str) -> Codec:
    return worker_cache(f"pieces {model_path}", lambda: Codec(model_path))


def _pieces(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    begin, held = 0, 0
    for k in range(len(column)):
        size = column[k].as_buffer().size if column[k].is_valid else 0
        if held and held + size > most:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(column):
        yield begin, len(column)


def _encoder(model_path: str, text_col: str, out_col: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for b in slices(batches, BATCH_ROWS):
            text = b.column(b.schema.get_field_index(text_col))
            for i, j in _pieces(text, 2 << 20):
                part = b.slice(i, j - i)
                encoded = codec.encode_all(text.slice(i, j - i).to_pylist())
                ends = np.cumsum([0] + [len(e) // 4 for e in encoded]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids if f.name == out_col else part.column(part.schema.get_field_index(f.name)) for f in schema], names=schema.names)

    return run


def _decoder(model_path: str, ids_col: str, out_col: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for b in slices(batches, BATCH_ROWS):
            column = b.column(b.schema.get_field_index(ids_col))
            texts = pa.array([codec.decode(x.values.to_pylist()) if x.is_valid and len(x.values) else "" for x in column], pa.string())
            yield pa.RecordBatch.from_arrays([texts if f.name == out_col else b.column(b.schema.get_field_index(f.name)) for f in schema], names=schema.names)

    return run


def _with(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df.withColumn(column, F.lit(None).cast(kind))


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with ``out_col`` array<int>: the ids that the library's encode(text) gives, without begin and end. The text itself is kept."""
    out = _with(docs, out_col, "array<int>").schema
    return docs.drop(out_col).mapInArrow(_encoder(model_path, text_col, out_col, _arrow(out)), out)


def decode(df: DataFrame, model_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with ``out_col``: the text that the library's decode(ids) gives."""
    out = _with(df, out_col, "string").schema
    return df.drop(out_col).mapInArrow(_decoder(model_path, ids_col, out_col, _arrow(out)), out)


def _arrow(schema) -> pa.Schema:
    """Names alone matter to the workers."""
    return pa.schema([(f.name, pa.null()) for f in schema.fields])
