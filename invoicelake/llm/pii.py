"""Personal data: plain identifiers, and disguised ones found through offset-preserving transducers.

Plain matches are leftmost and non-overlapping for each kind (email, ip, card, phone); what fails its check is dropped and
not tried again. A disguised text runs through a chain of transducers, each of which rewrites pieces and keeps, for every character it
gives, the span of source characters it stands for:

1. characters: format characters vanish; no-break spaces, full-width, mathematical, Cyrillic and Greek look-alikes become ASCII;
2. look-alike letters between digits (O, o, I, l) become digits;
3. spelled digits, "plus", "double", "triple", "dot", "dash" become characters, and the separators between them vanish;
4. "[at]", "(dot)" and the like, and "at" ... "dot" between the parts of an address, in English, Spanish, French and German, become "@" and ".".

White space of any kind and length separates; local parts, labels and runs have no bound.

Identifiers found in the result are mapped back to source spans. They are added where they overlap no plain match; plain matches
stay as they are. Spelled digits and numerals may be mixed in a run; the kinds' own checks reject what is none of them. A step runs only where
its gate finds what each of its edits must hold; gates take in more than the steps, so they change no result. Each step is linear in the
text's length.

Null and empty texts: no spans. Null ids and repeated rows are kept as they are. An empty table gives no rows. Other
columns are left out by ``find``, and kept by ``redact``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_columns, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _good_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _good_card(s: str) -> bool:
    digits = _NOT_DIGIT.sub("", s)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _good_phone(s: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", s)) <= 15


def plain(text: str) -> list[Span]:
    """By start, then kind."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        for kind, pattern, good in (("ip", _IP, _good_ip), ("card", _CARD, _good_card), ("phone", _PHONE, _good_phone)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Tape:
    """A rewritten text and, for each of its characters, the source span [start, end)."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: Iterator[tuple[int, int, str]]) -> None:
        """Replaces ascending pieces [i, j); every new character stands for the whole piece."""
        parts, start, end, at = [], [], [], 0
        for i, j, new in edits:
            parts += [self.text[at:i], new]
            start += self.start[at:i] + [self.start[i]] * len(new)
            end += self.end[at:i] + [self.end[j - 1]] * len(new)
            at = j
        if at or parts:
            self.text = "".join([*parts, self.text[at:]])
            self.start, self.end = start + self.start[at:], end + self.end[at:]


# Cyrillic and Greek letters that look like Latin ones.
_CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijshdqwABEKMHOPCTYXIJS"))
_GREEK = dict(zip("οανρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavptuikABEZHIKMNOPTYX"))
_LOOKS = _CYRILLIC | _GREEK
#: Format characters (zero-width ones, soft hyphens, marks of direction, tags) and variation selectors.
_HIDDEN = frozenset(c for c in map(chr, (*range(1 << 16), *range(0xE0000, 0xE01F0))) if unicodedata.category(c) == "Cf" or unicodedata.name(c, "").startswith("VARIATION SELECTOR"))
_ODD = re.compile(r"[^\x00-\u024F]|[\xA0\xAD]")


def _characters(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ODD.finditer(text):
        c = m[0]
        if c in _HIDDEN:
            yield m.start(), m.end(), ""
        elif c in _LOOKS:
            yield m.start(), m.end(), _LOOKS[c]
        elif len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii() and n != c:
            yield m.start(), m.end(), n


_MIXED = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9OoIl](?:[ ().-]*+[0-9OoIl]){6,}(?![A-Za-z0-9])")
#: A run with both has a figure and a letter side by side, with the run's own separators between.
_MIXED_SIGN = re.compile(r"[0-9][ ().-]*+[OoIl]|[OoIl][ ().-]*+[0-9]")
_AS_DIGIT = {"O": "0", "o": "0", "I": "1", "l": "1"}


def _digit_looks(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _MIXED.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        if 2 * n >= sum(c.isalnum() for c in m[0]):
            for k, c in enumerate(m[0], m.start()):
                if c in _AS_DIGIT:
                    yield k, k + 1, _AS_DIGIT[c]


# Digits spelled in four languages, and what stands between them.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
_MARKS = {"dot": ".", "point": ".", "punto": ".", "punkt": ".", "plus": "+", "dash": "-", "hyphen": "-"}
_REPEATS = {"double": 2, "triple": 3}
_NUMBER_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_SPOKEN = "|".join([_NUMBER_WORD, *_MARKS, *_REPEATS])
#: A run is edited for a spoken piece in it, and that has a neighbour.
_SPELLED_SIGN = re.compile(rf"(?i)(?<!\w)(?:(?:{_SPOKEN})[\s,./()-]++(?:{_SPOKEN}|[0-9]+)|[0-9]+[\s,./()-]++(?:{_SPOKEN}))(?!\w)")
_ITEM = rf"(?:{_NUMBER_WORD}|{'|'.join([*_MARKS, *_REPEATS])}|[0-9]+)"
_SPELLED_RUN = re.compile(rf"(?i)(?<![\w@.+-])\+?(?:{_ITEM})(?:[\s,./()-]++(?:{_ITEM})(?!\w))+")
_PIECE = re.compile(r"[^\W\d_]+|[0-9]+|[^\w]+|_+")


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _SPELLED_RUN.finditer(text):
        pieces = [(p.start() + m.start(), p.end() + m.start(), p[0].lower()) for p in _PIECE.finditer(m[0])]
        while pieces and not (pieces[-1][2] in _SPELLED or pieces[-1][2][0].isdigit()):
            pieces.pop()  # a mark behind the last digit may belong to an address
        words = sum(p in _SPELLED for _, _, p in pieces)
        spoken = words or any(p in _MARKS or p in _REPEATS for _, _, p in pieces)
        digits, times = 0, 1
        for _, _, p in pieces:
            digits += times if p in _SPELLED else sum(c.isdigit() for c in p)
            times = _REPEATS.get(p, 1 if p in _SPELLED or p[0].isdigit() else times)
        if not spoken or digits < 4:
            continue  # no kind has fewer digits
        times = 1
        for k, (i, j, p) in enumerate(pieces):
            if p in _REPEATS:
                times = _REPEATS[p]
                yield i, j, ""
            elif p in _SPELLED:
                yield i, j, _SPELLED[p] * times
                times = 1
            elif p in _MARKS:
                yield i, j, _MARKS[p]
            elif p[0].isdigit():
                if times > 1:
                    yield i, j, p[0] * times + p[1:]
                times = 1
            elif k and (words >= 4 or not (pieces[k - 1][2][0].isdigit() and pieces[k + 1][2][0].isdigit())):
                yield i, j, "." if "." in p and len(p) == 1 else ""


_BRACKETED = re.compile(r"(?i)[\[({<]\s*+(at|dot|@|\.|arroba|arobase?|punto|punkt|point)\s*+[\])}>]\s*+")
#: At signs and their words, with what stands around them. Each run of separators is entered at its beginning alone.
_AT = re.compile(r"(?i)(?<!\s)\s*+(@)\s*+|(?<![\s_-])[\s_-]++(at|arroba|arobase?)[\s_-]++")
#: The words for a dot that go with each of them. "At this point in time" is no address.
_DOTS = {"@": ("dot", "punto", "punkt"), "at": ("dot", "punkt"), "arroba": ("punto", "dot"), "arobas": ("point", "dot"), "arobase": ("point", "dot")}
_LABEL = {at: re.compile(rf"(?i)[A-Za-z0-9]++(?:-++(?!(?:{'|'.join(dots)})[\s_-])[A-Za-z0-9]++)*+") for at, dots in _DOTS.items()}
_DOT = {at: re.compile(rf"(?i)\s*+\.\s*+|[\s_-]++({'|'.join(dots)})[\s_-]++") for at, dots in _DOTS.items()}
_TOP = re.compile(r"[A-Za-z]{2,}")
#: A worded address has a word for a dot or an at sign, or white space beside an at sign or beside a dot of its domain.
_WORDED_SIGN = re.compile(r"(?i)[\s_-](?:dot|punkt)[\s_-]|\s@|@\s|@[A-Za-z0-9.-]+(?:\s+\.|\.\s|[\s_-]+punto)|arroba|arobas")


def _bracketed(text: str) -> Iterator[tuple[int, int, str]]:
    done = 0
    for m in _BRACKETED.finditer(text):
        i = m.start()
        while i > done and text[i - 1].isspace():
            i -= 1
        done = m.end()
        yield i, done, "." if m[1].lower() in ("dot", ".", "punto", "punkt", "point") else "@"


def _domain(text: str, at: int, word: str) -> tuple[int, list[re.Match]]:
    """Where the domain ends that starts at a place, and its dots; without dots there is none. The last label has letters alone. A dot before white
    space ends a sentence, unless the domain's first dot is written so too."""
    dots: list[re.Match] = []
    end, kept = at, 0
    while m := _LABEL[word].match(text, at):
        if dots and _TOP.fullmatch(m[0]):
            end, kept = m.end(), len(dots)
        d = _DOT[word].match(text, m.end())
        if d is None or dots and not d[1] and d[0][-1] != "." and d[0][0] == "." and (dots[0][1] or dots[0][0][-1] == "." or dots[0][0][0] != "."):
            break
        dots.append(d)
        at = d.end()
    return end, dots[:kept]


def _local(text: str, end: int, least: int, word: str) -> tuple[int, list[tuple[int, int]]]:
    """Where the local part starts that ends at a place, not before ``least``, and the words for dots within."""
    dots: list[tuple[int, int]] = []
    start = end
    while True:
        i = start
        while i > least and text[i - 1] in _LOCAL:
            i -= 1
        if i == start:
            return (dots.pop()[1], dots) if dots else (end, dots)
        start = k = i
        while k > least and text[k - 1].isspace():
            k -= 1
        dot = next((d for d in _DOTS[word] if text[max(least, k - len(d)) : k].lower() == d), None)
        if dot is None or k == start:
            return start, dots
        j = i = k - len(dot)
        while j > least and text[j - 1].isspace():
            j -= 1
        if j == i:
            return start, dots
        dots.append((j, start))
        start = j


def _worded(text: str) -> Iterator[tuple[int, int, str]]:
    done = 0
    for m in _AT.finditer(text):
        word = (m[1] or m[2]).lower()
        if m.start() < done:
            continue
        end, dots = _domain(text, m.end(), word)
        if not dots or word == "at" and not any(d[1] for d in dots):
            continue  # "at" before a plain domain is ordinary prose
        start, before = _local(text, m.start(), done, word)
        if start == m.start():
            continue
        for i, j in reversed(before):
            yield i, j, "."
        yield m.start(), m.end(), "@"
        for d in dots:
            yield d.start(), d.end(), "."
        done = end


_STEPS: tuple[tuple[re.Pattern, Callable], ...] = ((_ODD, _characters), (_MIXED_SIGN, _digit_looks), (_SPELLED_SIGN, _spelled), (_BRACKETED, _bracketed), (_WORDED_SIGN, _worded))
#: A run of digits without a plus sign that has a telephone number's length. Nothing else checks it: at least 4 of its digits
#: are spelled, and 3 are different.
_BARE = re.compile(r"(?<![0-9+])[0-9]{9,15}(?![0-9])")


def disguised(text: str, base: list[Span], gated: bool = True) -> list[Span]:
    """Spans of identifiers that only the transducers show, in source characters. Without gates every step runs; the result is the same."""
    tape: Tape | None = None
    spelled = False
    for sign, step in _STEPS:
        now = tape.text if tape else text
        if (not gated or sign.search(now)) and (edits := list(step(now))):
            tape = tape or Tape(text)
            tape.rewrite(iter(edits))
            spelled |= step is _spelled
    if tape is None:
        return []
    found = plain(tape.text)
    if spelled:
        taken = [(s, e) for _, s, e in found]
        for m in _BARE.finditer(tape.text):
            wide = tape.end[m.end() - 1] - tape.start[m.start()]
            words = sum(tape.end[k] - tape.start[k] > 1 for k in range(m.start(), m.end()))
            if wide >= 3 * len(m[0]) and words >= 4 and len(set(m[0])) >= 3 and not any(s < m.end() and m.start() < e for s, e in taken):
                found.append(("phone", m.start(), m.end()))
    out: list[Span] = []
    held: list[Span] = sorted(base, key=lambda s: s[1])
    for kind, s, e in found:
        i, j = tape.start[s], tape.end[e - 1]
        if not any(i < be and bs < j for _, bs, be in held):
            out.append((kind, i, j))
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))
_SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,plain:boolean>>"


def spans_of(text: str) -> list[dict]:
    """All spans of a text, by start, then kind."""
    base = plain(text)
    every = [(*s, True) for s in base] + [(*s, False) for s in disguised(text, base)]
    every.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [{"kind": k, "start": i, "end": j, "plain": p} for k, i, j, p in every]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        (texts,) = next(batch_columns(iter([b]), "text"), [[]])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spans_of(t or "") for t in texts], _SPAN)], names=["doc_id", "spans"])


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): kind, start, end (code points, end exclusive) and whether a plain match."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_find, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans {_SPAN_DDL}")


def redacted(text: str) -> str:
    """Each span, or run of overlapping spans, becomes its kinds in angle brackets."""
    out, at, kinds, start, end = [], 0, [], -1, -1
    for s in [*spans_of(text), {"kind": "", "start": len(text) + 1, "end": len(text) + 1}]:
        if s["start"] >= end and kinds:
            out += [text[at:start], "<", "+".join(dict.fromkeys(kinds)).upper(), ">"]
            at, kinds = end, []
        if not kinds:
            start, end = s["start"], s["end"]
        kinds.append(s["kind"])
        end = max(end, s["end"])
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns, with identifiers in the text replaced; a null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = pa.array([t if t is None else redacted(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if k == at else b.column(k) for k in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, numbers of plain matches of each kind, SHA-256 of the plain matches, all spans, how many there are, how many were added, and
    how many of each kind there are, plain or added."""
    base = F.filter("spans", lambda s: s["plain"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["plain"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"), *(F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_all_{k}") for k in KINDS))
