"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over the words of all documents: a Python task counts words, turns the counts into trigram
   counts and gives at most alphabet**3 rows, which are summed. The model grows in mass with the corpus and is bounded in size: scripts
   of thousands of signs, which no sign of a Latin disguise stands for, count as one letter.
2. A word that looks disguised (digits or signs among letters, letters repeated, letters set apart) is a lattice: a position may be
   what is seen or what the sign stands for, a repeated letter may be one or two, a separator nothing. An exact Viterbi search
   over states of two characters gives the likeliest readings under the model.
3. A document's evidence is that of its three worst restored words. Evidence of a word is the smoothed share of toxic documents among those
   that hold it, or, where different words share a beginning, hold a word that begins so; it is counted over labelled rows, of near copies only one.
   Strong evidence comes first; the rest is counted anew over the toxic documents that hold none of it, so that what merely goes
   along with strong words is not taken for a cause.

Labels are learned only from rows whose crc32(doc_id) mod 3 is not 1, of each class at most ``class_rows``, the first by a hash of the
doc_id; the classifier keeps at most ``model_features`` features, those of the most evidence. These two bound what is sent to the
executors. Where labels of a doc_id differ, toxic holds. Scores read the text alone.

Null and empty texts score the share of toxic rows. Null labels teach nothing; without labels every score is 0. Rows that repeat
a doc_id are scored each on its own. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch_columns, slices, worker_cache
from .shingles import mix, window_hashes, word_hashes

# What a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¥": "y"}
_SIGNS = re.escape("".join(STANDS_FOR))
_EDGE = " \t\n.,;:!?\"'`´«»“”‘’()[]{}<>*#%&|~_-=/\\^…"
_LOOSE = re.compile(rf"[^\W\d_][{_SIGNS}]|[{_SIGNS}][^\W\d_]|(\w)\1\1|^\w(?:[.\-_*/]\w){{2,}}$|[^\W\d_][*_.\-][^\W\d_]")
_SEPARATORS = ".-_*/~'"
#: Four or more single characters, each with its combining marks, set apart by any white space.
_SPACED = re.compile(r"(?<!\S)\S[\u0300-\u036f]*+(?:\s++\S[\u0300-\u036f]*+(?!\S)){3,}")
_SPACE = re.compile(r"\s+")
#: Seen as meant, a sign for a letter, a letter more or less: costs in nats.
COST_SIGN, COST_SEPARATOR, COST_RUN, COST_LOST_SIGN = 1.0, 0.5, 0.3, 8.0
#: Readings given of a lattice.
BEST = 6
#: Beginnings of a word that carry evidence, in letters.
BEGINNINGS = (4, 5, 6, 7)
#: A long lattice is read in windows of twice as many pieces, half of each in the next: what has so many letters lies whole in one.
HALF_WINDOW = 24
#: Of a longer token, what stands between separators counts too, and words within.
LONG = 40
_APART = re.compile(rf"[^\w{_SIGNS}]+|_+")
PRIOR_ROWS = 3.0
#: Ideographs, kana, syllables of Hangul and the like, and the letter that they count as.
_MANY = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")
_FIRST_OF_MANY, _ONE = "\u2e80", "\u5b57"


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[bytes] = Counter()
    grams: Counter[str] = Counter()

    def fold() -> None:
        for w, n in words.items():
            text = w.decode().strip(_EDGE).lower()
            if text.isalpha():
                padded = f"^^{_MANY.sub(_ONE, text)}$"
                for k in range(len(padded) - 2):
                    grams[padded[k : k + 3]] += n
        words.clear()

    for (texts,) in batch_columns(batches, "utf8"):
        for utf8 in texts:
            words.update(utf8.split())
        if len(words) > 300_000:
            fold()
    fold()
    yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])


class CharModel:
    """Interpolated character trigrams; cost(a, b, c) is -log p(c | a b)."""

    def __init__(self, counts: dict[str, int]):
        self.tri = counts
        self.two: Counter[str] = Counter()
        self.mid: Counter[str] = Counter()
        self.one: Counter[str] = Counter()
        for g, n in counts.items():
            self.two[g[:2]] += n
            self.mid[g[1:]] += n
            self.one[g[2]] += n
        self.pre: Counter[str] = Counter()
        for g, n in self.mid.items():
            self.pre[g[0]] += n
        self.total = sum(self.one.values()) or 1
        self.kinds = len(self.one) + 1

    def cost(self, a: str, b: str, c: str) -> float:
        if a >= _FIRST_OF_MANY or b >= _FIRST_OF_MANY or c >= _FIRST_OF_MANY:
            a, b, c = _MANY.sub(_ONE, a), _MANY.sub(_ONE, b), _MANY.sub(_ONE, c)
        one = (self.one[c] + 1) / (self.total + self.kinds)
        two = (self.mid[b + c] + 4 * one) / (self.pre[b] + 4)
        return -math.log((self.tri.get(a + b + c, 0) + 4 * two) / (self.two[a + b] + 4))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each piece of a word, its readings and their costs. A run of a letter is one piece, read once or twice."""
    out: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(word):
        c, run = word[k], 1
        while k + run < len(word) and word[k + run] == c:
            run += 1
        if c.isalpha():
            ways = [(c * run, 0.0)] if run <= 2 else []
            if run > 1:
                ways += [(c, COST_RUN if run > 2 else 3.0)]
            if run > 2:
                ways += [(c * 2, COST_RUN)]
        elif c in STANDS_FOR:
            ways = [(x * min(run, 2), COST_SIGN) for x in STANDS_FOR[c]]
            if run > 1:
                ways += [(x, COST_SIGN) for x in STANDS_FOR[c]]
            ways += [("", COST_LOST_SIGN)]
        elif c in _SEPARATORS:
            ways = [("", COST_SEPARATOR)]
        else:
            ways = [(c * run, 0.0)]
        out.append(ways)
        k += run
    return out


def windows(word: str, half: int = HALF_WINDOW) -> Iterator[list[list[tuple[str, float]]]]:
    """The pieces of a word but for separators; of more than twice ``half``, in windows of that many."""
    pieces = [ways for ways in lattice(word) if ways != [("", COST_SEPARATOR)]]
    for k in range(0, max(len(pieces) - half, 1), half):
        yield pieces[k : k + 2 * half]


def readings(pieces: list[list[tuple[str, float]]], model: CharModel) -> list[str]:
    """The ``BEST`` likeliest readings of a lattice, best first. Exact: what follows costs the same after the same two characters,
    so of the strings that end in them only so many can be among the best."""
    held: dict[str, list[tuple[float, str]]] = {"^^": [(0.0, "")]}
    for ways in pieces:
        nxt: dict[str, dict[str, float]] = {}
        for last, best in held.items():
            for text, extra in ways:
                now, total = last, extra
                for c in text:
                    total += model.cost(now[0], now[1], c)
                    now = now[1] + c
                into = nxt.setdefault(now, {})
                for cost, seen in best:
                    if cost + total < into.get(seen + text, math.inf):
                        into[seen + text] = cost + total
        held = {last: sorted((c, s) for s, c in into.items())[:BEST] for last, into in nxt.items()}
    ended: dict[str, float] = {}
    for last, best in held.items():
        end = model.cost(last[0], last[1], "$")
        for cost, seen in best:
            ended[seen] = cost + end
    return [s for _, s in sorted((c, s) for s, c in ended.items())[:BEST]]


def bared(word: str) -> str:
    """Lower case, without marks at its ends."""
    low = word.lower()
    bare = low.strip(_EDGE)
    return "!" + bare if low[:1] == "!" and bare and low[:2] != "!!" else bare


def restore(word: str, model: CharModel, half: int = HALF_WINDOW) -> list[str]:
    """A word as written, bared, and, where it looks disguised, its likeliest readings, of a long one those of each window."""
    bare = bared(word)
    if not _LOOSE.search(bare):
        return [bare]
    return [bare, *(x for pieces in windows(bare, half) for x in readings(pieces, model))]


def spaced_runs(text: str) -> set[str]:
    """Letters that were set apart, joined."""
    return {unicodedata.normalize("NFC", _SPACE.sub("", run)) for run in _SPACED.findall(text)}


def restored_text(text: str, model: CharModel) -> str:
    """The text with each disguised word replaced by its likeliest reading, and letters set apart joined."""

    def best(word: str) -> str:
        pieces, step = lattice(bared(word)), 2 * HALF_WINDOW
        return "".join(readings(pieces[k : k + step], model)[0] for k in range(0, len(pieces), step))

    text = _SPACED.sub(lambda m: _SPACE.sub("", m[0]), text)
    return re.sub(r"\S+", lambda m: best(m[0]) if _LOOSE.search(m[0].strip(_EDGE)) else m[0], text)


def read_words(word: str, model: CharModel, half: int = HALF_WINDOW) -> list[str]:
    """What a token may be read as, in words of three letters or more: its readings and, of a long one, those of its parts."""
    out = restore(word, model, half)
    if len(out[0]) > LONG:
        for part in set(_APART.split(out[0])) - {out[0]}:
            out += restore(part, model, half)
    return [x for x in dict.fromkeys(out) if len(x) >= 3]


def features(word: str) -> list[str]:
    """The word as a whole, a long one by its hash, and its beginnings."""
    return [(word if len(word) <= LONG else xxhash.xxh3_128_hexdigest(word)) + "$", *(word[:k] for k in BEGINNINGS if len(word) > k)]


def doc_words(utf8: bytes, model: CharModel, limit: dict) -> set[str]:
    out: set[str] = set()
    for w in set(utf8.lower().split()):
        got = limit.get(w)
        if got is None:
            if len(limit) > 200_000:
                limit.clear()
            got = tuple(read_words(w.decode(), model))
            if len(w) <= 64:
                limit[w] = got
        out.update(got)
    for run in spaced_runs(utf8.decode(errors="ignore")):
        out.update(restore(run, model))
    return out


def copy_bands(utf8: bytes) -> list[int]:
    """Four hashes, each of two least five-word windows: near copies share one of them, texts that share a passage seldom."""
    h = word_hashes(utf8.lower().split())
    if not len(h):
        return []
    w = window_hashes(h, min(5, len(h)))
    least = np.array([mix(w ^ np.uint64(0x1F3D5B79 * (k + 1))).min() for k in range(8)], np.uint64)
    return mix(least[::2] * np.uint64(3) + least[1::2] + np.arange(4, dtype=np.uint64)).view(np.int64).tolist()


def _sample_features(model: CharModel):
    ints, strings = pa.list_(pa.int64()), pa.list_(pa.string())
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("bands", ints), ("features", strings), ("low", ints), ("high", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for doc_ids, toxic, texts in batch_columns(batches, "doc_id", "toxic", "utf8"):
            rows = []
            for doc_id, t, utf8 in zip(doc_ids, toxic, texts):
                held: dict[str, tuple[int, int]] = {}
                for w in doc_words(utf8, model, cache):
                    own = xxhash.xxh3_64_intdigest(w) >> 1
                    for f in features(w):
                        lo, hi = held.get(f, (own, own))
                        held[f] = (min(lo, own), max(hi, own))
                rows.append((doc_id, t, copy_bands(utf8), list(held), [x[0] for x in held.values()], [x[1] for x in held.values()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


class WordScores(dict):
    """Evidence of each word, as written, in bytes; forgets all at ``limit``."""

    limit = 300_000

    def __init__(self, model: CharModel, weights: dict[str, float]):
        self.model, self.weights = model, weights
        self.lengths = sorted({len(f) - 1 for f in weights if f[-1] == "$" and len(f) > 4})
        self.half = max([HALF_WINDOW, *self.lengths])

    def of(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def __missing__(self, w: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        ways = read_words(w.decode(), self.model, self.half)
        got = max(map(self.of, ways), default=0.0)
        if len(w) > LONG and len(bared(w.decode())) > LONG:
            got = max(got, self.within(ways))
        if len(w) <= 64:
            self[w] = got
        return got

    def joined(self, text: str) -> float:
        """Evidence in letters that were set apart: of any whole word within."""
        return self.within(restore(text, self.model, self.half))

    def within(self, ways: list[str]) -> float:
        return max((self.weights.get(way[i : i + n] + "$", 0.0) for way in ways for n in self.lengths for i in range(len(way) - n + 1)), default=0.0)

    def score(self, utf8: bytes, rate: float) -> float:
        found = [*map(self.__getitem__, set(utf8.lower().split())), *map(self.joined, spaced_runs(utf8.decode(errors="ignore").lower()))]
        worst = sorted((s for s in found if s > 0.5), reverse=True)[:3]
        left = 1.0
        for s in worst:
            left *= 1 - s
        return max(1 - left, 0.0) if worst else rate


def _scores_of(key: str, shared) -> WordScores:
    return worker_cache(key, lambda: WordScores(CharModel(shared.value[0]), shared.value[1]))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _score_all(key: str, shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores_of(key, shared)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scores.score(x, rate) for x in _texts(b.column(1))], pa.float64())], names=["doc_id", "score"])

    return run


def _below(key: str, shared, rate: float, at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores_of(key, shared)
        for b in slices(batches):
            yield b.filter(pa.array([scores.score(x, rate) < threshold for x in _texts(b.column(at))], pa.bool_()))

    return run


def held_out(doc_id: Column | str) -> Column:
    """Rows that nothing is learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", class_rows: int = 10_000, model_features: int = 200_000) -> tuple[dict[str, int], dict[str, float], float]:
    """(trigram counts, evidence of features, share of toxic rows). Both tables are bounded: by the alphabet, by ``model_features``."""
    spark = docs.sparkSession
    work = Scratch(spark, "toxicity")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("utf8"))
    grams = source.select("utf8").mapInArrow(_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = {g: n for g, n in grams.collect()}
    model = CharModel(counts)

    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    numbers = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not numbers.get(1):
        return counts, {}, 0.0
    rate = numbers[1] / sum(numbers.values())
    taken = {k: min(1.0, class_rows / n) for k, n in numbers.items()}
    first_rows = lambda k: known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(class_rows)
    chosen = work.store(first_rows(1).unionByName(first_rows(0)))
    made = source.join(F.broadcast(chosen), "doc_id").mapInArrow(_sample_features(model), "doc_id long, toxic int, bands array<long>, features array<string>, low array<long>, high array<long>")
    sample = work.store(made)
    bands = sample.select("doc_id", "toxic", F.explode("bands").alias("band"))
    first = bands.groupBy("band", "toxic").agg(F.min("doc_id").alias("first"))
    copies = bands.join(first, ["band", "toxic"]).filter("doc_id <> first").select("doc_id").distinct()
    rows = work.store(sample.join(copies, "doc_id", "left_anti"))
    work.drop(sample)
    toxic = rows.filter("toxic = 1").select("doc_id", F.expr("inline(arrays_zip(features, low, high))")).withColumnRenamed("features", "feature")
    n_toxic = rows.filter("toxic = 1").count()
    several = toxic.groupBy("feature").agg(F.count("*").alias("t"), F.min("low").alias("lo"), F.max("high").alias("hi"))
    several = several.filter(f"t >= {max(3, n_toxic // 500)} and (right(feature, 1) = '$' or lo <> hi)").select("feature", "t")
    clean = rows.filter("toxic = 0").select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("c"))
    weight = taken[1] / taken.get(0, 1.0)
    found = several.join(clean, "feature", "left").select("feature", "t", (F.coalesce("c", F.lit(0)) * weight).alias("c"))

    def share(t: str) -> Column:
        return (F.col(t) + PRIOR_ROWS * rate) / (F.col(t) + F.col("c") + PRIOR_ROWS)

    found = work.store(found.withColumn("share", share("t")).filter("share > 0.3"))
    strong = found.filter(f"share > 0.85 and t >= {max(8, n_toxic // 100)}").select("feature", "share")
    explained = toxic.join(strong, "feature", "left_semi").select("doc_id").distinct()
    again = toxic.join(explained, "doc_id", "left_anti").groupBy("feature").agg(F.count("*").alias("u"))
    weak = found.join(strong, "feature", "left_anti").join(again, "feature").filter("u >= 3").withColumn("share", share("u")).filter("share > 0.5")
    kept = strong.unionByName(weak.select("feature", "share")).orderBy(F.desc("share"), "feature").limit(model_features)
    weights = {r["feature"]: r["share"] for r in kept.collect()}
    work.drop(rows, found, chosen)
    return counts, weights, rate


def _learned(docs: DataFrame, labels: DataFrame, **how) -> tuple[str, object, float]:
    """The workers' key for a model, the model as it is sent to them, and the score of texts without evidence."""
    counts, weights, rate = learn(docs, labels, **how)
    return f"toxicity {uuid.uuid4().hex}", docs.sparkSession.sparkContext.broadcast((counts, weights)), min(rate, 0.5)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", class_rows: int = 10_000, model_features: int = 200_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    key, shared, rate = _learned(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, class_rows=class_rows, model_features=model_features)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = source.mapInArrow(_score_all(key, shared, rate), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", class_rows: int = 10_000, model_features: int = 200_000, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score less than ``threshold``."""
    key, shared, rate = _learned(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, class_rows=class_rows, model_features=model_features)
    return docs.mapInArrow(_below(key, shared, rate, docs.columns.index(text_col), threshold), docs.schema)
