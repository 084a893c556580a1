"""Quality rules as a bitmask ledger.

Each rule is evaluated once: a document's row in the ledger holds its measurements and one bit for each rule it fails. A policy is a
version and a mask of the rules it enforces; applying another policy, or asking what each rule alone is responsible for, is
bit arithmetic over the stored ledger and reads no text again.

Null and empty texts have no words and fail ``few_words``. Null ids and repeated rows are kept as they are. An empty table
gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch_columns, slices
from .shingles import window_hashes, word_hashes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_exclaims", "n_stutters")
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SPACE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """Bit ``bit`` is set where ``fails`` (SQL over the measurements) holds. Numbers of bits are never used again for other rules."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "word_length", "n_words >= 10 and (10 * word_chars < 25 * n_words or word_chars > 15 * n_words)"),
    Rule(5, "shouting", "n_letters >= 20 and 10 * n_upper > 7 * n_letters"),
    Rule(6, "exclaims", "2 * n_exclaims > n_words"),
    Rule(7, "stutter", "n_words >= 10 and 100 * n_stutters > 20 * n_words"),
)
BIT = {r.name: 1 << r.bit for r in RULES}
BASE_MASK = BIT["few_words"] | BIT["repeated_windows"]
#: Version -> mask. Versions are never changed, only added.
POLICIES = {1: BASE_MASK, 2: BASE_MASK | BIT["symbols"] | BIT["repeated_lines"] | BIT["word_length"], 3: sum(BIT.values())}
CURRENT_POLICY = 3


def measure(utf8: bytes) -> tuple[int, ...]:
    """The MEASURES of a text. Letters and capitals are the ASCII ones."""
    raw = utf8.split()
    h = word_hashes(raw)
    n = len(h)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in utf8.split(b"\n"):
        if line.strip(_SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = 0
    if n > 5:
        _, inverse, counts = np.unique(window_hashes(h, 5), return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int32)
        again = np.flatnonzero(counts[inverse] > 1)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + 5, -1)
        repeats = int((np.cumsum(edge[:n]) > 0).sum())
    chars = sum(map(len, raw)) if utf8.isascii() else sum(len(w.decode()) for w in raw)
    upper = len(utf8) - len(utf8.translate(None, _UPPER))
    letters = upper + len(utf8) - len(utf8.translate(None, _LOWER))
    stutters = int((h[1:] == h[:-1]).sum()) if n > 1 else 0
    return n, chars, len(utf8) - len(utf8.translate(None, SYMBOLS)), dup, repeats, lines, letters, upper, utf8.count(b"!"), stutters


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = [measure(x) for (texts,) in batch_columns(iter([b]), "utf8") for x in texts]
        cols = zip(*rows) if rows else [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failures``: the bits of the rules that a document fails."""
    source = docs.select(F.col(id_col).alias("doc_id"), as_bytes(F.col(text_col)).alias("utf8"))
    kind = source.schema["doc_id"].dataType.simpleString()
    measured = source.mapInArrow(_measure, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " | ".join(f"if({r.fails}, {1 << r.bit}L, 0L)" for r in RULES)
    return measured.withColumn("failures", F.expr(bits))


def stored_ledger(docs: DataFrame, **how) -> DataFrame:
    """The ledger as a table in the shared folder: policies and ablations read it, not the texts."""
    return Scratch(docs.sparkSession, "ledger").store(ledger(docs, **how))


def alone(version: int) -> Column:
    """The bit of the rule that alone rejects a document under a policy; null where none or several do."""
    held = F.col("failures").bitwiseAND(F.lit(POLICIES[version]).cast("long"))
    return F.when(F.bit_count(held) == 1, F.bit_count(held - 1)).cast("long")


def passes(version: int, failures: Column | str = "failures") -> Column:
    """Whether a policy keeps a document."""
    c = F.col(failures) if isinstance(failures, str) else failures
    return c.bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents failing it, and those that it alone rejects (kept if the rule were dropped)."""
    mask = POLICIES[version]
    rules = [r for r in RULES if mask >> r.bit & 1]
    held = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    sums = rows.select(held.alias("f")).agg(
        F.count("*").alias("n"), F.count_if(F.col("f") == 0).alias("kept"),
        *(F.count_if(F.col("f").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"fail_{r.bit}") for r in rules),
        *(F.count_if(F.col("f") == (1 << r.bit)).alias(f"only_{r.bit}") for r in rules),
    )
    items = ", ".join(f"struct({r.bit} as bit, '{r.name}' as rule, fail_{r.bit} as failing, only_{r.bit} as alone)" for r in rules)
    return sums.select("n", "kept", F.expr(f"inline(array({items}))"))
