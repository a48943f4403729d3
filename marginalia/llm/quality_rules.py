"""Quality rules: a rule bitmask ledger.

Each rule is evaluated once per document.  The ledger keeps its measurements
and one ``failed`` bitmask (bit k: rule k failed); a policy is a named,
versioned mask of the rules that reject.  Changing policy, or asking what a
rule adds, needs the ledger only, never the texts again.

Null and empty texts measure 0 everywhere and fail ``few_words``.  Repeated
rows get equal ledger rows each.  An empty table gives an empty ledger.  Other
columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import Chunk, chunks, ngrams, release

WINDOW = 5  #: words in a window that may repeat
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_START = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def _measure(chunk: Chunk) -> dict[str, np.ndarray]:
    starts, ends, first = chunk.words()
    n_words = np.diff(first)
    letters = _START[chunk.data]
    run = np.r_[0, np.cumsum(letters)]
    inside = np.r_[0, np.cumsum(run[ends] - run[starts])]
    # words covered by a window that occurs twice or more in its text
    windows, bounds = ngrams(chunk.word_hashes(starts, ends, lower=False), first, WINDOW)
    own = np.repeat(np.arange(chunk.n), np.diff(bounds))
    order = np.lexsort((windows, own))
    same = (windows[order][1:] == windows[order][:-1]) & (own[order][1:] == own[order][:-1])
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    # window k of text i starts at word first[i] + k; spread each repeated window over its words
    at = np.flatnonzero(again)
    at = at + (first[:-1] - bounds[:-1])[own[at]]
    step = np.zeros(len(starts) + WINDOW + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(step)[: len(starts)] > 0)]
    n_dup, n_lines = _lines(chunk, starts, ends)
    return {
        "n_words": n_words,
        "word_chars": inside[first[1:]] - inside[first[:-1]],
        "n_symbols": chunk.per_text(_SYMBOL[chunk.data]),
        "n_dup_lines": n_dup,
        "n_repeat_words": covered[first[1:]] - covered[first[:-1]],
        "n_lines": n_lines,
        "n_upper": chunk.per_text(_UPPER[chunk.data]),
        "n_letters": chunk.per_text(_LETTER[chunk.data]),
    }


def _lines(chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of the text, byte by byte, and all lines with a word."""
    raw = chunk.data.tobytes()
    dup, count = np.zeros(chunk.n, np.int64), np.zeros(chunk.n, np.int64)
    for i in range(chunk.n):
        lines = [x for x in raw[chunk.offsets[i] : chunk.offsets[i + 1]].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        count[i] = len(lines)
        dup[i] = len(lines) - len(set(lines))
    return dup, count


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements per document, in the order of MEASURES, after the id."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in chunks(batch.column(1)):
                found = _measure(chunk)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, chunk.n), *(pa.array(found[k], pa.int64()) for k in names)], [id_col, *names])
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {MEASURES}")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def rules() -> list[Rule]:
    """The rules in bit order; a new rule takes the next bit, an old bit is never used again."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < 10),
        Rule("repeated_words", 100 * c("n_repeat_words") > 20 * c("n_words")),
        Rule("symbols", 100 * c("n_symbols") > 10 * c("word_chars")),
        Rule("short_words", 10 * c("word_chars") < 20 * c("n_words")),
        Rule("long_words", c("word_chars") > 15 * c("n_words")),
        Rule("duplicate_lines", 100 * c("n_dup_lines") > 50 * c("n_lines")),
        Rule("upper_case", 100 * c("n_upper") > 60 * F.greatest(c("n_letters"), F.lit(1))),
    ]


#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "short_words", "long_words", "duplicate_lines", "upper_case"),
    "v2": ("few_words", "repeated_words", "symbols", "long_words", "duplicate_lines"),
}


def mask(policy: str) -> int:
    bit = {rule.name: 1 << k for k, rule in enumerate(rules())}
    return sum(bit[name] for name in POLICIES[policy])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and the ``failed`` bitmask of all rules, each evaluated once."""
    failed = F.lit(0).cast("long")
    for k, rule in enumerate(rules()):
        failed = failed.bitwiseOR(F.when(rule.fails, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, id_col, text_col).withColumn("failed", failed)


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger written to a folder, and read from there: the texts are measured once for all policies."""
    rows = ledger(docs, id_col, text_col)
    rows.write.mode("errorifexists").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def apply_policy(ledger_rows: DataFrame, policy: str, name: str = "kept") -> DataFrame:
    """``kept``, or another name: no rule of the policy failed."""
    return ledger_rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def only_rule(policy: str) -> Column:
    """The rule of a policy that alone rejects a document; null if none or several do."""
    whole, out = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")), F.lit(None).cast("string")
    for k, rule in enumerate(rules()):
        out = F.when(whole == (1 << k), F.lit(rule.name)).otherwise(out)
    return out


def ablations(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those only it rejects (kept again without it).

    The ledger is summed once by its bitmask, a handful of distinct values, so
    no rule is evaluated again.
    """
    whole = mask(policy)
    seen = ledger_rows.groupBy("failed").agg(F.count("*").alias("n"))
    bits = [(k, rule.name) for k, rule in enumerate(rules()) if rule.name in POLICIES[policy]]
    has = lambda m: F.col("failed").bitwiseAND(F.lit(m).cast("long"))
    sums = [F.sum(F.when(has(1 << k) != 0, F.col("n")).otherwise(0)).alias(f"fail_{k}") for k, _ in bits]
    sums += [F.sum(F.when(has(whole) == (1 << k), F.col("n")).otherwise(0)).alias(f"only_{k}") for k, _ in bits]
    row = seen.agg(*sums)
    return row.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"fail_{k}").alias("n_failed"), F.col(f"only_{k}").alias("n_only")) for k, name in bits))).alias("r")).select("r.*")
