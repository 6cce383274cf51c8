"""Quality rules as a ledger: every rule is evaluated once per document, its outcome is one bit, and policies are masks.

A ledger row holds the measurements and ``failed``, a bitmask with one bit per rule. A policy is a versioned set of rules;
applying it is one bitwise test, so a new policy or an ablation never reads a text again. Only DataFrame functions are used.

Null text has no words and no lines: every count is 0 and the document fails ``few_words``. Repeated rows give repeated
ledger rows. An empty table gives an empty ledger. Input columns of any name are allowed: only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

C = F.col
WINDOW = 8
# Fixed value: characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``condition``, SQL over the measurements, is true."""

    name: str
    bit: int
    condition: str


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_passages", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("capitals", 5, "10 * n_upper > 3 * word_chars"),
    Rule("stuttering", 6, "10 * n_stutter > 3 * n_words"),
    Rule("digits", 7, "2 * n_digits > word_chars"),
)

# Versioned policies: the rules whose failure removes a document.
POLICIES = {
    "base": ("few_words", "repeated_passages"),
    "v1": ("few_words", "repeated_passages", "symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stutter",
            "n_digits")


def mask(rules: Iterable[str]) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[name] for name in set(rules))


def passes(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint")) == 0


def _joined(hashes: str, step: int) -> Column:
    """Hashes of runs twice as long: each with the one ``step`` further on."""
    later = F.slice(hashes, step + 1, F.greatest(F.size(hashes) - step, F.lit(0)))
    return F.zip_with(hashes, later, lambda x, y: F.xxhash64(x, y))


def with_ledger(docs: DataFrame, text: str = "text", row: str = "row", name: str = "ledger") -> DataFrame:
    """``row``: the input row as a struct, ``name``: a struct of the measurements and ``failed``. Narrow, one pass."""
    blank = F.coalesce(docs[text], F.lit(""))
    df = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias(row), blank.alias("_text"),
        F.array_remove(F.split(blank, SPACE), "").alias("_words"),
        F.filter(F.split(blank, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    n = F.size("_words")
    df = df.select(row, "_text", "_words", "_lines", n.alias("_n"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    df = df.withColumn("_windows", C("_hashes"))
    for step in (1, 2, 4):
        df = df.withColumn("_windows", _joined("_windows", step))
    df = df.withColumn("_windows", F.slice("_windows", F.lit(1), F.greatest(C("_n") - (WINDOW - 1), F.lit(0))))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_found", F.when(again, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))

    def twin(x: Column, i: Column) -> Column:
        before, after = F.get("_found", i - 1)["h"], F.get("_found", i + 1)["h"]
        return F.when(before.eqNullSafe(x["h"]) | after.eqNullSafe(x["h"]), x["i"])

    df = df.withColumn("_places", F.sort_array(F.array_compact(F.transform("_found", twin))))
    covered = F.aggregate(
        F.transform("_places", lambda p, k: F.least(F.lit(WINDOW), p - F.get("_places", k - 1))),
        F.lit(0), lambda s, x: s + x)
    stutter = F.size(F.filter("_hashes", lambda h, i: F.get("_hashes", i - 1) == h))
    counts = {
        "n_words": C("_n"), "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": covered, "n_lines": F.size("_lines"),
        "n_upper": F.regexp_count("_text", F.lit(r"\p{Lu}")), "n_stutter": stutter,
        "n_digits": F.regexp_count("_text", F.lit("[0-9]")),
    }
    df = df.select(row, *[counts[m].cast("bigint").alias(m) for m in MEASURES])
    failed = F.lit(0).cast("bigint")
    for r in RULES:
        failed = failed + F.when(F.expr(r.condition), F.lit(1 << r.bit)).otherwise(0).cast("bigint")
    # The generator keeps later filters above it: pushed further down they would repeat the array work per element.
    return df.select(row, F.explode(F.array(F.struct(*MEASURES, failed.alias("failed")))).alias(name))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, measurements and ``failed`` for every document."""
    return with_ledger(docs.select(key, text), text).select(f"row.{key}", "ledger.*")


def decide(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    return rows.withColumn("base_failed", ~passes(C("failed"), "base")).withColumn(
        "kept", passes(C("failed"), "base") & passes(C("failed"), policy))


def ablation(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents failing it, removed by it alone, kept with the policy, kept without the rule.

    Documents are counted by bitmask first, so one row per distinct mask and task is shuffled, whatever the table's size.
    """
    used = [r for r in RULES if r.name in POLICIES[policy]]
    whole = F.lit(mask(POLICIES[policy])).cast("bigint")
    by_mask = rows.groupBy(C("failed").bitwiseAND(whole).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    each = by_mask.select("failed", "n", F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in used])).alias("r"))
    hit = C("failed").bitwiseAND(C("r.bit")) != 0
    others = C("failed").bitwiseAND(whole - C("r.bit")) == 0

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, C("n"))), F.lit(0))

    return each.groupBy(C("r.rule").alias("rule")).agg(
        total(hit).alias("n_failed"), total(hit & others).alias("n_alone"),
        total(C("failed") == 0).alias("n_kept"), total(others).alias("n_kept_without"),
        F.bit_or("failed").alias("seen_with"))


def keep_good(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    rows = with_ledger(docs, text)
    kept = passes(C("ledger.failed"), "base") & passes(C("ledger.failed"), policy)
    return rows.filter(kept).select("row.*")
