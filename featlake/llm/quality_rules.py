"""Quality rules as a bitmask ledger, in SQL functions only.

Every text is measured once and every rule evaluated once: a ledger row holds the
measurements and one bit per failed rule. Policies are versioned masks over the
bits, so a new policy is a bitwise AND over the stored ledger and reads no text. Ablations
count the distinct bit patterns first, of which there are at most two to the power of the
rules, and work on those counts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window whose second occurrence in a text marks a repeat.
WINDOW = 8

SPACE = " \t\n\x0b\f\r"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rules in the order of their bits: name and the condition of a failure, in whole numbers. New
#: rules go to the end, so that stored ledgers keep their meaning.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "many_symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
}

BASE = ("few_words", "repeated_windows")

#: Versions of the policy: the rules that reject a text.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "duplicate_lines", "many_symbols"),
    "v3": (*BASE, "duplicate_lines", "many_symbols", "short_words", "long_words"),
}

LATEST = "v3"


def _equal_beside(rows: str, field: str) -> Column:
    """The entries of a sorted array column whose ``field`` equals that of a neighbour."""
    beside = lambda entry, at: F.coalesce(F.get(rows, at)[field] == entry[field], F.lit(False))
    return F.filter(rows, lambda entry, at: beside(entry, at - 1) | beside(entry, at + 1))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with MEASURES; columns of those names are replaced.

    Words lie between ASCII white space; a null text has none. ``n_repeat_words`` counts the
    words in windows of eight that occur twice or more in the text: hashes of all windows
    say where to look, and the windows found are compared word by word.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in MEASURES))
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    worded = docs.select(row.alias("_row"), words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda at: F.xxhash64(F.slice("_words", at, WINDOW)))
    hashed = worded.select("*", F.when(n >= WINDOW, hashes).alias("_hashes"))
    again = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    placed = F.sort_array(F.transform("_hashes", lambda x, at: F.struct(x.alias("hash"), at.alias("at"))))
    looked = hashed.select("*", F.when(again, placed).alias("_placed"))
    looked = looked.select("*", _equal_beside("_placed", "hash").alias("_alike"))
    spelled = lambda x: F.struct(F.array_join(F.slice("_words", x["at"] + 1, WINDOW), " ").alias("window"), x["at"].alias("at"))
    looked = looked.select("*", F.sort_array(F.transform("_alike", spelled)).alias("_spelled"))
    starts = F.sort_array(F.transform(_equal_beside("_spelled", "window"), lambda x: x["at"]))
    looked = looked.select("*", starts.alias("_starts"))
    reach = F.transform("_starts", lambda x, at: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", at + 1) - x, F.lit(WINDOW))))
    repeated = F.aggregate(reach, F.lit(0).cast("bigint"), lambda total, x: total + x)
    number = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    return looked.select(
        "_row.*",
        n.cast("bigint").alias("n_words"),
        F.char_length(F.concat_ws("", "_words")).cast("bigint").alias("word_chars"),
        number(F.char_length(F.regexp_replace("_row.text", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        number(F.size("_lines")).alias("n_lines"),
        number(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        number(repeated).alias("n_repeat_words"),
    )


def mask(rules: tuple[str, ...]) -> int:
    """The bits of the named rules; an unknown name raises."""
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in set(rules))


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with MEASURES and ``failed``: the bit of every rule that a row fails.

    Null and empty texts have no words and fail ``few_words``. Every row is judged on its own,
    rows that repeat an id too; an empty table gives an empty ledger.
    """
    measured = measure(docs).drop("text")
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(0).cast("bigint") for bit, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def passes(rules: tuple[str, ...], failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(rules))) == 0


def apply_policies(rows: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """A boolean ``kept_<version>`` per policy on ledger rows; only the bits are read."""
    return rows.withColumns({f"kept_{version}": passes(rules) for version, rules in policies.items()})


def ablations(rows: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """version, rule, n_failed, n_alone, n_kept and n_kept_without of each rule of each policy.

    ``n_alone`` rows fail only that rule of the policy: so many more are kept without it. A rule that
    nothing fails has zeros. An empty ledger gives no rows.
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    tried = [
        F.struct(F.lit(version).alias("version"), F.lit(rule).alias("rule"), F.lit(mask(rules)).alias("mask"), F.lit(mask((rule,))).alias("bit"))
        for version, rules in policies.items()
        for rule in rules
    ]
    each = patterns.select("failed", "n", F.inline(F.array(*tried)))
    within = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return each.groupBy("version", "rule").agg(
        total(within.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(within == F.col("bit")).alias("n_alone"),
        total(within == 0).alias("n_kept"),
        total((within == 0) | (within == F.col("bit"))).alias("n_kept_without"),
    )
