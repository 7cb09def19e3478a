"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and, in one integer, a
bit for each rule that failed. Policies are versioned sets of rules: applying one is a bitwise
``and``, and leaving rules out (an ablation) is arithmetic on the histogram of the bit patterns,
so neither reads a text again. Everything is built-in expressions.

Null and empty texts have no words: all measurements are 0, the ratio rules pass and ``few_words``
fails. Window equality is that of 64-bit hashes of hashes of words. Repeated rows stay repeated
rows; an empty table gives an empty ledger. Columns beyond the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.llm.words import WORD, id_and_text

SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 5
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines",
    "n_repeat_words", "n_echoes",
]


@dataclass(frozen=True)
class Rule:
    """``failed`` is a condition on the measurements; the bit is the place in ``RULES``."""

    name: str
    failed: Callable[[], Column]


def _over(part: str, percent: int, whole: str) -> Callable[[], Column]:
    return lambda: 100 * F.col(part) > percent * F.col(whole)


#: Bits never change their meaning: new rules go to the end.
RULES = [
    Rule("few_words", lambda: F.col("n_words") < 10),
    Rule("repeated_windows", _over("n_repeat_words", 20, "n_words")),
    Rule("symbols", _over("n_symbols", 5, "word_chars")),
    Rule("repeated_lines", _over("n_dup_lines", 50, "n_lines")),
    Rule("capitals", _over("n_upper", 40, "word_chars")),
    Rule("echoed_words", _over("n_echoes", 30, "n_words")),
]
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "1": (*BASE, "symbols", "repeated_lines", "capitals"),
    "2": (*BASE, "symbols", "repeated_lines", "capitals", "echoed_words"),
}
CURRENT = "2"


def mask(rules: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    places = {rule.name: k for k, rule in enumerate(RULES)}
    return sum(1 << places[name] for name in rules)


def _removed(text: str, pattern: str) -> Column:
    """Code points of the text that the pattern takes."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _covered(windows: Column) -> Column:
    """Words that lie in windows whose value stands at two places or more."""
    places = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    n = F.size(windows)

    def starts(sorted_places: Column) -> Column:
        def repeated(k: Column) -> Column:
            w = F.get(sorted_places, k)["w"]
            return (w == F.get(sorted_places, k - 1)["w"]) | (w == F.get(sorted_places, k + 1)["w"])

        kept = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(repeated(k), F.lit(False)))
        return F.sort_array(F.transform(kept, lambda k: F.get(sorted_places, k)["i"]))

    def total(at: Column) -> Column:
        spans = F.transform(
            at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))
        )
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    # a one-element transform names a value, so that it is made once
    named = F.transform(F.array(places), starts)
    return F.transform(named, total)[0]


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of each row."""
    read = id_and_text(docs, doc_id, text).select(
        "doc_id",
        _removed("text", SYMBOLS).alias("n_symbols"),
        _removed("text", r"\p{Lu}+").alias("n_upper"),
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = read.select(
        "doc_id", "n_symbols", "n_upper",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    hashes = F.col("hashes")
    windowed = counted.select(
        *[c for c in counted.columns if c != "hashes"],
        F.size(
            F.filter(
                F.zip_with(hashes, F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))),
                           lambda a, b: a == b),
                lambda same: same,
            )
        ).cast("long").alias("n_echoes"),
        F.when(
            F.size(hashes) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(hashes) - WINDOW),
                lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    windows = F.col("windows")
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return windowed.withColumn(
        "n_repeat_words", F.when(repeats, _covered(windows)).otherwise(F.lit(0).cast("long"))
    ).select("doc_id", *MEASURES)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and ``failures``: bit k is set where rule k of ``RULES`` failed."""
    bits = [
        F.when(rule.failed(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        for k, rule in enumerate(RULES)
    ]
    joined = bits[0]
    for bit in bits[1:]:
        joined = joined.bitwiseOR(bit)
    return measure(docs, doc_id, text).withColumn("failures", joined)


def fails(version: str) -> Column:
    """Whether a row of the ledger fails a rule of the policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[version]))) != 0


def ablations(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, documents that fail it alone, and
    documents rejected without it. The ledger is reduced to one row per bit pattern first."""
    chosen = F.lit(mask(POLICIES[version]))
    patterns = (
        entries.groupBy(F.col("failures").bitwiseAND(chosen).alias("failed"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "rule",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(name).alias("name"), F.lit(mask((name,))).cast("long").alias("bit"))
                        for name in POLICIES[version]
                    ]
                )
            ),
        )
    )
    rest = F.col("failed").bitwiseAND(F.bitwise_not(F.col("rule.bit")))
    has = F.col("failed").bitwiseAND(F.col("rule.bit")) != 0

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return patterns.groupBy(F.col("rule.name").alias("rule")).agg(
        count(has).alias("n_failed"),
        count(has & (rest == 0)).alias("n_alone"),
        count(rest != 0).alias("n_rejected_without"),
    )
