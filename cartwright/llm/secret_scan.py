"""Secret scan: known forms, and strings that read like random characters.

Known forms (``base``) are found by pattern. Beyond them, every long run of the characters keys
are made of is scored by two first-order Markov chains over characters, one trained on random
strings and one on ordinary identifiers: the logarithm of their likelihood ratio decides. The labelled samples come from the documents
themselves: values that a known form marks as secret are the random strings; in documents without
any, runs of ``SAMPLE_LENGTH`` characters up to the length of a candidate, and numbers, are the
ordinary ones. Both are counted in all documents, each distinct string once. Transitions are interpolated with those between character classes, so few samples, even none,
suffice.

Everything is built-in expressions. Positions are code points, ends exclusive. A null or empty
text has no spans; long texts are searched whole; rows are treated on their own, so repeated rows
agree; an empty table gives an empty result. Columns beyond id and text are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.llm.words import id_and_text, unused, whole_text

# Fixed: the known forms, in the order in which spans of equal start are listed.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "random"]

# Where a match that is long enough must begin; texts without one aren't split.
HINTS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "random": r"[A-Za-z0-9+/_=-]{16}",
}

UPPER, LOWER, DIGIT, OTHER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_=-"
ALPHABET = UPPER + LOWER + DIGIT + OTHER
RUN = r"[A-Za-z0-9+/_=-]+"
RUN_LENGTH = 16
LONG_RUN = r"[A-Za-z0-9+/_=-]{16,}"
SAMPLE_LENGTH = 6
BACKING = 8.0  # weight of the class transitions, in observations
THRESHOLD = 12.0  # natural logarithm of the likelihood ratio

SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _spans(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """Matches of a pattern with their places: gaps and matches alternate, so places are sums."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.arrays_zip(
        gaps.alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        stop = begin + F.length(x["match"])
        span = F.struct(
            begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"),
            x["value"].alias("value"),
        )
        keep = F.length(x["value"]) >= (SHORTEST.get(kind) or RUN_LENGTH)
        return F.struct(
            stop.alias("at"),
            F.when(keep, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    real = F.filter(found, lambda x: x["match"].isNotNull())
    spans = F.aggregate(real, start, add)["spans"]
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the known forms, by start and then kind."""
    return F.sort_array(
        F.concat(
            _spans(text, "assign", ASSIGN, 2), _spans(text, "access", ACCESS), _spans(text, "hex", HEX)
        )
    )


def _codes(run: Column) -> Column:
    """Place of each character in the alphabet, from 1."""
    letters = F.slice(F.split(run, ""), F.lit(1), F.length(run))
    return F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c))


def _transitions(codes: Column) -> Column:
    """Numbers of the pairs of adjacent characters, from 1."""
    n = len(ALPHABET)
    following = F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0)))
    pairs = F.zip_with(codes, following, lambda a, b: (a - 1) * n + b)
    return F.filter(pairs, lambda p: p.isNotNull())


def _class_of(letter: str) -> str:
    return next(k for k in (UPPER, LOWER, DIGIT, OTHER) if letter in k)


def _chain(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """Log-probabilities of each character after each other one."""
    classes = (UPPER, LOWER, DIGIT, OTHER)
    class_pair: dict = defaultdict(float)
    for (a, b), n in counts.items():
        class_pair[_class_of(a), _class_of(b)] += n
    out = {}
    for a in ALPHABET:
        own = _class_of(a)
        among = sum(class_pair[own, k] for k in classes)
        seen = sum(counts.get((a, b), 0) for b in ALPHABET)
        for b in ALPHABET:
            k = _class_of(b)
            share = (class_pair[own, k] + len(k) / len(ALPHABET)) / (among + 1) / len(k)
            out[a, b] = math.log((counts.get((a, b), 0) + BACKING * share) / (seen + BACKING))
    return out


def likelihood_ratios(random: dict[tuple[str, str], int], ordinary: dict[tuple[str, str], int]) -> list[float]:
    """Log-ratio of each transition, in the order of the alphabet."""
    one, two = _chain(random), _chain(ordinary)
    return [round(one[a, b] - two[a, b], 4) for a in ALPHABET for b in ALPHABET]


def fit(docs: DataFrame, text: str = "text") -> list[float]:
    """Log-ratios learnt from all documents; the driver gets one count per transition."""
    rows = docs.select(whole_text(text).alias("text"))
    marked = rows.select("text", base_spans(F.col("text")).alias("base"))
    secret = F.transform("base", lambda s: F.regexp_replace(s["value"], r"[^A-Za-z0-9+/_=-]", ""))
    # longer runs are candidates themselves, but numbers are ordinary at any length
    runs = F.filter(
        F.regexp_extract_all("text", F.lit(RUN), F.lit(0)),
        lambda r: (F.length(r) >= SAMPLE_LENGTH)
        & ((F.length(r) < RUN_LENGTH) | ~r.rlike("[^0-9]")),
    )
    samples = marked.select(
        (F.size("base") > 0).alias("random"),
        F.explode(F.array_distinct(F.when(F.size("base") > 0, secret).otherwise(runs))).alias("run"),
    ).distinct()  # a string that stands often says no more than once
    counted = (
        samples.select("random", F.explode(_transitions(_codes(F.col("run")))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )
    kinds: dict[bool, dict] = {True: {}, False: {}}
    for label, pair, n in counted:
        a, b = divmod(pair - 1, len(ALPHABET))
        kinds[label][ALPHABET[a], ALPHABET[b]] = n
    return likelihood_ratios(kinds[True], kinds[False])


def all_spans(text: Column, base: Column, ratios: list[float]) -> Column:
    """The base spans and the runs that read like random strings, by start and then kind.

    A run that touches a base span is left to it.
    """
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")

    def score(run: Column) -> Column:
        return F.aggregate(
            _transitions(_codes(run)), F.lit(0.0), lambda total, p: total + F.get(table, p - 1)
        )

    runs = _spans(text, "random", LONG_RUN)
    added = F.filter(
        runs,
        lambda r: ~F.exists(base, lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"]))
        & (score(r["value"]) >= THRESHOLD),
    )
    return F.sort_array(F.concat(base, added))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
        ),
        ",",
    )


def scan(docs: DataFrame, ratios: list[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, base, spans`` of each row."""
    if ratios is None:
        ratios = fit(docs, text)
    based = id_and_text(docs, doc_id, text).withColumn("base", base_spans(F.col("text")))
    return based.withColumn("spans", all_spans(F.col("text"), F.col("base"), ratios))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by the mask."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(state["parts"], F.array(before, F.lit(mask))))
            .otherwise(state["parts"])
            .alias("parts"),
        )

    done = F.aggregate(spans, start, add)
    rest = F.transform(
        F.array(done), lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(text, d["at"] + 1, F.length(text)))
    )[0]
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def mask_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with secrets masked in the text column; a null text stays null."""
    ratios = fit(docs, text)
    whole = whole_text(text)
    base, spans = unused(docs, "base", "spans")
    found = docs.withColumn(base, base_spans(whole))
    found = found.withColumn(spans, all_spans(whole, F.col(base), ratios))
    return found.withColumn(
        text, F.when(F.col(text).isNotNull(), masked(F.col(text), F.col(spans)))
    ).drop(base, spans)
