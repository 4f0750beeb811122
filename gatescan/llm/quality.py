"""Operator 7 [native]: quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a yes/no test of one text, an expression of its own. How many texts it rejects, and how long the texts are that it would
search, is measured on a bounded sample (SAMPLE_ROWS rows as the table gives them, which bears on the order alone); its cost is its
price for a character times that length. Costs are no times of a clock, so the order is the same whenever the sample is. Rules
are then tried in the order of rejections per cost.
The cascade is one CASE expression, of which Spark evaluates a branch only for texts that no rule before it has rejected; rules
beyond those of the returned statistics work on the text inside their branches, so rejected texts skip their cost. The order
changes the work and the reported `rejected_by`, never the verdict: a text is kept if no rule rejects it.

Words are `[^ \\t-\\r]+`. Repeated 8-word windows are found by 64-bit hashes within one text: its sorted (hash, place) pairs show
equal neighbours, so the work is n log n for a text of n words, whatever repeats in it.

Defined cases: null or empty text has no words (and fails the base rule); a null id stays; rows are independent, repeated rows
repeat their results, an empty table gives an empty result. Result columns get a suffix; with the empty suffix, underscores are
added to it until no column of docs has such a name. Columns that begin with `__q_` are the operator's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample on which sizes and rejections are measured, and what any test costs, in the unit of Rule.price.
SAMPLE_ROWS, TEST_COST = 400, 1.0
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and the STATISTICS (longs) under names that begin with `__q_`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^ \t-\r]")))
    df = docs.withColumn("__q_words", words_of(text)).withColumn("__q_lines", lines)
    df = df.withColumn("__q_hash", F.transform("__q_words", lambda w: F.xxhash64(w)))
    n = F.size("__q_words")
    places = F.when(n >= WINDOW, F.sequence(F.lit(1), n - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.xxhash64(*[F.element_at("__q_hash", i + k) for k in range(WINDOW)])
    df = df.withColumn("__q_windows", F.transform(places, window))
    repeats = F.size(F.array_distinct("__q_windows")) < F.size("__q_windows")
    pairs = F.array_sort(F.transform("__q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__q_sorted", F.when(repeats, pairs))
    at = lambda k: F.get(F.col("__q_sorted"), k)["h"]
    twice = F.filter(F.transform("__q_sorted", lambda p, k: F.when(F.coalesce(at(k - 1) == p["h"], F.lit(False)) | F.coalesce(at(k + 1) == p["h"], F.lit(False)), p["i"])), lambda i: i.isNotNull())
    df = df.withColumn("__q_twice", F.array_sort(twice))
    steps = F.transform("__q_twice", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__q_twice"), k + 1) - i, F.lit(WINDOW))).cast("long"))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    return df.select(
        *docs.columns,
        n.cast("long").alias("__q_n_words"),
        F.aggregate(F.transform("__q_words", lambda w: F.length(w).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x).alias("__q_word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("__q_n_symbols"),
        (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long").alias("__q_n_dup_lines"),
        F.size("__q_lines").cast("long").alias("__q_n_lines"),
        repeated.alias("__q_n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """rejects is true for a bad text; it reads the statistics by stat() and the text by the name `__q_text`. price is what it costs
    for each character of the text, in readings of one character by a pattern; rules over statistics alone cost none."""

    name: str
    rejects: Column
    price: float = 0.0


def stat(name: str) -> Column:
    return F.col("__q_" + name)


def base_failed() -> Column:
    return (stat("n_words") < 20) | (100 * stat("n_repeat_words") > 30 * stat("n_words"))


def rules() -> list[Rule]:
    """The base rules and the method's own; clean prose of any alphabetic script passes them all. The last three search the text."""
    text = F.col("__q_text")
    found = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return [
        Rule("few_words", stat("n_words") < 20),
        Rule("repeated_words", 100 * stat("n_repeat_words") > 30 * stat("n_words")),
        Rule("symbols", 10 * stat("n_symbols") > stat("word_chars")),
        Rule("duplicate_lines", (stat("n_lines") > 3) & (100 * stat("n_dup_lines") > 50 * stat("n_lines"))),
        Rule("word_length", (stat("word_chars") < 2 * stat("n_words")) | (stat("word_chars") > 20 * stat("n_words"))),
        Rule("ellipses", (stat("n_lines") > 3) & (100 * found(r"(?:\.\.\.|\u2026)(?=[ \t]*(?:\n|$))") > 30 * stat("n_lines")), price=1.0),
        Rule("bullets", (stat("n_lines") > 3) & (100 * found(r"(?:^|\n)[ \t]*[-*\u2022][ \t]") > 90 * stat("n_lines")), price=1.0),
        Rule("digits", 100 * found("[0-9]") > 50 * stat("word_chars"), price=1.0),
    ]


def order_rules(docs: DataFrame, found: list[Rule], text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, cost a text, share rejected) on a bounded sample, by rejections per cost; equal figures keep the given order. One job."""
    sample = with_statistics(docs.select(F.col(text_col).alias("__q_text")).limit(rows), "__q_text")
    n, size, *rejected = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("__q_text")), F.lit(0)), *[F.count_if(r.rejects) for r in found]).first()
    n = max(1, n)
    return sorted(((r, TEST_COST + r.price * size / n, k / n) for r, k in zip(found, rejected, strict=True)), key=lambda x: -x[2] / x[1])


def cascade(ordered: list[Rule]) -> Column:
    """The name of the first rule that rejects a text, or null."""
    by = F.lit(None).cast("string")
    for rule in reversed(ordered):
        by = F.when(rule.rejects, F.lit(rule.name)).otherwise(by)
    return by


def judge(docs: DataFrame, text_col: str = "text", found: list[Rule] | None = None, suffix: str = "") -> DataFrame:
    """docs with its statistics, base_failed, kept and rejected_by (the first rule of the cascade that rejects the text, or null),
    each with the suffix."""
    while not suffix.strip("_") and {c + suffix for c in (*STATISTICS, "base_failed", "kept", "rejected_by")} & set(docs.columns):
        suffix += "_"
    ordered = [r for r, _, _ in order_rules(docs, found or rules(), text_col)]
    whole = with_statistics(docs.withColumn("__q_text", F.coalesce(F.col(text_col), F.lit(""))), text_col)
    own = [F.col(f"`{c}`") for c in docs.columns] + [stat(c).alias(c + suffix) for c in STATISTICS]
    judged = whole.withColumn("__q_by", cascade(ordered)).withColumn("__q_bad", base_failed())
    return judged.select(*own, F.col("__q_by").alias("rejected_by" + suffix), F.col("__q_bad").alias("base_failed" + suffix), (~F.col("__q_bad") & F.col("__q_by").isNull()).alias("kept" + suffix))
