"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations read the bits.

:func:`ledger` stores measurements and one failure bit for each rule. A policy is a version with a mask of the rules it enforces; a
document is kept if no enforced bit is set. :func:`ablations` says what each rule of a policy removes on its own, from the
histogram of the bit patterns (at most ``2 ** rules`` rows), without looking at a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.numeric import let

SPACE = "[\\x20\\x09-\\x0D]"
#: Bit of each rule.
RULES = {"few_words": 0, "repeated_words": 1, "symbols": 2, "repeated_lines": 3, "word_length": 4, "shouting": 5, "few_letters": 6}
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that each enforces.
POLICIES = {1: BASE, 2: tuple(RULES)}


def mask(rules) -> int:
    return sum(1 << RULES[name] for name in rules)


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more; the windows' hashes are sorted to find those."""
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def places(order: Column) -> Column:
        def same(i):
            return F.get(order, i)["h"]

        twice = F.filter(order, lambda x, i: F.coalesce(x["h"] == same(i - 1), F.lit(False)) | F.coalesce(x["h"] == same(i + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(at, i + 1) - p), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def count(found: Column) -> Column:
        order = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), let(let(order, places), covered)).otherwise(F.lit(0))

    return F.coalesce(let(windows, count), F.lit(0))


def measurements(text="text") -> Column:
    """A struct of counts over the whole text; a null text counts as an empty one."""
    body = F.coalesce(F.col(text), F.lit(""))

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE + "+", -1), lambda w: w != "")
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

        def without(pattern: str) -> Column:
            return F.length(t) - F.length(F.regexp_replace(t, pattern, ""))

        counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")))
        repeats = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
        return F.struct(
            counts.alias("words"), repeats.alias("lines"), without("[#*$%&|<>]+").cast("long").alias("n_symbols"), without("[A-Z]+").cast("long").alias("n_capitals"),
            without("[!-@\\[-`{-~]+").cast("long").alias("n_marks"),
        )

    return let(body, of)


def ledger(docs: DataFrame, version: int = 2) -> DataFrame:
    """``doc_id``, measurements, ``fail_bits``, ``base_failed``, ``policy`` and ``kept`` for every row of ``docs (doc_id, text, ...)``.

    Null, empty and blank texts have no words and fail the first rule; ratios are compared as whole numbers, so nothing divides by
    zero. Other columns are ignored, repeated rows are measured each, an empty table gives an empty ledger.
    """
    m = docs.select("doc_id", measurements().alias("m"))
    rows = m.select("doc_id", "m.words.n_words", "m.words.word_chars", "m.n_symbols", "m.lines.n_dup_lines", "m.words.n_repeat_words", "m.lines.n_lines", "m.n_capitals", "m.n_marks")
    n, chars = F.col("n_words"), F.col("word_chars")
    fails = {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (chars < 2 * n) | (chars > 15 * n),
        "shouting": 10 * F.col("n_capitals") > 3 * chars,
        "few_letters": 10 * F.col("n_marks") > 4 * chars,
    }
    bits = sum((F.when(failed, F.lit(1 << RULES[name])).otherwise(F.lit(0)) for name, failed in fails.items()), F.lit(0))
    rows = rows.withColumn("fail_bits", bits.cast("int"))
    return rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(mask(BASE)) != 0).withColumn("policy", F.lit(version)).withColumn("kept", verdict(version))


def verdict(version: int) -> Column:
    """What the policy says of the bits; base rules hold in every version."""
    return F.col("fail_bits").bitwiseAND(mask({*POLICIES[version], *BASE})) == 0


def ablations(rows: DataFrame, version: int = 2) -> DataFrame:
    """``rule, failed, only, kept, kept_without`` for each rule of a policy: documents that fail it, that fail it alone, that the
    policy keeps, and that it would keep without the rule."""
    names = sorted({*POLICIES[version], *BASE}, key=RULES.get)
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    every = mask(names)

    def total(condition) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    bits = F.col("fail_bits")
    sums = [
        F.struct(
            F.lit(name).alias("rule"), total(bits.bitwiseAND(mask([name])) != 0).alias("failed"), total(bits.bitwiseAND(every) == mask([name])).alias("only"),
            total(bits.bitwiseAND(every) == 0).alias("kept"), total(bits.bitwiseAND(every - mask([name])) == 0).alias("kept_without"),
        )
        for name in names
    ]
    return patterns.agg(F.array(*sums).alias("r")).select(F.inline("r"))
