"""Operator 2: quality rules, native: one projection of built-in functions.

A table of thresholds is compiled into the projection; no user function runs.
Words are runs of characters other than space and U+0009..U+000D.

Null text has no words, no lines and zero counts; it fails the base rule.
Empty text likewise. Repeated rows get equal results; the order of rows and
ties play no part. Very long texts are handled whole: repeated windows are
found by sorting the windows' 64-bit hashes, in n log n (two different windows
of one text take the same hash with a chance of about n^2 / 2^65).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

#: Characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from have in is it of on or that the this to was with "
    "au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "als auf aus das dem den der die ein eine für im ist mit nicht sich sie und von zu "
    "al como con del el es las los más no por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A text is kept while ``low`` <= ratio <= ``high``."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are SQL over the measured columns.
RULES = (
    Rule("words", "n_words", low=20),
    Rule("mean_word", "word_chars / n_words", low=1.5, high=15),
    Rule("symbols", "n_symbols / n_words", high=0.3),
    Rule("stop_words", "n_stop_words / n_words", low=0.02),
    Rule("dup_lines", "n_dup_lines / n_lines", high=0.4),
    Rule("repeated", "n_repeat_words / n_words", high=0.3),
)


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once: lambdas would compute an outer expression at every element."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sorted (hash, position) pairs show equal neighbours, and the sorted positions of those windows how far they overlap."""

    def among(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = lambda i, j: pairs[i]["h"] == pairs[j]["h"]
        twice = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < last) & same(F.least(i + 1, last), i)))
        return F.sort_array(F.transform(twice, lambda i: pairs[i]["at"]))

    def cover(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"), x.alias("last")),
            lambda acc: acc["n"],
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return _let(_let(pairs, among), cover)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def measures(text: Column) -> Column:
    """The counts of a text as one struct, each computed once."""
    whole = F.coalesce(text, F.lit(""))

    def counts(words: Column) -> Column:
        n = F.size(words)

        def doubled(hashes: Column, step: int) -> Column:
            """Hashes of twice as many words: each with the one ``step`` on."""
            return _let(hashes, lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - step), F.slice(h, F.lit(step + 1), F.size(h) - step), lambda a, b: F.xxhash64(a, b)))

        def windows(hashes: Column) -> Column:  # WINDOW is 8: twice, twice and twice
            return doubled(doubled(doubled(hashes, 1), 2), 4)

        def repeated(found: Column) -> Column:
            return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(_covered(found))

        own = F.when(n > WINDOW, _let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), repeated)).otherwise(F.lit(0).cast("long"))
        stops = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
        return F.struct(n.alias("n"), own.alias("repeated"), stops.alias("stops"))

    lines = _let(F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    word_chars = F.char_length(F.translate(whole, SPACES, ""))
    symbols = F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))
    parts = F.struct(_let(_words(whole), counts).alias("words"), lines.alias("lines"), word_chars.alias("chars"), symbols.alias("symbols"))

    def named(p: Column) -> Column:
        values = (p["words"]["n"], p["chars"], p["symbols"], p["lines"]["n"], p["lines"]["dup"], p["words"]["repeated"], p["words"]["stops"])
        return F.struct(*(v.cast("long").alias(n) for n, v in zip(MEASURES, values, strict=True)))

    return _let(parts, named)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(base_failed, failed, kept) of a struct of counts: the base rule, the names of the rules that are broken, and whether none is."""
    base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    broken = []
    for rule in rules:
        over, _, under = rule.ratio.partition(" / ")
        ratio = F.coalesce(F.try_divide(m[over], m[under]) if under else m[over], F.lit(0)).cast("double")
        outside = [ratio < rule.low] if rule.low is not None else []
        outside += [ratio > rule.high] if rule.high is not None else []
        broken.append(F.when(outside[0] if len(outside) == 1 else outside[0] | outside[1], F.lit(rule.name)))
    return _let(F.filter(F.array(*broken), lambda x: x.isNotNull()), lambda failed: F.struct(base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept")))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and MEASURES. Columns of ``docs`` with these names give way."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    (all_,) = fresh(docs.columns, "measures")
    return docs.select(*kept, measures(F.col(text)).alias(all_)).select(*kept, f"{all_}.*")


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, failed and kept to what ``measure`` gives."""
    (all_,) = fresh(measured.columns, "verdict")
    found = measured.withColumn(all_, verdict(F.struct(*MEASURES), rules))
    return found.withColumns({c: F.col(f"{all_}.{c}") for c in ("base_failed", "failed", "kept")}).drop(all_)


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that keep all rules: one filter, in which each count is computed once."""
    return docs.where(_let(measures(F.col(text)), lambda m: verdict(m, rules))["kept"])
