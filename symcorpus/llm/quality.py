"""Quality rules: a threshold table compiled into one projection of text measures."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, text_of, words_of

# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = (
    "the and of to a in is it that for on with as by at from this be are was or an not have has but they which "
    "der die das und in zu den von mit ist auf ein eine nicht im dem des sich als auch an es für "
    "le la les de des un une et en que qui dans pour par sur est au du ne pas avec ce il "
    "el los las y que del se por con una para es no lo su al como más o"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 5


class Rule(NamedTuple):
    """A text of at least `words` words fails when the measure, or measure / per, lies outside [low, high]."""

    name: str
    measure: str
    per: str | None
    low: float | None
    high: float | None
    words: int = 0


BASE_RULES = (
    Rule("too_few_words", "n_words", None, 10, None),
    Rule("repeated_windows", "n_repeat_words", "n_words", None, 0.2),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", 2, 14),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None, 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def failure(rule: Rule, measured: Column) -> Column:
    """The rule over a struct of measures; ratios are compared as products, so nothing is divided."""
    value, per = measured[rule.measure], measured[rule.per] if rule.per else F.lit(1)
    tests = [100 * value < round(100 * rule.low) * per] if rule.low is not None else []
    tests += [100 * value > round(100 * rule.high) * per] if rule.high is not None else []
    failed = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return failed & (measured["n_words"] >= rule.words) if rule.words else failed


def compile_rules(rules: tuple[Rule, ...], measured: Column) -> Column:
    """An array of the names of the rules that a struct of measures fails."""
    return F.filter(F.array(*[F.when(failure(r, measured), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row, whatever the optimizer moves where."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def _spellings() -> list[str]:
    return sorted({w for s in STOP_WORDS for w in (s, s.capitalize(), s.upper())})


def _repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more.

    Windows are sorted only where a window's hash occurs twice, and then by the window's own
    words, so hash collisions do not count.
    """
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    windows = F.transform(places, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("g"), i.alias("i")))

    def twice(ordered: Column) -> Column:
        gram = lambda k: F.get(ordered, k)["g"]
        same = F.filter(ordered, lambda x, k: x["g"].eqNullSafe(gram(k - 1)) | x["g"].eqNullSafe(gram(k + 1)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n"), x.alias("at"))
        return F.aggregate(at, start, step)["n"]

    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(words) > WINDOW) & repeats, let(F.sort_array(windows), lambda s: let(twice(s), covered))).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of the text's measures, each a long, as one expression."""

    def of(whole: Column, words: Column, lines: Column) -> Column:
        out = {
            "n_words": F.size(words),
            "word_chars": F.length(_without(whole, BLANKS)),
            "n_symbols": F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeated_words(words),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(_spellings()))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in out.items()])

    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(text, lambda t: let(words_of(t), lambda w: let(lines(t), lambda x: of(t, w, x))))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def verdict(text: Column, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the measures, the names of failed rules, base_failed and kept, as one expression."""

    def judged(m: Column) -> Column:
        failed = lambda b, r: F.struct(*[m[k].alias(k) for k in MEASURES], b.alias("failed_base"), r.alias("failed_rules"), (F.size(b) > 0).alias("base_failed"), ((F.size(b) == 0) & (F.size(r) == 0)).alias("kept"))
        return let(compile_rules(base, m), lambda b: let(compile_rules(rules, m), lambda r: failed(b, r)))

    return let(measures(text), judged)


def quality(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with its measures, the names of failed rules, base_failed and kept.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged
    alike; an empty table stays empty. A column of docs that has the name of an output column
    is replaced.
    """
    out = (*MEASURES, "failed_base", "failed_rules", "base_failed", "kept")
    judged = docs.withColumn("__verdict", verdict(text_of(text), base, rules))
    return judged.select(*[c for c in docs.columns if c not in out], *[F.col("__verdict")[c].alias(c) for c in out])


def kept(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass every rule, with their own columns."""
    return docs.filter(verdict(text_of(text), base, rules)["kept"])
