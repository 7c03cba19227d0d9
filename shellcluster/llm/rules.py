"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_PATTERN

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "der", "die", "das", "und", "den", "von", "zu", "ist",
    "le", "la", "les", "de", "des", "et", "un", "une", "que", "el", "los", "y", "en", "se", "las", "es",
)

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """numerator must lie in [low, high] times denominator; a bound that is None isn't tested. Counts are integers."""

    name: str
    numerator: str
    denominator: str | None
    low: int | None
    high: int | None
    scale: int = 1

    def sql(self) -> str:
        """True where a row fails. Also valid in other SQL engines: integer arithmetic only."""
        unit = self.denominator or "1"
        tests = [f"{self.scale} * {self.numerator} < {self.low} * {unit}"] if self.low is not None else []
        tests += [f"{self.scale} * {self.numerator} > {self.high} * {unit}"] if self.high is not None else []
        return "(" + " OR ".join(tests) + ")"


#: Production thresholds. Length, symbol, stop-word and line ratios.
RULES = (
    Rule("length", "n_words", None, 50, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2, 20),
    Rule("symbols", "n_symbols", "n_words", None, 10, 100),
    Rule("stop_words", "n_stop_words", None, 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30, 100),
)


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    return "NOT (" + " OR ".join(r.sql() for r in rules) + ")" if rules else "true"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts the rules use to docs; the columns of docs stay, and nothing is shuffled.

    A null or blank text has no words, and all its counts are 0. Repeated rows are measured each for itself.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumns(
        {
            "__rules_words": F.when(F.trim(t, F.lit(SPACE)) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(t, F.lit(SPACE)), SPACE_PATTERN)),
            "__rules_lines": F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != ""),
            "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        }
    )
    step = step.withColumns(
        {
            "n_words": F.size("__rules_words").cast("long"),
            "n_lines": F.size("__rules_lines").cast("long"),
            "n_dup_lines": (F.size("__rules_lines") - F.size(F.array_distinct("__rules_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("__rules_words", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
            "__rules_sorted": F.expr("sort_array(if(size(__rules_words) < 3, array(), transform(slice(__rules_words, 1, greatest(size(__rules_words) - 2, 0)), (x, i) -> struct(concat(x, ' ', get(__rules_words, i + 1), ' ', get(__rules_words, i + 2)) AS g, i AS p))))"),
        }
    )
    step = step.withColumn(
        "__rules_covered",
        F.expr("flatten(transform(filter(__rules_sorted, (x, i) -> x.g = get(__rules_sorted, i - 1).g OR x.g = get(__rules_sorted, i + 1).g), x -> array(x.p, x.p + 1, x.p + 2)))"),
    )
    return step.withColumn("n_repeat_words", F.size(F.array_distinct("__rules_covered")).cast("long")).drop("__rules_words", "__rules_lines", "__rules_sorted", "__rules_covered")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed and kept. One projection over one scan."""
    out = measure(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.expr(verdict_sql(rules)))
