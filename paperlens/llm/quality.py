"""Quality rules: a threshold table compiled into one projection.

Every metric is a column expression over the whole text; every rule compares a ratio of two metrics with integer
bounds, so nothing depends on rounding.  The plan is a scan and projections: no shuffle and no user function.

Defined cases: a null text has no words and fails the base rule; an empty text likewise.  Each input row gives one
row, repeated rows included.  Columns of the input that carry the name of a metric are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperlens.llm.common import WORD

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in that is was for with as on are by it this be from at or an not have has he she they which but "
    "der die das und ist von den dem ein eine mit für auf im zu des sich nicht als auch "
    "le la les de des et un une du en est que dans pour sur par au aux qui pas "
    "el los las y se por con del una para al lo no su más"
).split()

#: (rule, part, whole, least per cent, most per cent); a bound of None is open.  A rule without a whole bounds the count.
RULES = [
    ("few_words", "n_words", None, 50, None),
    ("repeated_windows", "n_repeat_words", "n_words", None, 50),
    ("word_length", "word_chars", "n_words", 200, 1500),
    ("symbols", "n_symbols", "n_words", None, 25),
    ("stop_words", "n_stop_words", "n_words", 5, None),
    ("letters", "n_letter_words", "n_words", 60, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 40),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 40),
]
BASE = ("few_words", "repeated_windows")


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with the counts that the rules read, all bigint."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns(
        {
            "_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
            "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("bigint"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("bigint"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_bullet_lines": F.size(F.filter("_lines", lambda x: x.rlike("^\\s*[-*•‣●]\\s"))).cast("bigint"),
            "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))).cast("bigint"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
            "n_letter_words": F.size(F.filter("_words", lambda w: w.rlike("\\p{L}"))).cast("bigint"),
            "_windows": F.expr(
                "sort_array(transform(sequence(0, greatest(size(_words) - 3, 0)), "
                "i -> named_struct('w', concat_ws(' ', get(_words, i), get(_words, i + 1), get(_words, i + 2)), 'i', i)))"
            ),
        }
    )
    out = out.withColumn(
        "_starts",
        F.expr("sort_array(transform(filter(_windows, (x, k) -> get(_windows, k - 1).w <=> x.w OR get(_windows, k + 1).w <=> x.w), x -> x.i))"),
    )
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    return out.withColumn("n_repeat_words", covered.cast("bigint")).drop("_words", "_lines", "_windows", "_starts")


def broken(rule) -> Column:
    """Whether a row breaks a rule.  Ratios of an empty whole break nothing: the length rules speak for such rows."""
    _, part, whole, least, most = rule
    scale, whole = (100, F.col(whole)) if whole else (1, F.lit(1))
    tests = [F.col(part) * scale < whole * least] if least is not None else []
    tests += [F.col(part) * scale > whole * most] if most is not None else []
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def quality(docs: DataFrame, text: str = "text", rules=RULES, base=BASE) -> DataFrame:
    """The input with its metrics, `failed` (names of broken rules, in table order), `base_failed` and `kept`."""
    failed = F.array_compact(F.array(*[F.when(broken(r), F.lit(r[0])) for r in rules]))
    out = metrics(docs, text).withColumn("failed", failed)
    return out.withColumns({"base_failed": F.arrays_overlap("failed", F.array(*map(F.lit, base))), "kept": F.size("failed") == 0})
