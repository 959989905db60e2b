"""Patterns under look-aheads, and texts without vocabulary, against the plain patterns."""

import random

from pyspark.sql import functions as F

from paperlens import packs
from paperlens.functions import text as T
from paperlens.operators import elements


def texts():
    rnd = random.Random(7)
    words = ["T 检验", "t-TEST", "ſurvey", "SURVEY", "Kruſkal", "Fıne-tun", "MULTI", "n = 57", "F1", "AUC", "10 种\n模型", "[1, 2]", "{a}", "\u3000", "\x85", "İ", "p<.05", "review", "Overall"]
    pool = [*packs.BANK, *words, "plain words without any of it", "", None]
    return [(i, " ".join(rnd.choice([x for x in pool if x is not None]) for _ in range(rnd.randint(1, 4))) if i % 9 else rnd.choice(pool)) for i in range(600)]


def test_gated_patterns_hit_what_the_plain_ones_hit(spark):
    df = spark.createDataFrame(texts(), "id int, t string").repartition(4)
    t, off = F.col("t"), []
    for name, (p, fold) in packs.SIGNALS.items():
        flags = T.ci if fold else T.cs
        off.append(F.count_if(~F.regexp_count(t, F.lit(T.signal_pattern(name))).eqNullSafe(F.regexp_count(t, F.lit(flags(p))))).alias(name))
        off.append(F.count_if(~T.signal(t, name).eqNullSafe(t.rlike(flags(p)))).alias(f"hit_{name}"))
    for kind, ps in packs.ELEMENT_PATTERNS.items():
        low = [elements.folded(p) for p in ps]
        off.append(F.count_if(~F.lower(t).rlike(T.cs(T.gated(low))).eqNullSafe(F.lower(t).rlike(T.cs(T.any_of(low))))).alias(kind))
    plain = F.array_compact(F.array(*[F.when(F.lower(t).rlike(T.cs(T.any_of(list(map(elements.folded, ps))))), F.lit(k)) for k, ps in packs.ELEMENT_PATTERNS.items()]))
    off.append(F.count_if(~F.coalesce(elements.tag(t), F.array().cast("array<string>")).eqNullSafe(plain)).alias("tag"))
    off.append(F.count_if(~F.coalesce(elements.has_vocabulary(t), F.lit(False)).eqNullSafe(F.size(plain) > 0)).alias("vocabulary"))
    off.append(F.count_if(~T.strip(t).eqNullSafe(F.regexp_replace(t, T.cs(r"^\s+|\s+$"), ""))).alias("strip"))
    assert {k: v for k, v in df.agg(*off).first().asDict().items() if v} == {}


def test_all_spaces_are_stripped(spark):
    chars = [(c, chr(c)) for c in range(1, 0x3100)]
    got = spark.createDataFrame(chars, "c int, s string").filter(~T.strip(F.col("s")).eqNullSafe(F.regexp_replace("s", T.cs(r"^\s+|\s+$"), "")))
    assert got.count() == 0


def test_findings_are_made_from_one_facts_table(spark, tmp_path):
    """Asking for two columns of the findings must not run the patterns over the texts again."""
    from paperlens.catalog.common import scored

    spark.createDataFrame([(i, packs.BANK[i] + "\n" + packs.BANK[-i - 1], "en", "s", 9) for i in range(8)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    f = scored(spark, str(tmp_path)).select("doc_id", "verdict")
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert f.count() > 0 and "RLIKE" not in plan and "documents" not in plan


def test_first_characters_are_tried_once(spark):
    """Alternatives that share their beginning share its tests, and a character that none begins with costs one."""
    assert T.gated(["(prior|proposed|\\bprecision)"]) == r"(?=[p])(?:pr(?:ior|oposed|(?<=\bpr)ecision))"
    tree = T.gated([r"(\bprecision\b|prior|p\s*=|ab+|9%|\d+)"])
    words = ["precision", "xprecision", "xprior", "PRIOR", "p  =", "abbb", "a", "9%", "7", "pr", "precisions"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    plain = T.any_of([r"(\bprecision\b|prior|p\s*=|ab+|9%|\d+)"])
    for flags, fold in ((T.cs, False), (T.ci, True)):
        got = df.filter(F.col("t").rlike(flags(T.gated([plain], fold)))).collect()
        assert got == df.filter(F.col("t").rlike(flags(plain))).collect() and got
    assert tree.startswith(r"(?=[")


def test_texts_are_read_once_for_a_dual_review(spark, tmp_path):
    """Both verdict sets ask for the paper type; it must not be found anew for each."""
    from paperlens.catalog.findings import mod_dual_review

    spark.createDataFrame([(i, packs.BANK[i] + "\n" + packs.BANK[-i - 1], "en", "s", 9) for i in range(8)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    plan = mod_dual_review(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "综述" not in plan and "regexp_count" not in plan


def test_heading_patterns_stand_once_in_the_frame(frame_of):
    plan = frame_of({1: ["1. Methods", "text"]}).select("paras")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|".join(packs.SECTION_KEYWORDS)) == 1


def test_entry_numbers(spark):
    from paperlens.operators.structure import reference_number

    lines = {"[12] A": 12, "［3］ B": 3, " 7. C": 7, "8） D": 8, "19 E 2004": 19, "[ 4 ]x 5": 4, "2004": None, "x 1.": None, "": None, "99999999999999999999. F": None, None: None, "٣. G": None}
    got = spark.createDataFrame([(k,) for k in lines], "t string").select("t", reference_number(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == lines
