"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame operations only.

Every text's measures are taken once and staged. KLL sketches of each measure are built per (lang, source) and merged
per lang and over all; a group with fewer than `least` texts takes the limits of the next wider one. Two rounds, no
fixed cutoffs:

1. Among texts that pass the base rule, values beyond third quartile + `spread` * interquartile range are set aside.
   A measure with one and the same value at both quartiles (most texts have no symbols) sets nothing aside.
2. Among the rest, the usual texts, a measure's limit is as far beyond their quantile `tail` as that is from their
   median. Any text over a limit fails.

A group whose usual texts are of one bad kind has limits that let them pass: the rules are relative to their group.
Sketches of up to a few hundred texts are exact; beyond, KLL compaction is random, so a text at the very edge of a
threshold may change sides between runs. The limits of a run are staged, so all its tasks use the same ones.
The few limits are repeated over salts and joined to the measures, so no group meets in one task.

Null text has no words and fails the fixed base rule; null lang or source is a group of its own; empty tables give
empty results; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import dropped, staged

WHITE = r"[ \t\n\x0B\f\r]+"
WINDOW = 5
MEASURES = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mean_word"]
SALTS = 32


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once, as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that the text holds twice or more; 64-bit hashes stand for the windows."""

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    def starts(t: Column) -> Column:
        twice = F.filter(t, lambda x, k: (F.get(t, k - 1)["w"] == x["w"]) | (F.get(t, k + 1)["w"] == x["w"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def counted(windows: Column) -> Column:
        tagged = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        found = _bound(_bound(tagged, starts), covered)
        return F.when(F.size(windows) > F.size(F.array_distinct(windows)), found).otherwise(0)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, _bound(windows, counted)).otherwise(0).cast("long")


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and ratios of each text, with its group (null lang and source as they are)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("text"))
    parts = docs.withColumns({"words": F.array_remove(F.split("text", WHITE), ""), "lines": F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)})
    gone = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    out = parts.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        gone("#*$%&|<>").alias("n_symbols"), gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.withColumns({"symbol_ratio": share("n_symbols", "word_chars"), "upper_ratio": share("n_upper", "word_chars"), "dup_line_ratio": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words")})


def thresholds(taken: DataFrame, counts: Column, low: float, high: float, spread: float, flat: float | None, least: int) -> DataFrame:
    """lang, source and max_<measure> = q(high) + spread * (q(high) - q(low)) of the rows that `counts` holds for, one
    row per group of `taken`; flat: the limit where both quantiles are equal, instead of their value."""
    base = taken.groupBy("lang", "source").agg(F.count_if(counts).alias("n"), *[F.kll_sketch_agg_double(F.when(counts, F.col(m))).alias(m) for m in MEASURES])
    merged = lambda df: df.agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m).alias(m) for m in MEASURES])

    def limits(df: DataFrame, mark: str) -> DataFrame:
        q = lambda m, p: F.kll_sketch_get_quantile_double(m, F.lit(p))
        limit = lambda m: F.when(q(m, high) > q(m, low), q(m, high) + spread * (q(m, high) - q(m, low))).otherwise(q(m, high) if flat is None else F.lit(flat))
        return df.select(*[c for c in ("lang", "source") if c in df.columns], F.col("n").alias(f"n{mark}"), *[F.when(F.col("n") > 0, limit(m)).alias(f"{m}{mark}") for m in MEASURES])

    by_lang = merged(base.groupBy("lang"))
    wide = limits(by_lang, "_lang").withColumnRenamed("lang", "of_lang")
    whole = limits(merged(by_lang.groupBy(F.lit(1).alias("all"))), "_all")
    joined = limits(base, "").join(wide, F.col("lang").eqNullSafe(F.col("of_lang")), "left").join(F.broadcast(whole), F.lit(True), "left")
    pick = lambda m: F.when(F.col("n") >= least, F.col(m)).when(F.col("n_lang") >= least, F.col(f"{m}_lang")).otherwise(F.col(f"{m}_all"))
    return joined.select("lang", "source", *[pick(m).alias(f"max_{m}") for m in MEASURES])


def within(taken: DataFrame, limits: DataFrame) -> DataFrame:
    """taken with a column `within`: no measure is over its group's limit (or the limit is null)."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    few = limits.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[f"max_{m}" for m in MEASURES], salts)
    salted = taken.withColumn("own_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("own_salt") == F.col("salt"))
    passed = F.lit(True)
    for m in MEASURES:
        passed = passed & F.coalesce(F.col(m) <= F.col(f"max_{m}"), F.lit(True))
    return salted.join(few, same, "left").select(*taken.columns, passed.alias("within"))


def quality_rules(df: DataFrame, spread: float = 3.0, tail: float = 0.99, least: int = 50, **cols: str) -> DataFrame:
    """The measures of each text with base_failed (the fixed rule) and kept (base and every adaptive rule passed)."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    taken, _ = staged(measures(df, **cols).withColumn("base_failed", failed), "measures")
    sound = ~F.col("base_failed")
    far, far_path = staged(thresholds(taken, sound, 0.25, 0.75, spread, float("inf"), least), "far_limits")
    limits, _ = staged(thresholds(within(taken, far), sound & F.col("within"), 0.5, tail, 1.0, None, least), "limits")
    dropped(df.sparkSession, far_path)
    return within(taken, limits).withColumn("kept", ~F.col("base_failed") & F.col("within")).drop("within")
