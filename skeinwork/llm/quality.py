"""Quality rules with risk-controlled thresholds; DataFrame expressions only.

``signals`` measures every whole text.  ``cutoffs`` picks, per stratum (language) and rule, the
strictest cutoff of a fixed ladder for which labelled good documents prove a limited false
rejection: going from lenient to strict, the exact binomial tail of the rejected good documents
must refute a false-rejection rate above the rule's share of ``risk``; the first cutoff that does
not ends the ladder (fixed-sequence testing), and the confidence is split over all strata and
rules (Bonferroni).  So with confidence ``1 - doubt`` no stratum loses more than ``risk`` of its
good documents to the rules.  A stratum with too few labels gets no cutoff and keeps everything.
``joint_cutoffs`` proves all ladders together, which takes fewer labels; the pipeline uses it, while
the query keeps the split that its SQL states.

Edge cases: a null text is an empty one (no words, base_failed); a null language shares
the stratum of the empty one, and so is any other, however many there are (the rows of cutoffs are few, since each takes
hundreds of labels to prove); null labels and null doc_ids prove nothing; a document labelled several times is one piece of evidence, good if all its labels say so; repeated
documents are judged each; extra columns of either table are ignored; with no labels, only the
base rules reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.words import words
from skeinwork.runtime import checkpoint

#: Ladders of cutoffs from lenient to strict; a document whose signal exceeds the cutoff is rejected.
LADDERS = {
    "symbol_share": (0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01),
    "dup_line_share": (0.8, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
    "repeat_share": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "word_length": (12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5),
}


def signals(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the counts of every whole text."""
    split = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).select("*", words(F.col("text")).alias("w"))
    with_word = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        with_word.alias("lines"),
        F.sort_array(
            F.transform(
                F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
                lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")),
            )
        ).alias("s"),
    )
    same = lambda x, j: F.coalesce(x["h"] == F.get("s", j)["h"], F.lit(False))
    found = counted.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(F.filter("s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])).alias("p"),
    )
    covered = F.transform("p", lambda x, i: F.least(F.lit(3), F.get("p", i + 1) - x))  # least() passes over null
    return found.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words")
    )


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, Column]:
    """The signals of the rules; higher is worse."""
    return {
        "symbol_share": _share("n_symbols", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "word_length": _share("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact; 1 where k is at or above the mean."""
    from math import log

    first = n * F.lit(log(1 - p))
    terms = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")),
        F.struct(first.alias("last"), F.exp(first).alias("sum")),
        lambda a, i: F.struct(
            (a["last"] + F.log((n - i + 1) / i) + F.lit(log(p / (1 - p)))).alias("last"),
            (a["sum"] + F.exp(a["last"] + F.log((n - i + 1) / i) + F.lit(log(p / (1 - p))))).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(terms)


def _held(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, one column per rule: how many steps of its ladder fail) of documents labelled good that pass the base rules.

    A document that fails a ladder's lenient step fails all later ones, so it fails the last steps.
    Each doc_id is one piece of evidence, however often it is labelled or comes: it is good if no label
    says otherwise, and of its rows the one with the greatest stratum and failures counts.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).filter("least = 1 and most = 1").select("doc_id")
    held = measured.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), *(x.alias(r) for r, x in rules().items()), base_failed().alias("failed"))
    failed = (sum(((F.col(rule) > c).cast("int") for c in steps), F.lit(0)).alias(rule) for rule, steps in LADDERS.items())
    rows = held.join(good, "doc_id").filter(~F.col("failed")).select("doc_id", F.struct("stratum", *failed).alias("row"))
    return checkpoint(rows.groupBy("doc_id").agg(F.max("row").alias("row")).select("row.*"))


def _proven(each: DataFrame, risk: float, doubt: float) -> DataFrame:
    """(stratum, rule, step) up to the strictest proven ``step`` of each ladder, of rows (stratum, rule, steps_failed)."""
    n_steps = len(next(iter(LADDERS.values())))
    counts = each.groupBy("stratum", "rule", "steps_failed").count()
    counts = counts.withColumn("n", F.sum("count").over(Window.partitionBy("stratum", "rule")))
    steps = (
        counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("step"))
        .groupBy("stratum", "rule", "n", "step")
        .agg(F.coalesce(F.sum(F.when(F.col("steps_failed") >= n_steps - F.col("step"), F.col("count"))), F.lit(0)).alias("k"))
    )
    tests = F.count(F.lit(1)).over(Window.partitionBy("step"))  # strata times rules
    proven = steps.withColumn("tests", tests).withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk))
    proven = proven.withColumn("ok", F.min((F.col("p") <= F.lit(doubt) / F.col("tests")).cast("int")).over(Window.partitionBy("stratum", "rule").orderBy("step")))
    return proven.filter("ok = 1").select("stratum", "rule", "step")


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """Rows (stratum, one column of cutoff per rule or null) of the strata with a proven cutoff.

    ``measured``: signals with doc_id and lang; ``labels``: doc_id and quality (1 is good).
    """
    rows = F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("steps_failed")) for rule in LADDERS))
    proven = _proven(_held(measured, labels).select("stratum", F.inline(rows)), risk / len(LADDERS), doubt)
    ladder = F.create_map(*(x for rule, steps in LADDERS.items() for x in (F.lit(rule), F.array(*map(F.lit, steps)))))
    cutoff = F.get(ladder[F.col("rule")], F.col("step"))
    return proven.withColumn("cutoff", cutoff).groupBy("stratum").pivot("rule", list(LADDERS)).agg(F.min("cutoff"))


def joint_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """As ``cutoffs``, but a stratum's ladders are climbed together, as one rule that rejects what any of them does.

    The tail of the joint rejections is tested at the whole ``risk``, and ``doubt`` is split over strata only, so the
    guarantee is the same, and with four strata 217 good labels are enough where each rule by itself takes 1151.
    """
    held = _held(measured, labels).select("stratum", F.lit("all").alias("rule"), F.greatest(*LADDERS).alias("steps_failed"))
    last = _proven(held, risk, doubt).groupBy("stratum").agg(F.max("step").alias("step"))
    return last.select("stratum", *(F.get(F.array(*map(F.lit, steps)), F.col("step")).alias(rule) for rule, steps in LADDERS.items()))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``base_failed``, ``failed_rules`` and ``kept``; ``limits``: the rows of cutoffs, a few."""
    limits = F.broadcast(limits.select("stratum", *(F.col(r).alias(f"_{r}") for r in LADDERS)))
    known = measured.withColumn("stratum", F.coalesce("lang", F.lit("")))
    joined = known.join(limits, "stratum", "left")
    failed = F.filter(F.array(*(F.when(x > F.col(f"_{r}"), F.lit(r)) for r, x in rules().items())), lambda x: x.isNotNull())
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("stratum", *(f"_{r}" for r in LADDERS))
    )
