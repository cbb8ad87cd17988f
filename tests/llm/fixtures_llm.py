"""A small awkward table: nulls, empties, ties, repeats, long texts, clashing extra columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SYLLABLES = "th er on an in re en at ou ed nd ha to or it is ti hi as te et ng of al de".split()
EXTRA = "w long, n_words string, kept string, sequence_id long, rejected string, bucket long, lang_pred string"


def passage(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))).capitalize() if rng.random() < 0.1 else "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def awkward_rows() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(5)
    a, b, c = passage(rng, 130), passage(rng, 90), passage(rng, 60)
    near = a.split(" ")
    near[3] = "changed"
    return [
        (0, a, "en"), (1, a, "en"), (2, " ".join(near), "en"), (3, f"{b}\n\n{c}", "de"), (4, f"x {c} y {a}", "de"), (5, c, None), (6, None, "en"), (7, "", "de"), (8, " \t\n ", None),
        (9, "one", "en"), (10, "Ünïcode 漢字 😀 ½ '", "de"), (None, b, "en"), (12, a, "en"), (12, a, "en"), (12, b, "de"), (13, "z" * 3000, "en"), (14, passage(rng, 3000), "en"),
        (15, "a b c d " * 40, "de"), (16, "1234 ### $$$", None), (None, None, None),
    ]


def awkward(spark: SparkSession) -> DataFrame:
    rows = [(*r, "src", len(r[1] or ""), 1, "n", "k", 2, "r", 3, "l") for r in awkward_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return awkward(spark).limit(0)
