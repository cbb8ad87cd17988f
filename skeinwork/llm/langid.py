"""Language identification by interpolated Kneser-Ney character models.

One model of ``ORDER`` characters per language, learnt from a bounded sample of labelled texts.  For
each order the n-grams of up to ``TOGETHER`` languages lie in one sorted array of hashes beside a
matrix of log probabilities, one column per language; what an order lacks is looked up in the next
lower one with the back-off weight of its context.  More languages have further arrays, so the model
grows in proportion to their number.  The language with the lowest cross-entropy per character wins.
A part of the sample is kept out of the counts and calibrates the temperature of the score and, per
language, the cross-entropy above which a text of ``SHORTEST`` characters or more is rejected: of
texts in a learnt language that are predicted rightly, a share of ``RATE`` at most on average over
the draws of kept-out texts; ``MARGIN`` is added, as one draw can do worse.

Texts are compared in lower case, with every run of other characters than letters as one blank.

Edge cases: a null text or one without a letter is ``und`` with score 0 and rejected; a null label
teaches nothing; with no labels at all everything is ``und``; ties go to the label that sorts first;
repeated rows are predicted each; extra columns are carried along, but for those named like a result,
which give way; whole texts count, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork import runtime

ORDER = 4

#: Labelled texts per language to learn from, about.
SAMPLE = 1500

#: Languages that share arrays; labels whose counts may be broadcast (about 1 MB).
TOGETHER, BROADCAST = 64, 1 << 14

#: Share of texts in their own language that may be rejected; characters below which no text is;
#: kept-out texts that a language needs for a limit by its own spread; bits a character beyond it.
RATE, SHORTEST, OWN, MARGIN = 0.001, 20, 20, 0.25

#: Code points scored at a time.
STRETCH = 1 << 20

UND = "und"

_OTHER = re.compile(r"[\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """The text as compared: empty if it has no letter."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    return plain if any(map(str.isalpha, plain)) else ""


def codes(plain: str) -> np.ndarray:
    """Code points with blanks around."""
    return np.frombuffer(f"{' ' * (ORDER - 1)}{plain} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` code points."""
    last = len(points) - n + 1
    made = points[:last].copy()
    for j in range(1, n):
        made *= _MULTIPLIER
        made += points[j : j + last]
    return made


def hashed(run: str) -> int:
    made = 0
    for c in run:
        made = (made * int(_MULTIPLIER) + ord(c)) & 0xFFFFFFFFFFFFFFFF
    return made


class Part:
    """``keys[n]``, ``logs[n]``: hashes of n-grams and log2 P per language; ``contexts[n]``,
    ``weights[n]``: hashes of contexts and log2 of their back-off weights.  ``size``: characters that
    any language has, and one for all others."""

    def __init__(self, counts: dict[str, dict[str, int]], size: int, discount: float):
        self.languages = sorted(counts)
        wide = len(self.languages)
        levels: list[list[dict[str, int]]] = [[{} for _ in range(ORDER + 1)] for _ in self.languages]
        for table, language in zip(levels, self.languages):
            table[ORDER] = counts[language]
            for n in range(ORDER - 1, 0, -1):  # how many different characters come before
                table[n] = Counter(run[1:] for run in table[n + 1])
        self.floor = -np.log2(size)
        self.keys, self.logs = [np.zeros(0, np.uint64)] * (ORDER + 1), [np.zeros((0, wide), np.float32)] * (ORDER + 1)
        self.contexts, self.weights = list(self.keys), list(self.logs)
        lower: dict[str, np.ndarray] = {}
        for n in range(1, ORDER + 1):
            total, kinds = [Counter() for _ in levels], [Counter() for _ in levels]
            for table, t, k in zip(levels, total, kinds):
                for run, c in table[n].items():
                    t[run[:-1]] += c
                    k[run[:-1]] += 1
            back = {h: np.array([discount * k[h] / t[h] if t[h] else 1.0 for t, k in zip(total, kinds)]) for h in set().union(*total)}
            probs = {}
            for run in set().union(*(table[n] for table in levels)):
                h, below = run[:-1], lower[run[1:]] if n > 1 else np.full(wide, 1 / size)
                own = np.array([max(table[n].get(run, 0) - discount, 0) / t[h] if t[h] else 0.0 for table, t in zip(levels, total)])
                probs[run] = own + back[h] * below
            self.keys[n], self.logs[n] = self._sorted(probs)
            self.contexts[n], self.weights[n] = self._sorted(back)
            lower = probs

    def _sorted(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([hashed(run) for run in rows], np.uint64)
        order = np.argsort(keys)
        values = np.array(list(rows.values()), float).reshape(len(rows), len(self.languages))
        return keys[order], np.log2(values[order]).astype(np.float32)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

    def _total(self, points: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        """Sum of log2 P per language of the characters at ``ends``, by ``n``-grams and lower orders."""
        if n == 0 or not len(ends):
            return np.full(self.logs[ORDER].shape[1], self.floor * len(ends))
        made = points[ends - n + 1].copy()
        for j in range(1, n):
            made *= _MULTIPLIER
            made += points[ends - n + 1 + j]
        at, found = self._find(self.keys[n], made)
        if found.all():
            return self.logs[n][at].sum(axis=0, dtype=float)
        total = self.logs[n][at[found]].sum(axis=0, dtype=float)
        rest = ends[~found]
        context = np.zeros(len(rest), np.uint64)
        for j in range(n - 1):
            context *= _MULTIPLIER
            context += points[rest - n + 1 + j]
        at, found = self._find(self.contexts[n], context)
        return total + self.weights[n][at[found]].sum(axis=0, dtype=float) + self._total(points, rest, n - 1)

    def total(self, points: np.ndarray) -> np.ndarray:
        """Sum of log2 P per language of all characters but the first ``ORDER - 1``."""
        return self._total(points, np.arange(ORDER - 1, len(points)), ORDER)


class Model(Part):
    """All languages: the first ``TOGETHER`` in arrays of its own, others in further parts."""

    def __init__(self, counts: dict[str, dict[str, int]], discount: float = 0.75, together: int = TOGETHER):
        names = sorted(counts)
        size = len({run[-1] for own in counts.values() for run in own}) + 1
        first, *others = [{x: counts[x] for x in names[k : k + together]} for k in range(0, max(len(names), 1), together)]
        super().__init__(first, size, discount)
        self.others = [Part(some, size, discount) for some in others]
        self.languages = names
        self.temperature, self.limits = 1.0, {x: np.inf for x in names}

    def entropies(self, text: str | None) -> tuple[int, np.ndarray]:
        """Characters scored, and the cross-entropy per character for each language."""
        plain = letters(text)
        if not plain or not self.languages:
            return 0, np.zeros(len(self.languages))
        points = codes(plain)
        total, n = np.zeros(len(self.languages)), len(points) - ORDER + 1
        for start in range(ORDER - 1, len(points), STRETCH):
            part = points[start - ORDER + 1 : start + STRETCH]
            total += np.concatenate([self.total(part), *(x.total(part) for x in self.others)])
        return n, -total / n

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, rejected."""
        n, h = self.entropies(text)
        if not n:
            return UND, 0.0, True
        best = int(h.argmin())
        odds = 2.0 ** np.clip(-(h - h[best]) * n * self.temperature, -1000, 0)
        return self.languages[best], float(1 / odds.sum()), n >= SHORTEST and bool(h[best] > self.limits[self.languages[best]])

    def calibrate(self, scored: list[tuple[str, int, list[float]]]) -> None:
        """Fit the temperature and the limits to (language, characters, entropies) of kept-out texts."""
        if not scored:
            return
        place = {x: i for i, x in enumerate(self.languages)}
        loss = {}
        for t in 2.0 ** np.arange(-12, 1):
            each = [(place[x], -t * n * (np.array(h) - min(h))) for x, n, h in scored]
            loss[t] = sum(np.log2((2.0 ** np.clip(z, -1000, 0)).sum()) - z[i] for i, z in each)
        self.temperature = min(loss, key=loss.get)
        right = [(x, h[place[x]]) for x, n, h in scored if n >= SHORTEST and h[place[x]] == min(h)]
        if not right:
            return
        every = np.array([h for _, h in right])
        own = {x: np.array([h for y, h in right if y == x]) for x in self.languages}
        spread = {x: self._spread(h if len(h) >= OWN else every) for x, h in own.items()}
        far = np.sort([(h - spread[x][0]) / spread[x][1] for x, h in right])
        rank = int(np.ceil((len(far) + 1) * (1 - RATE)))  # the next text is beyond it with chance RATE at most
        edge = far[rank - 1] if rank <= len(far) else 4 * max(np.quantile(far, 0.99), 1.0)  # too few texts for that
        self.limits = {x: mid + max(edge, 0.0) * wide + MARGIN for x, (mid, wide) in spread.items()}

    @staticmethod
    def _spread(h: np.ndarray) -> tuple[float, float]:
        """The median, and how far the upper tenth begins above it."""
        mid = float(np.median(h))
        return mid, max(float(np.quantile(h, 0.9)) - mid, 1e-3)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of (text, lang) rows of ``labelled`` (with doc_id), at most about ``sample`` a language.

    Rows equal in doc_id and text are one text; rows of one doc_id, or without any, are drawn each for itself.
    A fifth of a language's texts is kept out, so one with fewer than five has all in the model.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").alias("row"))
    sizes = runtime.materialize(known.select("lang", "row").distinct().groupBy("lang").count(), "languages")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST else sizes
    share = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = known.join(sizes, "lang").filter(share < F.lit(float(sample)) / F.col("count")).dropDuplicates(["lang", "row"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("row", F.lit(8)), "row"))  # about ``sample`` rows a language
    drawn = runtime.materialize(drawn.select("text", "lang", (place % 5 == 0).alias("kept_out")), "drawn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if plain := letters(text):
                    padded = f"{' ' * (ORDER - 1)}{plain} "
                    seen.setdefault(lang, Counter()).update(map("".join, zip(*(padded[j:] for j in range(ORDER)))))
        rows = [(x, run, c) for x, own in seen.items() for run, c in own.items()]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "run", "n"])

    counts: dict[str, dict[str, int]] = {}
    counted = drawn.filter(~F.col("kept_out")).select("text", "lang").mapInArrow(count, "lang string, run string, n long")
    for batch in counted.groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for lang, run, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts.setdefault(lang, {})[run] = n
    model = Model(counts)
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(lang, *shared.value.entropies(text)) for text, lang in zip(*(c.to_pylist() for c in batch.columns))]
            columns = list(zip(*((a, n, h.tolist()) for a, n, h in made))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.float64())))], ["lang", "n", "h"])

    scored = drawn.filter("kept_out").select("text", "lang").mapInArrow(score, "lang string, n long, h array<double>").filter("n > 0").toArrow().to_pylist()
    model.calibrate([(x["lang"], x["n"], x["h"]) for x in scored if x["lang"] in counts])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Append lang_pred, score and rejected to ``docs``."""
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            columns = list(zip(*made)) or [(), (), ()]
            added = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
