"""The mixer and the map of op5 learn from all of their fold, however much it is."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skeinwork.llm import lm


def _runs(spark, parts):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    texts = [(" ".join(rng.choice(words) for _ in range(60)), i % 4 == 0, 1) for i in range(120)]
    training = spark.createDataFrame(texts, "text string, late boolean, kind int").repartition(parts)
    return lm.count_runs(lm.count_words(training)).persist()


def test_all_late_runs_teach_the_mixer(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEARN", 100)
    found, asked = [], []
    refine = lm.Mixer.refine
    monkeypatch.setattr(lm.Mixer, "refine", lambda self, cells: (asked.append(cells.sum()), refine(self, cells))[1])
    for parts in (1, 5):
        runs = _runs(spark, parts)
        early, _ = lm.build_tables(runs)
        mixer = lm.learn_mixer(runs, early)
        found.append((mixer.weights, mixer.refined))
        late = runs.filter("b > 0")
        assert late.count() > 5 * lm.LEARN
        assert asked[-1] == 8 * late.agg(F.sum("b")).first()[0]  # each of the eight bits of every late byte
    assert all(np.array_equal(a, b) for a, b in zip(*found))  # whatever the partitions
    # the learnt weights code the late runs in fewer bits than those at the start
    code, n = (x.to_numpy() for x in late.select("code", "b").toArrow().columns)
    assert (mixer.bits(early, code.view(np.uint64)) * n).sum() < (lm.Mixer().bits(early, code.view(np.uint64)) * n).sum()


def test_agreements_count_every_coded_bit():
    rng = np.random.default_rng(7)
    mixer, tables = lm.Mixer(), lm.Tables()
    tables.stretch[:] = rng.integers(-9000, 9000, lm.SLOTS)
    words = [w.ljust(8, b"\0") for w in (b"a ", b"ab ", b"abc\n", b"abcdefgh", b"\n", b"b ", "é ".encode())]
    next8, likely = (np.array([int.from_bytes(words[i], "big") for i in rng.integers(0, len(words), 3000)], np.uint64) for _ in range(2))
    kinds, level = rng.integers(0, 3, 3000).astype(np.uint8), rng.integers(0, lm.LEVELS, 3000)
    want = np.zeros((lm.LEVELS, lm.CELLS, 2), np.int64)
    for part, _, cell, used, came in lm._steps(mixer, tables, next8, kinds, likely, level):
        deep = np.broadcast_to(level[part][:, None], cell.shape)
        np.add.at(want, (deep[used], cell[used], came[used].astype(int)), 1)
    assert np.array_equal(lm.learn_agreements(mixer, tables, next8, kinds, likely, level), want)


def test_whole_arrays_of_texts_are_taken_as_single_texts():
    texts = ["A b  c b", None, "", " \n", "é ÀB é zz zz", "x" * 20 + " y", "\tq\x0br\fs ", "\x1c\x85 k"]
    for start in range(3):
        own = texts[start:]
        data, size, count = lm.spelt(pa.array(texts).slice(start))
        words = [lm.tokens(x) or [b""] for x in own]
        assert data.tobytes() == b"".join(b" ".join(x) + lm.END for x in words)
        assert size.tolist() == [len(w) + 1 for x in words for w in x] and count.tolist() == [len(x) for x in words]
        assert lm.kinds_of(pa.array(own)).tolist() == [lm.kind(lm.tokens(x)) for x in own]


def test_tokens_are_dealt_once(spark):
    docs = spark.createDataFrame([(i, f"a b c{i % 3} d a b") for i in range(40)], "doc_id long, text string")
    got = lm.score_documents(docs, lm.fold(5) == 1, lm.fold(5) == 0)
    assert len(got.collect()) == 40
    assert "ReusedExchange [place" in got._jdf.queryExecution().executedPlan().toString()
