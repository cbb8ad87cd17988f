"""Removal of word windows that an earlier document has, by De Bruijn compaction.

Edges of the graph are token k-mers: windows of ``WINDOW`` consecutive words.  Along a document,
edges that share their minimizer (the least hash among the window's runs of ``SEED_WORDS`` words)
form a path without a branch of its own; the path is one row, labelled by a digest of all its words.
Spark joins then compact the graph by minimizer: a minimizer that only one document has is no repeat
and goes; where all documents that share one agree in the label, the whole path is one repeat; where
labels differ, the path branches and only there, in one document per label, it is taken apart into
its edges, which are read again from the text at the path's coordinates and compared one by one.

A window is removed where its words also start in a document with a smaller doc_id.  Two windows of
equal words have equal minimizers, so none is missed.  What is compared are the words at the source
coordinates: labels and edges are 128-bit BLAKE2b digests of the words themselves there, so unequal
words are not taken for equal; the rolling hashes only choose minimizers.

A minimizer may be in any number of documents: verdicts are found by partial aggregation and written
before they are joined, so a hot one is broadcast or split, and never sits in one task.

Edge cases: a null text has no words; fewer words than a window stay whole; a null doc_id is neither
smaller nor larger than any, so such rows stay whole; rows that repeat a doc_id are judged each, none
of them earlier than the other; a document without removals keeps its text unchanged, else its words
are joined by one blank; extra columns are carried along, but those named as a result give way to it; whole texts count, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.runtime import materialize

WINDOW, SEED_WORDS = 50, 10

#: Windows whose minimizers are looked for at a time.
STRETCH = 1 << 16

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
#: Words of more bytes are hashed by XXH64.
_LONG = 256
_MASK = (1 << 64) - 1


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        made = np.ones(n, np.uint64)
        made[1:] = np.uint64(b)
        out.append(np.multiply.accumulate(made))
    return out[0], out[1]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(base, 1 << max(12, n.bit_length()))
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which ``spans`` takes the hash of any run of ``values``."""
    up, _ = _powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def spans(prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs [start, stop), alike wherever they lie."""
    _, down = _powers(base, len(prefix))
    return mixed((prefix[stops] - prefix[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def cut(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text, starts and stops of its words."""
    data = (text or "").encode()
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = _BLANK[np.frombuffer(data, np.uint8)]
    change = np.diff(gap)
    return data, np.flatnonzero(change == -1), np.flatnonzero(change == 1)


def word_hashes(data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes after eight, each mixed into what came before."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = mixed((stops - starts).astype(np.uint64))
    left, at = np.arange(len(starts)), starts
    for _ in range(_LONG // 8):
        block = np.ascontiguousarray(eight[at]).view("<u8")[:, 0]
        short = np.minimum(stops[left] - at, 8).astype(np.uint64)
        block = block << (np.uint64(64) - np.uint64(8) * short)
        out[left] = mixed(out[left] * np.uint64(_BASE) ^ block)
        more = stops[left] - at > 8
        left, at = left[more], at[more] + 8
        if not len(left):
            break
    for i in left.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : stops[i]])
    return out


def digests(data: bytes, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests, as two longs, of the words first..last, joined by one blank, of each run."""
    joined, size = data, stops - starts
    if len(starts) and (stops[-1] - starts[0] != size.sum() + len(starts) - 1 or _odd(data, starts, stops)):
        joined = b" ".join(data.split())
        starts = np.cumsum(size + 1) - size - 1
        stops = starts + size
    view = memoryview(joined)
    made = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts[first].tolist(), stops[last].tolist())])
    both = np.frombuffer(made, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _odd(data: bytes, starts: np.ndarray, stops: np.ndarray) -> bool:
    """Whether anything but one blank stands between two words."""
    between = np.frombuffer(data, np.uint8)[stops[:-1]]
    return bool((between != 32).any())


def paths(text: str | None, window: int = WINDOW, seed: int = SEED_WORDS) -> tuple[np.ndarray, ...]:
    """Minimizer, both halves of the label, first window and number of windows of each path of a text."""
    data, starts, stops = cut(text)
    n = len(starts) - window + 1
    if n < 1:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int32, np.int32))
    prefix = sums(word_hashes(data, starts, stops), _BASE)
    at = np.arange(len(starts) - seed + 1)
    runs = spans(prefix, at, at + seed, _BASE)
    wide = window - seed + 1
    least = np.empty(n, np.int64)
    for k in range(0, n, STRETCH):
        part = np.lib.stride_tricks.sliding_window_view(runs[k : k + STRETCH + wide - 1], wide)[: n - k]
        least[k : k + len(part)] = part.argmin(axis=1) + np.arange(k, k + len(part))
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.diff(np.r_[first, n])
    label = digests(data, starts, stops, first, first + size + window - 2)
    return runs[least[first]].view(np.int64), *label, first.astype(np.int32), size.astype(np.int32)


def edges(text: str | None, where: list[tuple[int, int]], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Both halves of the digest and the first word of each window of the paths ``where`` (first window, number)."""
    data, starts, stops = cut(text)
    at = np.concatenate([np.arange(a, a + n) for a, n in where])
    return *digests(data, starts, stops, at, at + window - 1), at.astype(np.int32)


def _batch(parts: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k.to_pandas_dtype()) for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, sha, spans) for documents with windows that an earlier document has.

    ``sha``: a hash of the text, which tells rows of one doc_id apart; ``spans``: word ranges
    [start, stop), as found.
    """
    known = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("sha"), "text")
    names, kinds = ["least", "label", "rest", "doc_id", "sha", "start", "n"], [pa.int64()] * 5 + [pa.int32()] * 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                least, label, rest, start, n = paths(text.as_py(), window)
                parts.append((least, label, rest, np.full(len(start), doc), np.full(len(start), sha), start, n))
            yield _batch(parts, names, kinds)

    every = materialize(known.mapInArrow(find, "least long, label long, rest long, doc_id long, sha long, start int, n int"), "paths")
    shared = every.groupBy("least").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min(F.struct("label", "rest")) < F.max(F.struct("label", "rest"))).alias("branches"))
    shared = materialize(shared.filter("lo < hi").select("least", "branches"), "shared")
    repeated = materialize(every.join(shared, "least"), "repeated")
    earliest = materialize(repeated.groupBy("least", "label", "rest").agg(F.min("doc_id").alias("first")), "earliest")
    told = repeated.join(earliest, ["least", "label", "rest"])
    whole = told.filter("doc_id > first").select("doc_id", "sha", "start", (F.col("start") + F.col("n") + (window - 1)).alias("stop"))
    apart = told.filter("doc_id = first and branches").groupBy("doc_id", "sha").agg(F.collect_list(F.struct("start", "n")).alias("paths"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, sha, text, where in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                a, b, at = edges(text.as_py(), [(x["start"], x["n"]) for x in where], window)
                parts.append((a, b, np.full(len(at), doc), np.full(len(at), sha), at))
            yield _batch(parts, ["a", "b", "doc_id", "sha", "start"], [pa.int64()] * 4 + [pa.int32()])

    placed = known.join(apart, ["doc_id", "sha"]).select("doc_id", "sha", "text", "paths").dropDuplicates(["doc_id", "sha"])
    single = materialize(placed.mapInArrow(take, "a long, b long, doc_id long, sha long, start int"), "edges")
    twice = single.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("a", "b", "first")
    twice = materialize(twice, "twice")
    one = single.join(twice, ["a", "b"]).filter("doc_id > first").select("doc_id", "sha", "start", (F.col("start") + window).alias("stop"))
    return whole.unionByName(one).groupBy("doc_id", "sha").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def removed(words: int, where: list[dict] | None) -> np.ndarray:
    """Which words the spans cover."""
    depth = np.zeros(words + 1, np.int64)
    for x in where or ():
        depth[x["start"]] += 1
        depth[x["stop"]] -= 1
    return np.cumsum(depth[:-1]) > 0


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with text cut down, and ``n_words``, ``n_removed``, ``kept_words`` (the kept words joined by one blank)."""
    results = ("n_words", "n_removed", "kept_words")
    names = [n for n in docs.columns if n not in results]
    others = [n for n in names if n != "text"]
    boxed = docs.select("doc_id", F.xxhash64("text").alias("sha"), "text", F.struct(*(F.col(f"`{n}`") for n in others)).alias("others"))
    joined = boxed.join(repeats(docs, window), ["doc_id", "sha"], "left").select("others", "text", "spans")
    schema = T.StructType(
        [joined.schema["others"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_words", T.StringType())]
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed, kept = [], [], [], []
            for text, where in zip(batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                words = (text or "").encode().split()
                gone = removed(len(words), where)
                left = b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode() if where else b" ".join(words).decode()
                texts.append(left if where else text)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(left)
            made = [pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["others", "text", *results])

    made = joined.mapInArrow(keep, schema)
    return made.select(*("text" if n == "text" else F.col("others").getField(n).alias(n) for n in names), *results)
