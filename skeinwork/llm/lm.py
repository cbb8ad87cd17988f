"""Language-model scores: online logistic mixing of hashed-context bit predictors, beside a word-frequency base.

A text is its lower-cased words (A-Z), joined by one blank, and an end byte.  The model codes the
text's kind, then its bytes bit by bit:

* Hashed contexts (the last bytes of the word so far, some with the kind) predict each bit from the
  counts of all training texts.  They are short, so the script bounds their number, not the corpus.
* A mixer combines these predictions in the logistic domain with weights that a gate (how often
  the longest contexts were seen, and the bit's place) selects; the weights are learnt online, in
  the order of a hash, from all distinct byte runs of one fold of the training texts against tables of the others:
  parts of about ``LEARN`` runs each, dealt by a hash, whose weights are averaged by what each gate saw.
  An adaptive map of (bits so far, mixed prediction), counted over the same runs, refines the result.
* The two words before a word are a context without a bound: every such pair of all training texts is
  kept, by its place in the deal and 32 bits of its hash, with the word that followed most often.  While the bits coded so far agree with that
  word (its first eight bytes), an adaptive map of (how often and how surely it followed, mixed
  prediction towards its bit) gives the chance.  That map is learnt from the same fold, over all its tokens.

All that is learnt is fixed before scoring, counts are whole numbers and costs are summed in units of
2^-20 bit, so a text's score depends on nothing but the text and the training texts: not on other
texts, their order or their partitions.  What training gathers grows with the corpus and stays in Spark: the driver
holds two tables of ``SLOTS`` slots, three bytes each, the counts of ``HEAD`` words at most and the hot pairs of
words, which are split over ``SALTS`` tasks each.

The base adds log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens.  Counts of words of at least a bound
chosen so that ``HEAD`` words at most reach it are broadcast; the others are joined by word.

Edge cases: a null text is an empty one, that is the end alone; a row with a null doc_id
counts as held out; equal texts have equal scores; repeated rows are scored each; with nothing
to learn from, contexts predict one half and counts are zero; extra columns are ignored; whole texts
count, however long.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.words import LOWER
from skeinwork.runtime import checkpoint, discard, free_shuffles, materialize

#: Contexts: bytes, which never reach back past the blank before the word, and whether with the kind.
CONTEXTS = ((1, True), (2, True), (3, True), (4, False), (5, False))
REACH = max(n for n, _ in CONTEXTS)

#: Kinds of texts: by a hash of a text's most frequent word; a text's kind is coded first, uniformly.
KINDS = 61

BITS = 22
SLOTS = 1 << BITS
#: Slots of the tables that one task sums.
RANGE = 1 << 16

#: Words whose counts are broadcast at most, and byte runs from which one task learns weights (about).
HEAD, LEARN = 1 << 17, 1 << 17

#: Byte runs that a task holds before it passes them on; a quarter as many words.
HOLD = 1 << 19

#: Training words for each task of a look-up; one in so many words makes a pair hot, if it comes so often; tasks of a hot
#: pair; rows of which one in so many are probed for hot pairs.
PER_TASK, HOT, HOT_LEAST, SALTS, PROBE = 1 << 19, 512, 16, 64, 16

END = b"\n"
GATES = 27 * 8
CELLS = 24
#: Levels of a word pair: six of how often, four of how surely.
LEVELS = 6 * 4
_SCALE = 2048
_UNIT = float(1 << 20)
#: How often a slot was seen, by level: hardly, sometimes, often.
_GRADE = np.minimum(2, (np.arange(256) + 1) >> 1).astype(np.uint8)
#: Parts of one in which the base's logarithms are summed.
_FINE = float(1 << 36)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_LOWER = np.frombuffer(LOWER, np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


def spelt(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the tokens of all texts as modelled, each with the blank or end behind it; the length of each token with
    that, and the number of tokens of each text (a text without words is one empty word)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind_of = pa.large_binary()
    closed = pc.binary_join_element_wise(texts.cast(kind_of).fill_null(b""), pa.scalar(b"", kind_of), pa.scalar(b"\n", kind_of))
    stops, raw = _bytes_of(closed)
    gap = _SPACE[raw]
    before = np.r_[True, gap[:-1]]
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(gap & ~before)
    count = np.diff(np.searchsorted(starts, stops))
    empty = np.flatnonzero(count == 0)
    np.logical_not(gap, out=gap)
    gap[ends] = True
    if len(empty):
        lone = stops[1:][empty] - 1
        at = np.searchsorted(starts, lone)
        starts, ends, count[empty], gap[lone] = np.insert(starts, at, lone), np.insert(ends, at, lone), 1, True
    size = ends - starts + 1
    data = _LOWER[raw[gap]]
    stop = np.cumsum(size) - 1
    data[stop] = 32
    data[stop[np.cumsum(count) - 1]] = END[0]
    return data, size, count


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_binary array."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, 8 * strings.offset)
    held = strings.buffers()[2]
    return offsets - offsets[0], np.frombuffer(held, np.uint8, offsets[-1] - offsets[0], offsets[0]) if held else np.zeros(0, np.uint8)


def _strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """A large_binary array of strings that lie one behind the other."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)]), pa.py_buffer(data)])


def marked(data: np.ndarray, size: np.ndarray, count: np.ndarray, kinds: np.ndarray) -> pa.DictionaryArray:
    """Tokens from ``spelt``, the last byte of each replaced by its text's kind and whether it ends the text."""
    out, stop = data.copy(), np.cumsum(size) - 1
    out[stop] = np.repeat(2 * kinds, count) + (data[stop] == END[0])
    return _strings(out, size).dictionary_encode()


def unmarked(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of ``marked`` tokens with the blank or end behind them, their lengths and kinds."""
    stops, data = _bytes_of(words)
    data, stop = data.copy(), stops[1:] - 1
    mark = data[stop]
    data[stop] = np.where(mark & 1, END[0], 32)
    return data, np.diff(stops), mark >> 1


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BLOCK_BYTES`` of text (one text may be longer)."""
    size = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
    edges = np.flatnonzero(np.diff(np.cumsum(size) // BLOCK_BYTES, prepend=0))
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


# ---- the mixing model


def kind(words: list[bytes]) -> int:
    """Kind of a text: 0 without words, else by its most frequent word (the smallest of equals)."""
    if not words:
        return 0
    seen = Counter(words)
    most = max(seen.values())
    return zlib.crc32(min(w for w, c in seen.items() if c == most)) % (KINDS - 1) + 1


def kinds_of(texts: pa.Array) -> np.ndarray:
    """The ``kind`` of each text."""
    data, size, count = spelt(texts)
    data[np.cumsum(size) - 1] = 32
    named = _strings(data, size).dictionary_encode()
    words, many = named.dictionary, max(1, len(named.dictionary))
    key = np.sort(np.repeat(np.arange(len(count)), count) * many + np.asarray(named.indices))
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    text, word = np.divmod(key[edges], many)
    times = np.diff(np.r_[edges, len(key)])
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else edges
    most = np.flatnonzero(times == np.maximum.reduceat(times, first)[text]) if len(text) else edges
    text, word = text[most], word[most]
    tried, place = np.unique(word, return_inverse=True)
    spelling = words.take(pa.array(tried)).to_pylist()
    order = sorted(range(len(tried)), key=lambda i: spelling[i][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else edges
    chosen = [spelling[order[i]] for i in np.minimum.reduceat(rank[place], first).tolist()] if len(text) else []
    return np.array([zlib.crc32(w[:-1]) % (KINDS - 1) + 1 if len(w) > 1 else 0 for w in chosen], np.int64)


def runs(data: np.ndarray) -> np.ndarray:
    """Codes of the last ``REACH`` + 1 bytes up to each position past the first ``REACH``.

    Context bytes before the last blank are zero; the topmost byte is left for the kind.
    """
    out = np.zeros(len(data) - REACH, np.uint64)
    for j in range(REACH + 1):
        out <<= np.uint64(8)
        out |= data[j : len(data) - REACH + j]
    blank = data == 32
    kept = np.full(len(out), (1 << 8 * (REACH + 1)) - 1, np.uint64)
    for j in range(REACH, 0, -1):
        kept[blank[REACH - j : len(data) - j]] = np.uint64((1 << 8 * (j + 1)) - 1)
    return out & kept


def hashed(code: np.ndarray, context: int) -> np.ndarray:
    """Hash of a context of each run."""
    n, with_kind = CONTEXTS[context]
    h = (code >> np.uint64(8)) & np.uint64((1 << 8 * n) - 1 | (0xFF << 48 if with_kind else 0))
    h = (h * np.uint64(8) + np.uint64(context)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def slots_at(h: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Table slots of hashed contexts and the bits of the byte so far."""
    return (((h + node.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def slots(code: np.ndarray, context: int, node: np.ndarray) -> np.ndarray:
    """Table slots of a context of each run and the bits of the byte so far."""
    return slots_at(hashed(code, context), node)


def bits_of(code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, node (bits so far behind a one) and value of the eight bits of the last byte."""
    last = (code & np.uint64(255)).astype(np.int64) | 256
    for j in range(8):
        yield j, last >> (8 - j), last >> (7 - j) & 1


class Tables:
    """Stretched prediction and level of confidence of each slot."""

    def __init__(self) -> None:
        self.stretch, self.level = np.zeros(SLOTS, np.int16), np.zeros(SLOTS, np.uint8)


def told(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table entries from the counts of zero and one bits."""
    stretch = np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -8, 8) * _SCALE
    return stretch.astype(np.int16), np.minimum(7, np.log2(zeros + ones + 1)).astype(np.uint8)


def slot_counts(code: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all contexts of distinct runs, and (a, b) counts of zero and one bits there: columns a0, a1, b0, b1."""
    found, sums = [], []
    for context in range(len(CONTEXTS)):
        h = hashed(code, context)
        at, bit = (np.concatenate(x) for x in zip(*((slots_at(h, node), bit) for _, node, bit in bits_of(code))))
        unique = np.flatnonzero(np.bincount(at, minlength=SLOTS))
        place = np.zeros(SLOTS, np.int32)
        place[unique] = np.arange(len(unique))
        at = 2 * place[at] + bit
        found.append(unique)
        sums.append(np.concatenate([np.bincount(at, np.tile(x, 8), 2 * len(unique)).reshape(-1, 2) for x in (a, b)], axis=1))
    return np.concatenate(found), np.concatenate(sums)


def _inputs(tables: Tables, hashes: list[np.ndarray], j: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the mixer (one row per context, and a constant) and its gate."""
    x = np.empty((len(CONTEXTS) + 1, len(node)), np.float32)
    gate = np.zeros(len(node), np.uint8)  # of 216
    for i, h in enumerate(hashes):
        at = slots_at(h, node)
        np.multiply(tables.stretch[at], np.float32(1 / _SCALE), out=x[i])
        if i >= len(CONTEXTS) - 3:
            gate *= 3
            gate += _GRADE[tables.level[at]]
    x[-1] = 0.3
    gate *= 8
    gate += np.uint8(j)
    return x, gate.astype(np.int64)


def _cells(stretched: np.ndarray) -> np.ndarray:
    return np.clip((stretched + 12).astype(np.int64), 0, CELLS - 1)


class Mixer:
    def __init__(self) -> None:
        self.weights = np.full((GATES, len(CONTEXTS) + 1), 1 / len(CONTEXTS), np.float32)
        self.weights[:, -1] = 0
        self.refined = np.tile(1 / (1 + np.exp(-(np.arange(CELLS) - 11.5))), (256, 1))

    def stretched(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        s = x[0] * self.weights[:, 0][gate]
        for i in range(1, len(x)):
            s += x[i] * self.weights[:, i][gate]
        return np.clip(s, -12, 12, out=s)

    def learn(self, tables: Tables, code: np.ndarray, count: np.ndarray, rounds: int = 3, rate: float = 0.1) -> np.ndarray:
        """Online passes over runs and how often they came; what each gate saw.

        Steps are scaled by each weight's curvature, since frequent runs count a thousandfold.
        """
        seen = np.zeros(GATES)
        order = np.argsort(code * np.uint64(0xD6E8FEB86659FD93))
        code, count = code[order], count[order]
        for turn in range(rounds):
            for k in range(0, len(code), 1024):
                part, n = code[k : k + 1024], count[k : k + 1024]
                hashes = [hashed(part, i) for i in range(len(CONTEXTS))]
                for j, node, bit in bits_of(part):
                    x, gate = _inputs(tables, hashes, j, node)
                    s = self.stretched(x, gate)
                    p = 1 / (1 + np.exp(-s))
                    error, bend = (bit - p) * n, p * (1 - p) * n
                    for i in range(len(x)):
                        slope, curve = np.bincount(gate, error * x[i], GATES), np.bincount(gate, bend * x[i] ** 2, GATES)
                        self.weights[:, i] += np.clip(rate * slope / (curve + 1), -0.05, 0.05)
                    if turn == rounds - 1:
                        seen += np.bincount(gate, n, GATES)
        return seen

    def cells(self, tables: Tables, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(bits so far, cell, bit) counts of runs and how often they came, flat."""
        out = np.zeros(256 * CELLS * 2)
        for k in range(0, len(code), 1 << 12):
            part, n = code[k : k + (1 << 12)], count[k : k + (1 << 12)]
            hashes = [hashed(part, i) for i in range(len(CONTEXTS))]
            for j, node, bit in bits_of(part):
                s = self.stretched(*_inputs(tables, hashes, j, node))
                out += np.bincount((node * CELLS + _cells(s)) * 2 + bit, n, len(out))
        return out

    def refine(self, cells: np.ndarray) -> None:
        """Set the map to what came of the predictions of each cell."""
        self.refined = (cells[:, :, 1] + 8 * self.refined) / (cells.sum(axis=2) + 8)

    def chances(self, tables: Tables, code: np.ndarray) -> np.ndarray:
        """The chance given to each of the eight bits of the last byte of each run.

        Neighbours that agree in context and bits so far share a prediction, which is worked out once: sorted runs are cheapest.
        """
        out = np.empty((len(code), 8), np.float32)
        for k in range(0, len(code), 1 << 12):  # parts that stay in a core's cache
            part = code[k : k + (1 << 12)]
            same = part >> np.uint64(8)
            own = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
            hashes = [hashed(part[own], i) for i in range(len(CONTEXTS))]
            for j, node, bit in bits_of(part):
                start = part >> np.uint64(8 - j)
                first = np.r_[True, start[1:] != start[:-1]]
                one = np.flatnonzero(first)
                context, node = np.searchsorted(own, one, "right") - 1, node[one]
                x, gate = _inputs(tables, [h[context] for h in hashes], j, node)
                s = self.stretched(x, gate)
                p = 0.5 / (1 + np.exp(-s)) + 0.5 * self.refined[node, _cells(s)]
                p = np.clip(p, 1e-5, 1 - 1e-5)[np.cumsum(first) - 1]
                out[k : k + len(part), j] = np.where(bit == 1, p, 1 - p)
        return out

    def bits(self, tables: Tables, code: np.ndarray) -> np.ndarray:
        """Cost of the last byte of each run, in bits."""
        return -np.log2(self.chances(tables, code).astype(np.float64)).sum(axis=1)


def runs_of(data: np.ndarray, size: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Codes of all bytes of words that lie one behind the other with what ends them, each as behind a blank."""
    if not len(size):
        return np.zeros(0, np.uint64)
    own = np.arange(len(data)) + np.repeat(np.arange(len(size)) * REACH, size)  # where a byte's own lead would start it
    led = np.full(len(data) + len(size) * REACH, 32, np.uint8)
    led[own + REACH] = data
    return runs(led)[own] | np.repeat(kinds.astype(np.uint64) << np.uint64(56), size)


def _units(bits: np.ndarray) -> np.ndarray:
    return np.rint(bits * _UNIT).astype(np.int64)


class Costs:
    """Costs of words with what ends them, in units of 2^-20 bit; those of the byte runs met last are kept."""

    def __init__(self, mixer: Mixer, tables: Tables):
        self.mixer, self.tables = mixer, tables
        self.run, self.run_cost = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of_runs(self, code: np.ndarray) -> np.ndarray:
        """Cost of each of some distinct byte runs in rising order."""
        if len(self.run) > 2 * HOLD:
            self.run, self.run_cost = self.run[:0], self.run_cost[:0]
        at = np.searchsorted(self.run, code)
        known = np.zeros(len(code), bool)
        inside = at < len(self.run)
        known[inside] = self.run[at[inside]] == code[inside]
        out = np.empty(len(code), np.int64)
        out[known] = self.run_cost[at[known]]
        out[~known] = _units(self.mixer.bits(self.tables, code[~known]))
        self.run, self.run_cost = np.insert(self.run, at[~known], code[~known]), np.insert(self.run_cost, at[~known], out[~known])
        return out

    def of_words(self, words: pa.Array) -> np.ndarray:
        """Cost of each of some ``marked`` words."""
        data, size, kinds = unmarked(words)
        if not len(size):
            return np.zeros(0, np.int64)
        unique, place = np.unique(runs_of(data, size, kinds), return_inverse=True)
        return np.add.reduceat(self.of_runs(unique)[place], np.cumsum(size) - size)


#: The costs that this worker's earlier tasks worked out, of one model.
_KEPT: dict[int, Costs] = {}


def kept_costs(model: int, mixer: Mixer, tables: Tables) -> Costs:
    """The worker's costs under a model (the number of its broadcast), made when another model's are held."""
    if model not in _KEPT:
        _KEPT.clear()
        _KEPT[model] = Costs(mixer, tables)
    return _KEPT[model]


# ---- the words before


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def followers(data: np.ndarray, size: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, next8, text) of every token of ``spelt`` that has two words before it.

    ``context`` is a hash of those words; ``next8`` are the first eight bytes of the token with the
    blank or end behind it, big-endian, zeros behind.
    """
    padded = np.r_[np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)]
    eight = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))  # the eight bytes from each on
    stop = np.cumsum(size)
    shift = np.uint64(8) * np.maximum(8 - size, 0).astype(np.uint64)
    next8 = eight[stop - size + 8].astype(np.uint64) >> shift << shift
    short = np.minimum(size - 1, 8).astype(np.uint64)
    last = eight[stop - 1].astype(np.uint64)
    last = np.where(short > 0, last << (np.uint64(64) - np.uint64(8) * np.maximum(short, np.uint64(1))), np.uint64(0))
    h = _mixed(next8 * _A ^ _mixed(last + (size - 1).astype(np.uint64) * _C))
    owner = np.repeat(np.arange(len(count)), count)
    own = np.flatnonzero(np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) >= 2)
    context = _mixed(h[own - 1] * _A + _mixed(h[own - 2]))
    return context, next8[own], owner[own]


def likeliest(context: np.ndarray, next8: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: whether its context was taught, the context's most frequent follower (the smallest of equals) and its level.

    A row teaches its follower ``n`` times, 0 for one that only asks.
    """
    if not len(context):
        return np.zeros(0, bool), next8, np.zeros(0, np.int64)
    order = np.argsort(context)
    c, f, m = context[order], next8[order], n[order]
    first = np.r_[True, c[1:] != c[:-1]]
    group, edges = np.cumsum(first) - 1, np.flatnonzero(first)
    total = np.add.reduceat(m, edges)
    most, likely = total.copy(), f[edges]
    several = np.flatnonzero((np.diff(np.r_[edges, len(c)]) > 1)[group] & (m > 0))
    if len(several):
        several = several[np.lexsort((f[several], group[several]))]
        g, w, k = group[several], f[several], m[several]
        pair = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
        g, w, k = g[pair], w[pair], np.add.reduceat(k, pair)
        pick = np.lexsort((w, -k, g))
        g, w, k = g[pick], w[pick], k[pick]
        top = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        likely[g[top]], most[g[top]] = w[top], k[top]
    often = np.minimum(5, np.log2(most + 0.5).clip(0).astype(np.int64))
    sure = (4 * most > total).astype(np.int64) + (4 * most > 3 * total) + (most == total)
    known, likely_of, level = np.empty(len(c), bool), np.empty(len(c), np.uint64), np.empty(len(c), np.int64)
    known[order], likely_of[order], level[order] = (total > 0)[group], likely[group], (often * 4 + sure)[group]
    return known, likely_of, level


class Agreements:
    """Adaptive map: the chance that the bit of the likeliest word comes, by level and mixed prediction."""

    def __init__(self) -> None:
        self.chance = np.tile(1 / (1 + np.exp(-(np.arange(CELLS) - 11.5))), (LEVELS, 1))

    def refine(self, counts: np.ndarray) -> None:
        """Set the map from (level, cell, came) counts; cells seen seldom stay near the mixed prediction."""
        self.chance = np.clip((counts[:, :, 1] + 4 * self.chance) / (counts.sum(axis=2) + 4), 1e-5, 1 - 1e-5)


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    """Of 64 bits; 64 of zero."""
    out, x = np.full(len(x), 64, np.int64), x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = x >> np.uint64(step)
        more = high > 0
        out[more] -= step
        x[more] = high[more]
    return out - (x > 0)


def _steps(mixer: Mixer, tables: Tables, next8: np.ndarray, kinds: np.ndarray, likely: np.ndarray, level: np.ndarray) -> Iterator[tuple[slice, np.ndarray, ...]]:
    """For parts of the tokens: the part, mixed chances of their bits, cells towards the likely bit, which bits
    are coded while the likely word agrees, and how many of them agree."""
    for k in range(0, len(next8), 1 << 13):
        part = slice(k, k + (1 << 13))
        word, n = next8[part], len(next8[part])
        laid_out = word.astype(">u8").view(np.uint8).reshape(n, 8)
        run = np.full(n, 32, np.uint64)
        code = np.empty((n, 8), np.uint64)
        high, kept = kinds[part].astype(np.uint64) << np.uint64(56), np.uint64((1 << 8 * (REACH + 1)) - 1)
        for i in range(8):
            run = ((run << np.uint64(8)) | laid_out[:, i]) & kept
            code[:, i] = run | high
        size = 8 * np.maximum(1, (laid_out != 0).sum(axis=1))
        agree = np.minimum(_leading_zeros(word ^ likely[part]), size)
        upto = np.minimum(agree + 1, size)
        used = np.arange(8) * 8 < upto[:, None]
        unique, place = np.unique(code[used], return_inverse=True)
        chance = np.full((n, 8, 8), 0.5, np.float32)
        chance[used] = mixer.chances(tables, unique)[place]
        chance = chance.reshape(n, 64)
        bit = np.arange(64)
        came = bit < agree[:, None]
        st = np.log(chance / (1 - chance))
        cell = _cells(np.where(came, st, -st))
        yield part, chance, cell, bit < upto[:, None], came


def _alike(next8: np.ndarray, kinds: np.ndarray, likely: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct (word, kind, likely word, level) of tokens, by kind and word; the tokens' order, and where each is in it."""
    order = np.argsort(next8)
    order = order[np.argsort(kinds[order].astype(np.uint8), kind="stable")]
    word, high, guess, deep = next8[order], kinds[order].astype(np.uint64), likely[order], level[order].astype(np.int64)
    # tokens of one word and kind lie together; of those, one for each likely word and level
    start = np.r_[True, (word[1:] != word[:-1]) | (high[1:] != high[:-1])]
    group = (np.cumsum(start) - 1).astype(np.uint64)
    key = _mixed(group * _A ^ _mixed(guess + _mixed(deep.astype(np.uint64))))
    again = np.argsort(key)
    new = np.r_[True, key[again][1:] != key[again][:-1]]
    one = again[new]
    place = np.empty(len(key), np.int64)
    place[again] = np.cumsum(new) - 1
    rank = np.argsort(one)  # back to the order of words
    one = one[rank]
    back = np.empty(len(rank), np.int64)
    back[rank] = np.arange(len(rank))
    return word[one], high[one], guess[one], deep[one], order, back[place]


def _coded(mixer: Mixer, tables: Tables, word: np.ndarray, high: np.ndarray, guess: np.ndarray) -> Iterator[tuple[np.ndarray, bool, np.ndarray, np.ndarray]]:
    """(tokens, whether their bits are the likely word's, cells towards its bits, log2 of the mixed chances) of the bits that are
    coded while the likely word agrees, cells and logs with a row for each token; logs are summed over a whole byte that agrees.
    The mixed chances of a byte are worked out once for each start of a word of each kind."""
    size = np.zeros(len(word), np.int64)
    for i in range(8):
        size += (word >> np.uint64(56 - 8 * i) & np.uint64(255)) != 0
    size = 8 * np.maximum(1, size)
    agree = np.minimum(_leading_zeros(word ^ guess), size)
    upto = np.minimum(agree + 1, size)
    for i in range(8):
        own = np.flatnonzero(8 * i < upto)
        if not len(own):
            break
        prefix, own_kind = word[own] >> np.uint64(56 - 8 * i), high[own]
        first = np.r_[True, (prefix[1:] != prefix[:-1]) | (own_kind[1:] != own_kind[:-1])]
        run = prefix[first] | (np.uint64(32) << np.uint64(8 * (i + 1)) if i < 7 else np.uint64(0))
        code = (run & np.uint64((1 << 8 * (REACH + 1)) - 1)) | own_kind[first] << np.uint64(56)
        chance = mixer.chances(tables, code)
        st = np.log(chance / (1 - chance))
        towards, against, log = _cells(st).astype(np.uint8), _cells(-st).astype(np.uint8), np.log2(chance.astype(np.float64))
        of, came = np.cumsum(first) - 1, agree[own] - 8 * i
        whole = came >= 8
        yield own[whole], True, towards[of[whole]], log.sum(axis=1)[of[whole]]
        part = np.flatnonzero(~whole)  # a token's last byte
        own, of, came = own[part], of[part], came[part]
        for j in range(8):
            yes = came > j
            yield own[yes], True, towards[of[yes], j : j + 1], log[of[yes], j]
            missed = (came == j) & (8 * i + j < size[own])
            yield own[missed], False, against[of[missed], j : j + 1], log[of[missed], j]


def learn_agreements(mixer: Mixer, tables: Tables, next8: np.ndarray, kinds: np.ndarray, likely: np.ndarray, level: np.ndarray) -> np.ndarray:
    """(level, cell, came) counts of coded bits; tokens alike in all four are worked out once."""
    counts = np.zeros(LEVELS * CELLS * 2)
    if len(next8):
        word, high, guess, deep, _, place = _alike(next8, kinds, likely, level)
        n = np.bincount(place, minlength=len(word)).astype(float)
        deep = (deep * (2 * CELLS)).astype(np.int16)
        for rows, came, cell, _ in _coded(mixer, tables, word, high, guess):
            at = deep[rows][:, None] + 2 * cell.astype(np.int16) + np.int16(came)
            counts += np.bincount(at.reshape(-1), np.repeat(n[rows], cell.shape[1]), len(counts))
    return counts.astype(np.int64).reshape(LEVELS, CELLS, 2)


def savings(mixer: Mixer, tables: Tables, agreements: Agreements, next8: np.ndarray, kinds: np.ndarray, likely: np.ndarray, level: np.ndarray) -> np.ndarray:
    """What each token costs less for its likely word being known, in units of 2^-20 bit; tokens alike in all four are costed once."""
    out = np.zeros(len(next8), np.int64)
    if not len(out):
        return out
    word, high, guess, deep, order, place = _alike(next8, kinds, likely, level)
    likely_p, other_p = np.log2(agreements.chance).reshape(-1), np.log2(1 - agreements.chance).reshape(-1)
    gain, deep = np.zeros(len(word)), (deep * CELLS).astype(np.int16)
    for rows, came, cell, log in _coded(mixer, tables, word, high, guess):
        at = deep[rows][:, None] + cell
        gain[rows] += (likely_p if came else other_p)[at].sum(axis=1) - log
    out[order] = _units(gain)[place]
    return out


# ---- training and scoring in Spark


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def count_words(training: DataFrame) -> DataFrame:
    """(word, a, b): how often each ``marked`` word comes in the texts of ``training`` (text, late, kind), early and late."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in pieces(batch, 0):
                late, kinds = part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy()
                data, size, count = spelt(part.column(0))
                named = marked(data, size, count, kinds)
                at, n = np.asarray(named.indices), len(named.dictionary)
                b = np.bincount(at[np.repeat(late, count)], minlength=n)
                held.append((named.dictionary, np.bincount(at, minlength=n) - b, b))
                if sum(len(x[0]) for x in held) > HOLD:
                    held = [_summed(held)]
                    if len(held[0][0]) > HOLD // 2:
                        yield from _counted(*held.pop())
        if held:
            yield from _counted(*_summed(held))

    counted = training.select("text", "late", "kind").mapInArrow(run, "word binary, a long, b long")
    return counted.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _summed(held: list[tuple]) -> tuple:
    """Distinct words and the sums of their counts."""
    words, *counts = zip(*held)
    if len(words) == 1:
        return held[0]
    named = pa.concat_arrays(words).dictionary_encode()
    at, n = np.asarray(named.indices), len(named.dictionary)
    return named.dictionary, *(np.bincount(at, np.concatenate(x), n).astype(np.int64) for x in counts)


def _counted(words: pa.Array, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(words), HOLD // 8):
        part = slice(k, k + HOLD // 8)
        yield pa.RecordBatch.from_arrays([words[part].cast(pa.binary()), pa.array(a[part]), pa.array(b[part])], ["word", "a", "b"])


def _totals(code: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes in rising order, and the sums of their counts."""
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], *(np.add.reduceat(x[order], first) if len(code) else x for x in counts)


def count_runs(words: DataFrame) -> DataFrame:
    """(code, a, b): how often each byte run comes, early and late, from rows of ``count_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, a, b = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, HOLD // 8):
                part = batch.slice(k, HOLD // 8)
                data, size, kinds = unmarked(part.column(0).cast(pa.large_binary()))
                new = _totals(runs_of(data, size, kinds), *(np.repeat(part.column(i).to_numpy(), size) for i in (1, 2)))
                code, a, b = _totals(*(np.concatenate(x) for x in zip((code, a, b), new)))
                if len(code) > HOLD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code.view(np.int64), a, b)], ["code", "a", "b"])
                    code, a, b = code[:0], a[:0], b[:0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code.view(np.int64), a, b)], ["code", "a", "b"])

    counted = words.select("word", "a", "b").mapInArrow(run, "code long, a long, b long")
    return counted.groupBy("code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """Arrays of equal length, one behind the other."""
    n, at, out = int.from_bytes(blob[:8], "little"), 0, []
    blob = pa.decompress(blob[8:], n * sum(np.dtype(k).itemsize for k in kinds), "zstd").to_pybytes() if n else b""
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += out[-1].nbytes
    return out


def _packed(*arrays: np.ndarray) -> bytes:
    return len(arrays[0]).to_bytes(8, "little") + pa.compress(b"".join(x.tobytes() for x in arrays), "zstd", asbytes=True)


def _dealt(place: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """One row (place, compressed blob) of the arrays' rows of each place."""
    order = np.argsort(place, kind="stable")
    edges = np.flatnonzero(np.diff(place[order])) + 1
    groups = np.split(order, edges) if len(order) else []
    blobs = [_packed(*(x[g] for x in arrays)) for g in groups]
    return pa.RecordBatch.from_arrays([pa.array([int(place[g[0]]) for g in groups], pa.int32()), pa.array(blobs, pa.binary())], ["place", "blob"])


def _gathered(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """All arrays of each place of a task."""
    held: dict[int, list] = {}
    for batch in batches:
        for place, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(place, []).append(_arrays(blob.as_py(), *kinds))
    for place in sorted(held):
        yield place, [np.concatenate(x) for x in zip(*held.pop(place))]


def build_tables(runs_: DataFrame) -> tuple[Tables, Tables]:
    """Tables of the early texts, and of all, from the counts of all runs."""
    kinds = ("i4", "i8", "i8", "i8", "i8")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, a, b = (batch.column(i).to_numpy() for i in range(3))
            for k in range(0, len(code), HOLD // 4):
                part = slice(k, k + HOLD // 4)
                at, n = slot_counts(code[part].view(np.uint64), a[part], b[part])
                yield _dealt(at // RANGE, at.astype(np.int32), *n.astype(np.int64).T)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, (at, *n) in _gathered(batches, kinds):
            a0, a1, b0, b1 = (np.bincount(at - place * RANGE, x, RANGE) for x in n)
            blob = pickle.dumps((*told(a0, a1), *told(a0 + b0, a1 + b1)))
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([blob], pa.binary())], ["place", "blob"])

    early, final = Tables(), Tables()
    dealt = runs_.select("code", "a", "b").mapInArrow(deal, "place int, blob binary").repartitionById(SLOTS // RANGE, F.col("place"))
    for row in dealt.mapInArrow(sum_up, "place int, blob binary").toLocalIterator():
        at = slice(row.place * RANGE, (row.place + 1) * RANGE)
        early.stretch[at], early.level[at], final.stretch[at], final.level[at] = pickle.loads(bytes(row.blob))
    return early, final


def learn_mixer(runs_: DataFrame, early: Tables) -> Mixer:
    """One mixer, learnt from all late runs.

    Runs are dealt by a hash to parts of about ``LEARN``; each part learns online from the same start, and weights are averaged
    by what their gate saw.  Then the map is counted over all runs under these weights.  Sums are of whole numbers.
    """
    mixer, spark = Mixer(), runs_.sparkSession
    late = runs_.filter("b > 0").select("code", "b")
    n = late.count()
    if not n:
        return mixer
    parts = -(-n // LEARN)
    shared = spark.sparkContext.broadcast((mixer, early))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        code, count = (np.concatenate(x) for x in zip(*held))
        order, own = np.argsort(code.view(np.uint64)), Mixer()
        seen = own.learn(shared.value[1], code.view(np.uint64)[order], count[order]).astype(np.int64)
        units = _units(own.weights.astype(np.float64)) * seen[:, None]
        at = np.flatnonzero(np.repeat(seen, units.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(seen, units.shape[1])[at]), pa.array(units.reshape(-1)[at])], ["at", "n", "units"])

    dealt = late.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))
    found = dealt.select("code", "b").mapInArrow(learn, "at long, n long, units long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("units").alias("units")).toArrow()
    at, seen, units = (found.column(i).to_numpy() for i in range(3))
    mixer.weights.reshape(-1)[at] = units / _UNIT / seen
    shared = spark.sparkContext.broadcast((mixer, early))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(256 * CELLS * 2)
        for b in batches:
            cells += shared.value[0].cells(shared.value[1], b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy())
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at].astype(np.int64))], ["at", "n"])

    found = late.mapInArrow(place, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(256 * CELLS * 2)
    cells[found.column(0).to_numpy()] = found.column(1).to_numpy()
    mixer.refine(cells.reshape(256, CELLS, 2))
    return mixer


#: Columns of the tokens that are looked up: 32 bits of the context beside those that chose the place (a context meets
#: another of its place once in some thousands, at any size of the corpus), next8, steps between rows (of one block), kind,
#: use (0 is asked only, 1 early and 2 late texts, 3 and 4 their repeats for other salts), and how often they teach.
_TOKENS = ("u4", "u8", "u2", "u1", "u1", "u4")

#: Neighbouring rows whose savings travel together.
SLICE = 1 << 12

#: Rows and bytes of a block of texts that is dealt at once (one text may be longer).
BLOCK, BLOCK_BYTES = 1024, 1 << 21


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of (text, row, ...) of at most ``BLOCK`` rows, ``BLOCK_BYTES`` of text and a span of rows below 2^16."""
    rows = batch.column(1).to_numpy()
    size = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(0)], np.int64)
    start, held = 0, 0
    for at in range(len(rows)):
        if at > start and (at - start >= BLOCK or held + size[at] > BLOCK_BYTES or not 0 <= rows[at] - rows[start] < 1 << 16 or rows[at] < rows[at - 1]):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size[at]
    if len(rows):
        yield batch.slice(start)


def _sent(place: np.ndarray, row: np.ndarray, *arrays: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The places and a blob of each; ``row`` (offsets that never fall within a place) leaves as steps."""
    order = np.argsort(place.astype(np.uint16 if len(place) and place.max() < 1 << 16 else np.uint32), kind="stable")
    place, row = place[order], row[order]
    edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    step = np.diff(row, prepend=0)
    step[edges] = row[edges]
    context, next8, *rest = arrays
    columns = [x.astype(k) for x, k in zip((context[order], next8[order], step, *(x[order] for x in rest)), _TOKENS)]
    low, high = (columns[2] & 255).astype(np.uint8), (columns[2] >> 8).astype(np.uint8)
    packed = [columns[1], low, high, *columns[3:]]
    blobs = []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(place)]):
        body = pa.compress(b"".join([x[a:b].tobytes() for x in packed]), "zstd", asbytes=True)
        blobs.append(b"".join([(b - a).to_bytes(8, "little"), columns[0][a:b].tobytes(), body]))
    return pa.array(place[edges].astype(np.int32)), pa.array(blobs, pa.binary())


def _received(base: int, blob: bytes) -> list[np.ndarray]:
    """context, next8, row, kind, use and n of a blob's tokens."""
    n = int.from_bytes(blob[:8], "little")
    context = np.frombuffer(blob, "u4", n, 8)
    body = pa.decompress(blob[8 + 4 * n :], n * 16, "zstd").to_pybytes()
    next8, at, out = np.frombuffer(body, "u8", n), 8 * n, []
    for kind_, width in (("u1", 1), ("u1", 1), ("u1", 1), ("u1", 1), ("u4", 4)):
        out.append(np.frombuffer(body, kind_, n, at))
        at += width * n
    low, high, kinds, use, times = out
    return [context, next8, base + np.cumsum(low.astype(np.int64) | high.astype(np.int64) << 8), kinds, use, times]


def deal(docs: DataFrame, tasks: int, hot: np.ndarray) -> DataFrame:
    """(place, base, blob): all tokens of ``docs`` (text, row, use, kind), dealt by their context.

    ``use``: 0 is asked only, 1 (early) and 2 (late) teach and are asked.  Hot contexts are dealt to ``SALTS`` places by row,
    and what they teach, counted for each block, goes to all of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _KEPT.clear()  # scoring is over; its memory is wanted here
        pa.default_memory_pool().release_unused()
        for batch in batches:
            for part in blocks(batch):
                context, next8, text = followers(*spelt(part.column(0)))
                base = part.column(1)[0].as_py()
                row, use, kinds = (part.column(i).to_numpy()[text] for i in (1, 2, 3))
                row, use = row - base, use.astype(np.uint8)
                place = (context >> np.uint64(32)) % np.uint64(tasks)
                many = np.isin(context, hot)
                place = np.where(many, (place + row.astype(np.uint64) % np.uint64(SALTS)) % np.uint64(tasks), place).astype(np.int64)
                n = np.where(many, 0, use > 0).astype(np.int64)  # what hot contexts teach follows, summed
                parts = [(place, row, context, next8, kinds, use, n)]
                for taught in (1, 2):
                    own = many & (use == taught)
                    if not own.any():
                        continue
                    pairs, times = np.unique(np.stack([context, next8], axis=1)[own], axis=0, return_counts=True)
                    last, none, repeat = np.full(len(pairs), row[-1]), np.zeros(len(pairs), np.uint8), np.full(len(pairs), taught + 2, np.uint8)
                    for salt in range(min(SALTS, tasks)):
                        to = (((pairs[:, 0] >> np.uint64(32)) % np.uint64(tasks) + np.uint64(salt)) % np.uint64(tasks)).astype(np.int64)
                        parts.append((to, last, pairs[:, 0], pairs[:, 1], none, repeat, times))
                place, row, context, *arrays = (np.concatenate(x) for x in zip(*parts))
                to, blobs = _sent(place, row, context & np.uint64(0xFFFFFFFF), *arrays)
                yield pa.RecordBatch.from_arrays([to, pa.array(np.full(len(to), base, np.int64)), blobs], ["place", "base", "blob"])

    dealt = docs.select("text", "row", "use", "kind").mapInArrow(run, "place int, base long, blob binary")
    return dealt.repartitionById(tasks, F.col("place"))


def _places(held: dict[int, list], rehearsal: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """next8, row, kind, likely word and level of the tokens of each place whose context was taught.

    In the ``rehearsal`` early texts teach and late ones are asked, else both teach and all are asked.
    """
    for place in sorted(held):
        got = held.pop(place)
        for i, (base, blob) in enumerate(got):
            got[i] = _received(base, blob)
            if rehearsal:
                wanted = np.isin(got[i][4], (1, 2, 3))
                got[i] = [x[wanted] for x in got[i]]
        context, next8, row, kinds, use, n = (np.concatenate(x) for x in zip(*got))
        del got
        known, likely, level = likeliest(context, next8, np.where(use == 2, 0, n) if rehearsal else n.astype(np.int64))
        seen = np.flatnonzero(known & ((use == 2) if rehearsal else (use <= 2)))
        asked = [x[seen] for x in (next8, row, kinds, likely, level)]
        del context, next8, row, kinds, use, n, known, likely, level, seen  # a place's arrays are a worker's largest
        yield asked


def rehearse(dealt: DataFrame, mixer: Mixer, early: Tables) -> DataFrame:
    """One row (chance): the map's chances, float64, as the late texts teach them when early ones alone are known."""
    shared = dealt.sparkSession.sparkContext.broadcast((mixer, early))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for place, base, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.setdefault(place, []).append((base, blob))
        for next8, _, kinds, likely, level in _places(held, True):
            counts = learn_agreements(*shared.value, next8, kinds, likely, level)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.reshape(-1)[at])], ["at", "n"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agreements, counts = Agreements(), np.zeros(LEVELS * CELLS * 2)
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[at] = n
        agreements.refine(counts.reshape(LEVELS, CELLS, 2))
        yield pa.RecordBatch.from_arrays([pa.array([agreements.chance.tobytes()], pa.binary())], ["chance"])

    counted = dealt.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return counted.coalesce(1).mapInArrow(refine, "chance binary")


def save(dealt: DataFrame, chance: DataFrame, mixer: Mixer, tables: Tables) -> DataFrame:
    """(row, saved): what the tokens of each row cost less for their likely words, in units of 2^-20 bit; ``chance``: see ``rehearse``."""
    shared = dealt.sparkSession.sparkContext.broadcast((mixer, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        agreements = Agreements()
        for batch in batches:
            if batch.num_rows:
                agreements.chance = np.frombuffer(batch.column(3)[0].as_py()).reshape(LEVELS, CELLS)
            for place, base, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.setdefault(place, []).append((base, blob))
        for next8, row, kinds, likely, level in _places(held, False):
            saved = savings(*shared.value, agreements, next8, kinds, likely, level)
            order = np.argsort(row)
            row, saved = row[order], saved[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            row, saved = row[first], np.add.reduceat(saved, first) if len(row) else saved
            part, at = row // SLICE, (row % SLICE).astype(np.uint16)
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            blobs = [_packed(at[a:b], saved[a:b]) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[edges]), pa.array(blobs, pa.binary())], ["part", "blob"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, saved = _arrays(blob.as_py(), "u2", "i8")
                if part not in sums:
                    sums[part] = np.zeros(SLICE, np.int64)
                np.add.at(sums[part], at, saved)
        for part, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(part * SLICE + at), pa.array(own[at])], ["row", "saved"])

    saved = dealt.crossJoin(F.broadcast(chance)).mapInArrow(run, "part long, blob binary")
    return saved.repartition("part").mapInArrow(sum_up, "row long, saved long")


def hot_contexts(docs: DataFrame) -> np.ndarray:
    """Contexts that are frequent in one row in ``PROBE``: only how they are dealt, not what is found, depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                context = followers(*spelt(batch.column(0).slice(k, 2048)))[0]
                unique, n = np.unique(context, return_counts=True)
                many = n >= max(HOT_LEAST, len(context) // HOT)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[unique[many].view(np.int64), 0]), pa.array(np.r_[n[many], len(context)]), pa.array(np.r_[many[many], False])], ["context", "n", "many"])

    probe = docs.filter(F.pmod(F.xxhash64("row"), F.lit(PROBE)) == 0).select("text")
    found = checkpoint(probe.mapInArrow(run, "context long, n long, many boolean").groupBy("context", "many").agg(F.sum("n").alias("n")))
    total = int(found.filter("not many").agg(F.sum("n")).first()[0] or 0)
    hot = found.filter(F.col("many") & (F.col("n") > total // (4 * HOT))).select("context").toArrow()
    return np.sort(hot.column(0).to_numpy().view(np.uint64))


def numbered(docs: DataFrame, held: Column, late: Column) -> DataFrame:
    """(doc_id, text, held_out, late, row, kind) of every row, written once so that row numbers hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kinds_of(part.column(1)).astype(np.int32))], [*batch.schema.names, "kind"])

    known = docs.select("doc_id", "text", held.alias("held_out"), late.alias("late"), F.monotonically_increasing_id().alias("row"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, held_out boolean, late boolean, row long, kind int"
    return materialize(known.mapInArrow(run, kinds), "numbered", compression="zstd")


def learn(words: DataFrame) -> tuple[Mixer, Tables, Tables]:
    """Mixer, tables of the early texts and of all, from the counts of ``marked`` words."""
    counted = materialize(count_runs(words), "runs")
    early, final = build_tables(counted)
    mixer = learn_mixer(counted, early)
    discard(counted)
    return mixer, early, final


def _asked(known: DataFrame) -> DataFrame:
    return known.withColumn("use", F.when(F.col("held_out"), 0).when(F.col("late"), 2).otherwise(1))


def train(known: DataFrame, words: DataFrame, hot: np.ndarray, tasks: int) -> tuple[Mixer, Tables, Agreements]:
    """Mixer, tables and map from the texts of ``known`` (text, row, kind, held_out, late) that are not held out; ``words``: their counts."""
    mixer, early, final = learn(words)
    agreements = Agreements()
    found = rehearse(deal(_asked(known.filter(~F.col("held_out"))), tasks, hot), mixer, early).first()
    agreements.chance = np.frombuffer(bytes(found.chance)).reshape(LEVELS, CELLS)
    return mixer, final, agreements


def score_documents(docs: DataFrame, held: Column, late: Column) -> DataFrame:
    """Scores of every text of ``docs`` (doc_id, text) by what all rows where ``held`` is false teach.

    ``late``: the part of those from which mixer and map learn.  ``score`` is the log10 probability of a text,
    ``bits_per_byte`` the same in bits for each byte of its tokens and what separates them.
    """
    spark = docs.sparkSession
    known = numbered(docs, held, late)
    training = known.filter(~F.col("held_out"))
    by_kind = materialize(count_words(training), "words_by_kind")
    end = training.count()  # of the ends of texts, which are tokens too
    plain = by_kind.filter(F.octet_length("word") > 1).select(F.expr("substring(word, 1, octet_length(word) - 1)").alias("word"), (F.col("a") + F.col("b")).alias("n"))
    words = materialize(plain.groupBy("word").agg(F.sum("n").alias("n")), "words")
    n, v = (int(x or 0) for x in words.agg(F.sum("n"), F.count("n")).first())
    n, v = n + end, v + (end > 0)
    base = math.log10(n + 0.5 * (v + 1))
    step = F.floor(F.log2("n") * 8).cast("int")
    bound, total = 1 << 62, 0
    for row in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # 8 rows for each doubling
        total += row["count"]
        if total > HEAD:
            break
        bound = row.step
    head = words.filter(step >= bound).toArrow()
    costs = head.column(0).cast(pa.large_binary()).combine_chunks(), np.array([math.log10(c + 0.5) for c in head.column(1).to_pylist()]) - base
    free_shuffles(spark)
    hot = hot_contexts(known)
    tasks = max(8, -(-n // PER_TASK))
    mixer, early, tables = learn(by_kind)
    discard(by_kind)
    shared = spark.sparkContext.broadcast((mixer, tables, costs))
    model = uuid.uuid4().int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, tables, (known_head, paid_head) = shared.value
        costs = kept_costs(model, mixer, tables)
        start = int(math.log2(KINDS) * _UNIT)
        for batch in batches:
            for part in pieces(batch, 1):
                data, size, count = spelt(part.column(1))
                named = marked(data, size, count, part.column(4).to_numpy())
                number, plain = np.asarray(named.indices), pc.binary_slice(named.dictionary, 0, -1)
                at = pc.index_in(plain, value_set=known_head)
                paid = np.r_[paid_head, np.nan][np.asarray(at.fill_null(len(paid_head)))]
                paid[np.asarray(pc.binary_length(plain)) == 0] = 0.0
                first = np.cumsum(count) - count
                cost, base = np.add.reduceat(costs.of_words(named.dictionary)[number], first) + start, paid[number]
                rare = np.isnan(base)
                of_text = np.repeat(np.arange(len(count)), count)
                per_text = np.bincount(of_text[rare], minlength=len(count))
                tail = plain.take(pa.array(number[rare])).cast(pa.binary())
                rest = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_text)], pa.int32()), tail)
                units = np.add.reduceat(np.rint(np.where(rare, 0, base) * _FINE).astype(np.int64), first)
                n_words = np.add.reduceat((size > 1).astype(np.int64), first)
                columns = [part.column(0), part.column(2), part.column(3), pa.array(n_words + 1), pa.array(np.add.reduceat(size, first))]
                columns += [pa.array(cost), pa.array(units / _FINE), pa.array(n_words - per_text), rest]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "row", "n_tokens", "n_bytes", "cost", "head", "head_known", "tail"])

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind_of_id}, held_out boolean, row long, n_tokens long, n_bytes long, cost long, head double, head_known long, tail array<binary>"
    made = materialize(known.select("doc_id", "text", "held_out", "row", "kind").mapInArrow(run, kinds), "scored_words")

    rare = words.filter(step < bound).select("word", "n")
    tail = made.select("row", F.explode("tail").alias("word")).join(rare, "word", "left")
    c = F.coalesce("n", F.lit(0))
    # whole units here too, so that the sum does not depend on its order
    unit = F.round((F.log10(c + 0.5) - F.lit(base)) * _FINE).cast("long")
    tail = tail.groupBy("row").agg((F.sum(unit) / _FINE).alias("tail_sum"), F.sum((c > 0).cast("long")).alias("tail_known"))
    scored = materialize(made.drop("tail").join(tail, "row", "left"), "scored")
    discard(made)
    discard(words)
    free_shuffles(spark)  # the deal of all tokens wants the room

    dealt = deal(_asked(known), tasks, hot)  # one shuffle, read by the rehearsal and then by what is saved
    saved = save(dealt, rehearse(dealt, mixer, early), mixer, tables)
    joined = scored.join(saved, "row", "left")
    cost = F.col("cost") - F.coalesce("saved", F.lit(0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(end > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head") + F.coalesce("tail_sum", F.lit(0.0)) + F.lit(math.log10(end + 0.5) - base)).alias("base_score"),
        (-cost * (math.log10(2) / _UNIT)).alias("score"),
        (cost / _UNIT / F.col("n_bytes")).alias("bits_per_byte"),
    )
