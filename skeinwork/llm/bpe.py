"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Adjacent parts of a pre-token form pairs; a pair that may merge has a rank, and the lowest rank
merges first, leftmost among equals.  ``RankQueue`` keeps one bucket of positions per rank under a
bitmap of two levels, so find-first-set twice gives the next rank however long the input is.  Parts
form a linked list over positions; an entry whose pair has changed since is stale and skipped.

Pre-tokens do not touch each other, so one queue serves all distinct pre-tokens of a stretch of
texts: a popped bucket holds the positions of its rank in all of them, and the leftmost of each merge
at once, as arrays (``Codec.merge_all``).  A very long pre-token has a queue to itself and merges
position by position in O(n log n) (``Codec.merge``).

Edge cases: a null text is an empty one (no ids); an empty id list decodes to empty bytes; other
columns are carried along unchanged; equal rows give equal results; text of any length is encoded
whole; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skeinwork.llm import chunks

#: Bits of one word of the bitmap.
WORD = 256

#: Pre-tokens of more bytes have a queue to themselves.
LONG = 96

#: Fewer positions of a bucket are merged one by one.
FEW = 12

#: Characters of texts that are encoded together.
STRETCH = 6 << 20

#: Pieces of Latin letters only, and those with one stop behind them (RE2).
_LETTERS = r"\A[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+\z"
_LETTERS_STOP = r"\A[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+[.,]\z"

_NONE = -1


class RankQueue:
    """Buckets of positions per merge rank under a bitmap of two levels.

    Bit ``rank % WORD`` of ``low[rank // WORD]`` is set while bucket ``rank`` has entries, and bit
    ``w`` of ``top`` while ``low[w]`` has bits.  Only buckets with entries exist.
    """

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (n_ranks // WORD + 1)
        self.top = 0

    def _bucket(self, rank: int) -> list[int]:
        bucket = self.buckets.get(rank)
        if bucket is None:
            bucket = self.buckets[rank] = []
            self.low[rank // WORD] |= 1 << rank % WORD
            self.top |= 1 << rank // WORD
        return bucket

    def push(self, rank: int, at: int) -> None:
        heappush(self._bucket(rank), at)

    def fill(self, rank: int, positions: list[int]) -> None:
        """Add positions, or arrays of them; buckets filled with arrays are taken whole."""
        self._bucket(rank).extend(positions)

    def lowest(self) -> int:
        """The lowest rank with entries."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        return word * WORD + (bits & -bits).bit_length() - 1

    def _drop(self, rank: int) -> None:
        word = rank // WORD
        self.low[word] &= ~(1 << rank % WORD)
        if not self.low[word]:
            self.top &= ~(1 << word)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position."""
        rank = self.lowest()
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self._drop(rank)
        return rank, at

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank and all its positions, in no order."""
        rank = self.lowest()
        self._drop(rank)
        return rank, self.buckets.pop(rank)


class Pairs:
    """(left id, right id) -> merge rank, as open addressing over sorted-in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(10, int(len(rank)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        self.get = dict(zip(keys.tolist(), rank.tolist())).get
        self.reach = 0
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.ranks[slot[take]] = keys[take], rank[take]
            left_over = np.ones(len(keys), bool)
            left_over[take] = False
            keys, rank, slot = keys[left_over], rank[left_over], (slot[left_over] + 1) & ((1 << self.bits) - 1)
            self.reach += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; none where a side is no part."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (left >= 0) & (right >= 0))
        for _ in range(self.reach - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class Codec:
    """Encoder and decoder for one vocabulary, its merges and one pre-token pattern.

    ``pairs`` are (left id, right id, rank); ``id_of`` gives the id of each rank; ``whole`` holds
    the byte strings that are one token before any merge.
    """

    def __init__(self, bytes_of: dict[int, bytes], pairs: tuple[np.ndarray, np.ndarray, np.ndarray], id_of: np.ndarray, whole: dict[bytes, int] | None, find: Callable[[str], list[str]]):
        of_byte = {b[0]: i for i, b in bytes_of.items() if len(b) == 1}
        if missing := [b for b in range(256) if b not in of_byte]:
            raise ValueError(f"the vocabulary lacks the single bytes {missing}")
        self.find, self.whole_of, self.id_of = find, whole or {}, id_of.astype(np.int32)
        self.whole = pa.array(list(whole), pa.large_binary()) if whole else None
        self.whole_id = np.array(list(self.whole_of.values()), np.int64)
        #: The pattern takes letters after a blank as one match, and a stop behind them as another.
        self.letters_whole = find(" aéªǅ x, xz.") == [" aéªǅ", " x", ",", " xz", "."]
        self.byte_id = np.array([of_byte[b] for b in range(256)], np.int32)
        self.pairs = Pairs(*pairs)
        of = np.arange(256)
        self.of_two = self.pairs.of(np.repeat(self.byte_id[of], 256), np.tile(self.byte_id[of], 256))
        n = max(bytes_of, default=0) + 1
        made = [bytes_of.get(i, b"") for i in range(n)]
        self.token_bytes = pa.array(made, pa.large_binary())
        self.token_size = np.array([len(b) for b in made], np.int64)
        self.token_digits = pa.array([b"%d," % i for i in range(n)], pa.large_binary())
        self.digit_size = np.array([len(b"%d," % i) for i in range(n)], np.int64)

    # ---- merging

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token, by a queue of its own."""
        if piece in self.whole_of:
            return [self.whole_of[piece]]
        queue, n, rank_of, id_of = RankQueue(len(self.id_of)), len(piece), self.pairs.get, self.id_of.tolist()
        data = np.frombuffer(piece, np.uint8)
        ids = self.byte_id[data].tolist()
        pair = [*self.of_two[(data[:-1].astype(np.int64) << 8) | data[1:]].tolist(), _NONE]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        for i, rank in enumerate(pair):
            if rank >= 0:
                queue.fill(rank, (i,))  # positions ascend, so the bucket is a heap
        while queue.top:
            rank, i = queue.pop()
            if pair[i] != rank:
                continue  # stale: this pair has changed or is gone
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            ids[i], ids[j], pair[j] = id_of[rank], _NONE, _NONE
            pair[i] = rank_of(ids[i] << 32 | ids[k], _NONE) if k < n else _NONE
            if pair[i] >= 0:
                queue.push(pair[i], i)
            h = before[i]
            if h >= 0:
                pair[h] = rank_of(ids[h] << 32 | ids[i], _NONE)
                if pair[h] >= 0:
                    queue.push(pair[h], h)
        return [x for x in ids if x >= 0]

    def merge_all(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many pre-tokens (large_binary), one after the other, and how many each has."""
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        starts = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
        sizes = np.diff(starts)
        given = {int(i): self.merge(pieces[i].as_py()) for i in np.flatnonzero(sizes > LONG).tolist()}
        # each piece keeps its bytes, or has its ids if they are known, and an end that is no part
        known = np.full(len(pieces), _NONE, np.int64)
        if self.whole is not None:
            known = pc.fill_null(pc.index_in(pieces, value_set=self.whole), _NONE).to_numpy().astype(np.int64)
            known = np.where(known >= 0, self.whole_id[known], _NONE)
        held = np.where(known >= 0, 1, sizes)
        for i, own in given.items():
            known[i], held[i] = _NONE, len(own)
        ends = np.cumsum(held + 1) - 1
        ids = np.full(int(ends[-1]) + 1, _NONE, np.int32)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), held + 1)
        plain = known < 0
        plain[list(given)] = False
        own = np.repeat(plain, sizes)
        where = np.arange(len(data)) - np.repeat(starts[:-1] - starts[0] - (ends - held), sizes)
        data, where = data[own], where[own]
        ids[where] = self.byte_id[data]
        pair = np.full(len(ids), _NONE, np.int32)
        if len(data):
            next_to = np.flatnonzero(np.diff(where) == 1)
            pair[where[next_to]] = self.of_two[(data[next_to].astype(np.int64) << 8) | data[next_to + 1]]
        one = np.flatnonzero(known >= 0)
        ids[ends[one] - 1] = known[one]
        for i, made in given.items():
            ids[ends[i] - len(made) : ends[i]] = made
        self._drain(ids, pair, owner)
        live = ids >= 0
        return ids[live], np.add.reduceat(live, np.r_[0, ends[:-1] + 1]).astype(np.int64)

    def _drain(self, ids: np.ndarray, pair: np.ndarray, owner: np.ndarray) -> None:
        """Merge until no pair is left; every piece ends in a position that is no part."""
        queue = RankQueue(len(self.id_of))
        n = len(ids)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        first = np.flatnonzero(pair >= 0).astype(np.int32)
        order = np.argsort(pair[first], kind="stable")
        first = first[order]
        stops = np.flatnonzero(np.diff(pair[first], append=-2))
        starts = np.r_[0, stops[:-1] + 1]
        laid = {}  # the first positions of each rank stay in one array
        for rank, a, b in zip(pair[first[stops]].tolist(), starts.tolist(), (stops + 1).tolist()):
            laid[rank] = first[a:b]
            queue.fill(rank, ())
        id_of = self.id_of
        while queue.top:
            rank, found = queue.take()
            runs = [x for x in found if type(x) is not int]
            if rank in laid:
                runs.append(laid.pop(rank))
            if not runs and len(found) < FEW:
                self._one_by_one(queue, rank, sorted(found), ids, pair, owner, after, before)
                continue
            if len(runs) < len(found) or not runs:
                runs.append(np.array([x for x in found if type(x) is int], np.int32))
            at = np.concatenate(runs) if len(runs) > 1 else runs[0]
            at = at[pair[at] == rank]
            if len(runs) > 1:
                at.sort()
            if len(at) < FEW:
                if len(at):
                    self._one_by_one(queue, rank, at.tolist(), ids, pair, owner, after, before)
                continue
            again = np.r_[False, owner[at[1:]] == owner[at[:-1]]]
            if again.any():  # the leftmost of each piece now; others wait, as a lower rank may come before them
                queue.fill(rank, at[again].tolist())
                at = at[~again]
            j = after[at]
            k = after[j]
            after[at], before[k] = k, at
            ids[at], ids[j], pair[j] = id_of[rank], _NONE, _NONE
            h = before[at]
            left = np.where(h >= 0, ids[h], _NONE)
            ours = ids[at]
            made = self.pairs.of(np.concatenate([ours, left]), np.concatenate([ids[k], ours]))
            where = np.concatenate([at, h])
            inside = where >= 0
            where, made = where[inside], made[inside]
            pair[where] = made
            live = made >= 0
            where, made = where[live], made[live]
            order = np.argsort(made, kind="stable")
            where, made = where[order], made[order]
            stops = np.flatnonzero(made[1:] != made[:-1]) + 1
            a = 0
            for r, b in zip(made[np.r_[0, stops]].tolist() if len(made) else (), (*stops.tolist(), len(made))):
                queue.fill(r, (where[a:b],) if b - a > 4 else where[a:b].tolist())
                a = b

    def _one_by_one(self, queue: RankQueue, rank: int, at: list[int], ids: np.ndarray, pair: np.ndarray, owner: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        """The same for the few positions of a bucket, in rising order."""
        last, new, rank_of = _NONE, int(self.id_of[rank]), self.pairs.get
        for i in at:
            if pair[i] != rank:
                continue
            own = owner[i]
            if own == last:
                queue.fill(rank, (i,))
                continue
            last = own
            j = after[i]
            k = after[j]
            after[i], before[k] = k, i
            ids[i], ids[j], pair[j] = new, _NONE, _NONE
            right, h = int(ids[k]), before[i]
            made = rank_of(new << 32 | right, _NONE) if right >= 0 else _NONE
            pair[i] = made
            if made >= 0:
                queue.fill(made, (i,))
            left = int(ids[h]) if h >= 0 else _NONE
            if h >= 0:
                made = rank_of(left << 32 | new, _NONE) if left >= 0 else _NONE
                pair[h] = made
                if made >= 0:
                    queue.fill(made, (int(h),))

    # ---- texts

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and where each text's ids end; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts, ends, base = [], [], 0
        for some in stretches(texts):
            ids, stop = self._encode(some)
            parts.append(ids)
            ends.append(stop + base)
            base += len(ids)
        return (np.concatenate(parts), np.concatenate(ends)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, sizes = chunks.split_all(texts)
        coded = pieces.dictionary_encode()
        seen, kinds = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        lead = np.cumsum(sizes) - sizes  # a text's first piece has no blank before it
        first, seen[lead] = np.unique(seen[lead], return_inverse=True)
        seen[lead] += len(kinds)
        pre, uses = self._pre_tokens(kinds, kinds.take(pa.array(first)))
        ids, counts = self.merge_all(pre.cast(pa.large_binary()))
        upto = np.cumsum(uses[1])
        ids, ends = expanded(ids, counts, uses[0])
        ends = np.r_[0, ends]
        per_piece = ends[upto] - ends[upto - uses[1]]
        ids, ends = expanded(ids, per_piece, seen)
        return ids, ends[np.cumsum(sizes) - 1]

    def _pre_tokens(self, later: pa.Array, lead: pa.Array) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray]]:
        """Distinct pre-tokens, the numbers of those of each piece of ``later`` and of ``lead``, and how many each has."""
        blank = pa.scalar(" ", pa.large_string())
        none = pa.scalar("", pa.large_string())
        word = pc.match_substring_regex(later, _LETTERS).to_numpy(zero_copy_only=False) & self.letters_whole
        stop = pc.match_substring_regex(later, _LETTERS_STOP).to_numpy(zero_copy_only=False) & self.letters_whole
        behind = later.filter(pa.array(stop))
        odd = np.flatnonzero(~(word | stop))
        cut = [self.find(" " + x) for x in later.take(pa.array(odd)).to_pylist()] + [self.find(x) if x else [] for x in lead.to_pylist()]
        per = np.where(stop, 2, 1)
        per[odd] = [len(x) for x in cut[: len(odd)]]
        per = np.r_[per, np.array([len(x) for x in cut[len(odd) :]], np.int64)]
        parts = [
            pc.binary_join_element_wise(blank, later.filter(pa.array(word)), none),
            pc.binary_join_element_wise(blank, pc.utf8_slice_codeunits(behind, 0, -1), none),
            pc.utf8_slice_codeunits(behind, -1),
            pa.array([x for own in cut for x in own], pa.large_string()),
        ]
        coded = pa.concat_arrays(parts).dictionary_encode()
        number = np.split(coded.indices.to_numpy(), np.cumsum([len(x) for x in parts])[:-1])
        at = np.cumsum(per) - per
        uses = np.empty(int(per.sum()), np.int64)
        uses[at[: len(later)][word]], uses[at[: len(later)][stop]], uses[at[: len(later)][stop] + 1] = number[0], number[1], number[2]
        rest = np.r_[odd, np.arange(len(later), len(per))]
        uses[np.repeat(at[rest] - (np.cumsum(per[rest]) - per[rest]), per[rest]) + np.arange(len(number[3]))] = number[3]
        return coded.dictionary, (uses, per)

    def decode_all(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids, one after the other, and where each id's bytes start (and the last ends)."""
        return _laid(self.token_bytes, self.token_size, ids)

    def digits_all(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The same of decimal numbers, each with a comma behind it."""
        return _laid(self.token_digits, self.digit_size, ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as native 32-bit integers."""
        return self.encode_all(pa.array([text], pa.large_string()))[0].tobytes()

    def decode(self, ids: list[int]) -> bytes:
        return bytes(self.decode_all(np.array(ids, np.int64))[0])


def stretches(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``STRETCH`` bytes, whole texts each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STRETCH)) + 1
        yield texts.slice(at, min(stop, len(texts)) - at)
        at = stop


def expanded(values: np.ndarray, counts: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` (run i has ``counts[i]``) in the order of ``uses``, and where each ends."""
    if not len(uses):
        return values[:0], np.zeros(0, np.int64)
    starts = np.cumsum(counts) - counts
    n = counts[uses]
    ends = np.cumsum(n)
    return values[np.repeat(starts[uses] - (ends - n), n) + np.arange(ends[-1])], ends


def _laid(strings: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    starts = np.r_[0, np.cumsum(sizes[ids])] if len(ids) else np.zeros(1, np.int64)
    if not len(ids):
        return memoryview(b""), starts
    made = strings.take(pa.array(ids, pa.int64()))
    return memoryview(made.buffers()[2])[: starts[-1]], starts


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a file of ranks: lines of a token in base64 and its rank, which is its id too."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    rows = [(ranks[b[:k]], ranks[b[k:]], r) for b, r in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks]
    pairs = tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    n = max(ranks.values(), default=0) + 1
    return Codec({i: b for b, i in ranks.items()}, pairs, np.arange(n), ranks, regex.compile(pattern).findall)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files of byte-level tokenizers.

    Visible Latin-1 characters stand for themselves, the other bytes in rising order for U+0100 onward.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def merges_codec(path: str, pattern: str) -> Codec | None:
    """The codec of a tokenizer file (JSON) of byte-level BPE; None if the file asks for anything else."""
    with open(path) as file:
        made = json.load(file)
    model, cut = made["model"], made.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not made.get("normalizer")
    odd = model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback")
    if model.get("type") != "BPE" or not plain or odd:
        return None
    vocab, letters = model["vocab"], byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = tuple(np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], r) for r, (a, b) in enumerate(merges))))
    bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
    return Codec(bytes_of, pairs, np.array([vocab[a + b] for a, b in merges]), None, regex.compile(pattern).findall)


# ---- over tables


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind, True)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", drop_text: bool = False) -> DataFrame:
    """Append ``ids`` (array<int>): the byte-level BPE encoding of column ``text``.

    ``path`` names a rank file that every executor can open.  ``drop_text`` leaves the text out.
    """
    keep = df.drop(text) if drop_text else df
    names = keep.columns
    schema = T.StructType([*keep.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            made, ends = own.encode_all(batch.column(batch.schema.get_field_index(text)))
            column = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(made, pa.int32()))
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, column], [*names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append ``out`` (binary): the bytes that column ``ids`` stands for; null ids give empty bytes."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            made = [own.decode(x.values.to_numpy()) if x.is_valid else b"" for x in batch.column(batch.schema.get_field_index(ids))]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.binary())], [*names, out])

    return df.mapInArrow(run, _with(df, out, T.BinaryType()))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode whole documents, decode the ids, and give one row of digests per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            at = 0
            for some in stretches(batch.column(1)):
                ids, ends = own.encode_all(some)
                edges = np.r_[0, ends]
                digits, stop = own.digits_all(ids)
                a, b = stop[edges[:-1]].tolist(), stop[edges[1:]].tolist()
                listed = [hashlib.sha256(digits[x : y - 1 if y > x else y]).hexdigest() for x, y in zip(a, b)]
                data, stop = own.decode_all(ids)
                a, b = stop[edges[:-1]].tolist(), stop[edges[1:]].tolist()
                back = [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(a, b)]
                columns = [batch.column(0).slice(at, len(some)), pa.array(np.diff(edges)), pa.array(listed, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(some)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

