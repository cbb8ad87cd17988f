"""Best-fit packing of token sequences by vector best-fit.

``pieces`` tokenizes each document, appends a separator and cuts only what is longer than a
sequence; full-length pieces come last, so the first piece may be shorter.  ``pack`` gives every
piece a sequence and a place.  A bin has three capacities: tokens, documents and attention cost
(the sum of squared lengths); an item goes to the open bin that fits under every constraint and
scores best, by weighted dot product or by the smallest weighted norm of what is left.

Bins are filled in blocks of some ten thousand pieces, dealt out by a hash that mixes all lengths,
so blocks are alike and independent, and the loss is about one open bin a block.  Bins left open
enough are then taken apart and packed again in a second round over fewer blocks.

Edge cases: a null text is an empty one, so such a document is a single separator; a null doc_id
is kept; repeated rows are packed each; extra columns are ignored; no rows give no rows; a text of
any length is tokenized whole.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import bpe
from skeinwork.runtime import checkpoint


#: Pieces that one task packs together.
BLOCK = 16_384


class Ids:
    """Token ids of whole texts by a tokenizer file.

    Byte-level BPE files are encoded by the rank queue over their merges; texts with an added token
    in them, and files of any other kind, by the tokenizer itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.codec = bpe.merges_codec(path, public_tokenizers.PATTERN)
        self.added = "|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values())

    def _plainly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.codec is None:
            return self._plainly(texts.to_pylist())
        ids, ends = self.codec.encode_all(texts)
        made = np.split(ids.astype(np.uint32), ends[:-1]) if len(texts) else []
        if self.added:
            where = np.flatnonzero(pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)).tolist()
            for i, x in zip(where, self._plainly(texts.take(pa.array(where, pa.int64())).to_pylist())):
                made[i] = x
        return made


@functools.lru_cache(maxsize=2)
def ids_by(path: str) -> Ids:
    """One encoder per worker process and file."""
    return Ids(path)


def pieces(docs: DataFrame, path: str, most: int = 2048, separator: int = 0) -> DataFrame:
    """One row per piece of at most ``most`` tokens of each document with its separator."""
    end = np.asarray([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_by(path)
        for batch in batches:
            at = 0
            for some in bpe.stretches(batch.column(1)):
                rows: list[tuple] = []
                for doc, own in zip(batch.column(0).slice(at, len(some)).to_pylist(), ids.of(some)):
                    blob = own.astype("<u4").tobytes() + end
                    total, start, k = len(blob) // 4, 0, 0
                    upto = total % most or most
                    while start < total:
                        rows.append((doc, k, start, upto - start, zlib.crc32(blob[4 * start : 4 * upto])))
                        start, upto, k = upto, upto + most, k + 1
                at += len(some)
                columns = zip(*rows)
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(
    lengths: np.ndarray,
    capacity: tuple[float, float, float],
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins; ``lengths`` in falling order.

    ``capacity``: tokens, documents and attention cost of a bin.  ``rule``: ``norm`` takes the bin
    with the smallest weighted residual, ``dot`` the one whose residual points most along the item.
    An item beyond a capacity by itself gets a bin of its own.
    """
    caps = np.asarray(capacity, float)
    w = np.asarray(weights, float)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((3, 1024))  # residual capacities of the bins that may still take an item, in fractions
    owner = np.empty(1024, np.int64)
    filled: list[int] = []
    n = 0
    least = float(lengths[-1]) if len(lengths) else 0.0
    for at, length in enumerate(lengths.tolist()):
        item = np.array([length, 1.0, float(length) ** 2]) / caps
        slack = left[:, :n] - item[:, None]
        fits = (slack >= -1e-12).all(axis=0)
        if fits.any():
            score = (w[:, None] * slack * slack).sum(axis=0) if rule == "norm" else -(w * item) @ left[:, :n]
            k = int(np.where(fits, score, np.inf).argmin())
            left[:, k] = slack[:, k]
        else:
            if n == left.shape[1]:
                left, owner = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([owner, np.empty_like(owner)])
            k, n = n, n + 1
            left[:, k], owner[k] = 1 - item, len(filled)
            filled.append(0)
        b = int(owner[k])
        bins[at], offsets[at] = b, filled[b]
        filled[b] += int(length)
        if left[0, k] * caps[0] < least - 1e-9 or left[1, k] * caps[1] < 1 - 1e-9:  # closed: nothing fits any more
            n -= 1
            left[:, k], owner[k] = left[:, n], owner[n]
    return bins, offsets, len(filled)


def _round(df: DataFrame, blocks: int, most: int, capacity: tuple, weights: tuple, rule: str, turn: int) -> DataFrame:
    """Pack ``df`` in ``blocks`` independent blocks; sequence ids are unique among the blocks of a round."""

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="block").sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = rows["length"].to_numpy()
        bins, offsets, _ = best_fit(lengths, capacity, weights, rule)
        total = np.bincount(bins, weights=lengths) if len(rows) else np.zeros(0)
        return rows.assign(sequence_id=bins * (2 * blocks) + 2 * int(key[0]) + turn, offset=offsets, filled=total[bins].astype(np.int64))

    # row numbers, not keys, are hashed: equal rows must not meet in one block; ``df`` is checkpointed, so they hold
    dealt = df.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    kind = df.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").applyInPandas(fill, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, filled long")


def pack(
    cut: DataFrame,
    most: int = 2048,
    documents: int | None = None,
    attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
) -> DataFrame:
    """Rows of ``pieces``, checkpointed, with ``sequence_id`` and ``offset``.

    ``documents`` and ``attention`` bound the pieces and the squared lengths of a sequence;
    by default they bind no more than ``most`` tokens do.
    """
    capacity = (most, documents or most, attention or float(most) ** 2)
    full = cut.filter(F.col("length") == most)
    rest = cut.filter(F.col("length") < most)
    n = rest.count()
    first = checkpoint(_round(rest, max(1, round(n / BLOCK)), most, capacity, weights, rule, 0))
    open_bins = first.filter(F.col("filled") < most * 0.98)
    again = open_bins.select("doc_id", "piece", "start", "length", "ids_crc32")
    second = _round(again, max(1, round(again.count() / BLOCK)), most, capacity, weights, rule, 1)
    alone = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = first.filter(F.col("filled") >= most * 0.98).drop("filled")
    return done.unionByName(second.drop("filled")).unionByName(alone)


def pack_documents(docs: DataFrame, path: str, most: int = 2048, separator: int = 0, documents: int | None = None, attention: float | None = None, rule: str = "norm") -> DataFrame:
    """Tokenize, cut and pack whole documents under all three capacities."""
    return pack(checkpoint(pieces(docs, path, most, separator)), most, documents, attention, rule=rule)
