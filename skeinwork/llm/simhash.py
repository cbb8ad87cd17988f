"""SimHash near-duplicate detection with Golay-code fuzzy keys.

``fingerprints``: a bit of the fingerprint is one if it is set in over half of the hashes of the
text's word shingles, repeats included.  ``links``: distinct fingerprints that differ in at most
``BITS`` bits, found by the keys of ``golay`` (none is missed) and verified; of the fingerprints that
share a key, each is linked to the smallest of its group only, so a group of any size gives at most
one row per fingerprint and key.  ``grouped``: every document with its connected component.

Edge cases: a null text is an empty one; a text without words has fingerprint zero, which links like
any other; one of fewer words than a shingle is a single shingle; equal texts have one fingerprint
and are linked by it; a null doc_id takes part but is never a component's id unless all its ids are
null; repeated rows are returned each; extra columns are ignored; whole texts count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import golay
from skeinwork.llm.components import components
from skeinwork.llm.words import LOWER
from skeinwork.runtime import checkpoint

BITS, SHINGLE, SEED = 4, 4, 42

#: Shingles hashed at a time, and fingerprints compared with a run of others at a time.
STRETCH, BLOCK = 1 << 18, 1024


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = text.encode().translate(LOWER).split() if text else []  # bytes are split at exactly the six blanks
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return hashed(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ones = np.zeros(64, np.int64)
    for k in range(0, n, STRETCH):
        upto = min(n, k + STRETCH)
        spans = zip(starts[k:upto].tolist(), ends[k + shingle - 1 : upto + shingle - 1].tolist())
        made = np.fromiter((hashed(joined[a:b], seed) for a, b in spans), np.uint64, upto - k)
        ones += np.unpackbits(made.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def groups_within(prints: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each of some distinct fingerprints the smallest one linked to it, directly or over others."""
    prints = np.sort(prints)
    label = np.arange(len(prints))
    while True:
        new = label.copy()
        for k in range(0, len(prints), BLOCK):
            near = np.bitwise_count(prints[k : k + BLOCK, None] ^ prints[None, :]) <= bits
            new[k : k + BLOCK] = np.where(near, label[None, :], len(prints)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return np.stack([prints, prints[label]])
        label = new


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of the distinct ``fp`` within ``bits`` bits."""
    if bits > 4:
        raise ValueError("the keys find pairs within four bits only")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for k in range(0, len(own), 4096):
                part = own[k : k + 4096]
                rows, made = golay.keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(part[rows])], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by key; the last key of one may go on in the next."""
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, own = (c.to_numpy() for c in batch.columns)
            if not len(keys):
                continue
            begin = int(np.searchsorted(keys, keys[-1]))
            if begin:
                yield _met(*_joined([*waiting, (keys[:begin], own[:begin])]), bits)
                waiting = []
            waiting.append((keys[begin:], own[begin:]))
        if waiting:
            yield _met(*_joined(waiting), bits)

    spread_out = prints.select("fp").mapInArrow(spread, "key long, fp long")
    met = spread_out.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long")
    return met.distinct()


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


def _met(keys: np.ndarray, own: np.ndarray, bits: int) -> pa.RecordBatch:
    """Verified edges among rows sorted by key."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    two = first[size == 2]
    a, b = own[two], own[two + 1]
    near = (np.bitwise_count((a ^ b).view(np.uint64)) <= bits) & (a != b)
    us, vs = [a[near]], [b[near]]
    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        run = np.unique(own[at : at + n].view(np.uint64))
        each, least = groups_within(run, bits)
        moved = each != least
        us.append(each[moved].view(np.int64))
        vs.append(least[moved].view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def grouped(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) per document; component_id: the smallest doc_id reachable over links."""
    made = checkpoint(fingerprints(docs, shingle))
    known = checkpoint(made.groupBy("fp").agg(F.min("doc_id").alias("root")))
    linked = components(links(known, bits)).withColumnRenamed("node", "fp")
    roots = linked.join(known, "fp").groupBy("component").agg(F.min("root").alias("component_id"))
    found = linked.join(roots, "component").select("fp", "component_id")
    every = known.join(found, "fp", "left").select("fp", F.coalesce("component_id", "root").alias("component_id"))
    return made.join(every, "fp").select("doc_id", "fp", "component_id")
