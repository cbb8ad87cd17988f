"""Media columns stored as content-defined chunks, each kept once, and read back with every digest verified.

A payload (bytes, padded with zeros to a positive multiple of ``UNIT``) becomes a mono WAV of unsigned
8-bit samples.  A rolling gear hash over its samples cuts it where the hash's high ``BITS`` bits are
zero, at ``LEAST`` samples from the last cut at least and ``MOST`` at most, so equal passages of
different payloads give equal chunks wherever they stand.

``lists`` makes the ordered list of chunk digests of every row; no bytes leave the task.  ``store``
joins on digests: of the payloads that share a chunk the one with the smallest id owns it, and holds
its bytes; the others only name it.  Each distinct payload is one row of the store with its list and
the bytes it owns.  ``read`` puts payloads together: those that own all their chunks where they lie,
others after a join that carries only chunks that payloads share.  It verifies the digest of every
chunk and of the whole and fails on any difference.

Shuffled are digests and shared chunks, and texts that may share a chunk or be copies, compressed, to meet
the verdict on their chunks.  Which texts may is told by a sieve of fixed size, a bitmap of the hashes of
shared digests: those it clears share nothing and go to the store where they lie.  A full sieve would
clear none and change no result.  Frequent chunks and payloads are looked up by broadcast (``spread.look_up``: 256 chunks of
``MOST`` bytes at most).

Edge cases: a null text is an empty one; a payload without bytes is one unit of zeros; equal texts
are one payload; doc_id may be of any type, null or repeated, each row is returned; extra columns are
ignored; no rows give no rows.  A payload is one row and is held whole by its task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.spread import look_up
from skeinwork.runtime import discard, free_shuffles, materialize

#: Samples a second of the stored form, bytes of its head, and what payloads are padded to.
RATE, HEAD, UNIT = 8000, 44, 64

#: Least and most samples of a chunk, and bits of the hash that are zero at a cut (about LEAST + 2^BITS samples a chunk).
LEAST, MOST, BITS = 512, 16384, 11

#: Bits of the sieve (8 MB): a set bit is a chunk that payloads share, a payload that rows share, or one of their hash.
SIEVE = 1 << 26

#: Samples hashed at a time; the hash looks back over 64.
STRETCH = 1 << 20

#: One random-looking number a byte value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def head(n: int) -> bytes:
    """The first ``HEAD`` bytes of a WAV of ``n`` samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (n + 36) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n & 0xFFFFFFFF)


def _marks(data: bytes) -> np.ndarray:
    """Ends of samples at which the gear hash of the 64 samples before has ``BITS`` zero bits."""
    found = [np.zeros(0, np.int64)]
    for k in range(0, len(data), STRETCH):
        back = min(k, 63)
        h = GEAR[np.frombuffer(data, np.uint8, min(len(data) - k, STRETCH) + back, k - back)]
        for step in (1, 2, 4, 8, 16, 32):  # a hash over 2n samples is one over n and, shifted, the one n samples back
            more = h.copy()
            more[step:] += h[:-step] << np.uint64(step)
            h = more
        found.append(np.flatnonzero((h[back:] >> np.uint64(64 - BITS)) == 0) + k + 1)
    return np.concatenate(found)


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """Lengths of the chunks of each payload; the marks of all are found at once."""
    marks, out, at = _marks(b"".join(payloads)).tolist(), [], 0
    for data in payloads:
        stop, lengths, k = at + len(data), [], bisect_left(marks, at)
        while at < stop:
            k = bisect_left(marks, at + LEAST, k)
            end = min(stop, at + MOST, marks[k] if k < len(marks) else stop)
            lengths.append(end - at)
            at = end
        out.append(lengths)
    return out


def _chunks(data: bytes, lengths: list[int]) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[b - n : b] for b, n in zip(ends, lengths)]


def _media(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("media"), text.alias("text"))


def lists(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, digests, lengths): the chunks of every row of ``docs`` in order; ``media`` is the text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                texts = batch.column(2).to_pylist()
                made = [payload(x) for x in texts]
                lengths = cuts(made)
                digests = [[hashlib.sha256(c).digest() for c in _chunks(x, n)] for x, n in zip(made, lengths)]
                columns = [pa.array([len(x.encode()) for x in texts], pa.int64()), batch.column(1), pa.array(digests, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "media", "digests", "lengths"])

    rows = _media(docs)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, media binary, digests array<binary>, lengths array<int>")


STORE = "media binary, n_bytes long, head binary, digests array<binary>, lengths array<int>, own array<boolean>, lent array<boolean>, bytes binary"

_STORED = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.binary()]


def _stored(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_STORED)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _STORED)], [x.split()[0] for x in STORE.split(", ")])


def sieve(digests: DataFrame) -> np.ndarray:
    """The bitmap of the hashes of ``digests`` (digest): ``SIEVE`` bits, however many there are."""
    place = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % SIEVE + 1  # Spark's buckets of 32768 positions count from one
    rows = digests.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    told = np.zeros((SIEVE // 32768, 4096), np.uint8)
    for r in rows.collect():  # SIEVE / 8 bytes at most
        told[r.k - 1] = np.frombuffer(r.bits, np.uint8)
    return told.reshape(-1)


def _may_share(bits: np.ndarray, digests: list[bytes]) -> bool:
    return any(bits[p >> 3] >> (p & 7) & 1 for p in (int.from_bytes(d[:4], "big") % SIEVE for d in digests))


def store(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The written store: rows of ``STORE``, one for each distinct payload of ``docs``, of which ``listed`` has the ``lists``."""
    one = listed.groupBy("media").agg(F.any_value(F.struct("n_bytes", "digests", "lengths")).alias("x"), F.count(F.lit(1)).alias("copies"))
    each = materialize(one.select("media", "x.*", "copies"), "payloads")
    uses = materialize(each.select("media", F.explode(F.array_distinct("digests")).alias("digest")), "uses")
    shared = materialize(uses.groupBy("digest").agg(F.min("media").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shared")
    bits = docs.sparkSession.sparkContext.broadcast(sieve(shared.select("digest").unionByName(each.filter("copies > 1").select(F.col("media").alias("digest")))))
    foreign = look_up(uses, shared, ["digest"]).filter("media <> owner").groupBy("media").agg(F.collect_list("digest").alias("foreign"))
    lent = shared.groupBy(F.col("owner").alias("media")).agg(F.collect_list("digest").alias("lending"))
    told = each.drop("copies").join(foreign, "media", "left").join(lent, "media", "left")

    def cut(batches: Iterator[pa.RecordBatch], shared_too: bool) -> Iterator[list[tuple]]:
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                out, texts = [], batch.column(1).to_pylist()
                made = [payload(x) for x in texts]
                for media, text, data, lengths in zip(batch.column(0).to_pylist(), texts, made, cuts(made)):
                    chunks = _chunks(data, lengths)
                    digests = [hashlib.sha256(c).digest() for c in chunks]
                    if _may_share(bits.value, [media, *digests]) is shared_too:
                        out.append((media, text.encode(), data, digests, lengths, chunks))
                yield out

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cut(batches, True):
            packed = [pa.compress(r[1], "zstd", asbytes=True) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array(packed, pa.binary())], ["media", "packed"])

    def keep_clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cut(batches, False):
            held = lambda digests, chunks: b"".join(dict(zip(reversed(digests), reversed(chunks)))[d] for d in dict.fromkeys(digests))
            yield _stored([(m, len(raw), head(len(x)), d, n, [True] * len(d), [False] * len(d), held(d, c)) for m, raw, x, d, n, c in rows])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = payload(pa.decompress(r["packed"], r["n_bytes"], "zstd", asbytes=True).decode() if r["n_bytes"] else "")
                others, lending = set(r["foreign"] or ()), set(r["lending"] or ())
                held: dict[bytes, bytes] = {}
                for digest, chunk in zip(r["digests"], _chunks(data, r["lengths"])):
                    if digest not in others:
                        held.setdefault(digest, chunk)
                own, lent = [x not in others for x in r["digests"]], [x in lending for x in r["digests"]]
                out.append((r["media"], r["n_bytes"], head(len(data)), r["digests"], r["lengths"], own, lent, b"".join(held.values())))
            yield _stored(out)

    texts = _media(docs).select("media", "text")
    clear = texts.mapInArrow(keep_clear, STORE)
    doubtful = texts.mapInArrow(press, "media binary, packed binary").dropDuplicates(["media"])
    made = materialize(clear.unionByName(doubtful.join(told, "media").mapInArrow(keep, STORE)), "chunks", compression="zstd")
    for spent in (each, uses, shared):
        discard(spent)
    return made


def _held(row: dict) -> dict[bytes, bytes]:
    """The chunks that a row of the store holds, by digest."""
    found, at = {}, 0
    for digest, n, own in zip(row["digests"], row["lengths"], row["own"]):
        if own and digest not in found:
            found[digest] = row["bytes"][at : at + n]
            at += n
    return found


def feature(samples: np.ndarray) -> str:
    """The mean sample of each sixteenth of a payload, as hexadecimal digits."""
    parts = samples.reshape(16, -1)
    return (parts.sum(axis=1, dtype=np.int64) // parts.shape[1]).astype(np.uint8).tobytes().hex()


FIELDS = [("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int64())]
READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def put_together(row: dict, chunks: dict[bytes, bytes]) -> bytes:
    """The whole WAV of a row of the store; raises if a chunk is missing or any digest differs."""
    for digest, chunk in chunks.items():
        if hashlib.sha256(chunk).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} is damaged")
    samples = b"".join(chunks[x] for x in row["digests"])
    if hashlib.sha256(samples[: row["n_bytes"]]).digest() != row["media"] or row["head"] != head(len(samples)):
        raise ValueError(f"payload {row['media'].hex()} is damaged")
    return row["head"] + samples


def _told(media: bytes, whole: bytes, n_chunks: int) -> tuple:
    samples = whole[HEAD:]
    crc, sha = zlib.crc32(samples[-UNIT:]), hashlib.sha256(samples).hexdigest()
    return media, len(samples), sha, crc, len(whole), hashlib.sha256(whole).hexdigest(), feature(np.frombuffer(samples, np.uint8)), n_chunks


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, FIELDS)], [n for n, _ in FIELDS])


def read(stored: DataFrame) -> DataFrame:
    """Rows of ``READ``, one for each payload of the store, of its bytes as read back."""

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_told(r["media"], put_together(r, _held(r)), len(r["digests"])) for r in batch.to_pylist()])

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                asked = {d for d, x in zip(r["digests"], r["lent"]) if x}
                out += [(d, c) for d, c in _held(r).items() if d in asked]
            columns = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["digest", "chunk"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, chunks = None, None, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["media"] != at:
                    out += [_told(at, put_together(row, chunks | _held(row)), len(row["digests"]))] if at is not None else []
                    at, row, chunks = r["media"], None, {}
                if r["digest"] is None:
                    row = r
                else:
                    chunks[r["digest"]] = r["chunk"]
            yield _batch(out)
        yield _batch([_told(at, put_together(row, chunks | _held(row)), len(row["digests"]))] if at is not None else [])

    complete = F.forall("own", lambda x: x)
    wanted = stored.filter(~complete).select("media", F.explode(F.array_distinct(F.filter(F.zip_with("digests", "own", lambda d, o: F.when(~o, d)), lambda d: d.isNotNull()))).alias("digest"))
    lent = stored.filter(F.exists("lent", lambda x: x)).mapInArrow(lend, "digest binary, chunk binary")
    fetched = look_up(wanted, lent, ["digest"])
    rows = stored.filter(~complete).withColumn("digest", F.lit(None).cast("binary")).withColumn("chunk", F.lit(None).cast("binary"))
    dealt = rows.unionByName(fetched, allowMissingColumns=True).repartition("media").sortWithinPartitions("media", "digest")
    return stored.filter(complete).mapInArrow(direct, READ).unionByName(dealt.mapInArrow(gather, READ))


def stored_features(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with what its payload is after a way through the store and back."""
    listed = materialize(lists(docs), "lists")
    stored = store(docs, listed)
    free_shuffles(docs.sparkSession)
    back = materialize(read(stored), "media")
    discard(stored)
    columns = [n for n, _ in FIELDS if n != "media"]
    return look_up(listed.select("doc_id", "n_bytes", "media"), back, ["media"]).select("doc_id", "n_bytes", *columns)
