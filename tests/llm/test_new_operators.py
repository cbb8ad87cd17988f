"""The trie, centroid and media operators against brute force on small awkward tables."""

import hashlib
import io
import random
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures_llm import awkward, awkward_rows, empty


def _turns(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(("user", "assistant")), rng.choice("abc") * rng.randint(1, 2)) for c in range(0, 260, 3) for t in range(rng.randint(1, 9))]
    rows += [(100, None, None, None), (100, None, "b", None), (100, 2, "user", "z"), (100, 2, "user", "z"), (-7, 1, "x", "y"), (None, 0, "user", "lost"), (1, 5, "user", "漢字 😀"), (7, 0, "", ""), (7, 1, None, None)]
    rows += [(500, t, "user", "r" * (t % 3)) for t in range(70)] + [(501, t, "user", "r" * (t % 3)) for t in range(2100)]
    return rows, spark.createDataFrame([(*r, "n", 3) for r in rows], "conv_id long, turn long, role string, text string, length string, key int").repartition(5)


def _rebuilt(rows):
    talks = {}
    for c, t, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    talks = {c: [(a[2], a[3]) for a in sorted(x)] for c, x in talks.items()}
    out = {}
    for c, own in talks.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = talks.get(base, [])[:h] + own[h:]
    return talks, out


def _trie(talks):
    nodes = {}
    for c, x in talks.items():
        digest = hashlib.sha256()
        for d in range(len(x) + 1):
            if d:
                digest.update(repr(x[d - 1]).encode())
            node = nodes.setdefault((d, digest.hexdigest()), {"members": [], "ends": [], "parent": None, "s": len(x[d - 1][1]) if d else 0, "kids": []})
            node["members"].append(c)
            if d == len(x):
                node["ends"].append(c)
            if d and node["parent"] is None:
                node["parent"] = way
                nodes[way]["kids"].append((d, digest.hexdigest()))
            way = (d, digest.hexdigest())
    out = []
    for d, k in sorted(nodes, reverse=True):
        x = nodes[d, k]
        x["leaves"] = sum(nodes[y]["leaves"] for y in x["kids"]) or 1
        x["saved"] = (len(x["members"]) - 1) * x["s"] + sum(nodes[y]["saved"] for y in x["kids"])
        ends = hashlib.sha256(",".join(map(str, sorted(x["ends"]))).encode()).hexdigest()
        out.append((min(x["members"]), d, None if d == 0 else min(nodes[x["parent"]]["members"]), len(x["members"]), len(x["kids"]), x["leaves"], x["saved"], ends))
    return sorted(out, key=repr)


def test_trie(spark):
    from skeinwork.llm import prefix_trie

    rows, df = _turns(spark)
    plain, rebuilt = _rebuilt(rows)
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(df)).collect()), key=repr) == _trie(rebuilt)
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.plain(df)).collect()), key=repr) == _trie(plain)
    assert prefix_trie.trie(prefix_trie.rebuilt(df.limit(0))).count() == 0


def test_trie_of_copies_and_parts_of_ids(spark, monkeypatch):
    from skeinwork.llm import prefix_trie, spread

    monkeypatch.setattr(prefix_trie, "PART", 7)
    monkeypatch.setattr(spread, "WORTH", 5)
    rows = [(c, t, "user", "same" if t < 2 else str(c % 3)) for c in range(120) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain, rebuilt = _rebuilt(rows)
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(df)).collect()), key=repr) == _trie(rebuilt)


def test_look_up_and_dense_names(spark, monkeypatch):
    from skeinwork.llm import spread

    monkeypatch.setattr(spread, "WORTH", 3)
    rows = spark.createDataFrame([(x,) for x in "aaaaabbbbcd"], "k string")
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("e", 4)], "k string, v int")
    assert Counter(map(tuple, spread.look_up(rows, table, ["k"]).collect())) == Counter({("a", 1): 5, ("b", 2): 4, ("c", 3): 1})
    assert ("d", None) in {tuple(r) for r in spread.look_up(rows, table, ["k"], outer=True).collect()}
    named = spread.dense_names(rows, ["k"], "n").collect()
    assert len(named) == 11 and sorted({r.n for r in named}) == [0, 1, 2, 3] and len({(r.k, r.n) for r in named}) == 4


def _lloyd(points, k, rounds):
    ids, v = [i for i, _ in points], np.array([x for _, x in points], np.int64)
    first = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest(), v[i].tolist()))[:k]
    c = v[first]
    for t in range(rounds + 1):
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if t < rounds:
            c = np.array([v[own == j].sum(axis=0) // max((own == j).sum(), 1) if (own == j).any() else c[j] for j in range(len(c))])
    return sorted(((i, int(a), int(b)) for i, a, b in zip(ids, own, d.min(axis=1))), key=repr), c


def test_centroids(spark):
    from skeinwork.llm import centroids

    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=64) * 0.1 + i % 5).astype(np.float32).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[1][1]), (301, [0.5] * 64), (302, [0.5] * 64)]
    bad = [(400, [1.0] * 63), (401, None), (402, [float("nan")] + [0.0] * 63), (403, [float("inf")] * 64), (404, [1e30] * 64), (405, [-1e6] + [0.0] * 63)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + bad + [(406, None)]], "vec_id long, embedding array<float>, label int, cluster string").repartition(3)
    holes = spark.createDataFrame([(407, [None, *[1.0] * 63], 1, "c")], df.schema)
    kept = centroids.quantized(df.unionByName(holes))
    points = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    assert sorted(((r.id, r.v) for r in kept.collect()), key=repr) == sorted(points, key=repr)
    for k, rounds in ((8, 10), (3, 1), (1, 2), (400, 2)):
        made, c = centroids.cluster(kept, k, rounds)
        want, at = _lloyd(points, k, rounds)
        assert (c == at).all() and sorted(map(tuple, made.collect()), key=repr) == want
    told = centroids.summary(*centroids.cluster(kept)).collect()
    want, at = _lloyd(points, 8, 10)
    by = Counter()
    for _, j, d in want:
        by[j] += d
    assert all(r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values()) for r in told)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster].tolist())).encode()).hexdigest() for r in told)
    assert centroids.summary(*centroids.cluster(kept.limit(0))).count() == 0


def test_bounds_spare_scans_and_leave_ties_to_integers():
    from skeinwork.llm.centroids import reassigned

    v = np.array([[0, 0], [4, 0], [2, 0], [100, 0]], np.int64)
    c = np.array([[0, 0], [4, 0]], np.int64)
    own, upper, lower, scanned = reassigned(v, np.full(4, -1, np.int32), np.zeros(4), np.zeros(4), c, np.array([2.0, 2.0]))
    assert own.tolist() == [0, 1, 0, 1] and scanned == 4
    again = reassigned(v, own, upper, lower, c, np.array([2.0, 2.0]))
    assert again[0].tolist() == own.tolist() and again[3] == 1  # only the tie is looked at again
    assert (upper >= np.sqrt(((v - c[own]) ** 2).sum(axis=1))).all() and (lower <= np.sqrt(((v - c[1 - own]) ** 2).sum(axis=1))).all()


def test_media(spark):
    from skeinwork.llm import media

    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    more = [(100 + i, "".join(rng.choice("xyzuvw ") for _ in range(3000)) + shared[i * 10 :] + str(i), "en") for i in range(6)] + [(200, "z" * 50_000, "en"), (201, "y" * 64, "en"), (202, shared * 3, None)]
    docs = awkward(spark)
    extra = spark.createDataFrame([(*r, "src", 0, 1, "n", "k", 2, "r", 3, "l") for r in more], docs.schema)
    got = media.stored_features(docs.unionByName(extra)).collect()
    want = []
    for i, t, _ in awkward_rows() + more:
        raw = (t or "").encode()
        data = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        kept = io.BytesIO()
        with wave.open(kept, "wb") as f:
            f.setnchannels(1), f.setsampwidth(1), f.setframerate(8000), f.writeframes(data)
        whole = kept.getvalue()
        n = len(data) // 16
        means = "".join(f"{sum(data[k * n : k * n + n]) // n:02x}" for k in range(16))
        want.append((i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(whole), hashlib.sha256(whole).hexdigest(), means))
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted(want, key=repr)
    assert media.stored_features(empty(spark)).count() == 0


def test_chunks_are_kept_once_and_damage_is_seen(spark):
    from skeinwork.llm import media

    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    docs = spark.createDataFrame([(i, f"{i} begins otherwise " * (i + 1) + shared) for i in range(8)], "doc_id string, text string")
    listed = media.lists(docs)
    stored = media.store(docs, listed).collect()
    chunks = {d: n for r in stored for d, n in zip(r.digests, r.lengths)}
    assert sum(len(r.bytes) for r in stored) == sum(chunks.values()) < 2 * len(shared)
    whole = max(stored, key=lambda r: len(r.bytes)).asDict()
    everything = {}
    for r in stored:
        everything |= media._held(r.asDict())
    assert media.put_together(whole, everything)[44:][: whole["n_bytes"]].decode().endswith(shared)
    first = whole["digests"][0]
    with pytest.raises(ValueError):
        media.put_together(whole, everything | {first: b"other"})


def test_sieve_clears_only_what_is_not_shared(spark, monkeypatch):
    from skeinwork.llm import media

    digests = [hashlib.sha256(bytes([i])).digest() for i in range(200)]
    bits = media.sieve(spark.createDataFrame([(d,) for d in digests[:100]], "digest binary"))
    assert all(media._may_share(bits, [d]) for d in digests[:100]) and not any(media._may_share(bits, [d]) for d in digests[100:])
    docs = spark.createDataFrame([(i, "some text " * (i % 4) + "x" * 3000 * (i % 3)) for i in range(24)], "doc_id long, text string")
    usual = sorted(map(tuple, media.stored_features(docs).collect()))
    monkeypatch.setattr(media, "sieve", lambda digests: np.full(media.SIEVE // 8, 255, np.uint8))
    assert sorted(map(tuple, media.stored_features(docs).collect())) == usual


def test_cuts_follow_the_content():
    from skeinwork.llm import media

    rng = random.Random(6)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    one, = media.cuts([data])
    assert sum(one) == len(data) and max(one) <= media.MOST and min(one[:-1]) >= media.LEAST
    h, want, at = 0, [], 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(media.GEAR[b])) % (1 << 64)
        if i + 1 - at >= media.LEAST and (h >> (64 - media.BITS) == 0 or i + 1 - at == media.MOST):
            want, at = [*want, i + 1 - at], i + 1
    assert one == want + [len(data) - at] * (len(data) > at)
    moved = b"some bytes more" + data
    assert len(set(media._chunks(moved, media.cuts([moved])[0])) & set(media._chunks(data, one))) > 0.9 * len(one)
    assert media.cuts([data, b"", moved]) == [one, [], media.cuts([moved])[0]]


def test_languages_of_repeated_ids_and_texts_are_learnt(spark):
    from skeinwork.llm import langid

    rng = random.Random(9)
    words = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))
    rows = [(7, words("abcde"), "p") for _ in range(400)] + [(8, "vwxyz zyxwv " * 20, "q")] * 300 + [(None, words("klmno"), "r") for _ in range(300)] + [(9, words("fghij"), "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=50)
    assert {*model.languages} == {"p", "q", "r", "s"}
    told = langid.predict(docs, model).groupBy("lang", "lang_pred").count().collect()
    assert all(r.lang == r.lang_pred for r in told)
