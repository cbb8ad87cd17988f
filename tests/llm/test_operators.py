"""Each operator against brute force on a small awkward table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures_llm import awkward, awkward_rows, empty
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(rows):
    return sorted(rows, key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe(spark):
    import tiktoken

    from skeinwork.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.codec(path, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.whole_of, special_tokens={})
    want = []
    for i, t, _ in awkward_rows():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert by_id(map(tuple, bpe.digest(awkward(spark), path, public_tokenizers.PATTERN).collect())) == by_id(want)
    assert bpe.digest(empty(spark), path, public_tokenizers.PATTERN).count() == 0
    rng = random.Random(1)
    odd = ["".join(rng.choice(" \t\n\x1c\x85\xa0'sabéßπ漢😀12.,!tl\x00") for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    odd += ["".join(rng.choice("abz") for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["", "z" * 95, "  x", "<|endoftext|>a"]
    ids, ends = own.encode_all(pa.array([*odd, None]))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [*(enc.encode_ordinary(x) for x in odd), []]
    for text in odd[:50]:
        assert own.decode(np.frombuffer(own.encode(text), np.int32)) == text.encode()


def test_long_pre_tokens():
    import tiktoken

    from skeinwork.llm import bpe

    own = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.whole_of, special_tokens={})
    rng = random.Random(8)
    for text in ("".join(rng.choice("abcez") for _ in range(100_000)), "ab" * 20_000, "z" * 30_001):
        assert own.merge(text.encode()) == enc.encode_ordinary(text)


def test_merges_of_a_tokenizer_file():
    from tokenizers import Tokenizer

    from skeinwork.llm import bpe, packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, rng = Tokenizer.from_file(path), random.Random(9)
    texts = ["".join(rng.choice(" \t\n\x85\xa0'sabéßπ漢😀12.,!tl") for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["a<|endoftext|> b", "z" * 500, None]
    want = [tok.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert bpe.merges_codec(path, public_tokenizers.PATTERN) is not None
    assert [x.tolist() for x in packing.ids_by(path).of(pa.array(texts))] == want
    other = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.merges_codec(other, public_tokenizers.PATTERN) is None
    plain = Tokenizer.from_file(other)
    assert [x.tolist() for x in packing.ids_by(other).of(pa.array(["Some words", None]))] == [plain.encode("Some words", add_special_tokens=False).ids, []]


def test_packing(spark):
    from tokenizers import Tokenizer

    from skeinwork.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(awkward(spark), path, 256).collect()
    want = Counter()
    for i, t, _ in awkward_rows():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at, upto, k = 0, len(ids) % 256 or 256, 0
        while at < len(ids):
            want[(i, k, at, upto - at, zlib.crc32(np.array(ids[at:upto], "<u4").tobytes()))] += 1
            at, upto, k = upto, upto + 256, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        x.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(x, x[1:])) and x[0][0] == 0 and sum(n for _, n in x) <= 256
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 256) + 1
    for rule in ("norm", "dot"):  # binding document and attention capacities
        tight, held = {}, Counter()
        for r in packing.pack_documents(awkward(spark), path, 256, documents=2, attention=40_000.0, rule=rule).collect():
            tight.setdefault(r.sequence_id, []).append((r.offset, r.length))
            held[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        assert held == want
        for x in tight.values():
            x.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(x, x[1:])) and x[0][0] == 0 and sum(n for _, n in x) <= 256
            assert len(x) <= 2 and (len(x) == 1 or sum(n * n for _, n in x) <= 40_000)
    assert packing.pack_documents(empty(spark), path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    from skeinwork.llm.packing import best_fit

    lengths = np.sort(np.random.default_rng(3).integers(1, 100, 400))[::-1]
    bins, offsets, n = best_fit(lengths, (100, 4, 6000.0), rule=rule)
    for b in range(n):
        own = lengths[bins == b]
        assert len(own) == 1 or (own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 6000)
        assert sorted(offsets[bins == b]) == [0, *np.cumsum(lengths[bins == b][np.argsort(offsets[bins == b])])[:-1]]


def test_langid(spark):
    from skeinwork.llm import langid

    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices(x, k=5)) for _ in range(30)), lang) for i, (x, lang) in enumerate([("abcde", "p"), ("vwxyz", "q")] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.filter("doc_id < 300"))
    told = langid.predict(docs.filter("doc_id >= 300"), model).collect()
    assert all(r.lang == r.lang_pred and not r.rejected and 0.5 < r.score <= 1 for r in told)
    odd = langid.predict(spark.createDataFrame([(0, None), (1, "12 !"), (2, "ЖЖЖЖ ЖЖЖЖ ЖЖЖЖ ЖЖЖЖ ЖЖЖЖ ЖЖЖЖ")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in odd[:2]] == [("und", 0.0, True)] * 2 and odd[2].rejected
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs.limit(3), nothing).collect()} == {"und"}
    # the probabilities of all continuations of a seen context add up to one, with one share for the unseen
    h = langid.hashed("  a"[-3:])
    assert (model.logs[4] <= 0).all() and h in set(model.contexts[4].tolist())


def _kneser_ney(corpus: list[str], size: int):
    """P(character | three before) by the definition, from whole counts."""
    from skeinwork.llm.langid import ORDER

    runs = Counter(f"   {x} "[j : j + ORDER] for x in corpus for j in range(len(x) + 1))
    tables = {ORDER: runs}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = Counter(run[1:] for run in tables[n + 1])

    def chance(run: str) -> float:
        if not run:
            return 1 / size
        under = {r: c for r, c in tables[len(run)].items() if r[:-1] == run[:-1]}
        if not under:
            return chance(run[1:])
        total = sum(under.values())
        return max(under.get(run, 0) - 0.75, 0) / total + 0.75 * len(under) / total * chance(run[1:])

    return chance


@pytest.mark.parametrize("together", [64, 2])
def test_langid_is_kneser_ney(together):
    from skeinwork.llm import langid

    corpora = {"p": ["abba cab", "bac"], "q": ["cabbage bag", "gab"], "r": ["xyz", "zyx a"], "s": ["b"], "t": ["üñ üñ"]}
    counts = {x: Counter(f"   {y} "[j : j + 4] for y in own for j in range(len(y) + 1)) for x, own in corpora.items()}
    size = len({c for own in corpora.values() for y in own for c in f"{y} "}) + 1
    model = langid.Model(counts, together=together)
    assert len(model.others) == (0 if together == 64 else 2)
    by_hand = {x: _kneser_ney(own, size) for x, own in corpora.items()}
    for text in ("abba", "bag cab gab", "zzz", "ü", "漢字 cab"):
        n, h = model.entropies(text)
        padded = f"   {text} "
        want = [-sum(math.log2(by_hand[x](padded[j : j + 4])) for j in range(n)) / n for x in sorted(corpora)]
        assert n == len(text) + 1 and np.allclose(h, want, rtol=1e-5)


def test_langid_of_many_languages_and_awkward_rows(spark):
    from skeinwork.llm import langid

    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices([chr(0x4E00 + 8 * (i % 300) + j) for j in range(8)], k=4)) for _ in range(8)), f"l{i % 300:03}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 300 and len(model.others) == 4
    assert all(r.lang == r.lang_pred for r in langid.predict(docs, model).collect())
    made = langid.predict(awkward(spark), langid.fit(awkward(spark)))
    assert made.columns.count("lang_pred") == made.columns.count("rejected") == 1
    got = made.select("doc_id", "text", "lang_pred", "score", "rejected").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in awkward_rows())
    assert all((r.lang_pred == "und" and r.score == 0 and r.rejected) == (not langid.letters(r.text)) and 0 <= r.score <= 1 for r in got)
    assert len({(r.text, r.lang_pred, r.score) for r in got}) == len({r.text for r in got})
    assert langid.predict(empty(spark), model).count() == 0


def test_langid_rejects_at_the_stated_rate():
    from skeinwork.llm import langid

    rng = np.random.default_rng(8)
    model = langid.Model({"p": {"   a": 1}, "q": {"   b": 1}, "few": {"   c": 1}})
    draw = lambda x, n: [(x, 100, [3 + y if z == x else 9.0 for z in ("few", "p", "q")]) for y in rng.gamma(4.0, 0.1, n)]
    wrong = [("p", 100, [9.0, 8.9, 3.0])] * 9  # labelled p, yet in q: must not lift the limit of p
    model.calibrate([*draw("p", 4000), *draw("q", 4000), *draw("few", 3), *wrong])
    for x in ("p", "q", "few"):
        beyond = np.mean([min(h) > model.limits[x] for _, _, h in draw(x, 40_000)])
        assert beyond <= langid.RATE and model.limits[x] < 6


def test_substrings(spark):
    from skeinwork.llm import substrings

    rows = awkward_rows()
    starts = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                starts[key] = min(starts.get(key, i), i)
    want = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and starts[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    docs = awkward(spark).select("doc_id", "text", "lang")
    got = substrings.dedup(docs)
    assert by_id((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in got.collect()) == by_id(want)
    assert sum(x[2] for x in want) > 0
    assert substrings.dedup(docs.limit(0)).count() == 0
    odd = docs.select("*", *(F.lit(k).alias(f"`{n}`" if "." in n else n) for k, n in enumerate(["_spans", "_doc", "_sha", "sha", "spans", "others", "least", "n_words"])), F.lit(9).alias("x.y"))
    again = substrings.dedup(odd)
    assert again.columns == [*(c for c in odd.columns if c != "n_words"), "n_words", "n_removed", "kept_words"]
    assert by_id((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in again.collect()) == by_id(want)


def test_words_that_only_differ_in_order_are_kept(spark):
    """Two long words of two letters whose polynomial hashes are equal for every odd base are still two words."""
    from skeinwork.llm import substrings

    letters = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    other = letters.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*around[:30], letters, *around[30:]])), (2, " ".join([*around[:30], other, *around[30:]])), (3, "  ".join([*around[:30], other, *around[30:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.dedup(docs).collect()) == [(1, 0), (2, 0), (3, 61)]
    data, starts, stops = substrings.cut(" ".join(["a" * 8, "a" * 9, "a" * 300, "a" * 301, "b", "a"]))
    assert len(set(substrings.word_hashes(data, starts, stops).tolist())) == 6


def test_lm(spark):
    from skeinwork.llm import lm

    rows = awkward_rows()
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5
    held = F.coalesce(lm.fold(5) == 1, F.lit(True))
    got = lm.score_documents(awkward(spark), held, F.coalesce(lm.fold(5) == 0, F.lit(False))).collect()
    seen = Counter()
    for i, t, _ in rows:
        if fold(i) not in (1, None):
            seen.update([*WORD.findall((t or "").translate(LOWER)), ""])
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, t, _ in rows:
        own = [*WORD.findall((t or "").translate(LOWER)), ""]
        base = sum(math.log10((seen[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own)
        want.append((i, fold(i) in (1, None), len(own), sum(seen[x] > 0 for x in own), n, round(base, 6)))
    assert by_id((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == by_id(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    texts = {}
    for r, in zip(got):
        texts.setdefault((r.doc_id, r.n_tokens), set()).add(round(r.score, 6))
    assert len(texts[(0, 131)]) == 1
    assert lm.score_documents(empty(spark), held, F.lit(False)).count() == 0


def test_lm_bits_are_a_distribution():
    from skeinwork.llm import lm

    rng = np.random.default_rng(3)
    mixer, tables = lm.Mixer(), lm.Tables()
    tables.stretch[:], tables.level[:] = rng.integers(-9000, 9000, lm.SLOTS), rng.integers(0, 8, lm.SLOTS)
    mixer.weights += rng.normal(0, 0.2, mixer.weights.shape)
    code = np.arange(256, dtype=np.uint64) | np.uint64(0x206100)
    assert abs((2.0 ** -mixer.bits(tables, code)).sum() - 1) < 1e-6
    # with a likely word before them, the first bytes of all words still share one chance
    agreements = lm.Agreements()
    agreements.chance = rng.uniform(0.05, 0.95, agreements.chance.shape)
    words = (np.arange(256, dtype=np.uint64) << np.uint64(56)) | np.uint64(1 << 55)
    words = words[words >> np.uint64(56) != 0]
    likely = np.full(len(words), 0x6162630000000000, np.uint64)
    level = np.full(len(words), 7)
    kinds = np.zeros(len(words), np.uint8)
    one = np.zeros(len(words))
    for part, chance, cell, used, came in lm._steps(mixer, tables, words, kinds, likely, level):
        p = agreements.chance[7, cell]
        bits = np.where(used, np.where(came, p, 1 - p), chance)[:, :8]
        one[part] = bits.astype(float).prod(axis=1)
    zero = one[0]  # byte 0 never comes; its chance is what is left
    assert 0 < zero < 1 and one.sum() < 1 + 1e-6


def _text_by_hand(lm, mixer, tables, agreements, seen, text):
    """Bits of a text, one at a time, with nothing but the tables and the counts of followers."""
    words = lm.tokens(text)
    total, high = math.log2(lm.KINDS), lm.kind(words)
    for i, word in enumerate(words or [b""]):
        coded = word + (b"\n" if i == max(len(words), 1) - 1 else b" ")
        likely, level = None, None
        if i >= 2 and (words[i - 2], words[i - 1]) in seen:
            own = seen[(words[i - 2], words[i - 1])]
            likely, most = min(own.items(), key=lambda x: (-x[1], x[0]))
            whole = sum(own.values())
            level = min(5, int(math.log2(most + 0.5))) * 4 + (4 * most > whole) + (4 * most > 3 * whole) + (most == whole)
        past = b" " * lm.REACH if i == 0 else b" "
        agrees = likely is not None
        for at, byte in enumerate(coded):
            run = (past + coded[:at])[-lm.REACH :]
            blank = run.rfind(b" ")
            run = run[blank:] if blank >= 0 else run
            code = int.from_bytes(run + bytes([byte]), "big") | high << 56
            chances = mixer.chances(tables, np.array([code], np.uint64))[0]
            for j in range(8):
                p = float(chances[j])
                if agrees and at < 8:
                    bit = byte >> (7 - j) & 1
                    came = (likely[at] >> (7 - j) & 1) == bit
                    st = math.log(p / (1 - p)) * (1 if came else -1)
                    q = agreements.chance[level, min(lm.CELLS - 1, max(0, int(st + 12)))]
                    p, agrees = (q, True) if came else (1 - q, False)
                total -= math.log2(p)
    return total


def test_lm_scores_by_hand(spark):
    from skeinwork.llm import lm

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(i + 200, rows[i][1]) for i in range(40)] + [(500, None), (501, " "), (502, rows[3][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held, late = lm.fold(5) == 1, lm.fold(5) == 0
    known = lm.numbered(docs, held, late)
    mixer, tables, agreements = lm.train(known, lm.count_words(known.filter(~F.col("held_out"))), lm.hot_contexts(known), 8)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    counts, seen = Counter(), {}
    for i, t in rows:
        words = lm.tokens(t)
        if fold(i) == 1:
            continue
        for k in range(2, len(words)):
            coded = words[k] + (b"\n" if k == len(words) - 1 else b" ")
            seen.setdefault((words[k - 2], words[k - 1]), Counter())[coded[:8].ljust(8, b"\0")] += 1
        for k, word in enumerate(words or [b""]):
            coded = word + (b"\n" if k == max(len(words), 1) - 1 else b" ")
            for at in range(len(coded)):
                run = (b" " + coded[:at])[-2:]
                run = run[run.rfind(b" ") :] if b" " in run else run
                counts[(lm.kind(words), run, coded[at] >> 7)] += 1
    same = []
    for high, run, _ in list(counts)[:400]:  # the first bit after two bytes; some slots are shared, as in any hash table
        code = np.array([int.from_bytes(run + b"\0", "big") | high << 56], np.uint64)
        if run.startswith(b" ") and len(run) == 1:
            continue
        at = lm.slots(code, 1, np.array([1]))
        stretch, level = lm.told(np.array([counts[(high, run, 0)]]), np.array([counts[(high, run, 1)]]))
        same.append(abs(int(tables.stretch[at][0]) - int(stretch[0])) <= 1 and tables.level[at][0] == level[0])
    assert sum(same) > 0.95 * len(same) > 50
    got = {(r.doc_id, r.n_tokens): r for r in lm.score_documents(docs, held, late).collect()}
    for i, t in rows:
        r = got[(i, len(lm.tokens(t)) + 1)]
        want = _text_by_hand(lm, mixer, tables, agreements, seen, t)
        assert abs(r.score + want * math.log10(2)) < 1e-2 + 1e-4 * want, (i, t)
        assert abs(r.bits_per_byte - want / (len(b" ".join(lm.tokens(t))) + 1)) < 1e-2
    assert got[(500, 1)].score == got[(501, 1)].score
    # neither partitions nor the split of hot contexts matter
    want = sorted((k, r.score, r.bits_per_byte) for k, r in got.items())
    before = lm.HOT, lm.HOT_LEAST, lm.SALTS, lm.PROBE
    try:
        lm.HOT, lm.HOT_LEAST, lm.SALTS, lm.PROBE = 1 << 40, 1, 3, 1  # every context is hot
        again = lm.score_documents(docs.repartition(7), held, late).collect()
        assert sorted(((r.doc_id, r.n_tokens), r.score, r.bits_per_byte) for r in again) == want
    finally:
        lm.HOT, lm.HOT_LEAST, lm.SALTS, lm.PROBE = before


def _signals(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    grams, own = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            own |= {k, k + 1, k + 2}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(own), n < 50 or 100 * len(own) > 50 * n


def test_quality(spark):
    from skeinwork.llm import quality

    measured = quality.signals(awkward(spark).select("doc_id", "lang", "text"), "doc_id", "lang").cache()
    labels = spark.createDataFrame([(0, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    judged = quality.judge(measured, quality.cutoffs(measured, labels)).collect()
    assert by_id((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged) == by_id((i, *_signals(t)) for i, t, _ in awkward_rows())
    assert all(r.kept == (not r.base_failed) for r in judged)  # one label proves nothing


def test_quality_cutoffs_hold_the_risk(spark):
    from skeinwork.llm import quality

    rows = [(i, "en", 100, 500, 50 if i % 400 == 0 else 0, 10, 0, 0) for i in range(4000)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = measured.select("doc_id", F.lit(1).alias("quality"))
    limit = quality.cutoffs(measured, labels).first()
    assert limit.symbol_share == 0.01  # 10 of 4000 good documents exceed all cutoffs below 0.1, and P(X <= 10) for 0.5 % is 0.0108 < 0.05 / 4
    few = measured.filter("doc_id between 1 and 30")
    assert quality.cutoffs(few.union(few), labels.crossJoin(spark.range(64)).drop("id")).count() == 0  # however often they are labelled, 30 prove nothing
    doubted = labels.union(labels.select("doc_id", F.lit(0).alias("quality")))
    assert quality.cutoffs(measured, doubted).count() == 0
    tail = spark.range(1).select(quality.binomial_tail(F.lit(3).cast("long"), F.lit(1000).cast("long"), 0.01).alias("p")).first().p
    want = sum(math.comb(1000, k) * 0.01**k * 0.99 ** (1000 - k) for k in range(4))
    assert abs(tail - want) < 1e-9


def test_warc(spark):
    import base64
    import io

    from skeinwork.llm import warc

    pages = spark.createDataFrame([(1, "http://a/\n x", "<p>é</p>"), (5, None, "<p>é</p>"), (2, "u", None), (3, "u", ""), (3, "u", ""), (None, "u", "z"), (None, "u", "<p>é</p>")], "page_id long, url string, html string")
    got = by_id((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_files(warc.write(pages)).collect())
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    p, e, z = "<p>é</p>".encode(), b"", b"z"
    want = [(1, 9, digest(p), "revisit", 5), (5, 9, digest(p), "response", None), (2, 0, digest(e), "revisit", 3), (3, 0, digest(e), "response", None), (3, 0, digest(e), "response", None), (None, 1, digest(z), "response", None), (None, 9, digest(p), "revisit", 5)]
    assert got == by_id(want)
    assert warc.read_files(warc.write(pages.limit(0))).count() == 0
    data = warc.record(1, "u", b"hello" * 9, warc.sha1(b"hello" * 9), None, "2000-01-01T00:00:00Z")
    assert len(list(warc.read(io.BytesIO(data * 3)))) == 3
    with pytest.raises(ValueError):
        list(warc.read(io.BytesIO(data[:-9])))


def test_chat(spark):
    from skeinwork.llm import chat

    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", hard), (2, 0, "user", "hi"), (2, 1, "assistant", "other\\"), (3, 0, None, None), (4, 0, "user", "hi"), (4, 0, "user", "hi"), (None, 1, "assistant", "<\\s>\\"), (5, None, "x[INST]", "<<s>")]
    made = chat.trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    talks = {}
    for c, k, r, x in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0)):
        talks.setdefault(c, []).append((r or "", x or ""))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        said, loss = "".join(f"{r}\n{x}\n" for r, x in turns), "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha(said), len(loss), sha(loss))
    one = chat.Tree()
    for c in (1, 2):
        one.add(c, talks[c])
    tree = one.row()
    assert tree["text"].count("hi") == 1 and len(tree["nodes"]) == 4
    assert [n["position"] for n in tree["nodes"]][2] == [n["position"] for n in tree["nodes"]][3]
    for s in ("\\", "\\\\s", hard, "<<s>", "<\\/s>", "[[INST]"):
        assert chat.unescape(chat.escape(s)) == s and not any(x in chat.escape(s) for x in chat.CONTROL)


def test_simhash(spark):
    import xxhash

    from skeinwork.llm import golay, simhash

    def fp(t):
        w = WORD.findall((t or "").translate(LOWER))
        grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    rows = awkward_rows()
    got = simhash.grouped(awkward(spark)).collect()
    prints = [fp(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(rows))]
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(rows[i][0])
    least = {x: min((d for d in ids if d is not None), default=None) for x, ids in groups.items()}
    want = [(rows[i][0], prints[i], least[label[i]]) for i in range(len(rows))]
    assert by_id((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == by_id(want)
    assert simhash.grouped(empty(spark)).count() == 0
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    keys = [{} for _ in range(2)]
    for side, x in zip(keys, (a, b)):
        for r, k in zip(*golay.keys(x)):
            side.setdefault(int(r), set()).add(int(k))
    assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


def test_components(spark):
    from skeinwork.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_fingerprints(spark):
    from skeinwork.llm import fingerprint

    rows = [(i, t or "") for i, t, _ in awkward_rows() if i not in (12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.edited(docs).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        follow, half = order[(k + 1) % len(order)][1], len(t) // 2
        cut = t[: len(t) - half] + follow[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(cut))
    import xxhash

    def hashed(parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        return seed - (1 << 64) * (seed >> 63)

    def bottom(t):
        w = WORD.findall(t)
        return sorted({hashed(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {hashed([" ".join(w)])} if w else set())[:128]

    def like(a, b):
        both = sorted({*a, *b})[:128]
        return len({*both} & {*a} & {*b}) / len(both) if both else 1.0

    for k, (i, t) in enumerate(order):
        follow, half = order[(k + 1) % len(order)][1], len(t) // 2
        cut = t[: len(t) - half] + follow[:half]
        assert (got[i].sketch, got[i].edited_sketch) == (bottom(t), bottom(cut))
        assert abs(got[i].near_edited - like(bottom(t), bottom(cut))) < 1e-12 and abs(got[i].near_next - like(bottom(t), bottom(follow))) < 1e-12
    assert got[0].sketch == got[1].sketch and got[6].near_next == 0.0 and got[7].sketch == []
    assert got[8].near_edited == 1.0
    assert fingerprint.edited(awkward(spark)).count() == len(awkward_rows()) and fingerprint.edited(empty(spark)).count() == 0
    # far-apart, frequent and null ids: every row is followed by the next one in order
    far = [-(2**63), -(2**63) + 1, 0, 5, 2**63 - 1]
    rows = [(i, f"t {i}") for i in far] + [(7, f"seven {k}") for k in range(400)] + [(None, f"none {k}") for k in range(60)] + [(i, f"id {i}") for i in range(100, 400)]
    made = fingerprint.followed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ["text"]).collect()
    rank = {t: (i is None, -(i or 0), hashed([t])) for i, t in rows}
    line = sorted(rank, key=rank.get)
    assert {r.text: r.next_text for r in made} == dict(zip(line, [*line[1:], line[0]])) and len(made) == len(rows)
    s = spark.range(1).select(*(F.array_sort(F.transform(F.sequence(F.lit(a), F.lit(b)), lambda x: F.xxhash64(x))).alias(n) for n, a, b in (("a", 0, 5999), ("b", 3000, 8999))))
    s = s.select(fingerprint.sketch(F.col("a"), 512).alias("a"), fingerprint.sketch(F.col("b"), 512).alias("b"))
    r = s.select(fingerprint.resemblance(F.col("a"), F.col("b"), 512).alias("j"), fingerprint.containment(F.col("a"), F.col("b"), 512).alias("c"), fingerprint.distinct(F.col("a"), 512).alias("n")).first()
    assert abs(r.j - 1 / 3) < 0.08 and abs(r.c - 0.5) < 0.1 and abs(r.n - 6000) < 1000


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    names = ["_stay", "_doc_id", "_lang", "_sha", "_present", "_rest", "_spans", "_doc", "sha", "id", "n_removed"]
    odd = awkward(spark).select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)), F.lit("dot").alias("x.y"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 4:
            assert docs.columns == columns, name
        if k == 0:
            assert by_id((r.doc_id, r.text) for r in docs.collect()) == by_id((i, t) for i, t, _ in awkward_rows() if not _signals(t)[5])
        if k == 2:
            assert {r.doc_id for r in docs.collect()} & {0, 1} == {0}
    assert docs.count() > 0


def test_near_copies_of_the_pipeline(spark, tmp_path):
    import corpus_pipeline
    from skeinwork.llm import resemble

    rng = random.Random(3)
    rows = []
    for base in range(60):  # chains: each text is like the one before it, with fewer and fewer edits
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for step in range(4):
            rows.append((4 * base + step, " ".join(words)))
            for at in rng.sample(range(0, 200, 6), base % 8 + 1):
                words[at] = f"x{rng.randrange(10**6)}"
    rows += [(900, "a b"), (901, "A  b"), (902, "a c"), (903, None), (904, " "), (905, "")]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := WORD.findall((t or "").translate(LOWER))) else set() for _, t in rows]
    like = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if like(sets[i], sets[j])) for i in range(len(rows))]
        if new == label:
            break
        label = new
    want = sorted(rows[i][0] for i in range(len(rows)) if label[i] == i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want
    assert 60 < len(want) < 240 and resemble.firsts(docs.limit(0)).count() == 0
    assert len(resemble.linked([np.arange(k, k + 90, dtype=np.uint64) for k in range(0, 200, 10)])) == 19  # 80 of 100 shared by neighbours only


def test_quality_of_many_languages(spark):
    """Every language has its own cutoffs, as in the query's SQL, past the 64 most labelled ones too."""
    from skeinwork.llm import quality

    measured = spark.range(70 * 2000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.format_string("%02d", F.col("id") % 70)).alias("lang"), F.lit(100).cast("long").alias("n_words"), F.lit(500).cast("long").alias("word_chars"),
        F.when(F.col("id") >= 70 * 1999, 400).otherwise(0).cast("long").alias("n_symbols"), F.lit(10).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"),
    )
    labels = measured.filter("n_symbols = 0").select("doc_id", F.lit(1).alias("quality"))
    judged = quality.judge(measured, quality.cutoffs(measured, labels)).filter("n_symbols > 0").collect()
    assert len(judged) == 70 and all(not r.kept and r.failed_rules == ["symbol_share"] for r in judged)


def test_pipeline_rules_serve_small_languages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.randrange(10**5):05}" for _ in range(60)) + (" ########" * 20 if i >= 1200 else ""), ("de", "en", "es", "fr")[i % 4]) for i in range(1240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.filter("doc_id < 1200").select("doc_id", F.lit(1).alias("quality")).write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(r.doc_id for r in corpus_pipeline.rate_quality(spark, docs, str(tmp_path)).collect()) == list(range(1200))


def test_one_row_of_each_group_of_near_copies(spark):
    import corpus_pipeline

    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    rows = [(7, a, 1), (7, a, 1), (7, a, 2), (9, a, 1), (7, b, 1), (3, b, 1), (7, c, 1), (None, d, 1), (None, d, 1), (8, d, 1), (None, e, 1), (None, e, 1), (None, e, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert by_id((r.doc_id, r.text) for r in got.collect()) == by_id([(7, a), (3, b), (7, c), (8, d), (None, e)])
