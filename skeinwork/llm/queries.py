"""The registered queries of the corpus operators: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import bpe, centroids, chat, fingerprint, langid, lm, media, packing, prefix_trie, quality, simhash, substrings, warc
from skeinwork.runtime import materialize, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by the multilingual rank file."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from three folds of four and predict the language of every document."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(langid.fold(4) == 2, F.lit(False)))
    model = langid.fit(docs.filter(langid.fold(4) != 2))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove the 50-word windows that a document with a smaller doc_id has."""
    made = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from four folds of five and score every document."""
    held = F.coalesce(lm.fold(5) == 1, F.lit(True))
    return lm.score_documents(table(spark, sf_dir, "documents"), held, F.coalesce(lm.fold(5) == 0, F.lit(False)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base signals and the verdict of the risk-controlled rules on every document."""
    measured = materialize(quality.signals(table(spark, sf_dir, "documents"), "doc_id", "lang"), "signals")
    limits = quality.cutoffs(measured, table(spark, sf_dir, "labels"))
    return quality.judge(measured, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules")
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, then read the archives back."""
    files = warc.write(table(spark, sf_dir, "pages"))
    return warc.read_files(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and one that speaks in control strings, and read them back."""
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.trees(rows.unionByName(hard)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and find the components of near-equal fingerprints."""
    made = simhash.grouped(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch every document and its edited text, and compare them."""
    made = fingerprint.edited(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_shingles",
        "kept_in_edited",
    )


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that those of a hundred share how they begin."""
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster all vectors of 64 components into eight by ten rounds."""
    made = centroids.cluster(centroids.quantized(table(spark, sf_dir, "embeddings")))
    return centroids.summary(*made).withColumnRenamed("id", "vec_id")


def op13_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as chunks of 8-bit samples, and tell what is read back."""
    return media.stored_features(table(spark, sf_dir, "documents")).drop("n_chunks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_packing, op3_langid, op4_substrings, op5_lm, op6_quality, op7_warc, op8_chat, op9_simhash, op10_fingerprints, op11_trie, op12_centroids, op13_media)
}

#: crc32 of a list of bytes in SQL.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {0}), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
  lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


def _kmeans_sql(rounds: int) -> str:
    """The rounds one after the other: a<t> assigns every vector, c<t> are the centroids before that."""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v FROM v ORDER BY k LIMIT 8)",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (SELECT r, min(d * 8 + k) % 8 AS k, min(d) AS d FROM (SELECT r, k, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{t} c) GROUP BY r)""")
        if t < rounds:
            parts.append(f"""c{t + 1} AS MATERIALIZED (SELECT k, coalesce(n.v, c.v) AS v FROM c{t} c LEFT JOIN (SELECT k, list((s - (s % n + n) % n) // n ORDER BY i) AS v
  FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v JOIN a{t} USING (r)) GROUP BY k, i) GROUP BY k) n USING (k))""")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
 CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (r) JOIN c{rounds} c USING (k)"""


ORACLE_SQL: dict[str, str] = {
    "op4_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT doc_id, i, md5(string_agg(x, ' ') OVER s) AS h, count(*) OVER s AS n FROM t
      WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
e AS (SELECT doc_id, i, h FROM k WHERE n = 50),
f AS (SELECT doc_id, i FROM e JOIN (SELECT h, min(doc_id) AS first FROM e GROUP BY h HAVING min(doc_id) < max(doc_id)) USING (h) WHERE doc_id > first),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM f, range(50) r(j)),
m AS (SELECT t.doc_id, count(c.i) AS n_removed, coalesce(string_agg(CASE WHEN c.i IS NULL THEN x END, ' ' ORDER BY t.i), '') AS kept
      FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.i = t.i GROUP BY t.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN m USING (doc_id)""",
    "op6_quality": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER s || ' ' || lead(x, 2) OVER s AS gram FROM t WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM g WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, range(3) v(j) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]+') GROUP BY doc_id),
s AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
  n_repeat_words / greatest(n_words, 1) AS repeat_share, word_chars / greatest(n_words, 1) AS word_length FROM s),
h AS (SELECT lang, unnest(['symbol_share', 'dup_line_share', 'repeat_share', 'word_length']) AS rule, unnest([symbol_share, dup_line_share, repeat_share, word_length]) AS value FROM q JOIN labels USING (doc_id) WHERE quality = 1 AND NOT base_failed),
k AS (SELECT lang, h.rule, step, cutoff, count(*) AS n, count(*) FILTER (WHERE value > cutoff) AS k FROM h JOIN (VALUES ('symbol_share', 0, 0.5), ('symbol_share', 1, 0.3), ('symbol_share', 2, 0.2), ('symbol_share', 3, 0.1), ('symbol_share', 4, 0.05), ('symbol_share', 5, 0.03), ('symbol_share', 6, 0.02), ('symbol_share', 7, 0.01), ('dup_line_share', 0, 0.8), ('dup_line_share', 1, 0.6), ('dup_line_share', 2, 0.5), ('dup_line_share', 3, 0.4), ('dup_line_share', 4, 0.35), ('dup_line_share', 5, 0.3), ('dup_line_share', 6, 0.25), ('dup_line_share', 7, 0.2), ('repeat_share', 0, 0.5), ('repeat_share', 1, 0.45), ('repeat_share', 2, 0.4), ('repeat_share', 3, 0.35), ('repeat_share', 4, 0.3), ('repeat_share', 5, 0.25), ('repeat_share', 6, 0.2), ('repeat_share', 7, 0.15), ('word_length', 0, 12.0), ('word_length', 1, 10.0), ('word_length', 2, 9.0), ('word_length', 3, 8.5), ('word_length', 4, 8.0), ('word_length', 5, 7.5), ('word_length', 6, 7.0), ('word_length', 7, 6.5)) v(rule, step, cutoff) ON v.rule = h.rule GROUP BY ALL),
p AS (SELECT *, count(*) OVER (PARTITION BY step) AS tests, CASE WHEN k >= n * 0.005 THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
  lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(0.005) + (n - j) * ln(0.995)))) END AS p FROM k),
o AS (SELECT *, min(CAST(p <= 0.05 / tests AS INT)) OVER (PARTITION BY lang, rule ORDER BY step) AS ok FROM p),
m AS (SELECT lang, min(cutoff) FILTER (WHERE rule = 'symbol_share') AS c_symbol_share, min(cutoff) FILTER (WHERE rule = 'dup_line_share') AS c_dup_line_share, min(cutoff) FILTER (WHERE rule = 'repeat_share') AS c_repeat_share, min(cutoff) FILTER (WHERE rule = 'word_length') AS c_word_length FROM o WHERE ok = 1 GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(symbol_share > c_symbol_share, false) OR coalesce(dup_line_share > c_dup_line_share, false) OR coalesce(repeat_share > c_repeat_share, false) OR coalesce(word_length > c_word_length, false)) AS kept,
  concat_ws(',', CASE WHEN symbol_share > c_symbol_share THEN 'symbol_share' END, CASE WHEN dup_line_share > c_dup_line_share THEN 'dup_line_share' END, CASE WHEN repeat_share > c_repeat_share THEN 'repeat_share' END, CASE WHEN word_length > c_word_length THEN 'word_length' END) AS failed_rules FROM q LEFT JOIN m USING (lang)""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT page_id, payload_bytes, x, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(x, i, 1))]), '') AS bits FROM s)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * j + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * j + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * j + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * j + 4, 1) AS INT) + CAST(substr(bits, 5 * j + 5, 1) AS INT), 1)), '') AS payload_digest,
 CASE WHEN page_id = max(page_id) OVER (PARTITION BY x) THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> max(page_id) OVER (PARTITION BY x) THEN max(page_id) OVER (PARTITION BY x) END AS refers_to FROM b""",
    "op8_chat": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN t END, '' ORDER BY turn, role, t), '')) AS loss_sha256,
  CAST(3 + sum(17 + length(role) + length(t) + length(role || t) - length(replace(role || t, '\', ''))
    + len(regexp_extract_all(role, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) + len(regexp_extract_all(t, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id""",
    "op11_trie": f"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS t, length(coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, c - c % 100 AS b, {_CRC32.format("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 6 AS h FROM o GROUP BY c),
w AS (SELECT n.c, n.n, n.b, n.h, least(n.h, coalesce(f.n, 0)) AS k FROM n LEFT JOIN n f ON f.c = n.b),
r AS (SELECT w.c, o.p AS d, t, s FROM w JOIN o ON o.c = w.b AND o.p <= w.k UNION ALL SELECT w.c, o.p - w.h + w.k, t, s FROM w JOIN o ON o.c = w.c AND o.p > w.h),
m AS (SELECT c, max(d) AS l FROM (SELECT c, d FROM r UNION ALL SELECT c, 0 FROM n) GROUP BY c),
p AS (SELECT c, d, md5(string_agg(md5(t), '') OVER (PARTITION BY c ORDER BY d)) AS k, s FROM r UNION ALL SELECT c, 0, '', 0 FROM n),
g AS MATERIALIZED (SELECT p.d, p.k, min(p.c) AS conv_id, count(*) AS n_convs, any_value(s) AS s, string_agg(p.c, ',' ORDER BY p.c) FILTER (WHERE l = p.d) AS ends FROM p JOIN m USING (c) GROUP BY p.d, p.k),
e AS (SELECT g.d, g.k, u.k AS up, q.conv_id AS parent FROM g JOIN p u ON u.c = g.conv_id AND u.d = g.d - 1 JOIN g q ON q.d = u.d AND q.k = u.k),
f AS (SELECT g.*, count(e.k) AS n_children FROM g LEFT JOIN e ON e.d = g.d + 1 AND e.up = g.k GROUP BY ALL),
a AS (SELECT u.d, u.k, sum(CAST(f.n_children = 0 AS BIGINT)) AS n_leaves, sum((f.n_convs - 1) * f.s) AS saved FROM f JOIN p u ON u.c = f.conv_id AND u.d <= f.d GROUP BY u.d, u.k)
SELECT f.conv_id, f.d AS depth, e.parent AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM f JOIN a USING (d, k) LEFT JOIN e USING (d, k)""",
    "op12_centroids": _kmeans_sql(10),
    "op13_media": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT r, doc_id, octet_length(b) AS n_bytes, b || from_hex(repeat('00', CASE WHEN octet_length(b) = 0 THEN 64 ELSE (64 - octet_length(b) % 64) % 64 END)) AS p FROM d),
h AS (SELECT *, octet_length(p) AS n, list_transform(regexp_extract_all(hex(p), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS x FROM p),
m AS (SELECT *, from_hex('52494646' || printf('%02x%02x%02x%02x', (n + 36) % 256, (n + 36) // 256 % 256, (n + 36) // 65536 % 256, (n + 36) // 16777216) || '57415645666d74201000000001000100401f0000401f00000100080064617461'
  || printf('%02x%02x%02x%02x', n % 256, n // 256 % 256, n // 65536 % 256, n // 16777216)) || p AS w FROM h)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(p) AS payload_sha256, {_CRC32.format("x[n - 63 : n]")} AS tail_crc32, octet_length(w) AS media_bytes, sha256(w) AS media_sha256,
 array_to_string(list_transform(range(16), lambda i: printf('%02x', CAST(list_sum(x[i * n // 16 + 1 : (i + 1) * n // 16]) // (n // 16) AS BIGINT))), '') AS feature FROM m""",
}
