"""The trie of conversations by their initial turns, by prefix doubling.

A turn is known by the SHA-256 digest of its role and text, so texts are shuffled once, to be
numbered, and never again.  Digests get dense names.  In a logarithmic number of rounds two blocks of
2^k turns that lie side by side, the first at a multiple of 2^(k+1), make one of 2^(k+1) turns, named
by the pair of their names.  The first d turns are then the blocks of d's binary digits, largest
first; the names of these blocks are the prefix's own name, and rows of equal depth and name are one
node.  A node is known by its depth and its smallest member.

What is asked of whole subtrees is summed over members instead, so no round per depth is needed.  The
nodes of which a conversation is the smallest member are those of its prefixes from some depth,
``first``, to its end.  Hence a node at depth d has one child for each member with first <= d + 1 <=
length, one leaf for each member that is the smallest of a childless node, and in its subtree each
member's text from turn d on is counted once, less what follows turn ``first`` of the member.

Skew: a conversation of any length is dealt by its turns; a node of any number of members is
aggregated before it is shuffled; frequent turns and parents are looked up by broadcast
(``spread.look_up``).  A node's ids are joined in parts of ``PART`` and only these parts meet for its
digest, which is sequential by definition.

Edge cases: a null role or text is an empty one; null turn numbers come first, turns of equal number
follow by role, then text; rows without conv_id belong to no conversation and are passed over;
repeated rows are turns of their own; extra columns are ignored; no conversations give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.spread import dense_names, look_up
from skeinwork.runtime import materialize

#: Ids joined into one string at a time; turns that share a row of their conversation in a join.
PART, STRETCH = 4096, 10


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, at, digest, chars) in order and groups (conv_id, part, first, before, length).

    ``part`` and ``at`` place a turn in the table sorted over all partitions; its position in the
    conversation, from 1, is ``before + at - first + 1`` of its group; ``length``: all its turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order)
    said = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = dealt.select("conv_id", F.unhex(F.sha2(said, 256)).alias("digest"), F.char_length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("at"))
    turns = materialize(turns.withColumn("part", F.shiftright("at", 33)), "turns")
    groups = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # at most one a conversation and partition
    own = Window.partitionBy("conv_id")
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return turns, groups.select("conv_id", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(own).alias("length"))


def rebuilt(rows: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, length, depth, digest, chars): turns of conversations that begin like the first of their block.

    Of conversation c the first h turns, h = crc32(c) mod ``heads``, give way to the first h of c - c mod
    ``block``, fewer if it has fewer, none if it is not there.  One without turns left has a row of depth 0.
    """
    turns, groups = numbered(rows)
    base, head = (F.col("conv_id") - F.col("conv_id") % block).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("head")
    convs = groups.select("conv_id", "length", base, head).distinct()
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    taken = F.least("head", F.coalesce("base_length", F.lit(0)))  # a block is bounded, so is the join
    convs = convs.join(lengths, "base", "left").withColumn("taken", taken).withColumn("whole", taken + F.greatest(F.col("length") - F.col("head"), F.lit(0)))
    placed = groups.join(convs.select("conv_id", "head", "taken", "whole"), "conv_id")
    every = turns.join(placed, ["conv_id", "part"]).withColumn("position", F.col("before") + F.col("at") - F.col("first") + 1)
    own = every.filter("position > head").select("conv_id", F.col("whole").alias("length"), (F.col("position") - F.col("head") + F.col("taken")).alias("depth"), "digest", "chars")
    lent = every.filter((F.col("conv_id") % block == 0) & (F.col("position") < heads)).select(F.col("conv_id").alias("base"), F.col("position").alias("depth"), "digest", "chars")
    borrowed = convs.select("conv_id", "base", F.col("whole").alias("length"), "taken").join(lent, "base").filter("depth <= taken")
    none = convs.filter("whole = 0").select("conv_id", F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("")).alias("digest"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(borrowed.select(*own.columns)).unionByName(none)


def plain(rows: DataFrame) -> DataFrame:
    """The same columns for conversations as they are."""
    turns, groups = numbered(rows)
    return turns.join(groups, ["conv_id", "part"]).select("conv_id", "length", (F.col("before") + F.col("at") - F.col("first") + 1).alias("depth"), "digest", "chars")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, length, depth, key, before, chars) of every prefix but the empty one: ``key`` names it among
    those of its depth, ``before`` is the text before its last turn, ``chars`` that turn's."""
    said = turns.filter("depth > 0")
    blocks = materialize(dense_names(said, ["digest"], "name").select("conv_id", "length", (F.col("depth") - 1).alias("start"), "name", F.col("chars").alias("size")), "blocks-0")
    step, found = 0, []
    longest = said.agg(F.max("length")).first()[0] or 0
    while True:
        # block [start, start + 2^step) is a digit of the depths in which it is followed by less than itself
        reach = F.sequence(F.col("start") + (1 << step), F.least("length", F.col("start") + (2 << step) - 1))
        used = blocks.filter(F.shiftright("start", step) % 2 == 0)
        found.append(used.select("conv_id", "length", F.explode(reach).alias("depth"), F.lit(-step).alias("digit"), "name", "size", F.when(F.lit(step == 0), F.col("size")).alias("chars")))
        if step == 0:
            odd = blocks.filter("start % 2 = 1")
            found.append(odd.select("conv_id", "length", (F.col("start") + 1).alias("depth"), F.lit(None).cast("int").alias("digit"), F.lit(None).cast("long").alias("name"), F.lit(0).cast("long").alias("size"), F.col("size").alias("chars")))
        if 2 << step > longest:
            break
        side = F.shiftright("start", step) % 2
        pairs = blocks.groupBy("conv_id", "length", F.shiftright("start", step + 1).alias("pair")).agg(
            F.max(F.when(side == 0, F.col("name"))).alias("left"), F.max(F.when(side == 1, F.col("name"))).alias("right"), F.sum("size").alias("size")
        )
        pairs = materialize(pairs.filter("left is not null and right is not null"), f"pairs-{step}")
        step += 1
        blocks = dense_names(pairs, ["left", "right"], "name").select("conv_id", "length", F.shiftleft("pair", step).alias("start"), "name", "size")
        blocks = materialize(blocks, f"blocks-{step}")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    names = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("digit", "name"))))  # one a binary digit of the depth
    whole = rows.groupBy("conv_id", "length", "depth").agg(names.alias("names"), F.sum("size").alias("upto"), F.max("chars").alias("chars"))
    return whole.select("conv_id", "length", "depth", F.array_join(F.transform("names", lambda x: x["name"].cast("string")), ".").alias("key"), (F.col("upto") - F.col("chars")).alias("before"), "chars")


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) of rows (depth, key, conv_id): SHA-256 of ids in order, joined by commas."""
    order = ["depth", "key", "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []

        def told() -> list[tuple]:
            return [(*at, ids[0], ",".join(map(str, ids)))] if ids else []

        for batch in batches:
            out = []
            for depth, key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, key) != at or len(ids) == PART:
                    out += told()
                    at, ids = (depth, key), []
                ids.append(conv)
            yield _rows(out, [("depth", pa.int64()), ("key", pa.string()), ("least", pa.int64()), ("ids", pa.string())])
        yield _rows(told(), [("depth", pa.int64()), ("key", pa.string()), ("least", pa.int64()), ("ids", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for depth, key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, key) != at:
                    out += [(*at, state.hexdigest())] if state else []
                    at, state = (depth, key), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _rows(out, [("depth", pa.int64()), ("key", pa.string()), ("ends_sha256", pa.string())])
        yield _rows([(*at, state.hexdigest())] if state else [], [("depth", pa.int64()), ("key", pa.string()), ("ends_sha256", pa.string())])

    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "depth long, key string, least long, ids string")
    return parts.repartition("depth", "key").sortWithinPartitions("depth", "key", "least").mapInArrow(digest, "depth long, key string, ends_sha256 string")


def _rows(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of conversations given as ``rebuilt`` or ``plain`` give them: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialize(turns, "conversations")
    long = lambda c: F.lit(c).cast("long")
    roots = turns.filter((F.col("depth") <= 1)).select("conv_id", "length", long(0).alias("depth"), F.lit("").alias("key"), long(0).alias("before"), long(0).alias("chars"))
    prefixes = materialize(_prefixes(turns).unionByName(roots), "prefixes")
    first = prefixes.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.max("length").alias("deepest"), F.max("before").alias("before"))
    spine = first.groupBy("conv_id").agg(F.min("depth").alias("first"), F.min_by("before", "depth").alias("first_before"), F.max(F.col("deepest") == F.col("depth")).alias("leaf"))
    ends = prefixes.filter("depth = length")
    each = ends.select("conv_id", "length", (F.col("before") + F.col("chars")).alias("total")).join(spine, "conv_id", "left")
    each = each.select("conv_id", "total", "first", "first_before", "leaf", F.explode(F.sequence(long(0), F.shiftright("length", STRETCH))).alias("stretch"))
    known = prefixes.withColumn("stretch", F.shiftright("depth", STRETCH)).join(each, ["conv_id", "stretch"])
    known = materialize(known.select("conv_id", "length", "depth", "key", "before", "total", "first", "first_before", "leaf"), "members")
    after = F.col("total") - F.col("before")  # the text from the node's own turn on
    repeated = F.when(F.col("depth") >= F.col("first"), 0).otherwise(after - F.coalesce(F.col("total") - F.col("first_before"), F.lit(0)))
    child: Column = (F.col("first") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    nodes = known.groupBy("depth", "key").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(child).alias("n_children"), F.count_if("leaf").alias("n_leaves"), F.sum(repeated).alias("saved_tokens")
    )
    nodes = materialize(nodes, "nodes")
    heads = known.filter("first = depth + 1").select(F.col("conv_id").alias("child"), "depth", "key")
    hung = look_up(heads, nodes.select("depth", "key", F.col("conv_id").alias("parent_conv_id")), ["depth", "key"])
    hung = hung.select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("parent_conv_id").alias("hung_from"))
    made = nodes.join(_digests(ends), ["depth", "key"], "left").join(hung, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("hung_from", "conv_id"))
    return made.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
