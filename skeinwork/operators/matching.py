"""Picking, sampling and matching rows: deterministic, by explicit orders only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.runtime import materialize


def top(rows: DataFrame, keys: list[str], n: int, *order: Column, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; ``rank`` names a column for the place."""
    name = rank or "_rank"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First-occurrence dedup."""
    return top(rows, keys, 1, *order)


def once(rows: DataFrame, keys: list[str], made: dict[str, Column]) -> DataFrame:
    """``rows`` with dear columns of ``keys``, worked out once for each distinct combination of them; keys may be null."""
    distinct = rows.select(*keys).distinct().withColumns(made).select(*(F.col(k).alias(f"{k}__") for k in keys), *made)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return rows.join(distinct, same).drop(*(f"{k}__" for k in keys))


def union_capped(groups: list[DataFrame], key: str, order: str, most: int) -> DataFrame:
    """Ordered union of candidate lists: earlier lists win a key, ``most`` rows in all."""
    tagged = None
    for i, g in enumerate(groups):
        part = g.withColumn("_group", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    once = first_of(tagged, [key], F.col("_group"), F.col(order))
    return once.orderBy("_group", order, key).limit(most)


def sample(rows: DataFrame, key: Column, salt: str, n: int) -> DataFrame:
    """``n`` rows in the pseudo-random order of md5(key|salt)."""
    return rows.withColumn("_h", F.md5(F.concat(key, F.lit(salt)))).orderBy("_h", key).limit(n).drop("_h")


def quota_sample(rows: DataFrame, stratum: str, key: Column, quotas: dict[str, int], total: int) -> DataFrame:
    """Each stratum's quota in md5 order, then the rest by the same order up to ``total``."""
    hashed = rows.withColumn("_h", F.md5(key))
    places = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key)))
    quota = F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))
    marked = places.withColumn("in_quota", F.col("_rank") <= F.coalesce(F.try_element_at(quota, F.col(stratum)), F.lit(0)))
    return marked.orderBy(F.desc("in_quota"), "_h", key).limit(total).drop("_h", "_rank")


def match_greedily(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """One-to-one pairs within each group of bounded size.

    ``left``: group, l_ord, l_key; ``right``: group, r_ord, r_key.  Left rows in order take the first free right row
    of an equal key; if both sides are equally long, those without one take the right row of their
    place while it is free.
    """

    kind = dict(left.dtypes)[group]
    one = left.select(F.col(group).alias("g"), F.lit(0).alias("side"), F.col("l_ord").cast("long").alias("ord"), F.col("l_key").alias("key"))
    two = right.select(F.col(group).alias("g"), F.lit(1).alias("side"), F.col("r_ord").cast("long").alias("ord"), F.col("r_key").alias("key"))
    dealt = one.unionByName(two).repartition("g").sortWithinPartitions("g", "side", "ord", "key")

    def pair(lefts: list[tuple], rights: list[tuple]) -> list[tuple]:
        free: dict = {}
        for i, (_, k) in enumerate(rights):
            free.setdefault(k, []).append(i)
        taken = {}
        for i, (_, k) in enumerate(lefts):
            if free.get(k):
                taken[i] = free[k].pop(0)
        if len(lefts) == len(rights):
            used = set(taken.values())
            taken |= {i: i for i in range(len(lefts)) if i not in taken and i not in used}
        return [(lefts[i][0], rights[j][0]) for i, j in sorted(taken.items())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sides = None, ([], [])
        for rows in batches:
            out = []
            for g, side, o, k in zip(*(rows[c].tolist() for c in ("g", "side", "ord", "key"))):
                if g != at:
                    out += [(at, *x) for x in pair(*sides)]
                    at, sides = g, ([], [])
                sides[side].append((o, k))
            yield pd.DataFrame(out, columns=[group, "l_ord", "r_ord"])
        yield pd.DataFrame([(at, *x) for x in pair(*sides)], columns=[group, "l_ord", "r_ord"])

    return dealt.mapInPandas(run, f"{group} {kind}, l_ord long, r_ord long")


def match_by_score(left: DataFrame, right: DataFrame, group: str, levels: list[tuple[int, Column, Column]]) -> DataFrame:
    """One-to-one pairs (group, l_ord, r_ord, score) within each group, greedily by score, then by the ordinals of both sides.

    ``left`` has group, l_ord and columns of its own, ``right`` group, r_ord and others; ordinals are unique in a group.  A level (score,
    key of a left row, key of a right row) pairs rows of equal keys; null keys take no part.  Within a level the k-th
    free left row of a key takes the k-th free right one, which is what going through all pairs in order
    would do; so a level is two windows and a join by group and key, and no group sits in one task.
    """
    levels, found = sorted(levels, key=lambda x: -x[0]), None
    # keys are worked out once; a level reads its own column
    keyed = [(materialize(rows.select(group, ordinal, *(x[at].alias(f"_k{k}") for k, x in enumerate(levels))), "keys"), ordinal) for rows, ordinal, at in ((left, "l_ord", 1), (right, "r_ord", 2))]
    for k, (score, _, _) in enumerate(levels):
        sides = []
        for rows, ordinal in keyed:
            free = rows.select(group, ordinal, F.col(f"_k{k}").alias("_key")).filter("_key is not null")
            if found is not None:
                free = free.join(found.select(group, ordinal), [group, ordinal], "left_anti")
            sides.append(free.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_key").orderBy(ordinal))))
        pairs = sides[0].join(sides[1], [group, "_key", "_place"]).select(group, "l_ord", "r_ord", F.lit(score).alias("score"))
        pairs = materialize(pairs, f"level-{k}")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def with_track_keys(rows: DataFrame, artist: str, title: str) -> DataFrame:
    """``rows`` with what ``track_levels`` compares: artist, members of the credit, title, and title but for its writing; blanks are null."""
    names = F.when(text.norm(F.col(artist)) != "", text.norm(F.col(artist)))
    made = rows.withColumn("_artist", names).withColumn("_title", F.when(text.norm(F.col(title)) != "", text.norm(F.col(title))))
    parts = F.array_sort(F.array_distinct(F.transform(text.credit_parts(F.col(artist)), text.compact)))
    made = made.withColumn("_members", F.when(F.col("_artist").isNotNull(), F.array_join(parts, "|"))).withColumn("_core", F.nullif(text.title_core(F.col(title)), F.lit("")))
    return made.withColumn("_same", F.when(F.col("_core").isNotNull(), F.concat_ws("|", "_core", F.array_join(text.variant_kinds(F.col(title)), " "))))


def track_spellings(rows: DataFrame) -> DataFrame:
    """What ``with_track_keys`` makes of each distinct artist and title of ``rows``, worked out once and written, with ``_blocks``.

    Rows that a level of ``track_levels`` pairs have a block in common: a hash of the title, or of its core.
    """
    made = with_track_keys(rows.select("artist", "title").distinct(), "artist", "title")
    hashed = [F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in ("_title", "_core")]
    return materialize(made.withColumn("_blocks", F.array_distinct(F.array_compact(F.array(*hashed)))), "spellings")


def spelled(rows: DataFrame, spellings: DataFrame) -> DataFrame:
    """``rows`` with what ``track_spellings`` has for their artist and title, which may be null."""
    made = spellings.withColumnsRenamed({"artist": "_by", "title": "_of"})
    return rows.join(made, F.col("artist").eqNullSafe(F.col("_by")) & F.col("title").eqNullSafe(F.col("_of"))).drop("_by", "_of")


def with_partners(rows: DataFrame, group: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Left and right rows that share a group and a block with a row of the other side: group, l_ord or r_ord, item; each once.

    ``rows``: group, side (0 left, 1 right), ord, item, block, a row for each block.  One pass over narrow rows, after which ``match_by_score``
    needs the keys of these rows only.  Hashes may collide: a row too many has no partner in any level.
    """
    met = rows.filter(F.col(group).isNotNull()).select(group, "side", "ord", item, F.xxhash64(group, "block").alias("_meet"))
    both = Window.partitionBy("_meet")  # one number to sort by
    met = met.withColumns({"_least": F.min("side").over(both), "_most": F.max("side").over(both)}).filter("_least < _most")
    met = materialize(met.select(group, "side", "ord", item).distinct(), "partners")
    return tuple(met.filter(F.col("side") == side).select(group, F.col("ord").alias(name), item) for side, name in enumerate(("l_ord", "r_ord")))


def track_levels() -> list[tuple[int, Column, Column]]:
    """Levels for rows of ``with_track_keys``: 8 points for a title, 5 for one that is the same but for its writing; 4 for an artist, 2
    for the same members, none where one side names no artist; other artists contradict."""
    both = lambda *c: F.when(F.col(c[0]).isNotNull() & F.col(c[1]).isNotNull(), F.concat_ws("\x1f", *c))
    out = []
    for points, title in ((8, "_title"), (5, "_same")):
        for more, artist in ((4, "_artist"), (2, "_members")):
            out.append((points + more, both(title, artist), both(title, artist)))
        without = F.when(F.col("_artist").isNull(), F.col(title))
        out += [(points, without, F.col(title)), (points, F.col(title), without)]
    return out


def cooldown(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Events accepted when at least ``seconds`` after the key's last accepted one (a sequential fold).

    Events are streamed in order, so a key of any size needs no more memory than a batch.
    """
    dealt = events.repartition(key).sortWithinPartitions(key, ts)
    names = dealt.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = object(), None
        for rows in batches:
            keep = []
            for k, t in zip(rows[key], rows[ts]):
                if k != at:
                    at, last = k, None
                ok = last is None or (t - last).total_seconds() >= seconds
                last = t if ok else last
                keep.append(ok)
            yield rows.assign(accepted=keep)

    return dealt.mapInPandas(fold, f"{', '.join(f'`{n}` {t}' for n, t in dealt.dtypes)}, accepted boolean").select(*names, "accepted")
