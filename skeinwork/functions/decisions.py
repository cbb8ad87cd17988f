"""Decisions of catalog resolution as Column expressions: identity in context, transfers, recovery, search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions import text

# Bytes of a file at most, seconds a transfer may be off, share of missing rows that makes a bulk.
LARGEST, NEAR_SECONDS, BULK_SHARE, FEW = 49 * 1024 * 1024, 12, 0.35, 2


def _all_in(wanted: Column, found: Column) -> Column:
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, found)) == 0)


def credit_in_context(credit: Column, artist: Column) -> Column:
    """Whether a page of ``artist`` may hold a row credited to ``credit``: equal, or every wanted name is among the credited ones."""
    parts = lambda c: text.credit_parts(text.without_marks(c))
    wanted, actual = text.identity_norm(artist), text.identity_norm(credit)
    known = (F.coalesce(wanted, F.lit("")) != "") & (F.coalesce(actual, F.lit("")) != "")
    return known & ((wanted == actual) | _all_in(parts(artist), parts(credit)))


def title_credits(title: Column, artist: Column) -> Column:
    """Whether a featuring clause of ``title`` names ``artist``."""
    return F.coalesce(F.exists(text.featured_credits(title), lambda c: text.credits_compatible(artist, c)), F.lit(False))


def belongs_to(artist: Column, title: Column, context: Column) -> Column:
    """Whether a track belongs to the artist ``context``: by its own credit or by a featuring clause; blanks never do."""
    filled = lambda c: F.coalesce(text.clean(c), F.lit("")) != ""
    named = F.coalesce(text.credits_compatible(context, artist), F.lit(False)) | title_credits(title, context)
    return filled(artist) & filled(title) & filled(context) & named


def artist_was_inferred(artist: Column, title: Column) -> Column:
    """Whether an artist was taken from a featuring clause of the title."""
    who, what = text.norm(artist), text.norm(title)
    clause = lambda word: F.contains(what, F.concat(F.lit(f"{word} "), who))
    return (who != "") & (clause("feat") | clause("ft") | clause("featuring"))


def http_meta(status: Column, content_type: Column, size: Column, largest: int = LARGEST) -> Column:
    """struct(ok, reason, content_type, suspicious) of a response's head; a missing size passes."""
    kind = F.lower(F.split_part(F.trim(F.coalesce(content_type, F.lit(""))), F.lit(";"), F.lit(1)))
    reason = F.when(F.coalesce(status, F.lit(0)) == 0, "HTTP unknown").when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string"))).when(
        size > largest, F.concat(F.lit("file too large: "), size.cast("string"))
    )
    odd = F.startswith(kind, F.lit("text/")) | F.contains(kind, F.lit("json")) | F.contains(kind, F.lit("html")) | F.startswith(kind, F.lit("image/"))
    ok = reason.isNull()
    return F.struct(ok.alias("ok"), reason.alias("reason"), F.when(ok & (kind != ""), kind).alias("content_type"), F.when(ok, odd).alias("suspicious"))


def transfer(expected: Column, actual: Column, kind: Column, file_id: Column, known_id: Column, title_ok: Column, artist_ok: Column) -> Column:
    """struct(ok, same_file, off) of a returned file; unknown lengths and unknown identities do not contradict."""
    length = lambda c: F.nullif(c, F.lit(0))
    off = F.abs(length(expected) - length(actual))
    named = F.coalesce(file_id, F.lit("")) != ""
    agrees = F.coalesce(off <= NEAR_SECONDS, F.lit(True)) & F.coalesce(title_ok, F.lit(True)) & F.coalesce(artist_ok, F.lit(True))
    return F.struct((F.coalesce(kind == "audio", F.lit(False)) & named & agrees).alias("ok"), (named & F.coalesce(file_id == known_id, F.lit(False))).alias("same_file"), off.alias("off"))


def uses_bulk(total: Column, missing: Column) -> Column:
    """Whether so many of a list are missing that all are asked for at once."""
    return (total > 0) & (missing > FEW) & (missing / F.greatest(total, F.lit(1)) >= BULK_SHARE)


def bounded(items: Column, most: int) -> Column:
    """struct(attempt, skipped): the first ``most`` items, and how many are left."""
    return F.struct(F.slice(items, 1, most).alias("attempt"), F.greatest(F.size(items) - most, F.lit(0)).alias("skipped"))


def ordered_union(*lists: Column) -> Column:
    """The lists one after the other, each value once, where it comes first; null values go."""
    return F.array_distinct(F.array_compact(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))))


def message_fingerprint(number: Column, body: Column, buttons: Column, media: Column, edited: Column) -> Column:
    """A message's revision: its fields between record separators, its buttons between unit separators."""
    fields = (F.coalesce(number, F.lit(0)).cast("string"), F.coalesce(body, F.lit("")), F.array_join(F.transform(buttons, lambda x: F.coalesce(x, F.lit(""))), "\x1f"), F.coalesce(media, F.lit("none")), F.coalesce(edited, F.lit("")))
    return F.concat_ws("\x1e", *fields)


def accepts_shortened(same_query: Column, n_meaningful: Column, best_coverage: Column) -> Column:
    """Whether rows found by a shortened query may stand for those of the whole one."""
    return same_query | (n_meaningful == 0) | (F.coalesce(best_coverage, F.lit(0)) >= n_meaningful)


def needs_fallback(n_meaningful: Column, best_coverage: Column, consensus: Column, unrequested: Column) -> Column:
    """Whether found rows are too far from the query: not all words covered, or a variant nobody asked for."""
    covered = F.coalesce(best_coverage, F.lit(0))
    return F.when(n_meaningful == 0, False).when(n_meaningful == 1, (covered < 1) & ~consensus).otherwise((covered < n_meaningful) | (unrequested > 0))
