"""Listing rows, album surfaces, audio evidence and free dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import text

# What navigation rows say.
CONTROLS = (
    "صفحه اصلی", "جستجوی عمیق", "خرید اشتراک", "کیفیت معمولی", "کیفیت عالی", "آهنگهای مشابه", "آهنگ های مشابه", "متن آهنگ", "لینک اشتراک",
    "دانلود همه", "فالو کردن", "آنفالو", "ترتیب", "پیشنهاد", "دمو", "تبلیغ", "بیشتر", "بازگشت", "بعدی", "قبلی", "صفحه بعد", "صفحه قبل", "ادامه",
    "آهنگ در لیست نیست", "آهنگ مورد نظر در لیست نیست", "در لیست نیست",
)
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")


def is_control(row: Column) -> Column:
    """Whether a listing row is navigation: it begins with what a navigation row says."""
    bare = text.clean(F.regexp_replace(row, r"^[^\p{L}\p{N}]+", ""))
    return F.exists(F.array(*map(F.lit, CONTROLS)), lambda w: F.startswith(bare, w))


def track_row(row: Column, fallback_artist: Column | None = None) -> Column:
    """struct(artist, title, inferred, popularity_text, popularity) of ``Artist, Title x 1.6M`` and its kin; null for other rows."""
    original = text.clean(row)
    bare = F.regexp_replace(original, r"^#?\s*[۰-۹٠-٩0-9]+\s+[🎵🎶🎧]\s*", "")
    bare = text.clean(F.regexp_replace(bare, r"^[^\p{L}\p{N}]+", ""))
    bare = text.clean(F.regexp_replace(bare, r"\s+x\s+(?:<\s*)?\d+(?:\.\d+)?\s*[kKmMgG]?(?:\s*[.…]+)?\s*$", ""))
    comma, dash = r"^([^,]+),(.+)$", r"^(.+?)\s+[–—-]\s+(.+)$"
    side = lambda i: text.clean(F.when(bare.rlike(comma), F.regexp_extract(bare, comma, i)).when(bare.rlike(dash), F.regexp_extract(bare, dash, i)))
    known = (side(1) != "") & (side(2) != "")
    fallback = fallback_artist if fallback_artist is not None else F.lit(None).cast("string")
    inferred = ~F.coalesce(known, F.lit(False))
    made = F.struct(
        F.when(inferred, fallback).otherwise(side(1)).alias("artist"), F.when(inferred, bare).otherwise(side(2)).alias("title"), inferred.alias("inferred"),
        text.popularity_text(row).alias("popularity_text"), text.popularity(row).alias("popularity"),
    )
    other = (original == "") | is_control(original) | original.rlike("^[🗣🎤🎙💿📀]")
    return F.when(~other & (~inferred | (fallback.isNotNull() & (bare != ""))), made)


def album_row(row: Column, declared: Column) -> Column:
    """struct(title, track_count) of an album row; a count in brackets counts only under a disc or a declared listing."""
    clean = text.clean(text.fold_digits(row))
    disc = clean.rlike("^[💿📀]")
    bare = text.clean(F.regexp_replace(clean, r"^[^\p{L}\p{N}]+", ""))
    counted = r"^(.+?)\s*\((\d+)\)$"
    is_counted = bare.rlike(counted) & (disc | declared)
    title = F.when(is_counted, F.regexp_extract(bare, counted, 1)).when(disc, bare)
    return F.when(title.isNotNull() & (title != ""), F.struct(title.alias("title"), F.when(is_counted, F.regexp_extract(bare, counted, 2).try_cast("int")).alias("track_count")))


def album_listings(rows: DataFrame, listing: str, header: str, row: str) -> DataFrame:
    """Per listing: declared count (from brackets in the header), albums found, complete, confirmed empty."""
    count = F.regexp_extract(text.fold_digits(F.col(header)), r"\((\d+)\)", 1).try_cast("int")
    g = rows.withColumn("_declared", count).withColumn("_album", album_row(F.col(row), F.col("_declared").isNotNull()))
    g = g.groupBy(listing).agg(F.max("_declared").alias("declared"), F.count("_album").alias("albums"))
    return g.select(listing, "declared", "albums", F.coalesce(F.col("declared") == F.col("albums"), F.lit(False)).alias("complete"), F.coalesce(F.col("declared") == 0, F.lit(False)).alias("confirmed_empty"))


def is_audio(content: Column) -> Column:
    """Whether bytes begin like ID3, MPEG or ADTS, Ogg, FLAC, ADIF, WAVE or an ISO media file."""
    head = F.hex(F.substring(content, 1, 32))
    at = lambda a, n: F.substring(head, 2 * a + 1, 2 * n)
    frame = (at(0, 1) == "FF") & (at(1, 1) >= "E0")
    named = at(0, 3) == "494433"
    four = at(0, 4).isin("4F676753", "664C6143", "41444946")
    wave = (at(0, 4) == "52494646") & (at(8, 4) == "57415645")
    box = F.exists(F.sequence(F.lit(4), F.lit(16)), lambda i: F.substr(head, 2 * i + 1, F.lit(8)) == "66747970")
    return (F.length(content) >= 2) & (frame | named | four | wave | box)


def verify_audio(artist: Column, title: Column, seconds: Column, has_file: Column, got_artist: Column, got_title: Column, got_seconds: Column) -> Column:
    """struct(ok, reason, delta, title_ok, artist_ok); null evidence is unknown, not a contradiction."""
    blank = lambda x: F.nullif(text.clean(x), F.lit(""))
    delta = F.abs(F.nullif(seconds, F.lit(0)) - F.nullif(got_seconds, F.lit(0)))
    title_ok = F.when(blank(got_title).isNotNull(), text.titles_compatible(title, got_title))
    artist_ok = F.when(blank(got_artist).isNotNull(), text.credits_compatible(artist, got_artist) | text.cross_script_same(artist, got_artist))
    is_false = lambda x: F.coalesce(~x, F.lit(False))
    evidence = F.coalesce(title_ok, F.lit(False)) | F.coalesce(artist_ok, F.lit(False)) | F.coalesce(delta <= 3, F.lit(False))
    reason = (
        F.when(~has_file, "no file")
        .when(delta > 12, "duration mismatch")
        .when(is_false(title_ok) & is_false(artist_ok), "title and performer contradict")
        .when(is_false(title_ok), "title contradicts")
        .when(is_false(artist_ok), "performer contradicts")
        .when(~evidence, "insufficient evidence")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), delta.alias("delta"), title_ok.alias("title_ok"), artist_ok.alias("artist_ok"))


def release_date(value: Column) -> Column:
    """The first line that has a year of 19xx or 20xx and one of the known date formats."""
    lines = F.transform(F.split(value, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[^\p{L}\p{N}]+", "")))
    dated = F.filter(lines, lambda x: x.rlike("(?:19|20)[0-9]{2}"))
    days = F.transform(dated, lambda x: F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in DATE_FORMATS)).cast("date"))
    return F.get(F.filter(days, lambda x: x.isNotNull()), F.lit(0))
