"""What a query or a row says of albums, tracks and their other spellings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions import text


def _words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda x: x != "")


def _said(x: Column) -> Column:
    return F.coalesce(text.clean(x), F.lit(""))


def _joined(*parts: Column) -> Column:
    """The parts that say something, one blank between."""
    return text.clean(F.concat_ws(" ", *(F.nullif(_said(x), F.lit("")) for x in parts)))


def asks_for_album(query: Column) -> Column:
    return F.coalesce(F.exists(_words(text.norm(query)), lambda x: x.isin(*text.ALBUM_WORDS)), F.lit(False))


def album_words(query: Column) -> Column:
    """Words of a query without those that ask for an album; plural endings go only beside such a word (F-18)."""
    words = F.filter(_words(text.norm(query)), lambda x: ~x.isin(*text.ALBUM_WORDS))
    return F.when(asks_for_album(query), F.filter(words, lambda x: ~x.isin(*text.ALBUM_SUFFIXES))).otherwise(words)


def album_title_words(query: Column, artist: Column) -> Column:
    """Those of them that are not in the artist's name: what the album itself would be called (F-18)."""
    name = F.coalesce(_words(text.norm(artist)), F.array().cast("array<string>"))
    return F.filter(album_words(query), lambda x: ~F.array_contains(name, x))


def names_album(query: Column, artist: Column, titles: Column) -> Column:
    """Whether a query means one album: all words of one of ``titles`` are in it, or it says more than the artist's name (F-18)."""
    words, name = album_words(query), _words(text.norm(artist))
    titled = lambda t: (F.size(_words(text.norm(t))) > 0) & (F.size(F.array_except(_words(text.norm(t)), words)) == 0)
    more = F.arrays_overlap(words, name) & (F.size(F.array_except(words, name)) > 0)
    return F.coalesce(F.exists(titles, titled), F.lit(False)) | F.coalesce(more, F.lit(False))


def album_answers(query: Column, artist: Column, title: Column) -> Column:
    """Whether an album answers a query: its title holds every word left, or none is left and an album is asked for (R-20)."""
    left, whole = album_title_words(query, artist), F.coalesce(text.norm(title), F.lit(""))
    return F.when(F.size(left) == 0, asks_for_album(query)).otherwise(F.coalesce(F.forall(left, lambda x: F.contains(whole, x)), F.lit(False)))


def track_names(artist: Column, title: Column) -> Column:
    """What a query must say to be exactly this track: artist and title in either order (R-21)."""
    both = F.array(text.norm(_joined(artist, title)), text.norm(_joined(title, artist)))
    return F.array_distinct(F.filter(both, lambda x: x != ""))


def lyrics(raw: Column, artist: Column, title: Column, brand: str) -> Column:
    """Lines of a text without the source's brand, the bare artist and title, tags and download rows (F-24)."""
    lines = F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    who, what = F.coalesce(text.norm(artist), F.lit("")), F.coalesce(text.norm(title), F.lit(""))

    def kept(line: Column) -> Column:
        n = text.norm(line)
        branded = line.rlike(rf"(?i)@{brand}\b") | n.rlike(rf"\b{brand}\b")
        return (n != "") & ~branded & (n != who) & (n != what) & ~F.startswith(line, F.lit("#")) & ~line.rlike(r"دانلود\s*آهنگ")

    return F.array_join(F.filter(lines, kept), "\n")


def without_guests(title: Column) -> Column:
    """A title as written, without its featuring clause."""
    bare = F.regexp_replace(_said(title), r"(?i)\s*\((?:feat\.?|ft\.?|featuring)\s+[^)]+\)\s*$", "")
    return text.clean(F.regexp_replace(bare, r"(?i)\s+(?:feat\.?|ft\.?|featuring)\s+.+$", ""))


def spellings(query: Column, artist: Column, title: Column) -> Column:
    """Queries to try for a track, in order, each once: as asked, title with artist, without guests, "vs." as a plain word, the title (F-28)."""
    base, full, who = without_guests(title), _said(title), _said(artist)
    shorter = F.when((base != "") & (base != full), F.array(_joined(artist, base), _joined(base, artist), base)).otherwise(F.array().cast("array<string>"))
    versus = F.when(who.rlike(r"(?i)\bvs\b"), _joined(F.regexp_replace(who, r"(?i)\bvs\b\.?", "vs"), F.when(base != "", base).otherwise(full)))
    tried = F.concat(F.array(_said(query), _joined(title, artist)), shorter, F.array(versus, full))
    return F.array_distinct(F.filter(tried, lambda x: F.coalesce(x != "", F.lit(False))))


def leniently_same_artist(requested: Column, actual: Column) -> Column:
    """Every asked member is a credited one, names of two words or more also within each other; a request of one
    needs just one. Weaker than ``credits_compatible``: for listings, never for identity (R-28)."""
    a, b = F.coalesce(text.norm(requested), F.lit("")), F.coalesce(text.norm(actual), F.lit(""))
    several = lambda x: F.contains(x, F.lit(" "))
    same = lambda x, y: (x == y) | (several(x) & several(y) & (F.contains(x, y) | F.contains(y, x)))
    parts, have = text.credit_parts(requested), text.credit_parts(actual)
    each = (F.size(parts) > 0) & F.forall(parts, lambda x: F.exists(have, lambda y: same(x, y)))
    return (a != "") & (b != "") & ((a == b) | (text.compact(a) == text.compact(b)) | F.coalesce(each, F.lit(False)))


def leniently_same_track(artist: Column, title: Column, got_artist: Column, got_title: Column) -> Column:
    """Equal titles but for guests, and artists that are leniently the same where both are known (R-28)."""
    a, b = text.title_identity(title), text.title_identity(got_title)
    unknown = (_said(artist) == "") | (_said(got_artist) == "")
    return F.coalesce((a != "") & (a == b), F.lit(False)) & (unknown | leniently_same_artist(artist, got_artist))


def repaired(artist: Column, title: Column, inferred: Column, performer: Column, named: Column) -> Column:
    """struct(artist, title, inferred): a row after its file's tags.  The performer stands; an inferred row keeps its title,
    another takes the file's.  Without a performer or any title the row stays (R-25)."""
    own, theirs = F.nullif(_said(title), F.lit("")), F.nullif(_said(named), F.lit(""))
    made = F.when(F.coalesce(inferred, F.lit(False)), F.coalesce(own, theirs)).otherwise(F.coalesce(theirs, own))
    new = (_said(performer) != "") & made.isNotNull()
    return F.struct(F.when(new, _said(performer)).otherwise(artist).alias("artist"), F.when(new, made).otherwise(title).alias("title"), F.when(new, False).otherwise(inferred).alias("inferred"))
