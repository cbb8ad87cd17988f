"""Evidence on whether a found file or a provider's answer is the asked track, as Column expressions.

Each check is true, false, or null where a side says nothing; verdicts state how they read the nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions import text

# Seconds that lengths may differ; points of a provider's candidate, and what a second of difference costs.
NEAR_SECONDS, MATCH, CLOSE, A_SECOND = 12, 100, 30, 3
#: The version of a retry from which on it is not made again, and the failure that is.
RETRIED, RETRYABLE = 2, "unexpected content-type text/plain"


def _said(x: Column) -> Column:
    return F.nullif(text.clean(x), F.lit(""))


def _sure(x: Column, otherwise: bool = False) -> Column:
    return F.coalesce(x, F.lit(otherwise))


def same_artist(expected: Column, actual: Column) -> Column:
    """Equal credits, or the same name in the other script; blanks are nobody."""
    return _sure(text.credits_compatible(expected, actual)) | _sure(text.cross_script_same(expected, actual))


def seconds_apart(expected: Column, actual: Column) -> Column:
    """Difference of two lengths; null if either is null or zero."""
    return F.abs(F.nullif(expected, F.lit(0)) - F.nullif(actual, F.lit(0)))


def file_matches(artist: Column, title: Column, inferred: Column, performer: Column, named: Column) -> Column:
    """Whether a file's tags (``performer``, ``named``) leave it possible that it is the track; an inferred artist needs a performer (R-07)."""
    title_off = F.when(_said(title).isNotNull() & _said(named).isNotNull(), ~_sure(text.titles_compatible(title, named)))
    guest = F.exists(text.featured_credits(F.coalesce(_said(named), _said(title))), lambda c: text.credits_compatible(artist, c))
    unknown = _said(artist).isNull() | _said(performer).isNull()
    return ~(_sure(inferred) & _said(performer).isNull()) & ~_sure(title_off) & (unknown | same_artist(artist, performer) | _sure(guest))


def checks(artist: Column, title: Column, seconds: Column, performer: Column, named: Column, got_seconds: Column) -> Column:
    """struct(title, artist, duration) of a file's tags against a track, the credits being equal (R-11)."""
    return F.struct(
        F.when(_said(named).isNotNull(), _sure(text.titles_compatible(title, named))).alias("title"),
        F.when(_said(performer).isNotNull(), _sure(text.credits_compatible(artist, performer))).alias("artist"),
        (seconds_apart(seconds, got_seconds) <= NEAR_SECONDS).alias("duration"),
    )


def _one_of(found: list[tuple[Column, Column]]) -> Column:
    """Whether any of the stated (said, agrees) agrees; null if none is stated."""
    stated, agrees = found[0][0].isNotNull(), _sure(found[0][0].isNotNull() & found[0][1])
    for said, yes in found[1:]:
        stated, agrees = stated | said.isNotNull(), agrees | _sure(said.isNotNull() & yes)
    return F.when(stated, agrees)


def loose_checks(artist: Column, title: Column, seconds: Column, performer: Column, named: Column, got_seconds: Column) -> Column:
    """The same, where a tag may hold "Artist – Title" and one shared member is enough; of one asked artist, that one (R-11)."""
    before, after = text.artist_and_title(named)
    same_title = lambda x: text.title_identity(x) == text.title_identity(title)
    wanted = text.credit_parts(artist)
    named_in = lambda x: (F.size(wanted) > 0) & F.arrays_overlap(text.credit_parts(x), wanted)
    return F.struct(
        _one_of([(_said(named), same_title(named)), (_said(after), same_title(after))]).alias("title"),
        _one_of([(_said(performer), named_in(performer)), (_said(before), named_in(before))]).alias("artist"),
        (seconds_apart(seconds, got_seconds) <= NEAR_SECONDS).alias("duration"),
    )


def contradictions(made: Column) -> Column:
    """The names of the checks that are false."""
    return F.array_compact(F.array(*(F.when(~made[x], F.lit(x)) for x in ("title", "artist", "duration"))))


def confirmed(made: Column) -> Column:
    """Nothing contradicts, and the title or the artist agrees."""
    return (F.size(contradictions(made)) == 0) & (_sure(made["title"]) | _sure(made["artist"]))


def plausible(made: Column) -> Column:
    """The length does not contradict, and the title and the artist do not both."""
    return _sure(made["duration"], True) & (_sure(made["title"], True) | _sure(made["artist"], True))


def same_title(expected: Column, actual: Column) -> Column:
    """Compatible titles; a blank one is no title."""
    return _said(actual).isNotNull() & _sure(text.titles_compatible(expected, actual))


def any_artist(artist: Column, artists: Column) -> Column:
    """Whether one of ``artists`` is the asked one; null is nobody."""
    return _sure(F.exists(artists, lambda x: same_artist(artist, x)))


def candidate_score(title_ok: Column, artist_ok: Column, seconds: Column, got_seconds: Column) -> Column:
    """struct(exact, score, title_ok, artist_ok, duration_ok, delta) of a provider's candidate (R-10).

    Put ``same_title`` and ``any_artist`` into columns of their own first, as they are read more than once.
    """
    delta = seconds_apart(seconds.cast("double"), got_seconds.cast("double"))
    near = _sure(delta <= NEAR_SECONDS, True)
    points = F.when(title_ok, MATCH).otherwise(0) + F.when(artist_ok, MATCH).otherwise(0) + F.coalesce(F.greatest(F.lit(0.0), CLOSE - delta * A_SECOND), F.lit(0.0))
    return F.struct((title_ok & artist_ok & near).alias("exact"), points.alias("score"), title_ok.alias("title_ok"), artist_ok.alias("artist_ok"), near.alias("duration_ok"), delta.alias("delta"))


def links(*urls: tuple[Column, int | None, str]) -> Column:
    """array(struct(url, host, quality, source)) of (url, quality, source): https only, each address once, the address's own bitrate first."""
    made = [
        F.when(
            _sure(F.lower(F.try_parse_url(F.trim(url), F.lit("PROTOCOL"))) == "https") & F.try_parse_url(F.trim(url), F.lit("HOST")).isNotNull(),
            F.struct(
                F.trim(url).alias("url"), F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))).alias("host"),
                F.coalesce(text.url_bitrate(F.lower(F.try_parse_url(F.trim(url), F.lit("PATH")))), F.lit(quality).cast("int")).alias("quality"), F.lit(source).alias("source"),
            ),
        )
        for url, quality, source in urls
    ]
    kept = F.array_compact(F.array(*made))
    return F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda y: y["url"] == x["url"]))


def says_nothing(found: Column, *fields: Column) -> Column:
    """Whether an answer has no link and blank fields only."""
    blank = F.size(found) == 0
    for x in fields:
        blank = blank & _said(x).isNull()
    return blank


def recovered(track_id: Column, got_id: Column, artist_ok: Column, title_ok: Column, nothing: Column, got_seconds: Column, found: Column) -> Column:
    """struct(ok, reason, id, seconds, candidates) of a catalogue's fresh answer; an id, artist or title that differs fails it (R-09).

    Put ``same_artist``, ``same_title``, ``says_nothing`` and ``links`` into columns of their own first, as they are read more than once.
    """
    theirs, ours = _said(got_id), _said(track_id)
    reason = (
        F.when(nothing, "empty")
        .when(theirs != ours, F.concat(F.lit("id "), theirs, F.lit(" instead of "), ours))
        .when(~artist_ok & ~title_ok, "artist and title differ")
        .when(~artist_ok, "artist differs")
        .when(~title_ok, "title differs")
        .when(F.size(found) == 0, "no link")
    )
    ok = reason.isNull()
    only = lambda x: F.when(ok, x)
    return F.struct(ok.alias("ok"), reason.alias("reason"), only(F.coalesce(theirs, ours)).alias("id"), only(F.nullif(got_seconds, F.lit(0))).alias("seconds"), only(found).alias("candidates"))


def retryable(attempt: Column) -> Column:
    """Whether an upload may be tried again: never tried, or failed by an earlier version for the one reason that passes (P-25).

    ``attempt``: null or struct(version, ok, reason).
    """
    failed = _sure(attempt["version"] < RETRIED, True) & _sure(attempt["ok"] == F.lit(False)) & _sure(F.contains(text.clean(attempt["reason"]), F.lit(RETRYABLE)))
    return attempt.isNull() | failed


def caption(prefix: str, slot: Column, track_id: Column, quality: Column, host: Column) -> Column:
    """What a sent file says of itself: ``prefix:slot:id:quality:host`` (F-25)."""
    part = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.concat_ws(":", F.lit(prefix), part(slot), part(track_id), part(quality), part(host))


def read_caption(prefix: str, said: Column) -> Column:
    """struct(slot, id, quality, host) of a caption, also of one without a slot, which is of slot 1; null for others (F-25)."""
    bare = text.clean(said)
    parts = F.split(F.substr(bare, F.lit(len(prefix) + 2)), ":")
    at = lambda i: F.get(parts, F.lit(i))
    number = lambda x: F.nullif(x.try_cast("int"), F.lit(0))
    slotted = (F.size(parts) >= 4) & at(0).rlike("^[0-9]+$")
    shift = lambda i: F.when(slotted, at(i + 1)).otherwise(at(i))
    slot = F.when(slotted, at(0).try_cast("int")).otherwise(1)
    made = F.struct(slot.alias("slot"), shift(0).alias("id"), number(shift(1)).alias("quality"), F.coalesce(text.clean(shift(2)), F.lit("")).alias("host"))
    return F.when(F.startswith(bare, F.lit(f"{prefix}:")) & (shift(0) != "") & (slot >= 1), made)
