"""Text kernel: normalisation, credits, variants and metrics as Column expressions.

Everything stays in the JVM but ``identity_norm``, whose compatibility decomposition Spark has no
function for.  A null input gives null unless said otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, letters and words of the catalog's domain.
PERSIAN_DIGITS, ARABIC_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"
LETTER_FOLDS = {"ي": "ی", "ى": "ی", "ك": "ک", "ة": "ه"}
VARIANT_KINDS = {
    "remix": "remix", "ریمیکس": "remix", "mix": "mix", "edit": "edit", "version": "version", "ورژن": "version",
    "نسخه": "version", "live": "live", "لایو": "live", "زنده": "live", "acoustic": "acoustic", "unplugged": "acoustic",
    "آکوستیک": "acoustic", "instrumental": "instrumental", "بیکلام": "instrumental", "بی‌کلام": "instrumental",
    "remaster": "remaster", "remastered": "remaster", "rework": "rework", "sped": "sped", "slowed": "slowed",
    "karaoke": "karaoke", "demo": "demo", "radio": "radio", "extended": "extended", "club": "club", "cover": "cover",
    "original": "original", "reverb": "reverb", "reverbed": "reverb", "nightcore": "nightcore", "8d": "8d",
}
CONSONANTS = {
    "ب": "b", "پ": "p", "ت": "t", "ث": "s", "ج": "j", "چ": "ch", "ح": "h", "خ": "kh", "د": "d", "ذ": "z", "ر": "r",
    "ز": "z", "ژ": "zh", "س": "s", "ش": "sh", "ص": "s", "ض": "z", "ط": "t", "ظ": "z", "غ": "gh", "ف": "f", "ق": "gh",
    "ک": "k", "ك": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "ه": "h", "ة": "h", "و": "v", "ی": "y", "ي": "y", "ى": "y",
}
VOWEL_SIGNS = "اآأإعءؤئ"
ALBUM_SUFFIXES = ("ها", "های")
ALBUM_WORDS = ("album", "albums", "آلبوم", "آلبومها", "آلبومهای", "البوم", "البومها", "البومهای")

_SPACE = r"(?U)[\s\x{FEFF}]+"
_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_FEATURED = r"(?:feat\.?|ft\.?|featuring)"


def clean(text: Column) -> Column:
    """Without direction marks, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x{200E}\x{200F}\x{202A}-\x{202E}]", ""), _SPACE, " "))


def fold_digits(text: Column) -> Column:
    """Persian and Arabic digits as ASCII."""
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2)


def norm(text: Column) -> Column:
    """The catalog's comparable form: lower case, folded digits and letters, no marks, words by one blank."""
    folded = F.translate(fold_digits(F.lower(clean(text))), "".join(LETTER_FOLDS), "".join(LETTER_FOLDS.values()))
    unmarked = F.regexp_replace(folded, r"[\x{064B}-\x{065F}\x{0670}]", "")
    return F.trim(F.regexp_replace(unmarked, r"[^\p{L}\p{N}]+", " "))


def search_norm(text: Column) -> Column:
    """``norm`` that also joins words over zero-width joiners."""
    return norm(F.regexp_replace(text, r"[\x{200C}\x{200D}]", ""))


def without_marks(text: Column) -> Column:
    """The text decomposed for compatibility and without any marks (a vectorised UDF)."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c)[0] != "M").strip()

        return values.map(one)

    return plain(text)


def identity_norm(text: Column) -> Column:
    """``norm``, then ``without_marks``."""
    return without_marks(norm(text))


def identity_key(artist: Column, title: Column) -> Column:
    """``norm(artist)|norm(title)``; null unless both have something."""
    a, t = norm(artist), norm(title)
    return F.when((F.length(a) > 0) & (F.length(t) > 0), F.concat_ws("|", a, t))


def track_variant(text: Column) -> Column:
    """``norm`` of a listing row without its number and popularity."""
    digits = rf"[{PERSIAN_DIGITS}{ARABIC_DIGITS}0-9]+"
    bare = F.regexp_replace(clean(text), rf"^#?\s*{digits}\s+[🎵🎶🎧]\s*", "")
    return norm(F.regexp_replace(bare, rf"\s+x\s+(?:<\s*)?{digits}(?:[.,]{digits})?\s*[kKmMgG]?(?:\s*[.…]+)?\s*$", ""))


def is_composite_credit(artist: Column) -> Column:
    return clean(artist).rlike(rf"(?i)\s(?:&|x)\s|,\s*|{_NO_WORD_BEFORE}{_FEATURED}")


def credit_parts(artist: Column) -> Column:
    """Normalised members of a credit; "feat." splits wherever it stands, as keys depend on that."""
    parts = F.split(clean(artist), rf"(?i)\s*(?:&|{_NO_WORD_BEFORE}x{_NO_WORD_AFTER}|,|feat\.?|ft\.?|featuring)\s*")
    return F.filter(F.transform(parts, norm), lambda x: x != "")


def compact(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def credits_compatible(requested: Column, actual: Column) -> Column:
    """Strict credit identity: equal, equal without blanks, or the same number of members, each matched."""
    a, b = norm(requested), norm(actual)
    left, right = F.transform(credit_parts(requested), compact), F.transform(credit_parts(actual), compact)
    same = (F.size(left) > 0) & (F.size(left) == F.size(right)) & F.forall(left, lambda x: F.array_contains(right, x))
    return F.when((a == "") | (b == ""), False).otherwise((a == b) | (compact(a) == compact(b)) | same)


def featured_credits(title: Column) -> Column:
    """What follows each "feat." of a title."""
    found = F.regexp_extract_all(clean(title), F.lit(rf"(?i){_NO_WORD_BEFORE}{_FEATURED}\s+([^()\[\]]+?)(?=\)|\]|$|\s+[–—-]\s+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, clean), lambda x: x != ""))


def title_identity(title: Column) -> Column:
    """``norm`` of a title without its featured artists."""
    bare = F.regexp_replace(clean(title), rf"(?i)\s*\({_FEATURED}\s+[^)]+\)\s*$", "")
    return norm(F.regexp_replace(bare, rf"(?i)\s+{_FEATURED}\s+.+$", ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def variant_kinds(title: Column) -> Column:
    """Sorted kinds of the variant words in a title."""
    kinds = F.create_map(*(F.lit(x) for pair in VARIANT_KINDS.items() for x in pair))
    return F.array_sort(F.array_distinct(F.filter(F.transform(_words(title_identity(title)), lambda x: F.try_element_at(kinds, x)), lambda x: x.isNotNull())))


def title_core(title: Column) -> Column:
    """A title's identity without variant words."""
    return F.array_join(F.filter(_words(title_identity(title)), lambda x: ~x.isin(list(VARIANT_KINDS))), " ")


def script_family(text: Column) -> Column:
    """``persian`` or ``latin`` for letters of one script only, else ``mixed``."""
    persian, latin = clean(text).rlike(r"[\x{0600}-\x{06FF}]"), clean(text).rlike("(?i)[a-z]")
    return F.when(persian & ~latin, "persian").when(latin & ~persian, "latin").otherwise("mixed")


def script(text: Column) -> Column:
    return F.when(text.rlike(r"[\x{0600}-\x{06FF}]"), "arabic").when(text.rlike("(?i)[a-z]"), "latin").otherwise("")


def skeleton(token: Column) -> Column:
    """Consonants of one token, Persian ones as Latin letters."""
    source = F.lower(clean(token))
    bare = F.regexp_replace(F.regexp_replace(source, f"[{VOWEL_SIGNS}]", ""), "[یيى]$", "")
    bare = F.when(F.substr(source, F.lit(1), F.lit(1)) == "و", F.concat(F.lit("و"), F.regexp_replace(F.regexp_replace(bare, "^و", ""), "و", ""))).otherwise(F.regexp_replace(bare, "و", ""))
    for letter, latin in CONSONANTS.items():
        bare = F.replace(bare, F.lit(letter), F.lit(latin))
    arabic = F.regexp_replace(bare, "[^a-z]", "")
    latin = F.regexp_replace(F.regexp_replace(norm(source), "[^a-z0-9]+", ""), "[aeiou]+", "")
    return F.when(script(source) == "arabic", arabic).otherwise(latin)


def bones(value: Column) -> Column:
    """The consonants of each word of a name."""
    return F.transform(_words(clean(value)), skeleton)


def _close(x: Column, y: Column, one: int, two: int) -> Column:
    """Equal, or one edit apart from ``one`` letters on, two from ``two`` on; blanks never are."""
    longest = F.greatest(F.length(x), F.length(y))
    allowed = F.when(longest >= two, 2).when(longest >= one, 1).otherwise(0)
    return (x != "") & (y != "") & ((x == y) | ((allowed > 0) & (F.levenshtein(x, y) <= allowed)))


def same_bones(a: Column, b: Column) -> Column:
    """Whether the words of two names have the same consonants: word by word, or joined if their numbers differ."""
    each = F.forall(F.zip_with(a, b, lambda x, y: _close(x, y, 4, 1 << 30)), lambda x: F.coalesce(x, F.lit(False)))
    joined = _close(F.array_join(a, ""), F.array_join(b, ""), 6, 9)
    return (F.size(a) > 0) & (F.size(b) > 0) & F.when(F.size(a) == F.size(b), each).otherwise(joined)


def near_bones(a: Column, b: Column) -> Column:
    """``same_bones``, or two names of some words each that are as close when joined; for searching only."""
    joined = _close(F.array_join(a, ""), F.array_join(b, ""), 7, 9)
    return same_bones(a, b) | ((F.size(a) >= 2) & (F.size(b) >= 2) & joined)


def cross_script_same(left: Column, right: Column) -> Column:
    """Whether two names in different scripts have the same consonants, with a small edit distance allowed."""
    scripts = (script(left) != "") & (script(right) != "") & (script(left) != script(right))
    return scripts & same_bones(bones(left), bones(right))


def titles_compatible(requested: Column, actual: Column) -> Column:
    """Same variant kinds, and the same core or the same consonants in another script."""
    a, b = title_core(requested), title_core(actual)
    kinds = F.array_join(variant_kinds(requested), " ") == F.array_join(variant_kinds(actual), " ")
    return (a != "") & (b != "") & kinds & ((a == b) | cross_script_same(a, b))


_METRIC = r"\s+x\s+(<\s*)?(\d+(?:\.\d+)?)\s*([kKmMgG])?(\s*[.…]+)?\s*$"


def popularity_text(text: Column) -> Column:
    """The popularity at the end of a listing row, as written; null without one."""
    t = clean(fold_digits(text))
    part = lambda i: F.regexp_extract(t, _METRIC, i)
    raw = F.concat(F.when(part(1) != "", "<").otherwise(""), part(2), part(3), F.when(part(4) != "", "…").otherwise(""))
    return F.when(t.rlike(_METRIC), raw)


def popularity(text: Column) -> Column:
    """The same as a number; null for bounds and cut-off figures."""
    t = clean(fold_digits(text))
    part = lambda i: F.regexp_extract(t, _METRIC, i)
    unit = F.lower(part(3))
    times = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.when(t.rlike(_METRIC) & (part(1) == "") & (part(4) == ""), F.round(part(2).try_cast("double") * times).cast("long"))


def duration_seconds(text: Column) -> Column:
    """``mm:ss`` or ``hh:mm:ss`` in seconds; null for anything else."""
    parts = F.split(text, ":")
    n = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 2, n(0) * 60 + n(1)).when(F.size(parts) == 3, n(0) * 3600 + n(1) * 60 + n(2)).cast("long")


def duration_text(seconds: Column) -> Column:
    """Seconds as ``m:ss``."""
    return F.format_string("%d:%02d", F.floor(seconds / 60), F.floor(seconds) % 60)


def artist_and_title(text: Column) -> tuple[Column, Column]:
    """The two sides of ``Artist – Title``; nulls without a dash."""
    pattern = r"^(.+?)\s+[–—-]\s+(.+)$"
    t = clean(text)
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)), F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 2))


def after_colon(key: Column) -> Column:
    """What follows the first colon; all of a key without one."""
    return F.substr(key, F.locate(":", key) + 1)


def url_bitrate(url: Column) -> Column:
    return F.regexp_extract(url, r"(?:aac|mp3)[-_](\d{2,3})", 1).try_cast("int")


def flood_wait(error: Column) -> Column:
    """Seconds that a rate-limit error asks to wait."""
    return F.regexp_extract(error, r"FLOOD_WAIT_?(\d+)", 1).try_cast("int")


def ellipsis(text: Column, most: int = 47) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule (pattern, label) that matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out
