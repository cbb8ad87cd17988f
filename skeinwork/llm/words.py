"""Words as the operators count them: runs of anything but blank, tab and U+000A to U+000D."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
#: Python's form of the same; on bytes it is right for UTF-8, whose longer characters hold no ASCII byte.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Upper-case to lower-case A-Z on UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: Column) -> Column:
    """The array of words of a text that is not null (empty when it has none)."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
