"""Cutting a text into messages of bounded length, at line ends where that wastes little.

A message has at most ``most`` characters.  It ends at the last line end within that reach, if this
leaves it at least ``least_share`` of the length, else right at the limit.  White space around
messages is dropped, as is white space around the text; a blank or null text has no messages.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE_END, _VISIBLE = re.compile("\n"), re.compile(r"\S")


def _spans(text: str, most: int, least: int) -> Iterator[slice]:
    """Where each message lies in ``text``."""
    line_ends = [m.start() for m in _LINE_END.finditer(text)]
    stop = len(text.rstrip())
    head = _VISIBLE.search(text)
    while head is not None and stop - head.start() > most:
        start = head.start()
        within = bisect_right(line_ends, start + most)
        tail = line_ends[within - 1] if within else -1
        tail = max(tail, start + most) if tail < start + least else tail
        yield slice(start, tail)
        head = _VISIBLE.search(text, tail)
    if head is not None:
        yield slice(head.start(), stop)


def chunks(text: str, most: int = 3800, least_share: float = 0.55) -> list[str]:
    """The messages of ``text``."""
    return [text[span].rstrip() for span in _spans(text, most, int(most * least_share))]


def text_chunks(text: Column, most: int = 3800) -> Column:
    """The same of a column; a null text has no pieces."""

    @F.pandas_udf("array<string>")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda x: chunks(x or "", most))

    return cut(text)
