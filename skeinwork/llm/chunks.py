"""Cutting text at blanks where byte-level BPE pre-tokenization always starts a new match.

A blank between two characters that are not white space starts a match of the public
pattern (``' ?\\p{L}+'`` and its siblings), so the pieces between such blanks can be encoded
apart, each distinct one once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ``re`` counts more characters as white space than the pattern's engines do: a safe superset.
_ODD = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: The same in RE2's words, with every character that Python counts as white space.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def split(text: str) -> list[str]:
    """Pieces of ``text``; every piece but the first had one blank before it."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def split_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all ``texts`` (large_string without nulls), one after the other, and how many each text has."""
    odd = np.flatnonzero(pc.match_substring_regex(texts, f"(?: {_SPACE})|(?:{_SPACE} )").to_numpy(zero_copy_only=False))
    made = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(made).to_numpy().astype(np.int64)
    pieces = made.flatten()
    if not len(odd):
        return pieces, sizes
    stops, at, parts = np.cumsum(sizes), 0, []
    for i in odd.tolist():
        own = pa.array(split(texts[i].as_py()), pa.large_string())
        parts += [pieces.slice(at, stops[i] - sizes[i] - at), own]
        at, sizes[i] = int(stops[i]), len(own)
    return pa.concat_arrays([*parts, pieces.slice(at)]), sizes
