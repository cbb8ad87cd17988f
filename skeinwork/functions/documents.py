"""JSON documents as VARIANT: typed containment, merges that tell missing, null and empty apart, unwrapping, merged lists.

Documents are JSON texts.  A text that is null or does not parse contains nothing and merges as an empty
object.  Objects come back with their keys in order, so equal documents are equal texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions import text

#: Keys that a payload may be wrapped in, first wins (fixed values).
WRAPPERS = ("mp3", "data", "result", "track")

OBJECT, ARRAY = "map<string,variant>", "array<variant>"


def parse(document: Column) -> Column:
    return F.try_parse_json(document)


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _number(value: Column) -> Column:
    return _is(value, "BIGINT") | _is(value, "DECIMAL") | _is(value, "DOUBLE")


def _equal(value: Column, wanted: object) -> Column:
    """Whether a variant is a scalar of the type and value of ``wanted``; 1 and 1.0 are one number."""
    if wanted is None:
        return _is(value, "VOID")
    if isinstance(wanted, bool):
        return _is(value, "BOOLEAN") & (_as(value, "boolean") == F.lit(wanted))
    if isinstance(wanted, str):
        return _is(value, "STRING") & (_as(value, "string") == F.lit(wanted))
    if isinstance(wanted, float):
        return _number(value) & (_as(value, "double") == F.lit(wanted))
    return _number(value) & (_as(value, "decimal(38,9)") == F.lit(Decimal(wanted)))


def _contains(value: Column, wanted: object) -> Column:
    if isinstance(wanted, dict):
        fields, out = _as(value, OBJECT), _is(value, "OBJECT")
        for key, inner in wanted.items():
            out = out & F.coalesce(_contains(F.try_element_at(fields, F.lit(key)), inner), F.lit(False))
        return out
    if isinstance(wanted, (list, tuple)):
        items, out = _as(value, ARRAY), _is(value, "ARRAY")
        for inner in wanted:
            out = out & F.coalesce(F.exists(items, _holder(inner)), F.lit(False))
        return out
    return _equal(value, wanted)


def _holder(wanted: object) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(_contains(x, wanted), F.lit(False))


def contains(document: Column, wanted: object) -> Column:
    """Whether a document contains ``wanted`` (dicts, lists, strings, numbers, booleans, None): every field of an object with a value that
    contains the wanted one, an item for every item of an array; scalars by type and value; an array also contains its scalar items."""
    value = parse(document)
    found = _contains(value, wanted)
    if not isinstance(wanted, (dict, list, tuple)):
        found = found | F.exists(_as(value, ARRAY), lambda x: F.coalesce(_equal(x, wanted), F.lit(False)))
    return F.coalesce(found, F.coalesce(_contains(value, wanted), F.lit(False)))


def fields(document: Column) -> Column:
    """The fields of an object as JSON texts by key; none for anything else."""
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.transform_values(_as(parse(document), OBJECT), lambda k, v: F.to_json(v)), none)


def written(made: Column) -> Column:
    """The object of ``fields``."""
    entry = lambda e: F.concat(F.regexp_replace(F.to_json(F.struct(e["key"].alias("k"))), r'^\{"k":|\}$', ""), F.lit(":"), F.coalesce(e["value"], F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(made)), entry), ","), F.lit("}"))


def _over(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def merged(old: Column, new: Column) -> Column:
    """``new`` over ``old``, field by field; a null of ``new`` is a value."""
    return written(_over(fields(old), fields(new)))


def without(document: Column, *keys: str) -> Column:
    return written(F.map_filter(fields(document), lambda k, v: ~k.isin(*keys)))


def with_field(document: Column, key: str, value: Column, create: bool = True) -> Column:
    """The document with ``key`` set to the JSON text ``value``; one without the key stays as it is unless ``create``."""
    old = fields(document)
    made = written(_over(old, F.create_map(F.lit(key), value)))
    return made if create else F.when(F.map_contains_key(old, F.lit(key)), made).otherwise(written(old))


def merged_provenance(old: Column, new: Column, preferred: str, kept: Sequence[str] = ("source", "rawText")) -> Column:
    """``merged``; but a document of the ``preferred`` source keeps where it is from when another source adds to it."""
    source = lambda d: F.coalesce(F.try_variant_get(parse(d), "$.source", "string"), F.lit(""))
    foreign = (source(old) == preferred) & (source(new) != preferred)
    added = F.when(foreign, F.map_filter(fields(new), lambda k, v: ~k.isin(*kept))).otherwise(fields(new))
    return written(_over(fields(old), added))


def _truthy(value: Column) -> Column:
    empty = _is(value, "VOID") | _equal(value, False) | _equal(value, 0) | _equal(value, "")
    return value.isNotNull() & ~F.coalesce(empty, F.lit(True))


def _first(value: Column) -> Column:
    return F.get(F.filter(_as(value, ARRAY), _truthy), F.lit(0))


def unwrapped(payload: Column) -> Column:
    """The record of a payload, as JSON text: the first item of an array that is anything, the first object or array among
    ``WRAPPERS``, else the object itself; null for scalars."""
    value = parse(payload)
    inside, out = _as(value, OBJECT), F.when(_is(value, "OBJECT"), value)
    for key in reversed(WRAPPERS):
        inner = F.try_element_at(inside, F.lit(key))
        out = F.when(_is(inner, "ARRAY"), _first(inner)).when(_is(inner, "OBJECT"), inner).otherwise(out)
    return F.to_json(F.when(_is(value, "ARRAY"), _first(value)).otherwise(out))


def merged_list(known: Column, seen: Column, full: Column, trusted: Callable[[Column], Column]) -> Column:
    """A list of structs with a ``title`` after another was seen.

    A null list was not seen and changes nothing.  A ``full`` one replaces the known list, an empty one clears it.  A partial one never clears:
    its items take the place of known ones with an equal title, others follow.  Only ``trusted`` (a function of the item) items with a
    title count.
    """
    key = lambda x: text.norm(F.coalesce(x["title"], F.lit("")))
    good = F.filter(seen, lambda x: F.coalesce(trusted(x), F.lit(False)) & (key(x) != ""))
    every = F.concat(F.filter(F.coalesce(known, F.slice(good, 1, 0)), lambda x: key(x) != ""), good)
    partial = F.transform(F.array_distinct(F.transform(every, key)), lambda k: F.element_at(F.filter(every, lambda x: key(x) == k), -1))
    return F.when(seen.isNull(), known).when(full, good).otherwise(partial)
