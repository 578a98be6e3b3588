"""JSON paths over VARIANT payloads.

A path is key(.key | [n] | [])*. A key is letters, digits, '_', '-' and anything
beyond ASCII, or quoted text without escapes. It resolves to the array of values
that it reaches: an empty array where a key is missing, an element with the
variant null where the value is null. A trailing list is one value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import InvalidArgument

MAX_STEPS = 32
_KEY = re.compile(r'"([^"]*)"|([0-9A-Za-z_\-]|[^\x00-\x7F])+')
_INDEX = re.compile(r"\[([0-9]*)\]")


@dataclass(frozen=True)
class Step:
    key: str | None = None
    index: int | None = None  # None with no key: every element


def parse_path(path: str) -> list[Step]:
    steps, at = [], 0
    while True:
        m = _KEY.match(path, at)
        if not m:
            raise InvalidArgument(f"no key at position {at} of path {path!r}")
        steps.append(Step(key=m[1] if m[1] is not None else m[0]))
        at = m.end()
        while m := _INDEX.match(path, at):
            steps.append(Step(index=int(m[1]) if m[1] else None))
            at = m.end()
        if at == len(path):
            break
        if path[at] != ".":
            raise InvalidArgument(f"unexpected {path[at]!r} at position {at} of path {path!r}")
        at += 1
    if len(steps) > MAX_STEPS:
        raise InvalidArgument(f"a path has at most {MAX_STEPS} steps")
    return steps


def _quoted(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _each(values: Column, at: str) -> Column:
    return F.transform(values, lambda v: F.try_variant_get(v, at, "variant"))


def resolve(payload: Column, path: str) -> Column:
    """ARRAY<VARIANT> of what the path reaches in the payload."""
    values = F.filter(F.array(payload), lambda v: v.isNotNull())
    for step in parse_path(path):
        if step.key is not None:
            values = _each(values, _quoted(step.key))
        elif step.index is not None:
            values = _each(values, f"$[{step.index}]")
        else:
            values = F.flatten(F.transform(values, lambda v: F.coalesce(as_list(v), F.array().cast("array<variant>"))))
        values = F.filter(values, lambda v: v.isNotNull())
    return F.coalesce(values, F.array().cast("array<variant>"))


def as_list(v: Column) -> Column:
    """ARRAY<VARIANT>, or null where the value is no list."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def kind(v: Column) -> Column:
    """One of null, bool, integer, double, string, list, struct."""
    s = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "null").when(s == "BOOLEAN", "bool").when(s == "BIGINT", "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "double").when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "struct").otherwise("other")
    )


def leaves(values: Column) -> Column:
    """The values themselves, lists opened one level."""
    return F.flatten(F.transform(values, lambda v: F.coalesce(as_list(v), F.array(v))))
