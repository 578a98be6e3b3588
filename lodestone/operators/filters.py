"""Conditions over VARIANT payloads and their clauses, as plain boolean columns that are never null.

A condition is an object with a column(payload) method. A value condition holds
if any of the values that its path reaches does, lists opened one level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import InvalidArgument, Unsupported
from lodestone.functions import datetimes, paths

MAX_CONDITIONS = 16
REFUSED = ("min_should", "has_id", "nested", "has_vector", "slice", "geo_radius", "geo_bounding_box", "geo_polygon", "text", "phrase", "text_any", "except", "prefix")


def _true_or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Match:
    """Equality with a string, an integer or a boolean, or with any of several. A double never equals an integer."""

    path: str
    values: tuple

    def column(self, payload: Column) -> Column:
        reached = paths.leaves(paths.resolve(payload, self.path))
        return _true_or_false(F.exists(reached, self.test))

    def test(self, v: Column) -> Column:
        kinds = {bool: ("BOOLEAN", "boolean"), int: ("BIGINT", "bigint"), str: ("STRING", "string")}
        tests = []
        for t, (kind, cast) in kinds.items():
            wanted = [x for x in self.values if type(x) is t]
            if wanted:
                got = F.try_variant_get(v, "$", cast)
                tests.append(_true_or_false((F.schema_of_variant(v) == kind) & got.isin(*wanted)))
        if len([x for x in self.values if type(x) not in kinds]):
            raise InvalidArgument("match takes strings, integers or booleans")
        return reduce(lambda a, b: a | b, tests, F.lit(False))


def match(path: str, *values) -> Match:
    return Match(path, values)


@dataclass(frozen=True)
class Range:
    """Numbers within bounds; integers compare as doubles. NaN values never match; NaN is above all as a bound."""

    path: str
    lt: float | None = None
    gt: float | None = None
    lte: float | None = None
    gte: float | None = None

    def column(self, payload: Column) -> Column:
        return _true_or_false(F.exists(paths.leaves(paths.resolve(payload, self.path)), self.test))

    def test(self, v: Column) -> Column:
        x = F.try_variant_get(v, "$", "double")
        number = F.regexp_like(F.schema_of_variant(v), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
        ok = number & ~F.isnan(x)
        # Everything is below a bound of NaN, nothing above it.
        if self.lt is not None and not math.isnan(self.lt):
            ok = ok & (x < self.lt)
        if self.lte is not None and not math.isnan(self.lte):
            ok = ok & (x <= self.lte)
        if self.gt is not None:
            ok = ok & (F.lit(False) if math.isnan(self.gt) else x > self.gt)
        if self.gte is not None:
            ok = ok & (F.lit(False) if math.isnan(self.gte) else x >= self.gte)
        return _true_or_false(ok)


@dataclass(frozen=True)
class DatetimeRange:
    """Strings that are datetimes, within bounds, at microseconds."""

    path: str
    lt: str | None = None
    gt: str | None = None
    lte: str | None = None
    gte: str | None = None

    def column(self, payload: Column) -> Column:
        return _true_or_false(F.exists(paths.leaves(paths.resolve(payload, self.path)), self.test))

    def test(self, v: Column) -> Column:
        def within(x: Column) -> Column:
            ok = x.isNotNull()
            for bound, op in ((self.lt, lambda a, b: a < b), (self.gt, lambda a, b: a > b), (self.lte, lambda a, b: a <= b), (self.gte, lambda a, b: a >= b)):
                if bound is not None:
                    if (at := datetimes.parse(bound)) is None:
                        raise InvalidArgument(f"{bound!r} is no datetime")
                    ok = ok & op(x, F.lit(at))
            return ok

        # Each step is computed once: the string, then its microseconds.
        inside = datetimes.let(F.try_variant_get(v, "$", "string"), lambda t: datetimes.let(datetimes.micros(t), within))
        return _true_or_false((F.schema_of_variant(v) == "STRING") & inside)


@dataclass(frozen=True)
class Either:
    """A match or a range on the same path, per value."""

    first: Match | Range | DatetimeRange
    second: Match | Range | DatetimeRange

    def column(self, payload: Column) -> Column:
        return _true_or_false(F.exists(paths.leaves(paths.resolve(payload, self.first.path)), lambda v: self.first.test(v) | self.second.test(v)))


def _count(v: Column) -> Column:
    return F.when(paths.kind(v) == "null", F.lit(0)).otherwise(F.coalesce(F.size(paths.as_list(v)), F.lit(1)))


def _empty(v: Column) -> Column:
    return _count(v) == 0


@dataclass(frozen=True)
class ValuesCount:
    """How many values a field has: a list its length, null none, anything else one, a missing field none."""

    path: str
    lt: int | None = None
    gt: int | None = None
    lte: int | None = None
    gte: int | None = None

    def column(self, payload: Column) -> Column:
        def test(n: Column) -> Column:
            ok = F.lit(True)
            for bound, op in ((self.lt, n < F.lit(self.lt)), (self.gt, n > F.lit(self.gt)), (self.lte, n <= F.lit(self.lte)), (self.gte, n >= F.lit(self.gte))):
                ok = ok & op if bound is not None else ok
            return ok

        values = paths.resolve(payload, self.path)
        return _true_or_false(F.when(F.size(values) == 0, test(F.lit(0))).otherwise(F.exists(values, lambda v: test(_count(v)))))


@dataclass(frozen=True)
class FieldEmpty:
    """Any reached value is empty, or is not; a missing field is empty."""

    path: str
    want: bool = True

    def column(self, payload: Column) -> Column:
        values = paths.resolve(payload, self.path)
        return _true_or_false(F.when(F.size(values) == 0, F.lit(self.want)).otherwise(F.exists(values, lambda v: _empty(v) == F.lit(self.want))))


@dataclass(frozen=True)
class IsEmpty:
    """All reached values are empty, none reached included."""

    path: str

    def column(self, payload: Column) -> Column:
        return _true_or_false(F.forall(paths.resolve(payload, self.path), _empty))


@dataclass(frozen=True)
class IsNull:
    """Any reached value is null or a list that holds one. A missing field is not null."""

    path: str
    want: bool = True

    def column(self, payload: Column) -> Column:
        null = lambda v: F.coalesce(F.exists(paths.as_list(v), F.is_variant_null), F.is_variant_null(v))
        values = paths.resolve(payload, self.path)
        missing = F.lit(not self.want)
        return _true_or_false(F.when(F.size(values) == 0, missing).otherwise(F.exists(values, lambda v: null(v) == F.lit(self.want))))


@dataclass(frozen=True)
class Filter:
    """Every must, no must_not, and one should if there are any."""

    must: list = field(default_factory=list)
    must_not: list = field(default_factory=list)
    should: list = field(default_factory=list)

    def column(self, payload: Column) -> Column:
        for clause in (self.must, self.must_not, self.should):
            if len(clause) > MAX_CONDITIONS:
                raise InvalidArgument(f"a clause has at most {MAX_CONDITIONS} conditions")
        every = lambda cs: [c.column(payload) for c in cs]
        out = reduce(lambda a, b: a & b, every(self.must), F.lit(True))
        out = reduce(lambda a, b: a & ~b, every(self.must_not), out)
        return out & reduce(lambda a, b: a | b, every(self.should)) if self.should else out


#: What an entry of the grammar may hold for a field, and the condition it stands for.
_GRAMMAR = {
    "match": lambda path, spec: Match(path, (spec["value"],)),
    "match_any": lambda path, spec: Match(path, tuple(spec["any"])),
    "range": lambda path, spec: Range(path, **{name: float(bound) for name, bound in spec.items() if bound is not None}),
}


def _conditions(entries: list[dict] | None) -> list:
    """One condition for each kind of each field of each entry, so an entry may name several of either."""
    found = []
    for entry in entries or []:
        for path, kinds in entry.items():
            for kind, spec in kinds.items():
                if kind not in _GRAMMAR:
                    raise Unsupported(f"condition {kind}")
                found.append(_GRAMMAR[kind](path, spec))
    return found


def from_json(conditions: dict | None) -> Filter:
    """The JSON form of conditions: {"and": [entry, ...], "or": [entry, ...]}, each entry {field: {kind: what it asks for}}."""
    given = dict(conditions or {})
    out = Filter(must=_conditions(given.pop("and", None)), should=_conditions(given.pop("or", None)))
    if given:
        raise Unsupported(f"condition {min(given)}")
    return out


def refuse(name: str) -> None:
    if name in REFUSED:
        raise Unsupported(f"condition {name}")
