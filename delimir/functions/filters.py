"""Row filters: small immutable trees over physical columns, evaluated as Catalyst expressions.

Logic has three values: a predicate on a column that a record lacks is unknown, also a negative
one, and a record passes only where the whole filter is true.  That is SQL's logic on
``get(fields, i)``, so trees map to ``Column`` one to one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import DelimitedError
from ..plans.limits import MAX_COLUMN, MAX_LEAVES, MAX_NESTING, MAX_PROGRAM, MAX_REGEX_LEAVES
from .regex import Regex, regex


@dataclass(frozen=True)
class Filter:
    """kind: equals, notEquals, in, notIn, startsWith, regex, all, any or not."""

    kind: str
    column: int = -1
    values: tuple = ()
    parts: tuple[Filter, ...] = ()

    def leaves(self) -> Iterable[Filter]:
        if not self.parts:
            yield self
        for p in self.parts:
            yield from p.leaves()

    def size(self) -> int:
        return 1 + sum(p.size() for p in self.parts)


def _operand(value, label: str):
    if isinstance(value, str):
        return value
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value)  # a copy: later changes of the caller's buffer don't reach the filter
    raise DelimitedError(f"{label} must be a string, Buffer, or Uint8Array")


@dataclass(frozen=True)
class ColumnRef:
    """A zero-based physical column; its methods make filters."""

    index: int

    def equals(self, value) -> Filter:
        return Filter("equals", self.index, (_operand(value, "filter value"),))

    def does_not_equal(self, value) -> Filter:
        return Filter("notEquals", self.index, (_operand(value, "filter value"),))

    def is_one_of(self, values) -> Filter:
        return Filter("in", self.index, _operands(values))

    def is_none_of(self, values) -> Filter:
        return Filter("notIn", self.index, _operands(values))

    def starts_with(self, prefix) -> Filter:
        return Filter("startsWith", self.index, (_operand(prefix, "filter prefix"),))

    def has_match(self, pattern: Regex | str, flags: str = "") -> Filter:
        return Filter("regex", self.index, (pattern if isinstance(pattern, Regex) else regex(pattern, flags),))


def _operands(values) -> tuple:
    if isinstance(values, (str, bytes)) or not isinstance(values, Iterable):
        raise DelimitedError("filter values must be an array")
    got = tuple(_operand(v, f"filter values[{i}]") for i, v in enumerate(values))
    if not got:
        raise DelimitedError("filter values must not be empty")
    return got


def column_index(index, label: str = "filter column") -> int:
    if isinstance(index, bool) or not isinstance(index, int) or not 0 <= index <= MAX_COLUMN:
        raise DelimitedError(f"{label} out of range: {index}")
    return index


def column(index: int) -> ColumnRef:
    return ColumnRef(column_index(index))


def _many(kind: str, filters: tuple) -> Filter:
    if not filters:
        raise DelimitedError(f"csv.{kind}() requires at least one filter")
    for f in filters:
        _own(f)
    return Filter(kind, parts=tuple(filters))


def _own(f) -> Filter:
    if not isinstance(f, Filter):
        raise DelimitedError("filter must be created with csv.column(), csv.all(), csv.any(), or csv.not()")
    return f


def all_(*filters: Filter) -> Filter:
    return _many("all", filters)


def any_(*filters: Filter) -> Filter:
    return _many("any", filters)


def not_(f: Filter) -> Filter:
    return Filter("not", parts=(_own(f),))


def from_list(filters: list[dict]) -> Filter | None:
    """The older form: a list of {column, value | values | notEquals | notIn | prefix | regex}, all of which must hold."""
    if not filters:
        return None
    out = []
    for i, f in enumerate(filters):
        label = f"filters[{i}]"
        if not isinstance(f, dict):
            raise DelimitedError(f"{label} must be an object")
        c = column(f.get("column"))
        makers = {"value": c.equals, "values": c.is_one_of, "notEquals": c.does_not_equal, "notIn": c.is_none_of, "prefix": c.starts_with, "regex": c.has_match}
        kinds = [k for k in makers if k in f]
        if len(kinds) != 1 or set(f) != {"column", kinds[0]}:
            raise DelimitedError(f"{label} must contain equals, in, notEquals, notIn, startsWith, or regex")
        out.append(makers[kinds[0]](f[kinds[0]]))
    return check(all_(*out))


def check(f: Filter | None) -> Filter | None:
    """Size limits of a whole filter."""
    if f is None:
        return None
    leaves = list(_own(f).leaves())
    if len(leaves) > MAX_LEAVES:
        raise DelimitedError(f"filter count out of range: {len(leaves)}")
    if f.size() > MAX_PROGRAM:
        raise DelimitedError(f"filter program length out of range: {f.size()}")
    if (n := sum(x.kind == "regex" for x in leaves)) > MAX_REGEX_LEAVES:
        raise DelimitedError(f"regex filter count out of range: {n}")
    return f


# -- as Catalyst expressions --------------------------------------------------------------------
def to_column(f: Filter, field: Callable[[int], Column]) -> Column:
    """``field(i)`` gives a record's field, null where the record has none."""
    if f.kind in ("all", "any"):
        parts = [to_column(p, field) for p in f.parts]
        while len(parts) > 1:  # a balanced tree: thousands of parts stay shallow
            parts = [(parts[i] & parts[i + 1] if f.kind == "all" else parts[i] | parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]
    if f.kind == "not":
        return ~to_column(f.parts[0], field)
    x = field(f.column)
    if f.kind == "regex":
        return x.rlike(f.values[0].java)
    if any(isinstance(v, bytes) for v in f.values):
        x = x.cast("binary")
        values = [F.lit(v if isinstance(v, bytes) else v.encode()) for v in f.values]
    else:
        values = [F.lit(v) for v in f.values]
    if f.kind == "equals":
        return x == values[0]
    if f.kind == "notEquals":
        return x != values[0]
    if f.kind == "in":
        return x.isin(*values)
    if f.kind == "notIn":
        return ~x.isin(*values)
    return F.startswith(x, values[0])


def to_predicate(f: Filter) -> Callable[[list[str]], bool | None] | None:
    """The same filter on a list of fields, for scans that drop rows early; None where it has a pattern."""
    if any(x.kind == "regex" for x in f.leaves()):
        return None
    if f.kind in ("all", "any"):
        parts, stop = [to_predicate(p) for p in f.parts], f.kind == "any"

        def many(row):
            unknown = False
            for p in parts:
                got = p(row)
                if got is stop:
                    return stop
                unknown |= got is None
            return None if unknown else not stop

        return many
    if f.kind == "not":
        inner = to_predicate(f.parts[0])
        return lambda row: None if (got := inner(row)) is None else not got
    values, i = [v.decode("utf-8", "surrogateescape") if isinstance(v, bytes) else v for v in f.values], f.column
    some = frozenset(values)
    tests = {"equals": lambda x: x in some, "in": lambda x: x in some, "notEquals": lambda x: x not in some, "notIn": lambda x: x not in some, "startsWith": lambda x: x.startswith(values[0])}
    test = tests[f.kind]
    return lambda row: test(row[i]) if i < len(row) else None


# -- JSON ---------------------------------------------------------------------------------------
_KEYS = {"equals": "equals", "notEquals": "notEquals", "startsWith": "startsWith", "in": "in", "notIn": "notIn", "regex": "regex"}


def from_json(value, label: str = "--where", depth: int = 0) -> Filter:
    """A filter from parsed JSON: {all: [..]}, {any: [..]}, {not: ..} or {column, one predicate}."""
    if depth > MAX_NESTING:
        raise DelimitedError(f"{label.split('.')[0].split('[')[0]} nesting exceeds {MAX_NESTING}")
    if not isinstance(value, dict):
        raise DelimitedError(f"{label} must be a JSON object")

    def only(*allowed):
        if extra := next((k for k in value if k not in allowed), None):
            raise DelimitedError(f"{label} contains unknown property: {extra}")

    for kind in ("all", "any"):
        if kind in value:
            only(kind)
            if not isinstance(value[kind], list) or not value[kind]:
                raise DelimitedError(f"{label}.{kind} must be a non-empty array")
            return Filter(kind, parts=tuple(from_json(v, f"{label}.{kind}[{i}]", depth + 1) for i, v in enumerate(value[kind])))
    if "not" in value:
        only("not")
        return not_(from_json(value["not"], f"{label}.not", depth + 1))
    if isinstance(value.get("column"), bool) or not isinstance(value.get("column"), (int, float)):
        raise DelimitedError(f"{label}.column must be a number")
    kinds = [k for k in _KEYS if k in value]
    if not kinds:
        raise DelimitedError(f"{label} must contain equals, in, notEquals, notIn, startsWith, or regex")
    only("column", kinds[0])
    x, c = value[kinds[0]], column(int(value["column"]) if value["column"] == int(value["column"]) else value["column"])
    if kinds[0] in ("in", "notIn"):
        if not isinstance(x, list) or not x or not all(isinstance(v, str) for v in x):
            raise DelimitedError(f"{label}.{kinds[0]} must be a non-empty string array")
        return c.is_one_of(x) if kinds[0] == "in" else c.is_none_of(x)
    if kinds[0] == "regex":
        if not isinstance(x, dict):
            raise DelimitedError(f"{label}.regex must be a JSON object")
        if not isinstance(x.get("source"), str):
            raise DelimitedError(f"{label}.regex.source must be a string")
        if set(x) - {"source", "flags"} or not isinstance(x.get("flags", ""), str):
            raise DelimitedError(f"{label}.regex must contain source and optional flags strings")
        return c.has_match(x["source"], x.get("flags", ""))
    if not isinstance(x, str):
        raise DelimitedError(f"{label}.{kinds[0]} must be a string")
    return {"equals": c.equals, "notEquals": c.does_not_equal, "startsWith": c.starts_with}[kinds[0]](x)


def parse_json(text: str) -> Filter:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise DelimitedError(f"--where must be valid JSON: {e}") from e
    return check(from_json(value))
