"""Predicates as data: a tree that is written once and rendered as a Column, as SQL text and as a JSON document.

Every test is true or false: a test of a null is false, and its negation true, in all three. A test against a string
compares the column as text. NaN equals itself and is larger than any number, as in Spark.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNS = ("=", "<>", "<", "<=", ">", ">=")


def _literal(value: Any) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    # With an exponent the literal is a double for every engine, not a decimal.
    return str(value) if isinstance(value, int) else f"{value!r}" if "e" in repr(value) else f"{value!r}e0"


def _checked(value: Any) -> None:
    if not isinstance(value, (bool, int, float, str)) or (isinstance(value, float) and not math.isfinite(value)):
        raise ValueError(f"a predicate can't hold {value!r}")
    if isinstance(value, str) and "\\" in value:
        raise ValueError("a predicate can't hold a backslash, which engines read differently")


class Predicate:
    """One node of the tree."""

    def column(self) -> Column:
        raise NotImplementedError

    def sql(self, quote: str = '"') -> str:
        """SQL text; quote: what encloses names (a backtick for Spark)."""
        raise NotImplementedError

    def document(self) -> dict:
        raise NotImplementedError

    def json(self) -> str:
        return json.dumps(self.document(), separators=(",", ":"), sort_keys=True)

    def __and__(self, other: Predicate) -> Predicate:
        return All((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Some((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


def _name(name: str, quote: str) -> str:
    return f"{quote}{name.replace(quote, quote * 2)}{quote}"


def _col(name: str) -> Column:
    return F.col(_name(name, "`"))


@dataclass(frozen=True)
class Test(Predicate):
    """A column against a value."""

    name: str
    sign: str
    value: bool | int | float | str

    def __post_init__(self):
        if self.sign not in SIGNS:
            raise ValueError(f"{self.sign} is none of {', '.join(SIGNS)}")
        _checked(self.value)

    def column(self) -> Column:
        left, right = _col(self.name), F.lit(self.value)
        left = left.cast("string") if isinstance(self.value, str) else left
        found = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[self.sign]
        return F.coalesce(found, F.lit(False))

    def sql(self, quote: str = '"') -> str:
        left = _name(self.name, quote)
        left = f"CAST({left} AS STRING)" if isinstance(self.value, str) else left
        return f"coalesce({left} {self.sign} {_literal(self.value)}, FALSE)"

    def document(self) -> dict:
        return {"op": self.sign, "column": self.name, "value": self.value}


@dataclass(frozen=True)
class OneOf(Predicate):
    """A column among values; of none, false."""

    name: str
    values: tuple

    def __post_init__(self):
        for v in self.values:
            _checked(v)

    def _tests(self) -> Some:
        return Some(tuple(Test(self.name, "=", v) for v in self.values))

    def column(self) -> Column:
        return self._tests().column()

    def sql(self, quote: str = '"') -> str:
        return self._tests().sql(quote)

    def document(self) -> dict:
        return {"op": "in", "column": self.name, "values": list(self.values)}


@dataclass(frozen=True)
class Missing(Predicate):
    name: str

    def column(self) -> Column:
        return _col(self.name).isNull()

    def sql(self, quote: str = '"') -> str:
        return f"({_name(self.name, quote)} IS NULL)"

    def document(self) -> dict:
        return {"op": "missing", "column": self.name}


@dataclass(frozen=True)
class Holds(Predicate):
    """Text that holds another, letters in either case."""

    name: str
    text: str

    def __post_init__(self):
        _checked(self.text)

    def column(self) -> Column:
        return F.coalesce(F.contains(F.lower(_col(self.name).cast("string")), F.lower(F.lit(self.text))), F.lit(False))

    def sql(self, quote: str = '"') -> str:
        return f"coalesce(contains(lower(CAST({_name(self.name, quote)} AS STRING)), lower({_literal(self.text)})), FALSE)"

    def document(self) -> dict:
        return {"op": "holds", "column": self.name, "value": self.text}


@dataclass(frozen=True)
class Within(Predicate):
    """A column of positions in any of some stretches [low, high): the rows that fall into gaps of a line, say. The
    stretches are part of the predicate, so they are few; a table of gaps is joined."""

    name: str
    stretches: tuple

    def __post_init__(self):
        for low, high in self.stretches:
            _checked(low), _checked(high)

    def _tests(self) -> Some:
        return Some(tuple(All((Test(self.name, ">=", low), Test(self.name, "<", high))) for low, high in self.stretches))

    def column(self) -> Column:
        return self._tests().column()

    def sql(self, quote: str = '"') -> str:
        return self._tests().sql(quote)

    def document(self) -> dict:
        return {"op": "within", "column": self.name, "stretches": [list(x) for x in self.stretches]}


@dataclass(frozen=True)
class All(Predicate):
    """Every part holds; of no parts, true."""

    parts: tuple

    def column(self) -> Column:
        out = F.lit(True)
        for part in self.parts:
            out = out & part.column()
        return out

    def sql(self, quote: str = '"') -> str:
        return f"({' AND '.join(p.sql(quote) for p in self.parts)})" if self.parts else "TRUE"

    def document(self) -> dict:
        return {"op": "all", "parts": [p.document() for p in self.parts]}


@dataclass(frozen=True)
class Some(Predicate):
    """A part holds; of no parts, false."""

    parts: tuple

    def column(self) -> Column:
        out = F.lit(False)
        for part in self.parts:
            out = out | part.column()
        return out

    def sql(self, quote: str = '"') -> str:
        return f"({' OR '.join(p.sql(quote) for p in self.parts)})" if self.parts else "FALSE"

    def document(self) -> dict:
        return {"op": "some", "parts": [p.document() for p in self.parts]}


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def column(self) -> Column:
        return ~self.part.column()

    def sql(self, quote: str = '"') -> str:
        return f"(NOT {self.part.sql(quote)})"

    def document(self) -> dict:
        return {"op": "not", "part": self.part.document()}


def loaded(document: dict | str) -> Predicate:
    """The tree of a document, as json() or document() wrote it; ValueError for anything else."""
    x = json.loads(document) if isinstance(document, str) else document
    try:
        op = x["op"]
        if op in SIGNS:
            return Test(x["column"], op, x["value"])
        if op in ("all", "some"):
            return (All if op == "all" else Some)(tuple(loaded(p) for p in x["parts"]))
        if op == "not":
            return Not(loaded(x["part"]))
        if op == "in":
            return OneOf(x["column"], tuple(x["values"]))
        if op == "missing":
            return Missing(x["column"])
        if op == "holds":
            return Holds(x["column"], x["value"])
        if op == "within":
            return Within(x["column"], tuple((low, high) for low, high in x["stretches"]))
    except (KeyError, TypeError) as e:
        raise ValueError(f"not a predicate: {x!r}") from e
    raise ValueError(f"no predicate is called {op!r}")


def band(name: str, edges: Sequence[float]) -> list[Predicate]:
    """One predicate for each stretch between neighbouring edges, the last one with its upper edge."""
    pairs = list(zip(edges[:-1], edges[1:], strict=True))
    return [All((Test(name, ">=", low), Test(name, "<=" if k + 1 == len(pairs) else "<", high))) for k, (low, high) in enumerate(pairs)]
