"""From the syntax tree to DataFrames: names and types are settled here, Catalyst does the rest.

Inside, columns are called _0, _1, ...; names are told beside them, so that joins may hold a name
twice. Types never convert: a comparison of a string with a number is false, and so is one that names
a column beyond the row. Predicates become plain column expressions, which Catalyst pushes into scans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column as Col, DataFrame, functions as F

from .syntax import Column, Equal, Ident, Join, Literal, Project, Scan, Select, Star, Tuple, Union

WHOLE = {"tinyint", "smallint", "int", "bigint"}


class AnalysisError(ValueError):
    """The statement cannot be run on these tables."""


@dataclass(frozen=True)
class Relation:
    """A DataFrame with the columns _0, _1, ... and their outside names."""

    df: DataFrame
    names: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame) -> Relation:
        return cls(df.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(df.columns)]), tuple(df.columns))

    @property
    def kinds(self) -> list[str]:
        return [kind for _, kind in self.df.dtypes]

    def place(self, column: Column) -> int | None:
        """The column's position; None if there is none. Of equal names the first counts."""
        if isinstance(column.key, int):
            return column.key if column.key < len(self.names) else None
        if column.key not in self.names:
            raise AnalysisError(f"no column ${column.key} among {', '.join(self.names)}")
        return self.names.index(column.key)

    def output(self) -> DataFrame:
        """With outside names; a name's later bearers get _1, _2, ... appended."""
        seen: dict[str, int] = {}
        taken, out = set(self.names), []
        for name in self.names:
            n = seen.get(name, 0)
            label = name if not n else f"{name}_{n}"
            while n and label in taken:
                n += 1
                label = f"{name}_{n}"
            seen[name] = n + 1
            taken.add(label)
            out.append(label)
        return self.df.select(*[F.col(f"_{k}").alias(label) for k, label in enumerate(out)])


def comparable(a: str, b: str) -> bool:
    return a == b or a in WHOLE and b in WHOLE


def literal_kind(value: int | str) -> str:
    return "bigint" if isinstance(value, int) else "string"


def equality(equal: Equal, left: Relation, right: Relation, columns: Callable[[Relation, int], Col]) -> Col:
    """left and right are the rows that the comparison's sides speak of."""
    sides: list[tuple[str, Col]] = []
    for side, of in ((equal.left, left), (equal.right, right)):
        if isinstance(side, Ident):
            return F.lit(False)
        if isinstance(side, Literal):
            sides.append((literal_kind(side.value), F.lit(side.value)))
            continue
        at = of.place(side)
        if at is None:
            return F.lit(False)
        sides.append((of.kinds[at], columns(of, at)))
    (a, x), (b, y) = sides
    if not comparable(a, b):
        return F.lit(False)
    if isinstance(equal.left, Literal) and isinstance(equal.right, Literal):
        return F.lit(equal.left.value == equal.right.value)
    return F.lit(True) if equal.left == equal.right and left is right else x == y


def selection(where: Sequence[Tuple], of: Relation) -> Col:
    """True if all comparisons of one of the tuples hold."""
    each = [reduce(and_, [equality(e, of, of, lambda r, k: F.col(f"_{k}")) for e in conj], F.lit(True)) for conj in where]
    return reduce(or_, each)


class Planner:
    def __init__(self, table: Callable[[str], DataFrame], every: Callable[[], list[str]]) -> None:
        """table: a table by name, raising AnalysisError; every: the names of all tables."""
        self.table, self.every = table, every

    def plan(self, node: Union | Scan | Star | Select | Project | Join) -> Relation:
        return getattr(self, type(node).__name__.lower())(node)

    def scan(self, node: Scan) -> Relation:
        return Relation.of(self.table(node.table))

    def star(self, node: Star) -> Relation:
        """All tables' rows; a column that a table lacks is null."""
        tables = [self.table(t) for t in self.every()]
        if not tables:
            raise AnalysisError("there are no tables")
        kinds: dict[str, str] = {}
        for name, kind in (c for t in tables for c in t.dtypes):
            if not comparable(kinds.setdefault(name, kind), kind):
                raise AnalysisError(f"{name} is {kinds[name]} in one table and {kind} in another")
        return Relation.of(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables))

    def union(self, node: Union) -> Relation:
        parts = [self.plan(p) for p in node.parts]
        first = parts[0]
        for other in parts[1:]:
            if len(other.names) != len(first.names) or not all(map(comparable, first.kinds, other.kinds)):
                raise AnalysisError(f"a union of {first.kinds} and {other.kinds}")
        return first if len(parts) == 1 else Relation(reduce(DataFrame.union, [p.df for p in parts]), first.names)

    def select(self, node: Select) -> Relation:
        source = self.plan(node.source)
        return Relation(source.df.filter(selection(node.where, source)), source.names)

    def project(self, node: Project) -> Relation:
        source = self.plan(node.source)
        at = [source.place(c) for c in node.columns]
        if None in at:
            raise AnalysisError(f"${node.columns[at.index(None)].key} of {len(source.names)} columns")
        return Relation(source.df.select(*[F.col(f"_{k}").alias(f"_{n}") for n, k in enumerate(at)]), tuple(source.names[k] for k in at))

    def join(self, node: Join) -> Relation:
        """Inner join; left sides speak of the outer row, right sides of the inner one; all columns of both, in order."""
        outer, inner = self.plan(node.outer), self.plan(node.inner)
        shifted = inner.df.select(*[F.col(f"_{k}").alias(f"_{len(outer.names) + k}") for k in range(len(inner.names))])

        def column(of: Relation, k: int) -> Col:
            return F.col(f"_{k + len(outer.names) * (of is inner)}")

        for e in node.on:
            if isinstance(e.left, Ident) or isinstance(e.right, Ident):
                raise AnalysisError(f"{e}: a bare word in a join")
        on = [equality(e, outer, inner, column) for e in node.on]
        joined = outer.df.join(shifted, reduce(and_, on), "inner") if on else outer.df.crossJoin(shifted)
        return Relation(joined, outer.names + inner.names)
