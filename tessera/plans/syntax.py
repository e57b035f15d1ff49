"""The query language's syntax tree, and its printer.

A script is a series of statements: queries, inserts, deletes and creates. Columns are written ``$3``
(by position from 0) or ``$name``; predicates compare for equality; ``,`` joins comparisons by AND,
``|`` joins tuples of them by OR and queries by UNION ALL.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Column:
    """By position, or by name."""

    key: int | str

    def __str__(self) -> str:
        return f"${self.key}"


@dataclass(frozen=True)
class Ident:
    """A bare word as a value; no stored value ever equals it."""

    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Literal:
    value: int | str

    def __str__(self) -> str:
        return str(self.value) if isinstance(self.value, int) else f'"{self.value}"'


Side = Column | Ident | Literal


@dataclass(frozen=True)
class Equal:
    left: Side
    right: Side

    def __str__(self) -> str:
        return f"{self.left}={self.right}"


Tuple = tuple[Equal, ...]


@dataclass(frozen=True)
class Scan:
    table: str

    def __str__(self) -> str:
        return self.table


@dataclass(frozen=True)
class Star:
    """Every table."""

    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Select:
    where: tuple[Tuple, ...]
    source: Union

    def __str__(self) -> str:
        return f"{{s {'|'.join(map(listed, self.where))} {self.source}}}"


@dataclass(frozen=True)
class Project:
    columns: tuple[Column, ...]
    source: Union

    def __str__(self) -> str:
        return f"{{p {listed(self.columns)} {self.source}}}"


@dataclass(frozen=True)
class Join:
    on: Tuple
    outer: Union
    inner: Union

    def __str__(self) -> str:
        return f"{{j {listed(self.on)} {self.outer} {self.inner}}}"


@dataclass(frozen=True)
class Union:
    parts: tuple[Scan | Star | Select | Project | Join, ...]

    def __str__(self) -> str:
        return "|".join(map(str, self.parts))


@dataclass(frozen=True)
class Query:
    source: Union

    def __str__(self) -> str:
        return f"query {self.source}"


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Ident | Literal, ...]

    def __str__(self) -> str:
        return f"insert {self.table} {listed(self.values)}"


@dataclass(frozen=True)
class Delete:
    table: str
    values: tuple[Ident | Literal, ...]

    def __str__(self) -> str:
        return f"delete {self.table} {listed(self.values)}"


@dataclass(frozen=True)
class Create:
    table: str
    #: Column types ("string" or "int") of each variant.
    variants: tuple[tuple[str, ...], ...]

    def __str__(self) -> str:
        return f"create {self.table} {'|'.join(map(listed, self.variants))}"


Statement = Query | Insert | Delete | Create


def listed(items: tuple) -> str:
    return f"({','.join(map(str, items))})"
