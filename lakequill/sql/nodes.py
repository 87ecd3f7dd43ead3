"""Nodes of statements. Expressions compare by value, which is how a grouped expression is found again."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any  # None, int, float, str or bytes


@dataclass(frozen=True)
class Now:
    what: str  # date, time or timestamp


@dataclass(frozen=True)
class Column:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Param:
    number: int


@dataclass(frozen=True)
class Unary:
    sign: str
    of: Any


@dataclass(frozen=True)
class Binary:
    sign: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    of: Any
    negated: bool


@dataclass(frozen=True)
class Between:
    of: Any
    low: Any
    high: Any
    negated: bool


@dataclass(frozen=True)
class InList:
    of: Any
    items: tuple
    negated: bool


@dataclass(frozen=True)
class InSelect:
    of: Any
    select: Any
    negated: bool


@dataclass(frozen=True)
class Match:
    kind: str  # like or glob
    of: Any
    pattern: Any
    escape: Any
    negated: bool


@dataclass(frozen=True)
class Case:
    of: Any
    arms: tuple
    other: Any


@dataclass(frozen=True)
class Cast:
    of: Any
    type: str


@dataclass(frozen=True)
class Collate:
    of: Any
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False
    distinct: bool = False
    where: Any = None
    over: Any = None


@dataclass(frozen=True)
class Over:
    partition: tuple
    order: tuple
    frame: str = ""


@dataclass(frozen=True)
class Scalar:
    select: Any


@dataclass(frozen=True)
class Exists:
    select: Any
    negated: bool = False


@dataclass(frozen=True)
class Order:
    of: Any
    descending: bool = False
    nulls: str = ""


@dataclass(frozen=True)
class Item:
    of: Any  # None for a star
    alias: str | None = None
    star_of: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Derived:
    select: Any
    alias: str


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full or cross
    right: Any
    on: Any = None
    using: tuple | None = None
    natural: bool = False


@dataclass(frozen=True)
class Core:
    items: tuple
    first: Any = None
    joins: tuple = ()
    where: Any = None
    group: tuple | None = None
    having: Any = None
    distinct: bool = False
    grouping: str = ""


@dataclass(frozen=True)
class Cte:
    name: str
    columns: tuple | None
    select: Any
    recursive: bool


@dataclass(frozen=True)
class Select:
    core: Core
    compound: tuple = ()  # (operator, core)
    order: tuple = ()
    limit: Any = None
    offset: Any = None
    ctes: tuple = ()


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[tuple] | None = None
    select: Select | None = None
    conflict: str = "abort"


@dataclass
class Update:
    table: str
    sets: list[tuple[str, Any]]
    where: Any = None


@dataclass
class Delete:
    table: str
    where: Any = None


@dataclass
class ColumnDef:
    name: str
    type: str = ""
    not_null: bool = False
    primary: bool = False
    autoincrement: bool = False
    unique: bool = False
    default: Any = None
    references: str | None = None


@dataclass
class CreateTable:
    name: str
    columns: list[ColumnDef]
    if_not_exists: bool = False
    primary: list[str] = field(default_factory=list)
    uniques: list[list[str]] = field(default_factory=list)
    checks: list[tuple[Any, str]] = field(default_factory=list)
    foreign: list[str] = field(default_factory=list)


@dataclass
class CreateIndex:
    name: str
    table: str
    columns: list[str]
    unique: bool = False
    if_not_exists: bool = False


@dataclass
class Drop:
    kind: str
    name: str
    if_exists: bool = False


@dataclass
class Alter:
    table: str
    action: str  # rename, add, rename_column or drop
    name: str = ""
    to: str = ""
    column: ColumnDef | None = None


@dataclass
class Transaction:
    action: str


@dataclass
class Pragma:
    name: str
    value: Any = None


@dataclass
class Explain:
    of: Any
    plan: bool = False
