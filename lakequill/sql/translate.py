"""Typed translation of nodes to Spark SQL.

Each expression becomes Spark SQL text with the dialect's type of its result, so that the dialect's rules are decided
here: integer division, comparison of text with numbers, truth of numbers, 0 and 1 for booleans. Everything relational
stays SQL, subqueries included, so Catalyst decorrelates, pushes down, prunes and picks joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import BindError, UnsupportedError
from ..functions import dialect as fn
from . import nodes as n

INT, REAL, TEXT, BLOB, NULL, BOOL, OTHER = fn.INT, fn.REAL, fn.TEXT, fn.BLOB, fn.NULL, fn.BOOL, fn.OTHER
AGGREGATES = frozenset("count sum total avg min max group_concat string_agg".split())
WINDOW_ONLY = frozenset("row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value".split())
ROWID = ("rowid", "_rowid_", "oid")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Source:
    """A table or subquery of FROM: its alias, its columns (name, type), and whether it has a hidden row id."""

    alias: str
    columns: list[tuple[str, str]]
    rowid: bool = False
    #: Columns that USING or NATURAL merged away, which bare names do not see.
    hidden: set[str] = field(default_factory=set)


@dataclass
class Scope:
    sources: list[Source]
    outer: Scope | None = None
    #: Bare names that a join merged, with the text that stands for them.
    merged: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass
class Table:
    """What a name in FROM stands for: Spark SQL text that can be selected from."""

    sql: str
    columns: list[tuple[str, str]]
    rowid: bool = False


@dataclass
class X:
    sql: str
    type: str


class Translator:
    """``resolve`` maps a lower-case name to a Table, or None."""

    def __init__(self, resolve: Callable[[str], Table | None], params: tuple = (), recurse: Callable | None = None) -> None:
        self.resolve, self.params, self.recurse = resolve, params, recurse
        self.ctes: list[dict[str, Table]] = []
        self.count = 0

    # selects

    def select(self, s: n.Select, outer: Scope | None = None) -> tuple[str, list[tuple[str, str]]]:
        """Spark SQL of a select, and its columns."""
        self.ctes.append({})
        try:
            with_text = self._ctes(s.ctes)
            sql, columns = self._compound(s, outer)
        finally:
            self.ctes.pop()
        return with_text + sql, columns

    def _ctes(self, ctes: tuple) -> str:
        texts, recursive = [], False
        for cte in ctes:
            name = cte.name
            if cte.recursive and _mentions(cte.select, name):
                columns, text, native = self._recursive(cte)
                if native:
                    recursive = True
                    texts.append(text)
                continue
            sql, columns = self.select(cte.select)
            columns = self._renamed(cte, columns)
            texts.append(f"{quoted(name)}({', '.join(quoted(c) for c, _ in columns)}) AS ({sql})")
            self.ctes[-1][name.lower()] = Table(quoted(name), columns)
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(texts)} " if texts else ""

    def _renamed(self, cte: n.Cte, columns: list) -> list:
        if cte.columns:
            if len(cte.columns) != len(columns):
                raise BindError(f"{cte.name} has {len(columns)} columns, {len(cte.columns)} names")
            return [(c, t) for c, (_, t) in zip(cte.columns, columns, strict=True)]
        return _unique(columns)

    def _recursive(self, cte: n.Cte) -> tuple[list, str, bool]:
        s = cte.select
        if not s.compound or s.order or s.limit is not None:
            raise UnsupportedError(f"recursive {cte.name} needs a first part, UNION and a recursive part, without ORDER BY or LIMIT")
        op, step = s.compound[-1]
        base = n.Select(s.core, s.compound[:-1])
        sql, columns = self.select(base)
        columns = self._renamed(cte, columns)
        columns = [(c, INT if t in (NULL, BOOL) else t) for c, t in columns]
        names = ", ".join(quoted(c) for c, _ in columns)
        self.ctes[-1][cte.name.lower()] = Table(quoted(cte.name), columns)
        if op == "union all":
            text, got = self.select(n.Select(step))
            if len(got) != len(columns):
                raise BindError("the parts of a recursive query differ in columns")
            fit = ", ".join(f"CAST({quoted(g)} AS {fn.SPARK[t]}) AS {quoted(c)}" if t in fn.SPARK else f"{quoted(g)} AS {quoted(c)}" for (g, _), (c, t) in zip(_unique(got), columns, strict=True))
            inner = f"SELECT {fit} FROM ({text}) AS r({', '.join(quoted(g) for g, _ in _unique(got))})"
            return columns, f"{quoted(cte.name)}({names}) AS ({sql} UNION ALL {inner})", True
        if op != "union" or self.recurse is None:
            raise UnsupportedError(f"recursive {op.upper()}")
        # rows that a step makes again end there: a fixed point, computed step by step
        table = self.recurse(sql, columns, lambda t: self._step(step, cte.name.lower(), t))
        self.ctes[-1][cte.name.lower()] = table
        return columns, "", False

    def _step(self, step: n.Core, name: str, table: Table) -> str:
        self.ctes[-1][name] = table
        return self.select(n.Select(step))[0]

    def _compound(self, s: n.Select, outer: Scope | None) -> tuple[str, list[tuple[str, str]]]:
        if not s.compound:
            sql, columns, scope, aggregated = self._core(s.core, outer)
            order = self._ordering(s.order, s.core, columns, scope, aggregated)
            return sql + order + self._limits(s, outer), columns
        sql, columns, _, _ = self._core(s.core, outer)
        parts = [sql]
        types = columns
        for op, core in s.compound:
            right, got, _, _ = self._core(core, outer)
            if len(got) != len(columns):
                raise BindError(f"{op.upper()} of {len(columns)} and {len(got)} columns")
            types = [(c, _common(a, b)) for (c, a), (_, b) in zip(types, got, strict=True)]
            parts.append((op, right))
        text = f"({parts[0]})"
        for op, right in parts[1:]:
            text = f"({text} {op.upper()} ({right}))"
        names = _unique(types)
        labels = ", ".join(quoted(c) for c, _ in names)
        text = f"SELECT {', '.join(f'{quoted(u)} AS {quoted(c)}' for (u, _), (c, _) in zip(names, types, strict=True))} FROM {text} AS q({labels})"
        scope = Scope([Source("q", names)], outer)
        order = self._ordering(s.order, None, types, scope, False)
        return text + order + self._limits(s, outer), types

    def _limits(self, s: n.Select, outer: Scope | None) -> str:
        text = ""
        if s.limit is not None and (k := self._constant(s.limit)) is not None and k >= 0:
            text += f" LIMIT {k}"
        if s.offset is not None and (m := self._constant(s.offset)) and m > 0:
            text += f" OFFSET {m}"
        return text

    def _constant(self, e) -> int | None:
        if isinstance(e, n.Param):
            return None if self.params[e.number - 1] is None else int(self.params[e.number - 1])
        if isinstance(e, n.Literal) and (e.value is None or isinstance(e.value, int | float)):
            return None if e.value is None else int(e.value)
        if isinstance(e, n.Unary) and e.sign in "+-":
            k = self._constant(e.of)
            return k if k is None or e.sign == "+" else -k
        if isinstance(e, n.Binary) and e.sign in "+-*":
            a, b = self._constant(e.left), self._constant(e.right)
            return None if a is None or b is None else {"+": a + b, "-": a - b, "*": a * b}[e.sign]
        raise UnsupportedError("LIMIT and OFFSET take constants")

    def _ordering(self, order: tuple, core: n.Core | None, columns: list, scope: Scope, aggregated: bool) -> str:
        if not order:
            return ""
        parts = []
        names = [c.lower() for c, _ in columns]
        for o in order:
            of = o.of
            if isinstance(of, n.Literal) and isinstance(of.value, int):
                if not 1 <= of.value <= len(columns):
                    raise BindError(f"ORDER BY {of.value} of {len(columns)} columns")
                sql = str(of.value)
            elif isinstance(of, n.Column) and of.table is None and of.name.lower() in names and names.count(of.name.lower()) == 1:
                sql = quoted(columns[names.index(of.name.lower())][0])
            else:
                place = next((i for i, item in enumerate(core.items) if item.of == of), None) if core is not None and all(i.of is not None for i in core.items) else None
                if place is not None:
                    sql = str(place + 1)
                else:
                    sql = self.value(of, scope, core if aggregated else None).sql
            parts.append(sql + (" DESC" if o.descending else "") + (f" NULLS {o.nulls.upper()}" if o.nulls else ""))
        return " ORDER BY " + ", ".join(parts)

    def _core(self, core: n.Core, outer: Scope | None) -> tuple[str, list[tuple[str, str]], Scope, bool]:
        text, scope = self._from(core, outer)
        aggregated = core.group is not None or any(_aggregates(i.of) for i in core.items) or _aggregates(core.having)
        group: list[str] = []
        if core.group is not None:
            core = _grouped(core)
            for g in core.group:
                group.append(self.value(g, scope).sql)
        within = core if aggregated else None
        out, columns = [], []
        for item in core.items:
            if item.of is None:
                for sql, name, kind in self._star(item.star_of, scope):
                    if within is not None and n.Column(name) not in within.group_set():
                        sql = self._first(sql, name, scope)
                    out.append(f"{sql} AS {quoted(name)}")
                    columns.append((name, kind))
                continue
            x = self.value(item.of, scope, within)
            name = item.alias or _default_name(item.of)
            out.append(f"{x.sql} AS {quoted(name)}")
            columns.append((name, x.type))
        if not out:
            raise BindError("no columns to select")
        sql = f"SELECT {'DISTINCT ' if core.distinct else ''}{', '.join(out)}{text}"
        if core.where is not None:
            if _aggregates(core.where):
                raise BindError("aggregates do not stand in WHERE")
            sql += f" WHERE {self.truth(core.where, scope)}"
        if core.group is not None:
            listed = ", ".join(group)
            sql += f" GROUP BY {core.grouping.upper()}({listed})" if core.grouping else f" GROUP BY {listed}"
        if core.having is not None and aggregated:
            sql += f" HAVING {self.truth(core.having, scope, within)}"
        return sql, columns, scope, aggregated

    def _from(self, core: n.Core, outer: Scope | None) -> tuple[str, Scope]:
        if core.first is None:
            return "", Scope([], outer)
        text, source = self._source(core.first, outer)
        scope = Scope([source], outer)
        for join in core.joins:
            right, source = self._source(join.right, outer)
            if any(s.alias.lower() == source.alias.lower() for s in scope.sources):
                raise BindError(f"{source.alias} stands twice in FROM; give it an alias")
            using = join.using
            if join.natural:
                mine = {c.lower() for s in scope.sources for c, _ in s.columns}
                using = tuple(c for c, _ in source.columns if c.lower() in mine)
            kind = join.kind
            if using:
                conds, merged = [], {}
                for c in using:
                    left, lt = self._bare(c, Scope(scope.sources, None, scope.merged))
                    rt = dict((k.lower(), t) for k, t in source.columns).get(c.lower())
                    if rt is None:
                        raise BindError(f"{source.alias} has no column {c}")
                    there = f"{quoted(source.alias)}.{quoted(c)}"
                    conds.append(self._compare("=", X(left, lt), X(fn.widened(there, rt), rt)))
                    both = there if kind == "right" else f"coalesce({left}, {there})" if kind == "full" else left
                    merged[c.lower()] = (both, lt)
                    source.hidden.add(c.lower())
                scope.sources.append(source)
                scope.merged |= merged
                on = " AND ".join(conds)
            else:
                scope.sources.append(source)
                on = self.truth(join.on, scope) if join.on is not None else ""
            word = {"inner": "JOIN", "cross": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}[kind]
            if not on:
                word, on = ("CROSS JOIN", "") if kind in ("inner", "cross") else (word, "true")
            text += f" {word} {right}" + (f" ON {on}" if on else "")
        return " FROM " + text, scope

    def _source(self, ref, outer: Scope | None) -> tuple[str, Source]:
        if isinstance(ref, n.Derived):
            sql, columns = self.select(ref.select, None)
            columns = _unique(columns)
            return f"({sql}) AS {quoted(ref.alias)}({', '.join(quoted(c) for c, _ in columns)})", Source(ref.alias, columns)
        table = None
        for level in reversed(self.ctes):
            if table := level.get(ref.name.lower()):
                break
        table = table or self.resolve(ref.name.lower())
        if table is None:
            raise BindError(f"no such table: {ref.name}")
        alias = ref.alias or ref.name
        return f"{table.sql} AS {quoted(alias)}", Source(alias, table.columns, table.rowid)

    def _star(self, of: str | None, scope: Scope):
        found = False
        for s in scope.sources:
            if of is not None and s.alias.lower() != of.lower():
                continue
            found = True
            for c, t in s.columns:
                if of is None and c.lower() in s.hidden:
                    continue
                if of is None and c.lower() in scope.merged:
                    sql, t = scope.merged[c.lower()]
                    yield sql, c, t
                else:
                    yield fn.widened(f"{quoted(s.alias)}.{quoted(c)}", t), c, fn.narrow(t)
        if not found:
            raise BindError(f"no such table: {of}" if of else "no tables to select from")

    # columns

    def _bare(self, name: str, scope: Scope) -> tuple[str, str]:
        low = name.lower()
        if low in scope.merged:
            return scope.merged[low]
        hits = [(s, c, t) for s in scope.sources for c, t in s.columns if c.lower() == low and low not in s.hidden]
        if len(hits) > 1:
            raise BindError(f"ambiguous column: {name}")
        if hits:
            s, c, t = hits[0]
            return fn.widened(f"{quoted(s.alias)}.{quoted(c)}", t), fn.narrow(t)
        if low in ROWID:
            with_id = [s for s in scope.sources if s.rowid]
            if len(with_id) == 1:
                return f"{quoted(with_id[0].alias)}.`_rowid_`", INT
        if scope.outer is not None:
            return self._bare(name, scope.outer)
        raise BindError(f"no such column: {name}")

    def _column(self, e: n.Column, scope: Scope) -> X:
        if e.table is None:
            return X(*self._bare(e.name, scope))
        at: Scope | None = scope
        while at is not None:
            for s in at.sources:
                if s.alias.lower() == e.table.lower():
                    for c, t in s.columns:
                        if c.lower() == e.name.lower():
                            return X(fn.widened(f"{quoted(s.alias)}.{quoted(c)}", t), fn.narrow(t))
                    if e.name.lower() in ROWID and s.rowid:
                        return X(f"{quoted(s.alias)}.`_rowid_`", INT)
                    raise BindError(f"no such column: {e.table}.{e.name}")
            at = at.outer
        raise BindError(f"no such table: {e.table}")

    def _first(self, sql: str, name: str, scope: Scope) -> str:
        """The value in a group's first row: by row id where the table has one."""
        with_id = [s for s in scope.sources if s.rowid]
        if len(with_id) == 1 and len(scope.sources) == 1:
            return f"min_by({sql}, {quoted(with_id[0].alias)}.`_rowid_`)"
        return f"first({sql})"

    # expressions

    def value(self, e, scope: Scope, within: n.Core | None = None) -> X:
        """An expression as a value: booleans are 0 and 1."""
        x = self.any(e, scope, within)
        return X(f"CAST({x.sql} AS BIGINT)", INT) if x.type == BOOL else x

    def truth(self, e, scope: Scope, within: n.Core | None = None) -> str:
        return fn.truth(*self._pair(self.any(e, scope, within)))

    @staticmethod
    def _pair(x: X) -> tuple[str, str]:
        return x.sql, x.type

    def any(self, e, scope: Scope, within: n.Core | None = None) -> X:
        if within is not None and within.group is not None and e in within.group_set():
            return self.any(e, scope)
        match e:
            case n.Literal():
                return _literal(e.value)
            case n.Param():
                if e.number > len(self.params):
                    raise BindError(f"no value for parameter {e.number}")
                return _literal(self.params[e.number - 1])
            case n.Now():
                return X(fn.now(e.what), TEXT)
            case n.Column():
                x = self._column(e, scope)
                local = any(e.table is None or s.alias.lower() == e.table.lower() for s in scope.sources)
                if within is not None and local and not _in_outer(e, scope):
                    return X(self._first(x.sql, e.name, scope), x.type)
                return x
            case n.Unary():
                return self._unary(e, scope, within)
            case n.Binary():
                return self._binary(e, scope, within)
            case n.IsNull():
                x = self.any(e.of, scope, within)
                return X(f"({x.sql} IS {'NOT ' if e.negated else ''}NULL)", BOOL)
            case n.Between():
                of, low, high = (self.value(a, scope, within) for a in (e.of, e.low, e.high))
                sql = f"({self._compare('>=', of, low)} AND {self._compare('<=', of, high)})"
                return X(f"(NOT {sql})" if e.negated else sql, BOOL)
            case n.InList():
                of = self.value(e.of, scope, within)
                if not e.items:
                    return X("true" if e.negated else "false", BOOL)
                sql = "(" + " OR ".join(self._compare("=", of, self.value(i, scope, within)) for i in e.items) + ")"
                same = [self.value(i, scope, within) for i in e.items]
                if all(fn.comparable(of.type, s.type) for s in same):
                    sql = f"({of.sql} IN ({', '.join(s.sql for s in same)}))"
                return X(f"(NOT {sql})" if e.negated else sql, BOOL)
            case n.InSelect():
                of = self.value(e.of, scope, within)
                sql, columns = self.select(e.select, scope)
                if len(columns) != 1:
                    raise BindError("IN takes a select of one column")
                if not fn.comparable(of.type, columns[0][1]):
                    sql = f"SELECT CAST(NULL AS {fn.SPARK.get(of.type, 'STRING')}) FROM ({sql}) WHERE false"
                return X(f"({of.sql} {'NOT ' if e.negated else ''}IN ({sql}))", BOOL)
            case n.Exists():
                sql, _ = self.select(e.select, scope)
                return X(f"({'NOT ' if e.negated else ''}EXISTS ({sql}))", BOOL)
            case n.Scalar():
                return self._scalar(e, scope)
            case n.Match():
                of, pattern = self.value(e.of, scope, within), self.value(e.pattern, scope, within)
                escape = e.escape.value if isinstance(e.escape, n.Literal) else None
                if e.escape is not None and not (isinstance(escape, str) and len(escape) == 1):
                    raise UnsupportedError("ESCAPE takes one character")
                if e.kind == "like":
                    sql = fn.like(fn.text(*self._pair(of)), fn.text(*self._pair(pattern)), escape)
                else:
                    constant = e.pattern.value if isinstance(e.pattern, n.Literal) and isinstance(e.pattern.value, str) else None
                    sql = fn.glob(fn.text(*self._pair(of)), fn.text(*self._pair(pattern)), constant)
                return X(f"(NOT {sql})" if e.negated else sql, BOOL)
            case n.Case():
                return self._case(e, scope, within)
            case n.Cast():
                return X(*fn.cast(*self._pair(self.value(e.of, scope, within)), e.type))
            case n.Collate():
                x = self.any(e.of, scope, within)
                if e.name.lower() == "nocase" and x.type == TEXT:
                    return X(f"collate({x.sql}, 'UTF8_LCASE')", TEXT)
                return x
            case n.Call():
                return self._call(e, scope, within)
        raise UnsupportedError(f"{type(e).__name__} as an expression")

    def _scalar(self, e: n.Scalar, scope: Scope) -> X:
        sql, columns = self.select(e.select, scope)
        if len(columns) != 1:
            raise BindError("a scalar subquery has one column")
        s = e.select
        one = not s.compound and s.core.group is None and all(_aggregates(i.of) for i in s.core.items)
        if not one and s.limit is None:
            # the first row; an outer reference below LIMIT would not decorrelate, so a correlated one takes any
            if _correlated(s, self, scope):
                name = quoted(columns[0][0])
                if not s.order and not s.compound and not s.core.distinct and s.core.grouping == "" and len(s.core.items) == 1:
                    sql = self.select(n.Select(n.Core((n.Item(n.Call("first", (s.core.items[0].of,)), "v"),), s.core.first, s.core.joins, s.core.where)), scope)[0]
                else:
                    sql = f"SELECT first({name}) FROM ({sql})"
            else:
                sql += " LIMIT 1"
        return X(f"({sql})", columns[0][1])

    def _unary(self, e: n.Unary, scope: Scope, within: n.Core | None) -> X:
        if e.sign == "not":
            return X(f"(NOT {self.truth(e.of, scope, within)})", BOOL)
        x = self.value(e.of, scope, within)
        if e.sign == "+":
            return x
        if x.type == NULL:
            return x
        if e.sign == "~":
            return X(f"(~{x.sql})" if x.type == INT else f"CASE WHEN {x.sql} IS NULL THEN NULL ELSE 0L END", INT)
        if x.type in (INT, REAL):
            return X(f"(-{x.sql})", x.type)
        return X(f"CASE WHEN {x.sql} IS NULL THEN NULL ELSE 0L END", INT)

    def _binary(self, e: n.Binary, scope: Scope, within: n.Core | None) -> X:
        if e.sign in ("and", "or"):
            return X(f"({self.truth(e.left, scope, within)} {e.sign.upper()} {self.truth(e.right, scope, within)})", BOOL)
        a, b = self.value(e.left, scope, within), self.value(e.right, scope, within)
        if e.sign in ("=", "<>", "<", "<=", ">", ">="):
            return X(self._compare(e.sign, a, b), BOOL)
        if e.sign in ("is", "is not"):
            same = f"({a.sql} <=> {b.sql})" if fn.comparable(a.type, b.type) else f"({a.sql} IS NULL AND {b.sql} IS NULL)"
            return X(f"(NOT {same})" if e.sign == "is not" else same, BOOL)
        return X(*fn.arithmetic(e.sign, a.sql, a.type, b.sql, b.type))

    def _compare(self, sign: str, a: X, b: X) -> str:
        return fn.compare(sign, a.sql, a.type, b.sql, b.type)

    def _case(self, e: n.Case, scope: Scope, within: n.Core | None) -> X:
        of = self.value(e.of, scope, within) if e.of is not None else None
        arms, results = [], []
        for cond, then in e.arms:
            test = self._compare("=", of, self.value(cond, scope, within)) if of is not None else self.truth(cond, scope, within)
            x = self.value(then, scope, within)
            arms.append((test, x))
            results.append(x.type)
        other = self.value(e.other, scope, within) if e.other is not None else X("NULL", NULL)
        kind = other.type
        for t in results:
            kind = _common(kind, t)
        parts = " ".join(f"WHEN {t} THEN {_as(x, kind)}" for t, x in arms)
        return X(f"CASE {parts} ELSE {_as(other, kind)} END", kind)

    def _call(self, e: n.Call, scope: Scope, within: n.Core | None) -> X:
        aggregate = e.name in AGGREGATES and not (e.name in ("min", "max") and len(e.args) > 1)
        if e.over is not None:
            return self._window(e, scope, within)
        if e.name == "first":
            x = self.value(e.args[0], scope)
            return X(f"first({x.sql})", x.type)
        if aggregate:
            if within is None and not e.star and e.args == () and e.name != "count":
                raise BindError(f"{e.name} takes an argument")
            if any(_aggregates(a) for a in e.args):
                raise BindError(f"an aggregate inside {e.name}")
            where = f" FILTER (WHERE {self.truth(e.where, scope)})" if e.where is not None else ""
            args = [self.value(a, scope) for a in e.args]
            order = next((f"{quoted(s.alias)}.`_rowid_`" for s in scope.sources if s.rowid and len(scope.sources) == 1), None)
            return X(*fn.aggregate(e.name, e.star, e.distinct, [self._pair(a) for a in args], where, order))
        args = [self.value(a, scope, within) for a in e.args]
        truths = [self.truth(e.args[0], scope, within)] if e.name == "iif" and e.args else []
        constants = [a.value if isinstance(a, n.Literal) else None for a in e.args]
        return X(*fn.scalar(e.name, [self._pair(a) for a in args], constants, truths))

    def _window(self, e: n.Call, scope: Scope, within: n.Core | None) -> X:
        args = [self.value(a, scope, within) for a in e.args]
        if e.name in WINDOW_ONLY:
            kind = INT if e.name in ("row_number", "rank", "dense_rank", "ntile") else REAL if e.name in ("percent_rank", "cume_dist") else args[0].type
            plain = ("ntile", "lag", "lead", "nth_value")
            texts = [f"CAST({a.sql} AS INT)" if e.name in plain and (e.name == "ntile" or i == 1) else a.sql for i, a in enumerate(args)]
            call = f"{e.name}({', '.join(texts)})"
        elif e.name in AGGREGATES:
            call, kind = fn.aggregate(e.name, e.star, e.distinct, [self._pair(a) for a in args], "", None)
        else:
            raise BindError(f"{e.name} is not a window function")
        parts = []
        if e.over.partition:
            parts.append("PARTITION BY " + ", ".join(self.value(p, scope, within).sql for p in e.over.partition))
        if e.over.order:
            parts.append("ORDER BY " + ", ".join(self.value(o.of, scope, within).sql + (" DESC" if o.descending else "") + (f" NULLS {o.nulls.upper()}" if o.nulls else "") for o in e.over.order))
        if e.over.frame:
            parts.append(e.over.frame.upper())
        sql = f"{call} OVER ({' '.join(parts)})"
        return X(f"CAST({sql} AS BIGINT)" if kind == INT else sql, kind)


def _literal(v) -> X:
    if v is None:
        return X("NULL", NULL)
    if isinstance(v, bool):
        return X(f"{int(v)}L", INT)
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            return X(f"{float(v)!r}D", REAL)
        return X(f"{v}L" if v > -(1 << 63) else "CAST('-9223372036854775808' AS BIGINT)", INT)
    if isinstance(v, float):
        return X(f"CAST('{'Infinity' if v > 0 else '-Infinity'}' AS DOUBLE)" if math.isinf(v) else f"{v!r}D", REAL)
    if isinstance(v, bytes):
        return X(f"X'{v.hex()}'", BLOB)
    return X(literal(str(v)), TEXT)


def _as(x: X, kind: str) -> str:
    if x.type == kind or x.type == NULL or kind not in fn.SPARK:
        return x.sql
    return f"CAST({x.sql} AS {fn.SPARK[kind]})"


def _common(a: str, b: str) -> str:
    if a == b or b == NULL:
        return a
    if a == NULL:
        return b
    if {a, b} <= {INT, REAL, BOOL}:
        return REAL if REAL in (a, b) else INT
    if {a, b} <= {INT, REAL, BOOL, TEXT}:
        return TEXT
    return OTHER


def _unique(columns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Names that differ, also in upper and lower case."""
    seen: set[str] = set()
    out = []
    for c, t in columns:
        name, k = c, 1
        while name.lower() in seen:
            name, k = f"{c}:{k}", k + 1
        seen.add(name.lower())
        out.append((name, t))
    return out


def _default_name(e) -> str:
    match e:
        case n.Column():
            return f"{e.table}.{e.name}" if e.table else e.name
        case n.Literal(value=None):
            return "NULL"
        case n.Literal(value=bytes()):
            return "?"
        case n.Literal():
            return str(e.value)
        case n.Call():
            return f"{e.name}(...)" if e.args or e.star else f"{e.name}()"
    return "?"


def children(e):
    """Direct parts of an expression, without going into selects."""
    match e:
        case n.Unary() | n.IsNull() | n.Cast() | n.Collate():
            return [e.of]
        case n.Binary():
            return [e.left, e.right]
        case n.Between():
            return [e.of, e.low, e.high]
        case n.InList():
            return [e.of, *e.items]
        case n.InSelect():
            return [e.of]
        case n.Match():
            return [e.of, e.pattern]
        case n.Case():
            return [x for x in (e.of, *(p for arm in e.arms for p in arm), e.other) if x is not None]
        case n.Call():
            over = [*e.over.partition, *(o.of for o in e.over.order)] if e.over is not None else []
            return [*e.args, *over]
    return []


def _aggregates(e) -> bool:
    if isinstance(e, n.Call) and e.over is None and e.name in AGGREGATES | {"first"} and not (e.name in ("min", "max") and len(e.args) > 1):
        return True
    return any(_aggregates(c) for c in children(e))


def _grouped(core: n.Core) -> n.Core:
    """GROUP BY ordinals and aliases become the expressions that they stand for."""
    out = []
    names = {i.alias.lower(): i.of for i in core.items if i.alias and i.of is not None}
    for g in core.group:
        if isinstance(g, n.Literal) and isinstance(g.value, int):
            if not 1 <= g.value <= len(core.items) or core.items[g.value - 1].of is None:
                raise BindError(f"GROUP BY {g.value}")
            g = core.items[g.value - 1].of
        elif isinstance(g, n.Column) and g.table is None and g.name.lower() in names and not isinstance(names[g.name.lower()], n.Column):
            g = names[g.name.lower()]
        out.append(g)
    return n.Core(core.items, core.first, core.joins, core.where, tuple(out), core.having, core.distinct, core.grouping)


def _group_set(core: n.Core) -> set:
    out = set(core.group or ())
    for g in core.group or ():
        if isinstance(g, n.Column) and g.table is not None:
            out.add(n.Column(g.name))
        elif isinstance(g, n.Column):
            sources = [core.first, *(j.right for j in core.joins)]
            out |= {n.Column(g.name, s.alias or getattr(s, "name", None)) for s in sources if s is not None}
    return out


n.Core.group_set = _group_set


def _in_outer(e: n.Column, scope: Scope) -> bool:
    """Whether a column is none of the scope's own."""
    for s in scope.sources:
        if (e.table is None or s.alias.lower() == e.table.lower()) and (any(c.lower() == e.name.lower() for c, _ in s.columns) or s.rowid and e.name.lower() in ROWID):
            return False
    return e.name.lower() not in scope.merged


def _mentions(s: n.Select, name: str) -> bool:
    def in_source(r) -> bool:
        return r.name.lower() == name.lower() if isinstance(r, n.TableRef) else isinstance(r, n.Derived) and _mentions(r.select, name)

    return any(in_source(r) for c in (s.core, *(c for _, c in s.compound)) for r in (c.first, *(j.right for j in c.joins)) if r is not None)


def _correlated(s: n.Select, t: Translator, scope: Scope) -> bool:
    """Whether a select refers to columns outside: it does not bind alone."""
    try:
        t.select(s, None)
    except BindError:
        return True
    return False
