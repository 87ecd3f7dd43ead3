"""A session: the dialect's statements over managed tables and attached files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .errors import BindError, ConstraintError, EngineError, ParseError, UnsupportedError
from .functions import dialect as fn
from .introspect import explain_rows, plan_rows, pragma_rows
from .operators.recursive import fixed_point
from .sql import lexer, nodes as n
from .sql.parser import Parser, parse
from .sql.translate import Table as Named
from .sql.translate import Translator, quoted
from .storage.catalog import Catalog, Column, Index, Table
from .storage.files import shared_root

#: Levels of a recursive query; more is an error.
RECURSION = 1000


class Session:
    """``execute`` runs one statement: a query gives a DataFrame, a write the number of changed rows, others None.

    ``root`` is the folder of the database, on any file system that Spark writes to; without it a new one is made in
    the shared folder, for a database as long as the process.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = root or f"{shared_root(spark)}/database-{uuid.uuid4().hex}"
        self.catalog = Catalog(spark, self.root)
        self.attached: dict[str, Named] = {}
        self.waiting: dict[str, Callable[[], DataFrame]] = {}
        self.id = uuid.uuid4().hex[:8]
        self.last_rowid = self.last_changes = self.total_changes = 0
        spark.conf.set("spark.sql.cteRecursionLevelLimit", str(RECURSION))
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")

    # tables in names

    def attach(self, name: str, df: DataFrame) -> None:
        """A DataFrame as a read-only table."""
        view = f"lq_{self.id}_{name.lower()}"
        df.createOrReplaceTempView(view)
        self.attached[name.lower()] = Named(quoted(view), [(f.name, fn.of_spark(f.dataType.simpleString())) for f in df.schema.fields])

    def attach_lazily(self, name: str, load: Callable[[], DataFrame]) -> None:
        """As attach(), but loaded when a query first names the table."""
        self.waiting[name.lower()] = load

    def foreign(self) -> list[str]:
        """Names of attached tables."""
        return sorted({*self.attached, *self.waiting})

    def resolve(self, name: str) -> Named | None:
        if (t := self.catalog.tables.get(name)) is not None:
            view = f"lq_{self.id}_{name}_{(t.version or 'empty').rsplit('/', 1)[-1]}_{len(t.columns)}"
            self.catalog.read(t).createOrReplaceTempView(view)
            return Named(quoted(view), [(c.name, c.type) for c in t.columns], rowid=True)
        if name in ("schema_table", "sqlite_master", "sqlite_schema"):
            rows = [("table", t.name, t.name, t.sql) for t in self.catalog.tables.values()] + [("index", i.name, i.table, i.sql) for i in self.catalog.indexes.values()]
            view = f"lq_{self.id}_schema"
            self.spark.createDataFrame(rows, "type string, name string, tbl_name string, sql string").createOrReplaceTempView(view)
            return Named(quoted(view), [(c, fn.TEXT) for c in ("type", "name", "tbl_name", "sql")])
        if name in self.waiting:
            self.attach(name, self.waiting.pop(name)())
        return self.attached.get(name)

    def _translator(self, params: tuple = ()) -> Translator:
        return Translator(self.resolve, params, self._recurse)

    def _recurse(self, base: str, columns: list, step) -> Named:
        """WITH RECURSIVE ... UNION: the fixed point of a step over the rows that are new."""
        schema = T.StructType([T.StructField(c, T.StructType() if t not in fn.SPARK else T._parse_datatype_string(fn.SPARK[t])) for c, t in columns])
        count = iter(range(RECURSION + 1))

        def following(new: DataFrame) -> DataFrame:
            view = f"lq_{self.id}_step_{next(count)}"
            new.createOrReplaceTempView(view)
            got = self.spark.sql(step(Named(quoted(view), columns)))
            return got.toDF(*[c for c, _ in columns]).select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema])

        first = self.spark.sql(base).toDF(*[c for c, _ in columns]).select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema])
        view = f"lq_{self.id}_fixed_{uuid.uuid4().hex[:8]}"
        fixed_point(first, following, RECURSION).createOrReplaceTempView(view)
        return Named(quoted(view), columns)

    # statements

    def sql_of(self, text: str, params: tuple = ()) -> str:
        """The Spark SQL of a query."""
        s = parse(text)
        if not isinstance(s, n.Select):
            raise UnsupportedError("not a query")
        return self._translator(params).select(s)[0]

    def execute(self, text: str, params: tuple = ()) -> DataFrame | int | None:
        return self.run(Parser(text).statement(), text, params)

    def script(self, text: str) -> list:
        """The results of all statements of a script."""
        return [self.execute(s) for s in lexer.statements(text)]

    def run(self, s, text: str, params: tuple = ()):
        match s:
            case n.Select():
                return self._query(s, params)
            case n.Explain():
                rows = plan_rows(self, s.of) if s.plan else explain_rows(self, s.of)
                names = "id int, parent int, notused int, detail string" if s.plan else "addr int, opcode string, p1 int, p2 int, p3 int, p4 string, p5 int, comment string"
                return self.spark.createDataFrame(rows, names)
            case n.Pragma():
                return pragma_rows(self, s)
            case n.Transaction():
                getattr(self.catalog, s.action)()
                return None
        state = self.catalog.state()
        try:
            out = self._write(s, text, params)
            self.catalog.save()
            return out
        except Exception:
            self.catalog.restore(state)
            raise

    def _query(self, s: n.Select, params: tuple) -> DataFrame:
        sql, columns = self._translator(params).select(s)
        names = [c for c, _ in columns]
        if len({c.lower() for c in names}) == len(names):
            return self.spark.sql(sql)
        return self.spark.sql(sql).toDF(*names)

    def _write(self, s, text: str, params: tuple):
        match s:
            case n.Insert():
                return self._counted(self._insert(s, params))
            case n.Update():
                return self._counted(self._update(s, params))
            case n.Delete():
                return self._counted(self._delete(s, params))
            case n.CreateTable():
                return self._create_table(s, text)
            case n.CreateIndex():
                return self._create_index(s, text)
            case n.Drop():
                return self._drop(s)
            case n.Alter():
                return self._alter(s)
        raise UnsupportedError(type(s).__name__)

    def _counted(self, changed: int) -> int:
        self.last_changes = changed
        self.total_changes += changed
        return changed

    # definitions

    def _create_table(self, s: n.CreateTable, text: str) -> None:
        low = s.name.lower()
        if low in self.catalog.tables:
            if s.if_not_exists:
                return
            raise BindError(f"table {s.name} already exists")
        if not s.columns or len({c.name.lower() for c in s.columns}) < len(s.columns):
            raise BindError(f"columns of {s.name} are missing or stand twice")
        t = Table(s.name, [], " ".join(text.split()), foreign=s.foreign + [c.references for c in s.columns if c.references])
        for c in s.columns:
            column = Column(c.name, c.type, fn.affinity(c.type), c.not_null, None if c.default is None else _source_text(c.default))
            if c.primary:
                if c.type.upper() == "INTEGER":
                    t.key, t.autoincrement = c.name, c.autoincrement
                else:
                    column.not_null = True
                    t.uniques.append([c.name])
                t.primary = [c.name]
            if c.unique:
                t.uniques.append([c.name])
            t.columns.append(column)
        if s.primary:
            t.primary = s.primary
            t.uniques.append(s.primary)
            for c in s.primary:
                t.column(c).not_null = True
        t.uniques += s.uniques
        for columns in t.uniques:
            for c in columns:
                t.column(c)
        t.checks = [text for _, text in s.checks]
        self.catalog.tables[low] = t

    def _create_index(self, s: n.CreateIndex, text: str) -> None:
        if s.name.lower() in self.catalog.indexes:
            if s.if_not_exists:
                return
            raise BindError(f"index {s.name} already exists")
        t = self.catalog.table(s.table)
        columns = [t.column(c).name for c in s.columns]
        if s.unique:
            self._check_unique(self.catalog.read(t), t, [columns])
        self.catalog.indexes[s.name.lower()] = Index(s.name, t.name, columns, s.unique, " ".join(text.split()))

    def _drop(self, s: n.Drop) -> None:
        held = self.catalog.tables if s.kind == "table" else self.catalog.indexes
        if s.name.lower() not in held:
            if s.if_exists:
                return
            raise BindError(f"no such {s.kind}: {s.name}")
        gone = held.pop(s.name.lower())
        if s.kind == "table":
            self.catalog.indexes = {k: i for k, i in self.catalog.indexes.items() if i.table.lower() != gone.name.lower()}

    def _alter(self, s: n.Alter) -> None:
        t = self.catalog.table(s.table)
        if s.action == "rename":
            if s.to.lower() in self.catalog.tables:
                raise BindError(f"table {s.to} already exists")
            for i in self.catalog.indexes.values():
                if i.table.lower() == t.name.lower():
                    i.table = s.to
            self.catalog.tables.pop(t.name.lower())
            t.name = s.to
            self.catalog.tables[s.to.lower()] = t
            return
        df = self.catalog.read(t)
        if s.action == "add":
            c = s.column
            if any(x.name.lower() == c.name.lower() for x in t.columns):
                raise BindError(f"column {c.name} already exists")
            if c.not_null and c.default is None and t.rows:
                raise ConstraintError(f"NOT NULL column {c.name} has no default")
            t.columns.append(Column(c.name, c.type, fn.affinity(c.type), c.not_null, None if c.default is None else _source_text(c.default)))
            # old rows read null, without being written again; NOT NULL needs the default in them
            if c.not_null and c.default is not None and t.rows:
                value = self._constant(c.default, fn.affinity(c.type))
                self._store(t, df.withColumn(c.name, value), t.rows)
            return
        old = t.column(s.name)
        if s.action == "rename_column":
            if any(x.name.lower() == s.to.lower() for x in t.columns):
                raise BindError(f"column {s.to} already exists")
            df, name = df.withColumnRenamed(old.name, s.to), old.name
            for columns in [*t.uniques, t.primary, *(i.columns for i in self.catalog.indexes.values() if i.table.lower() == t.name.lower())]:
                columns[:] = [s.to if c.lower() == name.lower() else c for c in columns]
            t.key = s.to if t.key == name else t.key
            t.checks = [_renamed(c, name, s.to) for c in t.checks]
            old.name = s.to
        else:
            if len(t.columns) == 1 or old.name in t.primary or any(old.name.lower() in map(str.lower, u) for u in self.catalog.uniques(t)):
                raise BindError(f"cannot drop column {old.name}")
            df = df.drop(old.name)
            t.columns.remove(old)
        self._store(t, df, t.rows)

    def _constant(self, e, kind: str):
        x = self._translator().value(e, _no_scope())
        return F.expr(fn.stored(x.sql, x.type, kind))

    # writes

    def _store(self, t: Table, df: DataFrame, rows: int | None = None) -> None:
        """A new version of a table."""
        name = f"tables/{t.name.lower()}/{uuid.uuid4().hex}"
        df.select("_rowid_", *[quoted(c.name) for c in t.columns]).write.parquet(f"{self.catalog.files.root}/{name}")
        t.version = name
        t.rows = self.catalog.read(t).count() if rows is None else rows

    def _insert(self, s: n.Insert, params: tuple) -> int:
        t = self.catalog.table(s.table)
        names = [t.column(c).name for c in s.columns] if s.columns else [c.name for c in t.columns]
        if s.rows is not None and s.rows != [()] and any(len(r) != len(names) for r in s.rows):
            raise BindError(f"{len(names)} columns, but rows of {s.rows[0] and len(s.rows[0])} values")
        tr = self._translator(params)
        if s.select is not None:
            sql, got = tr.select(s.select)
            if len(got) != len(names):
                raise BindError(f"{len(names)} columns, but a select of {len(got)}")
            source = self.spark.sql(sql).toDF(*[f"c{i}" for i in range(len(got))])
            source = source.withColumn("_at", F.monotonically_increasing_id())
            kinds = [k for _, k in got]
        elif s.rows == [()]:
            names, kinds, source = [], [], self.spark.range(1).select(F.col("id").alias("_at"))
        else:
            kinds = [t.column(c).type for c in names]
            rows = []
            for at, row in enumerate(s.rows):
                values = [tr.value(v, _no_scope()) for v in row]
                rows.append("(" + ", ".join([f"{at}L", *(fn.stored(x.sql, x.type, k) for x, k in zip(values, kinds, strict=True))]) + ")")
            labels = ", ".join(["_at", *(f"c{i}" for i in range(len(names)))])
            source = self.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v({labels})")
        given = {c.lower(): f"c{i}" for i, c in enumerate(names)}
        columns = []
        for c in t.columns:
            if (at := given.get(c.name.lower())) is not None:
                columns.append(F.expr(fn.stored(quoted(at), fn.narrow(kinds[int(at[1:])]), c.type)).cast(fn.SPARK[c.type]).alias(c.name))
            elif c.default is not None:
                columns.append(self._constant(Parser(c.default).expression(), c.type).cast(fn.SPARK[c.type]).alias(c.name))
            else:
                columns.append(F.lit(None).cast(fn.SPARK[c.type]).alias(c.name))
        new = source.select("_at", *columns)
        old = self.catalog.read(t)
        new = self._with_ids(t, old, new)
        self._check_rows(t, new.drop("_at"))
        keys = ([["_rowid_"]] if t.key else []) + self.catalog.uniques(t)
        before = t.rows
        if s.conflict in ("replace", "ignore") and keys:
            new, old = self._conflicts(s.conflict, keys, new, old)
        else:
            both = old.select("_rowid_", *[quoted(c.name) for c in t.columns]).unionByName(new.drop("_at"))
            self._check_unique(both, t, keys)
        new = new.drop("_at")
        added = new.count()
        self._store(t, old.unionByName(new), None if s.conflict == "replace" else before + added)
        last = new.agg(F.max("_rowid_")).first()[0]
        if last is not None:
            self.last_rowid = last
            t.sequence = max(t.sequence, last) if t.autoincrement else t.sequence
        return added

    def _with_ids(self, t: Table, old: DataFrame, new: DataFrame) -> DataFrame:
        """Row ids: the key where it is given, else numbers above all others, in the order of the rows."""
        top = (old.agg(F.max("_rowid_")).first()[0] or 0) if t.version else 0
        if t.autoincrement:
            top = max(top, t.sequence)
        if t.key:
            top = max(top, new.agg(F.max(quoted(t.key))).first()[0] or 0)
            missing = F.col(quoted(t.key)).isNull()
        else:
            missing = F.lit(True)
        numbered = _numbered(new.where(missing), top)
        given = new.where(~missing).withColumn("_rowid_", F.col(quoted(t.key))) if t.key else None
        out = numbered.withColumn(t.key, F.col("_rowid_")) if t.key else numbered
        return out.unionByName(given) if given is not None else out

    def _conflicts(self, how: str, keys: list[list[str]], new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
        for columns in keys:
            cols = [F.col(quoted(c)) for c in columns]
            whole = cols[0].isNotNull()
            for c in cols[1:]:
                whole = whole & c.isNotNull()
            order = F.col("_at").desc() if how == "replace" else F.col("_at")
            ranked = new.withColumn("_k", F.when(whole, F.row_number().over(Window.partitionBy(*cols).orderBy(order))).otherwise(1))
            new = ranked.where("_k = 1").drop("_k")
            named = [F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(columns)]
            left, right = (old, new) if how == "replace" else (new, old)
            other = right.select(*named).distinct()
            on = [F.col(quoted(c)) == F.col(f"_k{i}") for i, c in enumerate(columns)]
            kept = left.join(other, on, "left_anti")
            new, old = (new, kept) if how == "replace" else (kept, old)
        return new, old

    def _check_rows(self, t: Table, rows: DataFrame) -> None:
        """NOT NULL and CHECK of rows, counted in one job."""
        view = f"lq_{self.id}_rows"
        tests, labels = [], []
        scope_table = Named(quoted(view), [(c.name, c.type) for c in t.columns], rowid=True)
        for c in t.columns:
            if c.not_null and c.name != t.key:
                tests.append(f"{quoted(c.name)} IS NULL")
                labels.append(f"NOT NULL constraint failed: {t.name}.{c.name}")
        for check in t.checks:
            tr = Translator(lambda _: scope_table)
            core = n.Core((n.Item(n.Literal(1)),), n.TableRef(t.name))
            _, scope = tr._from(core, None)
            tests.append(f"NOT {tr.truth(Parser(check).expression(), scope)}")
            labels.append(f"CHECK constraint failed: {check}")
        if not tests:
            return
        rows.createOrReplaceTempView(view)
        sql = f"SELECT {', '.join(f'coalesce(bool_or({x}), false) AS t{i}' for i, x in enumerate(tests))} FROM {quoted(view)} AS {quoted(t.name)}"
        for bad, label in zip(self.spark.sql(sql).first(), labels, strict=True):
            if bad:
                raise ConstraintError(label)

    def _check_unique(self, rows: DataFrame, t: Table, keys: list[list[str]]) -> None:
        for columns in keys:
            cols = [quoted(c) for c in columns]
            twice = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in cols)).groupBy(*cols).count().where("count > 1")
            if not twice.isEmpty():
                names = [t.key if c == "_rowid_" and t.key else c for c in columns]
                raise ConstraintError(f"UNIQUE constraint failed: {', '.join(f'{t.name}.{c}' for c in names)}")

    def _marked(self, t: Table, where, params: tuple, more: list[str] = ()) -> tuple[str, Translator, object]:
        tr = self._translator(params)
        _, scope = tr._from(n.Core((n.Item(n.Literal(1)),), n.TableRef(t.name)), None)
        test = f"coalesce({tr.truth(where, scope)}, false)" if where is not None else "true"
        return test, tr, scope

    def _update(self, s: n.Update, params: tuple) -> int:
        t = self.catalog.table(s.table)
        test, tr, scope = self._marked(t, s.where, params)
        sets = {t.column(c).name: e for c, e in s.sets}
        out = []
        for c in t.columns:
            q = f"{quoted(t.name)}.{quoted(c.name)}"
            if c.name in sets:
                x = tr.value(sets[c.name], scope)
                out.append(f"CASE WHEN `_hit` THEN {fn.stored(x.sql, x.type, c.type)} ELSE {q} END AS {quoted(c.name)}")
            else:
                out.append(f"{q} AS {quoted(c.name)}")
        key = f"{quoted(t.name)}.`_rowid_`"
        if t.key in sets:
            x = tr.value(sets[t.key], scope)
            key = f"CASE WHEN `_hit` THEN {fn.stored(x.sql, x.type, fn.INT)} ELSE {key} END"
        table = self.resolve(t.name.lower())
        inner = f"SELECT {quoted(t.name)}.*, {test} AS `_hit` FROM {table.sql} AS {quoted(t.name)}"
        rows = self.spark.sql(f"SELECT {key} AS `_rowid_`, {', '.join(out)}, `_hit` FROM ({inner}) AS {quoted(t.name)}")
        if t.key in sets and not rows.where("_rowid_ is null").isEmpty():
            raise ConstraintError(f"NOT NULL constraint failed: {t.name}.{t.key}")
        self._check_rows(t, rows.where("_hit"))
        touched = {c.lower() for c in sets}
        keys = [k for k in ([["_rowid_"]] if t.key in sets else []) + self.catalog.uniques(t) if k == ["_rowid_"] or touched & {c.lower() for c in k}]
        self._check_unique(rows, t, keys)
        changed = rows.where("_hit").count()
        if changed:
            self._store(t, rows.drop("_hit"), t.rows)
        return changed

    def _delete(self, s: n.Delete, params: tuple) -> int:
        t = self.catalog.table(s.table)
        if s.where is None:
            gone, t.version, t.rows = t.rows, None, 0
            return gone
        test, _, _ = self._marked(t, s.where, params)
        table = self.resolve(t.name.lower())
        kept = self.spark.sql(f"SELECT * FROM (SELECT {quoted(t.name)}.*, {test} AS `_hit` FROM {table.sql} AS {quoted(t.name)}) WHERE NOT `_hit`").drop("_hit")
        before = t.rows
        self._store(t, kept)
        return before - t.rows


def _no_scope():
    from .sql.translate import Scope

    return Scope([])


def _numbered(df: DataFrame, top: int) -> DataFrame:
    """_rowid_ = top + 1, ... in the order of _at, without bringing all rows to one task.

    Rows are ranged over tasks and numbered within them; each task starts after the counts of those before.
    """
    ranged = df.repartitionByRange(F.col("_at")).sortWithinPartitions("_at").withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").count()
    starts = counts.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_s"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_at"))
    return ranged.withColumn("_n", within).join(starts, "_p").withColumn("_rowid_", F.lit(top) + F.col("_s") + F.col("_n")).drop("_p", "_n", "_s")


def _renamed(check: str, old: str, new: str) -> str:
    out, at = [], 0
    for t in lexer.tokens(check):
        if t.kind in ("word", "name") and t.text.lower() == old.lower():
            end = t.at + len(t.text) + (2 if t.kind == "name" else 0)
            out += [check[at : t.at], '"' + new.replace('"', '""') + '"']
            at = end
    return "".join(out) + check[at:]


def _source_text(e) -> str:
    """An expression as text of the dialect: defaults are kept so."""
    match e:
        case n.Literal(value=None):
            return "NULL"
        case n.Literal(value=str()):
            return "'" + e.value.replace("'", "''") + "'"
        case n.Literal(value=bytes()):
            return f"X'{e.value.hex()}'"
        case n.Literal():
            return repr(e.value)
        case n.Now():
            return f"CURRENT_{e.what.upper()}"
        case n.Unary():
            return f"({e.sign} {_source_text(e.of)})"
        case n.Binary():
            return f"({_source_text(e.left)} {e.sign} {_source_text(e.right)})"
        case n.Call():
            return f"{e.name}({', '.join(map(_source_text, e.args))})"
        case n.Column():
            return "'" + e.name.replace("'", "''") + "'"
    raise UnsupportedError("this default")


__all__ = ["ConstraintError", "EngineError", "ParseError", "Session"]
