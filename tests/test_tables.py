"""Managed tables: writes, constraints, transactions, introspection, dumps, the shell."""

import pytest

from lakequill.cli import Shell
from lakequill.errors import BindError, ConstraintError, TransactionError
from lakequill.session import Session
from lakequill.sources.dump import dump, formatted


def test_constraints_leave_the_table_as_it_was(rows):
    rows("CREATE TABLE t (id INTEGER PRIMARY KEY, n TEXT NOT NULL, k INTEGER CHECK (k > 0), e TEXT UNIQUE, CHECK (k < 100))")
    assert rows("INSERT INTO t VALUES (1, 'a', 5, 'x'), (NULL, 'b', NULL, NULL), (NULL, 'c', 7, NULL)") == 3
    for bad in ("(9, NULL, 1, 'q')", "(9, 'z', 0, 'q')", "(9, 'z', 100, 'q')", "(1, 'z', 1, 'q')", "(9, 'z', 1, 'x')", "(9, 'z', 1, 'q'), (9, 'y', 1, 'r')"):
        with pytest.raises(ConstraintError):
            rows(f"INSERT INTO t VALUES {bad}")
    for bad in ("n = NULL", "k = -1", "e = 'x' WHERE id > 1", "id = 2 WHERE id = 1", "id = NULL"):
        with pytest.raises(ConstraintError):
            rows(f"UPDATE t SET {bad}")
    assert rows("SELECT id, n, k, e FROM t ORDER BY id") == [(1, "a", 5, "x"), (2, "b", None, None), (3, "c", 7, None)]


def test_conflicts(rows):
    rows("CREATE TABLE t (id INTEGER PRIMARY KEY, e TEXT)")
    rows("CREATE UNIQUE INDEX ix ON t (e)")
    rows("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    assert rows("REPLACE INTO t VALUES (1, 'b'), (9, 'z'), (9, 'y')") == 2
    assert rows("SELECT id, e FROM t ORDER BY id") == [(1, "b"), (3, "c"), (9, "y")]
    assert rows("INSERT OR IGNORE INTO t VALUES (3, 'q'), (5, 'c'), (6, 'n'), (6, 'm')") == 1
    assert rows("SELECT id, e FROM t ORDER BY id") == [(1, "b"), (3, "c"), (6, "n"), (9, "y")]
    for how in ("ABORT", "FAIL", "ROLLBACK"):
        with pytest.raises(ConstraintError):
            rows(f"INSERT OR {how} INTO t VALUES (1, 'x')")


def test_update_and_delete_see_old_values(rows):
    rows("CREATE TABLE t (a INTEGER, b INTEGER)")
    rows("INSERT INTO t VALUES (1, 2), (3, NULL)")
    assert rows("UPDATE t SET a = b, b = a") == 2
    assert rows("SELECT a, b FROM t ORDER BY rowid") == [(2, 1), (None, 3)]
    assert rows("DELETE FROM t WHERE a > 0") == 1
    assert rows("SELECT a, b FROM t") == [(None, 3)]
    assert rows("UPDATE t SET a = (SELECT max(b) FROM t) WHERE EXISTS (SELECT 1 FROM t)") == 1
    assert rows("SELECT a FROM t") == [(3,)]
    assert rows("DELETE FROM t") == 1


def test_affinity_and_defaults(rows):
    rows("CREATE TABLE t (i INTEGER, r DOUBLE PRECISION, t VARCHAR(5), b BLOB, n DECIMAL(4,1) DEFAULT 2.5, d TEXT DEFAULT 'it''s')")
    rows("INSERT INTO t (i, r, t, b) VALUES ('12', '1.5', 3, 'xy'), ('abc', 1, NULL, x'00')")
    assert [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows("SELECT * FROM t ORDER BY rowid")] == [(12, 1.5, "3", b"xy", 2.5, "it's"), (None, 1.0, None, b"\0", 2.5, "it's")]
    rows("INSERT INTO t (n) VALUES (NULL)")
    assert rows("SELECT n FROM t WHERE rowid = 3") == [(None,)]


def test_row_ids_go_on(rows):
    rows("CREATE TABLE t (id INTEGER PRIMARY KEY, x TEXT)")
    rows("INSERT INTO t VALUES (10, 'a')")
    rows("INSERT INTO t (x) VALUES ('b'), ('c')")
    rows("DELETE FROM t WHERE id = 12")
    rows("INSERT INTO t (x) VALUES ('d')")
    assert rows("SELECT rowid, id, oid, x FROM t ORDER BY id") == [(10, 10, 10, "a"), (11, 11, 11, "b"), (12, 12, 12, "d")]
    rows("CREATE TABLE s (id INTEGER PRIMARY KEY AUTOINCREMENT)")
    rows("INSERT INTO s VALUES (7)")
    rows("DELETE FROM s")
    rows("INSERT INTO s DEFAULT VALUES")
    assert rows("SELECT id FROM s") == [(8,)]


def test_transactions(rows, db):
    rows("CREATE TABLE t (a INTEGER UNIQUE)")
    rows("BEGIN")
    rows("INSERT INTO t VALUES (1)")
    with pytest.raises(ConstraintError):
        rows("INSERT INTO t VALUES (2), (1)")
    with pytest.raises(TransactionError):
        rows("BEGIN")
    rows("INSERT INTO t VALUES (3)")
    rows("CREATE TABLE u (b TEXT)")
    assert rows("SELECT a FROM t ORDER BY a") == [(1,), (3,)]
    rows("ROLLBACK")
    assert rows("SELECT count(*) FROM t") == [(0,)]
    with pytest.raises(BindError):
        rows("SELECT * FROM u")
    for text in ("COMMIT", "ROLLBACK", "END"):
        with pytest.raises(TransactionError):
            rows(text)
    rows("BEGIN EXCLUSIVE TRANSACTION")
    rows("INSERT INTO t VALUES (5)")
    rows("END")
    assert rows("SELECT a FROM t") == [(5,)]


def test_the_database_outlives_the_session(spark, tmp_path):
    root = str(tmp_path / "db")
    first = Session(spark, root)
    first.script("CREATE TABLE t (a INTEGER, b TEXT); CREATE INDEX ix ON t (a); INSERT INTO t VALUES (1, 'x'); INSERT INTO t VALUES (2, 'y')")
    second = Session(spark, root)
    assert [tuple(r) for r in second.execute("SELECT a, b FROM t ORDER BY a").collect()] == [(1, "x"), (2, "y")]
    assert second.catalog.vacuum() == 1
    assert second.execute("SELECT count(*) FROM t").first()[0] == 2


def test_alter_and_drop(rows):
    rows("CREATE TABLE t (a INTEGER, b TEXT, CHECK (a > 0))")
    rows("CREATE INDEX ix ON t (b)")
    rows("INSERT INTO t VALUES (1, 'x')")
    rows("ALTER TABLE t ADD c REAL DEFAULT 2.5")
    rows("INSERT INTO t (a) VALUES (2)")
    assert rows("SELECT * FROM t ORDER BY a") == [(1, "x", None), (2, None, 2.5)]
    rows("ALTER TABLE t RENAME a TO aa")
    with pytest.raises(ConstraintError):
        rows("INSERT INTO t (aa) VALUES (0)")
    rows("ALTER TABLE t DROP COLUMN b")
    rows("ALTER TABLE t RENAME TO u")
    assert rows("SELECT * FROM u ORDER BY aa") == [(1, None), (2, 2.5)]
    for text in ("DROP TABLE t", "ALTER TABLE u DROP COLUMN zz", "ALTER TABLE u ADD COLUMN aa TEXT", "CREATE TABLE u (x)", "DROP INDEX nope", "CREATE INDEX ix ON u (aa)"):
        with pytest.raises(BindError):
            rows(text)
    rows("DROP TABLE IF EXISTS t")
    rows("CREATE TABLE IF NOT EXISTS u (x)")
    rows("DROP TABLE u")
    assert rows("SELECT count(*) FROM schema_table") == [(0,)]


def test_unique_index_over_duplicates(rows):
    rows("CREATE TABLE t (a INTEGER)")
    rows("INSERT INTO t VALUES (1), (1)")
    with pytest.raises(ConstraintError):
        rows("CREATE UNIQUE INDEX ix ON t (a)")


def test_introspection(rows):
    rows("CREATE TABLE t (id INTEGER PRIMARY KEY, b TEXT NOT NULL DEFAULT 'x', c REAL)")
    rows("CREATE UNIQUE INDEX ix ON t (b, c)")
    assert rows("PRAGMA table_info(t)") == [(0, "id", "INTEGER", 0, None, 1), (1, "b", "TEXT", 1, "'x'", 0), (2, "c", "REAL", 0, None, 0)]
    assert rows("PRAGMA index_list('t')") == [(0, "ix", 1, "c", 0)]
    assert rows("PRAGMA index_info(ix)") == [(0, 1, "b"), (1, 2, "c")]
    assert rows("PRAGMA user_version") == [(0,)] and rows("PRAGMA unheard_of") == []
    assert [r[3] for r in rows("EXPLAIN QUERY PLAN SELECT * FROM t WHERE b = 'q' ORDER BY c")] == ["SEARCH table t USING INDEX ix", "USE TEMP B-TREE FOR ORDER BY"]
    assert [r[3] for r in rows("EXPLAIN QUERY PLAN SELECT b FROM t UNION SELECT b FROM t")] == ["SCAN table t", "COMPOUND SUBQUERY (UNION)", "SCAN table t"]
    plan = rows("EXPLAIN SELECT count(*) FROM t")
    assert plan[0][1] == "Init" and plan[-1][1] == "Halt" and any("Aggregate" in r[1] for r in plan)


def test_dump_restores(spark, db, tmp_path):
    db.script("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT, c REAL, d BLOB); INSERT INTO t VALUES (1, 'it''s', 1.5, x'0aff'), (5, NULL, NULL, NULL); CREATE INDEX ix ON t (b)")
    text = "\n".join(dump(db))
    again = Session(spark, str(tmp_path / "again"))
    again.script(text)
    read = "SELECT a, b, c, hex(d) AS d FROM t ORDER BY a"
    assert again.execute(read).collect() == db.execute(read).collect()
    assert list(again.catalog.indexes) == ["ix"]


def test_formats():
    rows = [(1, None), (22, "a,b")]
    assert formatted(["x", "yy"], rows) == "1|\n22|a,b"
    assert formatted(["x", "yy"], rows, "csv", True) == 'x,yy\n1,\n22,"a,b"'
    assert formatted(["x", "yy"], rows, "line") == " x = 1\nyy = \n\n x = 22\nyy = a,b"
    assert formatted(["x", "yy"], rows, "column", True) == "x   yy\n--  ---\n1\n22  a,b"


def test_shell(db, tmp_path):
    said = []
    shell = Shell(db, said.append)
    script = tmp_path / "s.sql"
    script.write_text("INSERT INTO t VALUES (2, 'b');\nSELECT count(*) FROM t;")
    for line in ("CREATE TABLE t (a INTEGER,", "b TEXT);", "INSERT INTO t VALUES (1, 'x;y');", ".headers on", "SELECT * FROM t;", ".mode line", "SELECT a FROM t;", ".tables", f".read {script}", "SELECT nope;", ".schema t", ".help", ".what"):
        assert shell.line(line)
    assert said[0] == "a|b\n1|x;y" and said[1] == "a = 1" and said[2] == "t" and said[3] == "count(...) = 2"
    assert said[4].startswith("Error: no such column") and said[5] == "CREATE TABLE t (a INTEGER, b TEXT);"
    assert not shell.line(".quit")
