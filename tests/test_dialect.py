"""Rules of the dialect on literals and small tables, partly against the standard library's engine."""

import random
import sqlite3

import pytest

from lakequill.errors import BindError, ParseError, UnsupportedError
from lakequill.sql.lexer import statements, tokens
from lakequill.sql.parser import parse

LITERALS = {
    "7 / 2": 3, "-7 / 2": -3, "7 / 0": None, "7 % 0": None, "-7 % 3": -1, "7.0 / 2": 3.5, "1.5 / 0": None, "2.5 % 2": None,
    "'1' = 1": 0, "'a' > 5": 1, "x'00' > 'zzz'": 1, "NULL = NULL": None, "NULL IS NULL": 1, "1 IS NOT 2": 1, "NOT NULL": None,
    "1 AND NULL": None, "0 AND NULL": 0, "NULL OR 1": 1, "NULL OR 0": None, "5 BETWEEN 10 AND NULL": 0, "1 IN (1, NULL)": 1, "2 IN (1, NULL)": None,
    "'ABC' LIKE 'a%'": 1, "'a%' LIKE 'a!%' ESCAPE '!'": 1, "'ab' LIKE 'a!%' ESCAPE '!'": 0, "'a\\b' LIKE 'a\\_'": 1, "'abc' GLOB 'A*'": 0, "'abc' GLOB '[a-c]?c'": 1, "'abc' NOT GLOB '*z*'": 1,
    "'a' || NULL": None, "1 || 2": "12", "3.0 || ''": "3.0", "6 & 3": 2, "6 | 3": 7, "1 << 4": 16, "-8 >> 1": -4, "~5": -6, "1.5 & 1": 0,
    "CASE WHEN NULL THEN 1 ELSE 2 END": 2, "CASE NULL WHEN NULL THEN 1 ELSE 2 END": 2, "CASE WHEN '0' THEN 1 WHEN 'x' THEN 2 WHEN '3' THEN 3 END": 3, "CASE WHEN 0.0 THEN 1 END": None,
    "CAST('12abc' AS INTEGER)": 12, "CAST('abc' AS INTEGER)": 0, "CAST(-3.9 AS INTEGER)": -3, "CAST('4.5e1x' AS REAL)": 45.0, "CAST(5 AS TEXT)": "5", "CAST('ab' AS BLOB)": b"ab", "CAST(NULL AS INTEGER)": None,
    "length('é')": 1, "octet_length('é')": 2, "length(x'0102')": 2, "upper('äb')": "ÄB", "abs(-5)": 5, "abs('x')": 0, "typeof(1)": "integer", "typeof(1.0)": "real", "typeof('a')": "text", "typeof(NULL)": "null", "typeof(x'')": "blob",
    "coalesce(NULL, NULL, 3)": 3, "ifnull(NULL, 'a')": "a", "nullif(1, 1)": None, "iif('0', 'a', 'b')": "b", "max(1, NULL, 3)": 3, "min(1, NULL, 3)": None,
    "substr('hello', 2)": "ello", "substr('hello', 0, 3)": "he", "substr('hello', -3, 2)": "ll", "substr('hello', 2, 0)": "", "trim('  a ')": "a", "replace('aXa', 'X', NULL)": "aa", "instr('hello', 'l')": 3, "instr('hello', 'z')": 0,
    "hex('ab')": "6162", "hex(NULL)": "", "hex(255)": "323535", "quote('it''s')": "'it''s'", "quote(NULL)": "NULL", "quote(x'0a')": "X'0A'", "unicode('€')": 8364, "unicode('')": None, "char(72, 105, 8364)": "Hi€",
    "round(2.5)": 3.0, "round(-2.5)": -3.0, "round(3.14159, 2)": 3.14, "sign(-2)": -1, "printf('%d|%s|%%', 3, 'x')": "3|x|%", "likely(1)": 1,
    "date('2024-01-31', '+1 month')": "2024-02-29", "date('2024-03-15', 'start of month', '-1 day')": "2024-02-29", "time('12:30')": "12:30:00", "datetime('2024-01-01 10:20:30', '+90 minutes')": "2024-01-01 11:50:30",
    "date('2024-01-01', 'weekday 0')": "2024-01-07", "julianday('2000-01-01 12:00:00')": 2451545.0, "unixepoch('1970-01-02')": 86400, "date(86400)": "1970-01-02", "date('nonsense')": None, "strftime('%Y %j %w', '2024-12-31')": "2024 366 2",
    "0x10": 16, "1e3": 1000.0, "'it''s'": "it's", "x'4142'": b"AB", "1 + 2 * 3": 7, "2 + 3 || 4": "54", "1 < 2 = 1": 1, "NOT 1 = 2": 1, "- - 3": 3, "9223372036854775807": 9223372036854775807,
}


def test_literals(spark, db):
    names = list(LITERALS)
    got = db.execute("SELECT " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(names))).first()
    wrong = {e: (v if not isinstance(v, bytearray) else bytes(v), LITERALS[e]) for e, v in zip(names, got, strict=True) if (bytes(v) if isinstance(v, bytearray) else v) != LITERALS[e]}
    assert not wrong


def _expression(r: random.Random, depth: int) -> str:
    if depth == 0:
        return r.choice(["a", "b", "c", "1", "2", "7", "0", "NULL"])
    e = lambda: _expression(r, depth - 1)
    return r.choice([
        lambda: f"({e()} + {e()})", lambda: f"({e()} * {e()})", lambda: f"({e()} - {e()})", lambda: f"({e()} / {e()})", lambda: f"({e()} % {e()})",
        lambda: f"({e()} < {e()})", lambda: f"({e()} = {e()})", lambda: f"({e()} IS {e()})", lambda: f"({e()} AND {e()})", lambda: f"({e()} OR {e()})",
        lambda: f"(NOT {e()})", lambda: f"({e()} BETWEEN {e()} AND {e()})", lambda: f"({e()} IN ({e()}, {e()}))", lambda: f"coalesce({e()}, {e()})",
        lambda: f"CASE WHEN {e()} THEN {e()} ELSE {e()} END", lambda: f"CASE {e()} WHEN {e()} THEN {e()} END", lambda: f"abs({e()})", lambda: f"nullif({e()}, {e()})",
        lambda: f"({e()} | {e()})", lambda: f"({e()} IS NULL)", lambda: f"min({e()}, {e()})",
    ])()


def test_random_expressions_against_the_standard_librarys_engine(spark, db):
    r = random.Random(11)
    data = [(1, 2, 3), (None, 5, -4), (0, None, 7), (-7, 2, 0)]
    lite = sqlite3.connect(":memory:")
    for run in (lite.execute, db.execute):
        run("CREATE TABLE t (a INTEGER, b INTEGER, c INTEGER)")
        run("INSERT INTO t VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in x) + ")" for x in data))
    texts = [_expression(r, 3) for _ in range(60)]
    sql = "SELECT " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(texts)) + " FROM t ORDER BY rowid"
    got = [tuple(x) for x in db.execute(sql).collect()]
    wanted = lite.execute(sql).fetchall()
    wrong = [(e, [g[i] for g in got], [w[i] for w in wanted]) for i, e in enumerate(texts) if [g[i] for g in got] != [w[i] for w in wanted]]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("text", ["SELECT", "SELECT 1 FROM", "SELECT 1 extra words here", "SELECT (1", "FOO", "SELECT 1;;SELECT 2", "SELECT 'open", "SELECT 1 ORDER BY", "SELECT * FROM t NATURAL", "SELECT 12abc", "/* open", "INSERT INTO t VALUES", "SELECT 1 LIMIT"])
def test_malformed(text):
    with pytest.raises(ParseError):
        parse(text)


def test_comments_quotes_and_scripts():
    assert [t.text for t in tokens('SELECT /* a /* b */ c */ "x""y", [z w], `q` -- end')][:-1] == ["SELECT", 'x"y', ",", "z w", ",", "q"]
    assert statements("SELECT ';'; -- x;\n/* ; */ SELECT 2;") == ["SELECT ';'", "-- x;\n/* ; */ SELECT 2"]


def test_binding_errors(db, rows):
    rows("CREATE TABLE t (a INTEGER, b TEXT)")
    rows("CREATE TABLE u (a INTEGER)")
    for text in ("SELECT z FROM t", "SELECT t.z FROM t", "SELECT a FROM t, u", "SELECT x.a FROM t", "SELECT nope(1)", "SELECT 1 FROM nope", "SELECT 1 UNION SELECT 1, 2", "SELECT (SELECT 1, 2)", "SELECT a FROM t WHERE count(*) > 1", "SELECT a FROM t ORDER BY 5", "SELECT substr('a')", "SELECT a FROM t, t"):
        with pytest.raises(BindError):
            rows(text)
    with pytest.raises(UnsupportedError):
        rows("SELECT a FROM t LIMIT a")


def test_parameters(rows):
    assert rows("SELECT ? + ?, ?2 || 'x', ? IS NULL", 1, 2, None) == [(3, "2x", 1)]


def test_joins_with_nulls(rows):
    rows("CREATE TABLE a (id INTEGER, v TEXT)")
    rows("CREATE TABLE b (id INTEGER, w TEXT)")
    rows("INSERT INTO a VALUES (1, 'x'), (2, 'y'), (NULL, 'n')")
    rows("INSERT INTO b VALUES (2, 'p'), (3, 'q'), (NULL, 'm')")
    assert rows("SELECT * FROM a JOIN b USING (id)") == [(2, "y", "p")]
    assert sorted(rows("SELECT id, v, w FROM a NATURAL LEFT JOIN b"), key=str) == sorted([(1, "x", None), (2, "y", "p"), (None, "n", None)], key=str)
    assert sorted(rows("SELECT id, v, w FROM a NATURAL RIGHT JOIN b"), key=str) == sorted([(2, "y", "p"), (3, None, "q"), (None, None, "m")], key=str)
    assert sorted(rows("SELECT id, v, w FROM a FULL JOIN b USING (id)"), key=str) == sorted([(1, "x", None), (2, "y", "p"), (None, "n", None), (3, None, "q"), (None, None, "m")], key=str)
    assert rows("SELECT v FROM a LEFT JOIN b ON a.id = b.id WHERE b.id IS NULL ORDER BY v") == [("n",), ("x",)]
    assert rows("SELECT a.* FROM a, b WHERE a.id = b.id") == [(2, "y")]


def test_aggregates_over_nothing_and_nulls(rows):
    rows("CREATE TABLE t (g TEXT, x INTEGER)")
    assert rows("SELECT count(*), sum(x), total(x), avg(x), min(x), group_concat(x) FROM t") == [(0, None, 0.0, None, None, None)]
    rows("INSERT INTO t VALUES ('a', NULL), ('a', NULL), ('b', 2), ('b', 2), (NULL, 5)")
    assert sorted(rows("SELECT g, count(x), sum(x), sum(DISTINCT x), group_concat(x), max(x) FROM t GROUP BY g"), key=str) == sorted([("a", 0, None, None, None, None), ("b", 2, 4, 2, "2,2", 2), (None, 1, 5, 5, "5", 5)], key=str)
    assert rows("SELECT g FROM t GROUP BY g HAVING count(*) > 1 ORDER BY g") == [("a",), ("b",)]
    assert rows("SELECT count(*) + 1 FROM t WHERE x > 99") == [(1,)]


def test_recursion_ends_or_raises(rows):
    assert rows("WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 200) SELECT count(*), max(x) FROM c") == [(200, 200)]
    assert rows("WITH RECURSIVE c(x) AS (SELECT 0 UNION SELECT (x + 1) % 4 FROM c) SELECT x FROM c ORDER BY x") == [(0,), (1,), (2,), (3,)]
    with pytest.raises(Exception, match="(?i)recursion|level"):
        rows("WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c) SELECT count(*) FROM c")
