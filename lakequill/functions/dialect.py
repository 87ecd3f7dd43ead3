"""The dialect's rules for values, as Spark SQL text.

Every function takes and gives (text, type). Nothing here needs a Python worker: what Spark lacks is composed of its
built-in functions, so whole-stage code generation goes on across it.
"""

from __future__ import annotations

import re

from ..errors import BindError
from . import dates

INT, REAL, TEXT, BLOB, NULL, BOOL, OTHER = "int", "real", "text", "blob", "null", "bool", "other"
SPARK = {INT: "BIGINT", REAL: "DOUBLE", TEXT: "STRING", BLOB: "BINARY", BOOL: "BOOLEAN"}
#: Order of classes of values: null, numbers, text, blobs.
_RANK = {INT: 1, REAL: 1, BOOL: 1, TEXT: 2, BLOB: 3}


def of_spark(kind: str) -> str:
    """The dialect's type of a Spark type; a trailing ! marks one that is widened where it is read."""
    kind = kind.lower()
    if kind == "bigint":
        return INT
    if kind in ("int", "smallint", "tinyint", "boolean"):
        return INT + "!"
    if kind == "double":
        return REAL
    if kind == "float" or kind.startswith("decimal"):
        return REAL + "!"
    if kind == "string":
        return TEXT
    if kind == "binary":
        return BLOB
    if kind == "void":
        return NULL
    return OTHER


def narrow(kind: str) -> str:
    return kind.rstrip("!")


def widened(sql: str, kind: str) -> str:
    return f"CAST({sql} AS {SPARK[narrow(kind)]})" if kind.endswith("!") else sql


def affinity(declared: str) -> str:
    """The type of a column by its declaration; the first rule that fits."""
    d = declared.upper()
    if "INT" in d:
        return INT
    if any(w in d for w in ("CHAR", "CLOB", "TEXT")):
        return TEXT
    if "BLOB" in d:
        return BLOB
    if not d:
        return TEXT
    return REAL


def comparable(a: str, b: str) -> bool:
    return NULL in (a, b) or OTHER in (a, b) or _RANK[a] == _RANK[b]


def compare(sign: str, a: str, ta: str, b: str, tb: str) -> str:
    """A comparison; values of different classes compare by class."""
    if comparable(ta, tb):
        return f"({a} {sign} {b})"
    holds = {"=": False, "<>": True, "<": _RANK[ta] < _RANK[tb], "<=": _RANK[ta] < _RANK[tb], ">": _RANK[ta] > _RANK[tb], ">=": _RANK[ta] > _RANK[tb]}[sign]
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE {str(holds).lower()} END"


def truth(sql: str, kind: str) -> str:
    if kind == BOOL:
        return sql
    if kind in (INT, REAL):
        return f"({sql} <> 0)"
    if kind == TEXT:
        return f"(CASE WHEN {sql} IS NULL THEN NULL ELSE {number(sql)} <> 0 END)"
    if kind == NULL:
        return "CAST(NULL AS BOOLEAN)"
    if kind == BLOB:
        return f"(CASE WHEN {sql} IS NULL THEN NULL ELSE false END)"
    return f"CAST({sql} AS BOOLEAN)"


def number(sql: str) -> str:
    """A text as a double: 0 where it is none."""
    return f"coalesce(try_cast({sql} AS DOUBLE), 0.0D)"


def text(sql: str, kind: str) -> tuple[str, str] | str:
    if kind == TEXT:
        return sql
    if kind == BLOB:
        return f"decode({sql}, 'UTF-8')"
    return f"CAST({sql} AS STRING)"


def real(sql: str, kind: str) -> str:
    if kind == REAL:
        return sql
    if kind in (INT, BOOL, OTHER, NULL):
        return f"CAST({sql} AS DOUBLE)"
    if kind == TEXT:
        return f"CASE WHEN {sql} IS NULL THEN NULL ELSE {number(sql)} END"
    return f"CASE WHEN {sql} IS NULL THEN NULL ELSE 0.0D END"


def arithmetic(sign: str, a: str, ta: str, b: str, tb: str) -> tuple[str, str]:
    if sign == "||":
        return f"concat({text(a, ta)}, {text(b, tb)})", TEXT
    if NULL in (ta, tb):
        return "NULL", NULL
    ints = ta in (INT, BOOL) and tb in (INT, BOOL)
    null = f"{a} IS NULL OR {b} IS NULL"
    if sign in "+-*":
        return (f"({a} {sign} {b})", INT) if ints else (f"({real(a, ta)} {sign} {real(b, tb)})", REAL)
    if sign == "/":
        if ints:
            return f"({a} div nullif({b}, 0L))", INT
        return f"try_divide({real(a, ta)}, {real(b, tb)})", REAL
    if sign == "%":
        return (f"try_mod({a}, {b})", INT) if ints else ("CAST(NULL AS BIGINT)", INT)
    if not ints:
        return f"CASE WHEN {null} THEN NULL ELSE 0L END", INT
    if sign in "&|":
        return f"({a} {sign} {b})", INT
    return f"shift{'left' if sign == '<<' else 'right'}({a}, CAST({b} AS INT))", INT


def like(of: str, pattern: str, escape: str | None) -> str:
    """Matches letters of either case. Without ESCAPE nothing escapes: a control character that texts lack stands in."""
    sign = escape if escape is not None else "\x01"
    return "({} ILIKE {} ESCAPE '{}')".format(of, pattern, sign.replace("\\", "\\\\").replace("'", "\\'"))


def _glob_regex(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "^!" else inner).replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&") + "]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob(of: str, pattern: str, constant: str | None) -> str:
    if constant is not None:
        return "({} RLIKE '{}')".format(of, _glob_regex(constant).replace("\\", "\\\\").replace("'", "\\'"))
    quote = f"regexp_replace({pattern}, '([^A-Za-z0-9*?])', '\\\\\\\\$1')"
    return f"({of} RLIKE concat('(?s)^', replace(replace({quote}, '*', '.*'), '?', '.'), '$'))"


def cast(sql: str, kind: str, declared: str) -> tuple[str, str]:
    """A hard conversion by the declared type; text without a number is 0."""
    d = declared.upper()
    if "INT" in d:
        if kind in (INT, BOOL, NULL):
            return f"CAST({sql} AS BIGINT)", INT
        if kind == REAL:
            return f"CAST({sql} AS BIGINT)", INT
        digits = f"regexp_extract({text(sql, kind)}, '^\\\\s*([+-]?[0-9]+)', 1)"
        return f"CASE WHEN {sql} IS NULL THEN NULL ELSE coalesce(try_cast({digits} AS BIGINT), 0L) END", INT
    if any(w in d for w in ("REAL", "FLOA", "DOUB")):
        return _cast_real(sql, kind), REAL
    if any(w in d for w in ("CHAR", "CLOB", "TEXT", "VAR")):
        return text(sql, kind), TEXT
    if "BLOB" in d:
        return (sql if kind == BLOB else f"CAST({text(sql, kind)} AS BINARY)"), BLOB
    if kind in (INT, REAL, NULL):
        return sql, kind
    return _cast_real(sql, kind), REAL


def _cast_real(sql: str, kind: str) -> str:
    if kind in (TEXT, BLOB):
        digits = f"regexp_extract({text(sql, kind)}, '^\\\\s*([+-]?([0-9]+\\\\.?[0-9]*|\\\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1)"
        return f"CASE WHEN {sql} IS NULL THEN NULL ELSE coalesce(try_cast({digits} AS DOUBLE), 0.0D) END"
    return real(sql, kind)


def stored(sql: str, kind: str, to: str) -> str:
    """A value as a column of a managed table takes it: null where it cannot be one."""
    if kind == to:
        return sql
    if to == TEXT:
        return text(sql, kind)
    if to == BLOB:
        return f"CAST({text(sql, kind)} AS BINARY)"
    return f"try_cast({text(sql, kind) if kind == BLOB else sql} AS {SPARK[to]})"


def now(what: str) -> str:
    return {"date": "date_format(current_timestamp(), 'yyyy-MM-dd')", "time": "date_format(current_timestamp(), 'HH:mm:ss')", "timestamp": "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')"}[what]


# aggregates


def aggregate(name: str, star: bool, distinct: bool, args: list[tuple[str, str]], where: str, order: str | None) -> tuple[str, str]:
    if name == "count":
        if star or not args:
            return f"count(*){where}", INT
        return f"count({'DISTINCT ' if distinct else ''}{args[0][0]}){where}", INT
    if not args:
        raise BindError(f"{name} takes an argument")
    sql, kind = args[0]
    d = "DISTINCT " if distinct else ""
    if name == "sum":
        if kind in (INT, BOOL):
            return f"sum({d}{sql}){where}", INT
        return f"sum({d}{real(sql, kind)}){where}", REAL
    if name == "total":
        values = "CAST(NULL AS DOUBLE)" if kind in (TEXT, BLOB) else real(sql, kind)
        return f"coalesce(sum({d}{values}){where}, 0.0D)", REAL
    if name == "avg":
        return f"avg({d}{real(sql, kind)}){where}", REAL
    if name in ("min", "max"):
        return f"{name}({sql}){where}", kind
    if name in ("group_concat", "string_agg"):
        value = text(sql, kind)
        sep = args[1][0] if len(args) > 1 else "','"
        sep = f"first({sep})" if len(args) > 1 and not sep.startswith("'") else sep
        if distinct:
            joined = f"array_join(array_sort(collect_set({value}){where}), {sep})"
        elif order is not None:
            rows = f"collect_list(CASE WHEN {sql} IS NOT NULL THEN named_struct('r', {order}, 'v', {value}) END){where}"
            joined = f"array_join(transform(array_sort({rows}), e -> e.v), {sep})"
        else:
            joined = f"array_join(array_sort(collect_list({value}){where}), {sep})"
        return f"CASE WHEN count({sql}){where} = 0 THEN NULL ELSE {joined} END", TEXT
    raise BindError(f"no such aggregate: {name}")


# scalar functions


def _arity(name: str, args: list, low: int, high: int | None) -> None:
    if len(args) < low or high is not None and len(args) > high:
        raise BindError(f"wrong number of arguments to {name}()")


def _common(args: list[tuple[str, str]]) -> str:
    kinds = {t for _, t in args} - {NULL}
    if not kinds:
        return NULL
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= {INT, REAL, BOOL}:
        return REAL
    return TEXT


def _same(args: list[tuple[str, str]]) -> tuple[list[str], str]:
    kind = _common(args)
    return [s if t in (kind, NULL) or kind not in SPARK else (text(s, t) if kind == TEXT else f"CAST({s} AS {SPARK[kind]})") for s, t in args], kind


def scalar(name: str, args: list[tuple[str, str]], constants: list, truths: list[str]) -> tuple[str, str]:
    if name in dates.NAMES:
        return dates.call(name, args, constants)
    if name not in _SCALARS:
        raise BindError(f"no such function: {name}")
    low, high, f = _SCALARS[name]
    _arity(name, args, low, high)
    if name == "iif":
        same, kind = _same(args[1:])
        return f"CASE WHEN {truths[0]} THEN {same[0]} ELSE {same[1]} END", kind
    return f(args, constants)


def _text_arg(a: tuple[str, str]) -> str:
    return text(*a)


def _length(a, _):
    sql, kind = a[0]
    return (f"CAST(octet_length({sql}) AS BIGINT)" if kind == BLOB else f"CAST(char_length({_text_arg(a[0])}) AS BIGINT)"), INT


def _abs(a, _):
    sql, kind = a[0]
    if kind in (INT, REAL, NULL):
        return f"abs({sql})", kind
    return f"CASE WHEN {sql} IS NULL THEN NULL ELSE 0L END", INT


def _typeof(a, _):
    sql, kind = a[0]
    named = {INT: "integer", BOOL: "integer", REAL: "real", TEXT: "text", BLOB: "blob", OTHER: "text", NULL: "null"}[kind]
    return f"CASE WHEN {sql} IS NULL THEN 'null' ELSE '{named}' END", TEXT


def _coalesce(a, _):
    if not a:
        return "NULL", NULL
    same, kind = _same(a)
    return f"coalesce({', '.join(same)})", kind


def _nullif(a, _):
    (x, tx), (y, ty) = a
    return (f"nullif({x}, {y})" if comparable(tx, ty) else x), tx


def _extreme(which: str):
    def f(a, _):
        same, kind = _same(a)
        # null is the smallest value: greatest passes it over, the smallest of all is null
        if which == "max":
            return f"greatest({', '.join(same)})", kind
        return f"CASE WHEN {' OR '.join(f'{s} IS NULL' for s in same)} THEN NULL ELSE least({', '.join(same)}) END", kind

    return f


def _substr(a, _):
    s, start = _text_arg(a[0]), f"CAST({a[1][0]} AS INT)"
    if len(a) == 2:
        return f"substring({s}, CASE WHEN {start} = 0 THEN 1 WHEN {start} < 0 THEN greatest({start}, -char_length({s})) ELSE {start} END)", TEXT
    size = f"CAST({a[2][0]} AS INT)"
    # a start of 0 is the place before the first character
    return f"CASE WHEN {size} IS NULL THEN NULL WHEN {start} = 0 THEN substring({s}, 1, greatest({size} - 1, 0)) ELSE substring({s}, {start}, greatest({size}, 0)) END", TEXT


_BLANK = "[\\\\s\\\\p{Z}]+"


def _trim(side: str):
    def f(a, _):
        s = _text_arg(a[0])
        if len(a) == 2:
            return f"trim({side} {_text_arg(a[1])} FROM {s})", TEXT
        pattern = {"BOTH": f"^{_BLANK}|{_BLANK}$", "LEADING": f"^{_BLANK}", "TRAILING": f"{_BLANK}$"}[side]
        return f"regexp_replace({s}, '{pattern}', '')", TEXT

    return f


def _replace(a, _):
    s, old, new = (_text_arg(x) for x in a)
    return f"replace({s}, coalesce({old}, ''), coalesce({new}, ''))", TEXT


def _hex(a, _):
    sql, kind = a[0]
    return f"coalesce(hex({sql if kind == BLOB else _text_arg(a[0])}), '')", TEXT


def _quote(a, _):
    sql, kind = a[0]
    if kind == TEXT:
        return f"CASE WHEN {sql} IS NULL THEN 'NULL' ELSE concat('\\'', replace({sql}, '\\'', '\\'\\''), '\\'') END", TEXT
    if kind == BLOB:
        return f"CASE WHEN {sql} IS NULL THEN 'NULL' ELSE concat('X\\'', hex({sql}), '\\'') END", TEXT
    return f"coalesce({_text_arg(a[0])}, 'NULL')", TEXT


def _unicode(a, _):
    s = _text_arg(a[0])
    return f"CASE WHEN {s} = '' THEN NULL ELSE CAST(ascii({s}) AS BIGINT) END", INT


def _char(a, _):
    """Code points to UTF-8: Spark's chr wraps at 256, so the bytes are put together here."""
    if not a:
        return "''", TEXT
    parts = []
    for s, _t in a:
        c = f"coalesce(CAST({s} AS INT), 0)"

        def byte(lead: int, shift: int, mask: int, c: str = c) -> str:
            return f"lpad(hex({lead} | (shiftright({c}, {shift}) & {mask})), 2, '0')"

        two = f"concat({byte(192, 6, 31)}, {byte(128, 0, 63)})"
        three = f"concat({byte(224, 12, 15)}, {byte(128, 6, 63)}, {byte(128, 0, 63)})"
        four = f"concat({byte(240, 18, 7)}, {byte(128, 12, 63)}, {byte(128, 6, 63)}, {byte(128, 0, 63)})"
        parts.append(f"CASE WHEN {c} < 128 THEN {byte(0, 0, 127)} WHEN {c} < 2048 THEN {two} WHEN {c} < 65536 THEN {three} ELSE {four} END")
    return f"decode(unhex(concat({', '.join(parts)})), 'UTF-8')", TEXT


def _round(a, _):
    x = real(*a[0])
    if len(a) == 1:
        return f"round({x})", REAL
    digits = a[1][0].rstrip("L")
    return (f"round({x}, {digits})" if re.fullmatch(r"-?\d+", digits) else f"CAST({x} * power(10, {a[1][0]}) + signum({x}) * 0.5D AS BIGINT) / power(10, {a[1][0]})"), REAL


def _sign(a, _):
    sql, kind = a[0]
    if kind in (TEXT, BLOB):
        return "CAST(NULL AS BIGINT)", INT
    return f"CAST(signum({real(sql, kind)}) AS BIGINT)", INT


def _printf(a, constants):
    form = constants[0]
    if not isinstance(form, str):
        raise BindError("printf() takes a constant format")
    parts, i, at = [], 1, 0
    for m in re.finditer(r"%([dif s%])", form):
        if m.start() > at:
            parts.append("'" + form[at : m.start()].replace("\\", "\\\\").replace("'", "\\'") + "'")
        at = m.end()
        if m[1] == "%":
            parts.append("'%'")
            continue
        value = a[i] if i < len(a) else ("NULL", NULL)
        i += 1
        if m[1] in "di":
            parts.append(f"coalesce(CAST({cast(*value, 'INTEGER')[0]} AS STRING), '0')")
        elif m[1] == "f":
            parts.append(f"coalesce(format_string('%.6f', {real(*value)}), '0.000000')")
        else:
            parts.append(f"coalesce({text(*value)}, '')")
    if at < len(form):
        parts.append("'" + form[at:].replace("\\", "\\\\").replace("'", "\\'") + "'")
    return f"concat({', '.join(parts) or repr('')})", TEXT


def _plain(sql: str, kind: str):
    return lambda a, _: (sql.format(*(_text_arg(x) for x in a)), kind)


_SCALARS = {
    "length": (1, 1, _length),
    "octet_length": (1, 1, lambda a, _: (f"CAST(octet_length({_text_arg(a[0])}) AS BIGINT)", INT)),
    "upper": (1, 1, _plain("upper({0})", TEXT)),
    "lower": (1, 1, _plain("lower({0})", TEXT)),
    "abs": (1, 1, _abs),
    "typeof": (1, 1, _typeof),
    "coalesce": (0, None, _coalesce),
    "ifnull": (2, 2, _coalesce),
    "nullif": (2, 2, _nullif),
    "iif": (3, 3, None),
    "max": (2, None, _extreme("max")),
    "min": (2, None, _extreme("min")),
    "substr": (2, 3, _substr),
    "substring": (2, 3, _substr),
    "trim": (1, 2, _trim("BOTH")),
    "ltrim": (1, 2, _trim("LEADING")),
    "rtrim": (1, 2, _trim("TRAILING")),
    "replace": (3, 3, _replace),
    "instr": (2, 2, _plain("CAST(instr({0}, {1}) AS BIGINT)", INT)),
    "hex": (1, 1, _hex),
    "quote": (1, 1, _quote),
    "unicode": (1, 1, _unicode),
    "char": (0, None, _char),
    "zeroblob": (1, 1, lambda a, _: (f"unhex(repeat('00', CAST({a[0][0]} AS INT)))", BLOB)),
    "round": (1, 2, _round),
    "sign": (1, 1, _sign),
    "random": (0, 0, lambda a, _: ("xxhash64(uuid())", INT)),
    "printf": (1, None, _printf),
    "format": (1, None, _printf),
    "likely": (1, 1, lambda a, _: a[0]),
    "unlikely": (1, 1, lambda a, _: a[0]),
    "like": (2, 3, lambda a, c: (like(_text_arg(a[1]), _text_arg(a[0]), c[2] if len(c) > 2 else None), BOOL)),
    "glob": (2, 2, lambda a, c: (glob(_text_arg(a[1]), _text_arg(a[0]), c[0] if isinstance(c[0], str) else None), BOOL)),
}
