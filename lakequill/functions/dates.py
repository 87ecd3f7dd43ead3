"""Date and time functions of the dialect.

A time value is text in one of a few forms, or a number of seconds since 1970; a function turns it into a Spark
timestamp without a zone, read as UTC, applies constant modifiers in order, and formats it. What cannot be read is null.
"""

from __future__ import annotations

import re

from ..errors import BindError, UnsupportedError

NAMES = frozenset("date time datetime julianday unixepoch strftime".split())
_UNITS = {"second": "SECS", "minute": "MINS", "hour": "HOURS", "day": "DAYS", "month": "MONTHS", "year": "YEARS"}


#: A day as text: years beyond 9999 have more digits, those before 0 a sign and no padding.
_DAY = r"(?:-\\d{1,6}|\\d{4,6})-\\d{2}-\\d{2}"
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
_NOW = "convert_timezone(current_timezone(), 'UTC', localtimestamp())"


def _at(seconds: str) -> str:
    return f"timestampadd(MICROSECOND, CAST({seconds} * 1000000 AS BIGINT), {_EPOCH})"


def stamp(sql: str, kind: str, constant) -> str:
    """A timestamp without a zone, so that no result depends on the session's."""
    if isinstance(constant, str) and constant.lower() == "now":
        return _NOW
    if kind in ("int", "real"):
        return _at(sql)
    if kind == "null":
        return "CAST(NULL AS TIMESTAMP_NTZ)"
    if kind == "other":
        local = f"CAST({sql} AS TIMESTAMP_NTZ)"
        return f"CASE WHEN typeof({sql}) = 'timestamp' THEN convert_timezone(current_timezone(), 'UTC', {local}) ELSE {local} END"
    day = f"regexp_extract({sql}, '^\\\\s*({_DAY})', 1)"
    clock = f"regexp_extract({sql}, '^\\\\s*(?:{_DAY} )?(\\\\d{{2}}:\\\\d{{2}}(?::\\\\d{{2}})?)', 1)"
    full = f"concat(CASE WHEN {day} = '' THEN '2000-01-01' WHEN {sql} RLIKE '^\\\\s*-' THEN regexp_replace({day}, '^-(\\\\d{{1,3}}-)', '-000$1') ELSE {day} END, ' ', CASE WHEN {clock} = '' THEN '00:00:00' WHEN length({clock}) = 5 THEN concat({clock}, ':00') ELSE {clock} END)"
    return f"CASE WHEN lower({sql}) = 'now' THEN {_NOW} WHEN {day} = '' AND {clock} = '' THEN {_at(f'try_cast({sql} AS DOUBLE)')} ELSE try_cast({full} AS TIMESTAMP_NTZ) END"


def modified(sql: str, modifier: str) -> str:
    m = modifier.strip().lower()
    if m in ("start of day", "start of month", "start of year"):
        day = f"CAST({sql} AS DATE)"
        return f"CAST({day if m[9:] == 'day' else f"trunc({day}, '{m[9:].upper()}')"} AS TIMESTAMP_NTZ)"
    if found := re.fullmatch(r"weekday\s+([0-6])", m):
        ahead = f"pmod({found[1]} - (dayofweek({sql}) - 1), 7)"
        return f"({sql} + make_dt_interval({ahead}))"
    if found := re.fullmatch(r"([+-]?\s*\d+(?:\.\d+)?)\s*(second|minute|hour|day|month|year)s?", m):
        amount, unit = float(found[1].replace(" ", "")), found[2]
        if unit in ("month", "year"):
            return f"({sql} + make_ym_interval({int(amount) if unit == 'year' else 0}, {int(amount) if unit == 'month' else 0}))"
        seconds = amount * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
        return f"timestampadd(MICROSECOND, {int(seconds * 1_000_000)}L, {sql})"
    # unixepoch, localtime and utc change nothing here; unknown ones are passed over
    return sql


def call(name: str, args: list[tuple[str, str]], constants: list) -> tuple[str, str]:
    form = None
    if name == "strftime":
        if not args or not isinstance(constants[0], str):
            raise BindError("strftime() takes a constant format")
        form, args, constants = constants[0], args[1:], constants[1:]
    if not args:
        args, constants = [("'now'", "text")], ["now"]
    ts = stamp(*args[0], constants[0])
    for (_, kind), c in zip(args[1:], constants[1:], strict=True):
        if kind == "null":
            return "NULL", "null"
        if not isinstance(c, str):
            raise UnsupportedError("time modifiers are constants")
        ts = modified(ts, c)
    seconds = _seconds(ts)
    if name == "unixepoch":
        return seconds, "int"
    if name == "julianday":
        return f"({seconds} / 86400.0D + 2440587.5D)", "real"
    if name != "strftime":
        form = {"date": "%Y-%m-%d", "time": "%H:%M:%S", "datetime": "%Y-%m-%d %H:%M:%S"}[name]
    return _formatted(form, ts), "text"


def _part(ts: str, first: int, n: int) -> str:
    """Some characters of MM-DD HH:MM:SS, which follow a year of any length."""
    text = f"CAST({ts} AS STRING)"
    return f"substring({text}, locate('-', {text}, 2) + {first}, {n})"


def _year(ts: str) -> str:
    """At least four digits; a year before 0 has its sign and no padding."""
    year = f"year({ts})"
    return f"CASE WHEN {year} BETWEEN 0 AND 9999 THEN lpad({year}, 4, '0') ELSE CAST({year} AS STRING) END"


def _seconds(ts: str) -> str:
    return f"(CAST(unix_date(CAST({ts} AS DATE)) AS BIGINT) * 86400 + hour({ts}) * 3600 + minute({ts}) * 60 + second({ts}))"


def _formatted(form: str, ts: str) -> str:
    known = {
        "Y": _year(ts), "m": _part(ts, 1, 2), "d": _part(ts, 4, 2), "H": _part(ts, 7, 2), "M": _part(ts, 10, 2), "S": _part(ts, 13, 2),
        "j": f"lpad(dayofyear({ts}), 3, '0')", "w": f"CAST(dayofweek({ts}) - 1 AS STRING)",
        "W": f"lpad(CAST((dayofyear({ts}) + 6 - pmod(dayofweek({ts}) - 2, 7)) div 7 AS STRING), 2, '0')",
        "s": f"CAST({_seconds(ts)} AS STRING)", "f": f"concat({_part(ts, 13, 2)}, '.000')",
        "J": f"CAST({_seconds(ts)} / 86400.0D + 2440587.5D AS STRING)",
    }
    # the plain forms take the timestamp once, since time functions that read them repeat their text
    text = f"CAST({ts} AS STRING)"
    if form == "%H:%M:%S":
        return f"substring(substring_index({text}, ' ', -1), 1, 8)"
    if end := {"%Y-%m-%d": " ", "%Y-%m-%d %H:%M:%S": "."}.get(form):
        return f"regexp_replace(substring_index({text}, '{end}', 1), '^(-)0+|^[+]', '$1')"
    parts: list[str] = []
    for piece in re.findall(r"%.|[^%]+|%$", form, re.S):
        if piece[0] == "%" and piece[1:] in known:
            parts.append(known[piece[1:]])
        else:
            plain = "%" if piece == "%%" else piece
            parts.append("'" + plain.replace("\\", "\\\\").replace("'", "\\'") + "'")
    whole = f"concat({', '.join(parts)})" if parts else "''"
    return f"CASE WHEN {ts} IS NULL THEN NULL ELSE {whole} END"
