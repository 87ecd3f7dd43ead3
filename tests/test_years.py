"""Years of more than four digits and before 0, as events of large tables reach them."""

CASES = {
    "date(518399913600)": "18397-06-10", "datetime(253402300800)": "10000-01-01 00:00:00", "time(253402304461)": "01:01:01", "date(253402214400)": "9999-12-31",
    "unixepoch(date(518399913600))": 518399913600, "unixepoch('18397-06-10 00:01')": 518399913660, "date('2024-01-01', '+9000 years')": "11024-01-01",
    "strftime('%Y/%m/%d %H-%M-%S %j %w %s %%', 253402304461)": "10000/01/01 01-01-01 001 6 253402304461 %", "strftime('%Y', 518399913600)": "18397",
    "date(-62167219200)": "0000-01-01", "date(-62167305600)": "-1-12-31", "unixepoch(date(-62167305600))": -62167305600, "datetime(-95040000000)": "-1042-04-21 00:00:00",
}


def test_years_of_any_length(rows):
    (row,) = rows("SELECT " + ", ".join(f"{sql} AS c{i}" for i, sql in enumerate(CASES)))
    assert dict(zip(CASES, row, strict=True)) == CASES
