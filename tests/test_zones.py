"""Time functions give the same in every session zone; fixed points over many steps."""

import pytest
from pyspark.sql import functions as F

from lakequill.operators.recursive import fixed_point
from lakequill.errors import UnsupportedError
from lakequill.session import Session

CASES = {
    "date(86400)": "1970-01-02", "unixepoch('1970-01-02')": 86400, "julianday('2000-01-01 12:00:00')": 2451545.0,
    "datetime('2024-03-10 02:30:00')": "2024-03-10 02:30:00", "datetime(-1)": "1969-12-31 23:59:59", "date('2024-01-31', '+1 month')": "2024-02-29",
    "date('2024-11-03', 'start of year', '-1 day')": "2023-12-31", "datetime('2024-11-03 01:30:00', '+1 hour')": "2024-11-03 02:30:00", "time('07:05')": "07:05:00",
    "strftime('%Y/%m/%d %H-%M-%S %s %j %w', '2024-03-10 02:30:59')": "2024/03/10 02-30-59 1710037859 070 0", "date('2024-02-30')": None, "date('2024-03-10', 'weekday 1')": "2024-03-11",
    "strftime('%f %W', '2024-03-10 02:30:59')": "59.000 10", "date('2024-03-10 23:59:59', 'start of month')": "2024-03-01",
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu", "America/Sao_Paulo"])
def test_time_functions_know_no_zone(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        db = Session(spark, str(tmp_path))
        row = db.execute("SELECT " + ", ".join(f"{sql} AS c{i}" for i, sql in enumerate(CASES))).first()
        assert dict(zip(CASES, row, strict=True)) == CASES
        assert db.execute("SELECT abs(unixepoch('now') - strftime('%s', 'now')) < 5 AS a").first()[0] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_fixed_points(spark):
    first = spark.createDataFrame([(1,), (1,), (None,)], "x long")
    out = fixed_point(first, lambda d: d.select((F.col("x") * 3 % 101).alias("x")), 1000)
    assert sorted(r.x or 0 for r in out.collect()) == [0, *sorted({pow(3, k, 101) for k in range(100)})]
    assert fixed_point(first.limit(0), lambda d: d, 5).count() == 0
    with pytest.raises(UnsupportedError):
        fixed_point(first, lambda d: d.select((F.col("x") + 1).alias("x")), 12)
