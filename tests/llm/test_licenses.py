import duckdb
import pytest
from pyspark.sql import functions as F

from lakequill.llm import licenses as lic

MIT, ZLIB, BSD3 = lic._MIT, lic._ZLIB, lic._BSD_HEAD + lic._BSD_NAME + lic._BSD_TAIL
ROWS = [
    (1, "Copyright (c) 2020 Some One\n\n" + MIT.upper().replace(" ", "\n"), "MIT"), (2, "# MIT Licence\n(c) me\n" + MIT.replace('"', "''"), "MIT"), (3, BSD3 + " x", None), (4, None, None), (5, "", None),
    (6, "Licenced under the Apache Licence, version 2.0", "Apache-2.0"), (7, "© 2001 X. All rights reserved.\n * " + ZLIB.replace("\n", "\n * "), "Zlib"), (8, BSD3.replace("holder ", "owner "), "BSD-3-Clause"), (9, MIT + "\nextra words", None),
    (10, "Some prose.\nReleased under the MIT License.\nMore prose, and more.\nLicensed under CC BY-NC 4.0.", None), (10, "Copyright 2020 A\nCopyright <year> B\n" + MIT, "MIT"), (None, "prose " * 9000, None), (11, "All rights reserved.", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t, _ in ROWS], "doc_id long, text string").repartition(3)


def test_entire_texts_and_notices(docs):
    got = sorted(((r.doc_id or 0, r.license or "") for r in lic.scanned(docs).collect()))
    assert got == sorted((i or 0, k or "") for i, _, k in ROWS)
    r = lic.scanned(docs).where("n_notices = 2").first()
    assert (r.doc_id, r.notices) == (10, "CC-BY-NC-4.0,MIT")


def test_against_sql(docs):
    c = duckdb.connect()
    frame = docs.toPandas()
    c.register("documents", frame)
    plain = lambda rows: sorted(tuple("" if v is None or v != v else v for v in r) for r in rows)
    got = plain([tuple(r) for r in lic.scanned(docs).select("license", "n_notices", "notices").collect()])
    assert got == plain(c.execute(f"SELECT license, n_notices, notices FROM ({lic.oracle()})").fetchall())


def test_odd_tables(docs):
    clashing = docs.withColumn("digest", F.lit(1)).withColumn("license", F.lit("x")).withColumn("found", F.lit(2))
    assert lic.scanned(clashing).count() == len(ROWS) and lic.scanned(docs.limit(0)).count() == 0


def test_plans_have_no_python(docs):
    plan = lic.scanned(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
