"""Folders of files as read-only tables of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import Session

# The tables of a test folder.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def attached(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES, form: str = "parquet", root: str | None = None, **options) -> Session:
    """A session with the files ``folder/name.form`` attached, lazily: only what a query reads is scanned."""
    session = Session(spark, root)
    reader = spark.read.options(**options)
    for name in names:
        session.attach_lazily(name, lambda name=name: reader.format(form).load(f"{folder}/{name}.{form}"))
    return session
