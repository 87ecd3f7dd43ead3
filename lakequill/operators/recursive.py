"""Fixed points of a step over DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import UnsupportedError
from ..storage.files import shared_root


#: Folders of rows so far, after which they are merged into one.
FOLDERS = 16


def fixed_point(first: DataFrame, step: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """first, and all that steps from new rows make, each row once.

    The new rows of every step are written once into a folder that executors share, so that plans stay short and survive
    lost executors; all rows so far are one scan of few folders. ``most`` steps without an end are an error, not a cut.
    """
    spark = first.sparkSession
    folder = f"{shared_root(spark)}/fixed-point-{uuid.uuid4().hex}"
    paths: list[str] = []

    def scan(*some: str) -> DataFrame:
        return spark.read.schema(first.schema).parquet(*some)

    def written(rows: DataFrame) -> str:
        path = f"{folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    paths.append(written(first.distinct()))
    new = scan(paths[0])
    for _ in range(most):
        if len(paths) > FOLDERS:
            paths = [written(scan(*paths))]
        seen = scan(*paths)
        # null-safe: EXCEPT treats nulls as equal, and leaves each row once
        paths.append(written(step(new).toDF(*first.columns).subtract(seen)))
        new = scan(paths[-1])
        if new.isEmpty():
            return seen
    raise UnsupportedError(f"no end after {most} steps of recursion")
