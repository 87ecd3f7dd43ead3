"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII space and U+0009..U+000D; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that Python workers get, unless the session says otherwise: 10,000 rows of long texts could be any size.
BATCH_BYTES = 4 << 20


def lean(spark: SparkSession) -> None:
    """Bound the batches of Python workers by bytes where the session has Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    It is the cluster's spark.checkpoint.dir. Only where that is unset, as in tests on one machine,
    a temporary folder takes its place.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not told:
        told = tempfile.mkdtemp(prefix="lakequill-")
        spark.sparkContext.setCheckpointDir(told)
        told = spark.sparkContext.getCheckpointDir()
    return told.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lakequill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a DataFrame into the shared folder and read it back: it is computed once, and its lineage is cut."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    lean(spark)
    (df.repartition(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that one file of a small result takes.
ROWS_A_FILE = 200_000


def compact(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """stored(), in as many files as its rows of a few numbers need, and the number of rows."""
    made = kept(df)
    n = made.count()
    out = stored(made, name, 1 + n // ROWS_A_FILE)
    made.unpersist()
    return out, n


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept(df: DataFrame) -> DataFrame:
    """A DataFrame that is computed once and kept on executors' disks, for later steps that read it again.

    Its lineage stays: what is lost with an executor is computed again.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def raw(column: pa.Array) -> list[bytes | None]:
    """Texts of a column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def split(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lowered; null has none."""
    return [] if text is None else text.lower().split()


def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves out batches without rows."""
    return (b for b in rows if b.num_rows)


def slices(rows: Iterable[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows in batches of a bounded number, so that what is made of them is bounded, too."""
    for batch in rows:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def trim() -> None:
    """Give memory that is free in this process back: Python workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


#: By name, how to clear what this process remembers for later tasks of the same kind.
REMEMBERED: dict[str, Callable[[], None]] = {}


def let_go(but: str = "") -> None:
    """Forget what only tasks of other kinds use: Python workers go on to other operators' tasks."""
    for name, clear in REMEMBERED.items():
        if name != but:
            clear()


def trimmed(run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]], uses: str = "") -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that trims its process when its task is done, and first lets go of what it does not use."""

    def then_trim(it):
        let_go(uses)
        yield from run(it)
        trim()

    return then_trim


def mapped(df: DataFrame, each: Callable[[pa.RecordBatch], Iterable[dict]], schema: str, uses: str = "") -> DataFrame:
    """mapInArrow with a function from a batch of some rows to dicts of columns."""
    lean(df.sparkSession)
    return df.mapInArrow(trimmed(_over(each, schema), uses), schema)


def _over(each: Callable[[pa.RecordBatch], Iterable[dict]], schema: str):
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(it):
        for batch in slices(it):
            for columns in each(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (columns[n] for n in names)], names=names)

    return run


#: Bits of a filter of ids: 1 MB, whatever the corpus.
ID_BITS = 1 << 23


def likely(rows: DataFrame, ids: DataFrame, each: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """mapped(), of those rows(doc_id, ...) whose id, a long, is among ids, and a few more: a filter of bounded size picks them.

    Both are one step, as each step of a stage has Python workers of its own, which live on.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    bits = np.zeros((ID_BITS // 32768, 4096), dtype=np.uint8)
    for at, part in ids.groupBy(F.floor(slot / 32768).alias("at")).agg(F.bitmap_construct_agg(slot % 32768).alias("bits")).collect():
        bits[at] = np.frombuffer(bytes(part), dtype=np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(bits.ravel())

    def picked(it):
        for batch in batches(it):
            at = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).cast(pa.bool_())).select(list(range(batch.num_columns - 1)))

    rows = rows.where("doc_id is not null")
    run = _over(each, schema)
    return rows.select("*", slot.alias(fresh("slot", rows))).mapInArrow(trimmed(lambda it: run(picked(it))), schema)


def id_crc(column: str = "doc_id"):
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string"))


class Forest:
    """Union-find over integer ids whose roots are the smallest ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while (y := up[x]) != top:
            up[x], x = top, y
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a < b:
            self.up[b] = a
        else:
            self.up[a] = b
        return True


def _contract(it):
    """Links of a partition become a star for each group that they form in it."""
    forest = Forest()
    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = list(forest.up)
    roots = [forest.root(x) for x in nodes]
    kept = [(x, r) for x, r in zip(nodes, roots, strict=True) if x != r]
    for i in range(0, len(kept), 65536):
        part = kept[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["a", "b"])


#: Up to so many links one task joins them all; more go through rounds of stars over all executors.
LINKS_IN_ONE_TASK = 200_000


def components(links: DataFrame, in_one_task: int = LINKS_IN_ONE_TASK) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node that links reach.

    Links (a, b) are contracted to stars partition by partition. A remainder of at most ``in_one_task`` links is
    joined in one task; a larger one goes through alternating large and small stars (Kiveris et al., 2014), each
    round written to the shared folder, so that neither the driver nor a task ever holds all of it.
    """
    edges, n = compact(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, "a long, b long"), "links")
    if n <= in_one_task:
        return stored(edges.repartition(1).mapInArrow(_contract, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("component")), "components").transform(_with_roots)
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        edges = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).transform(_with_roots)


def _with_roots(stars: DataFrame) -> DataFrame:
    return stars.union(stars.select("component", "component").distinct())


def padded_bits(n: int) -> int:
    """Smallest power of two of at least n."""
    return 1 << max(0, int(np.ceil(np.log2(max(1, n)))))
