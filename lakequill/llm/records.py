"""Token ids in length-delimited binary records, with an offset index.

A file holds a header record, then one record for each document. A record is framed as

    length of the payload   8 bytes, little-endian
    masked crc of these     4 bytes
    payload
    masked crc of it        4 bytes
    a line feed             1 byte

where mask(crc) = ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32 and crc is CRC-32. A document's payload is its id
(8 bytes), a byte that tells whether the id is null and how wide token ids are (2 or 4 bytes), and the token ids. The
header's payload is the number of its file in the order of documents, and the byte 255.

Rows are dealt by ranges of doc_id, so that each task writes one file in order, through Spark's own writer and commit
protocol: a lost executor costs its tasks only, and any file system that Spark writes to will do. The index is a table
beside the files, made by reading them, with each record's file, offset, length and place in the whole stream.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, tokens

#: Bytes of text for each file, about.
FILE_BYTES = 24_000_000
_HEADER = 255
_NULL_ID, _WIDE = 1, 2


class CorruptRecord(ValueError):
    """A record whose checksum or length is wrong."""


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its line feed, which the writer adds."""
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def frames(data: bytes, offset: int = 0):
    """(offset, payload) of each record of a file's bytes; every checksum is compared."""
    view, end = memoryview(data), len(data)
    while offset < end:
        if offset + 17 > end:
            raise CorruptRecord(f"cut off at {offset}")
        (size,) = struct.unpack_from("<Q", view, offset)
        if struct.unpack_from("<I", view, offset + 8)[0] != masked(view[offset : offset + 8]) or offset + size + 17 > end:
            raise CorruptRecord(f"length at {offset}")
        payload = view[offset + 12 : offset + 12 + size]
        if struct.unpack_from("<I", view, offset + 12 + size)[0] != masked(payload) or view[offset + 16 + size] != 10:
            raise CorruptRecord(f"payload at {offset}")
        yield offset, payload
        offset += size + 17


def packed(doc_id: int | None, ids: np.ndarray, wide: bool | None = None) -> bytes:
    """A payload; wide tells whether ids need 4 bytes, where that is known."""
    if wide is None:
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    kind = (_NULL_ID if doc_id is None else 0) | (_WIDE if wide else 0)
    return struct.pack("<qB", doc_id or 0, kind) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpacked(payload: memoryview | bytes) -> tuple[int | None, np.ndarray]:
    doc_id, kind = struct.unpack_from("<qB", payload)
    return None if kind & _NULL_ID else doc_id, np.frombuffer(payload, "<u4" if kind & _WIDE else "<u2", offset=9).astype("<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end: int = tokens.END) -> None:
    """Encode docs(doc_id, text) into path/data and write path/index.

    Rows come in the order of doc_id, a null id first and repeated ids in an order fixed by their texts. A null or empty
    text has the end id alone. An empty table makes a file without documents. Other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    key = ["doc_id", F.xxhash64("text")]
    rows = docs.repartitionByRange(max(1, -(-total // FILE_BYTES)), *key).sortWithinPartitions(*key)

    def run(it):
        yield pa.RecordBatch.from_arrays([pa.array([frame(struct.pack("<qB", TaskContext.get().partitionId(), _HEADER))])], names=["frame"])
        wide = max(end, tokens.encoder(tokenizer).tokenizer.get_vocab_size() - 1) > 0xFFFF
        tail = np.array([end], dtype="<u4" if wide else "<u2").tobytes()
        for batch in common.batches(it):
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids = tokens.ids_of(part.column(1), tokenizer)
                out = [frame(packed(d, x, wide) + tail) for d, x in zip(part.column(0).to_pylist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    # bytes pass the text writer as they are
    rows.mapInArrow(common.trimmed(run, "encoder"), "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", "\n").text(f"{path}/data")


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the files."""

    def run(it):
        for batch in it:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                shard, rows, seen = None, [], 0
                for n, (offset, payload) in enumerate(frames(data)):
                    if n == 0:
                        shard, kind = struct.unpack_from("<qB", payload)
                        if kind != _HEADER:
                            raise CorruptRecord(f"{name} has no header")
                        continue
                    doc_id, ids = unpacked(payload)
                    rows.append((name, shard, n - 1, doc_id, offset, len(payload) + 17, seen, len(ids), zlib.crc32(ids.tobytes())))
                    seen += len(ids)
                for i in range(0, len(rows), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 65536], strict=True), [pa.string(), *[pa.int64()] * 8], strict=True)], names=list(_INDEX))

    files = spark.read.format("binaryFile").load(f"{path}/data").select("path", "content")
    return files.mapInArrow(common.trimmed(run), ", ".join(f"{n} {'string' if n == 'file' else 'long'}" for n in _INDEX))


_INDEX = ("file", "shard", "ordinal", "doc_id", "offset", "bytes", "before", "n_tokens", "ids_crc32")


def index(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back, compare every checksum, write path/index and return it: a row for each record."""
    _scan(spark, path).write.mode("overwrite").parquet(f"{path}/index")
    found = spark.read.parquet(f"{path}/index")
    # a row for each file
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return found.join(bases, "shard").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the records that wanted(file, offset) names: the read that a shuffled order of the index needs."""

    def run(it):
        for batch in it:
            for content, offsets in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = content.as_buffer()
                got = [unpacked(next(frames(data, o))[1]) for o in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([x.astype(np.int64) for _, x in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    files = spark.read.format("binaryFile").load(f"{path}/data").select(F.col("path").alias("file"), "content")
    asked = wanted.groupBy("file").agg(F.collect_list("offset").alias("offsets"))
    return files.join(asked, "file").select("content", "offsets").mapInArrow(run, "doc_id long, ids array<long>")
