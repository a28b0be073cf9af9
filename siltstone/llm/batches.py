"""The corpus as compressed batches in the shared checkpoint folder.

Operators that ask something of the whole corpus (counts of words, which fingerprints recur) do it batch by batch: a
batch sends one packed request to each shard and gets one packed answer from it. Neither texts nor single words or
fingerprints then travel as rows of their own, a key that is frequent in the corpus is one entry a batch, and the batch
number names a row of the input even where ids are null or repeated. The batches are written once, so an answer always
meets the batch that asked, whatever executor is lost meanwhile.

Spark takes a row with compressed bytes for a small one, so joins of such rows carry a hint against broadcasting them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fixed_plan, partitions, settle, texts

SCHEMA = "batch long, ids array<long>, lengths binary, texts binary, rest binary"
#: Bytes of text in a batch, about; a longer text is a batch of its own.
SIZE = 4 << 20


def pack(a: np.ndarray) -> bytes:
    """An array compressed."""
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 3)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def to_bytes(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    return sink.getvalue().to_pybytes()


def rest(row: dict) -> pa.RecordBatch:
    """The other columns of a batch's rows."""
    return pa.ipc.open_stream(row["rest"]).read_next_batch()


def batched(docs: DataFrame, keep: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """``docs`` (doc_id, text; null: empty) as rows of SCHEMA, written to the checkpoint folder. keep: further columns."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in arrived:
            buf, offsets = texts(b.column("_text"))
            ids = b.column("_id")
            other = b.select(list(keep)) if keep else None
            for i, j in chunks(offsets, size):
                lists = pa.ListArray.from_arrays(np.array([0, j - i], np.int32), ids[i:j])
                cells = (pack(np.diff(offsets[i : j + 1])), pack(buf[offsets[i] : offsets[j]]), to_bytes(other.slice(i, j - i)) if keep else None)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists, *(pa.array([c], pa.binary()) for c in cells)], SCHEMA.replace(",", "").split()[::2])
                number += 1

    columns = [F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *keep]
    with fixed_plan(docs.sparkSession):  # dealt by batch, and so read without a shuffle by joins on it
        return settle(docs.select(*columns).mapInArrow(run, SCHEMA).repartition(partitions(docs), "batch"))


def opened(row: dict) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a batch's texts."""
    offsets = np.concatenate([[0], np.cumsum(unpack(row["lengths"], np.int64))])
    return row["ids"], unpack(row["texts"], np.uint8), offsets


def each(arrived: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that only one batch is unpacked at a time."""
    for b in arrived:
        for k in range(b.num_rows):
            yield {n: b.column(n)[k].as_py() for n in b.schema.names}


def shards(corpus: DataFrame, size: int) -> int:
    """How many shards of about ``size`` bytes of the corpus's texts."""
    total = corpus.select(F.sum(F.octet_length("texts"))).first()[0] or 0
    return max(1, -(-3 * total // size))
