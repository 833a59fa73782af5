"""Token files as ORC: run-length coded ids, row indexes and Bloom filters on document ids.

Files are ranges of doc_id, each written in ascending order by one task, so a reader can take
stripes in parallel, and a lookup by doc_id skips files and stripes by their statistics and rows by the Bloom
filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_text import chunks
from .storage import new_path, settle
from .tokens import TOKEN_CHUNK_BYTES, WordTokenizer
from .workers import bounded_batches, lean

#: ORC's own settings: a row index entry every so many rows, the bytes of a stripe, the Bloom filter.
ORC_OPTIONS = {"orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.compress": "LZ4"}


def _encoder(path: str, end_id: int) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.at(path)
        for table in chunks(batches, limit=TOKEN_CHUNK_BYTES):
            ids, offsets = tokenizer.encode(table["text"])
            body = np.insert(ids, offsets[1:], end_id).astype(np.int32)
            ends = (offsets + np.arange(len(offsets))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(body))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), table["tie"].combine_chunks(), lists], names=["doc_id", "tie", "tokens"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Write (doc_id, tie, tokens: array of int) of docs (doc_id, text) as ORC in ascending doc_id order, nulls first.

    A text (null: empty) gives its ids and end_id.  tie is a hash of the text and orders rows that
    share a doc_id; rows equal in both are spread by a seeded number, so one doc_id that many rows
    share takes several files.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.rand(7).alias("spread"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(parts, "doc_id", "tie", "spread").sortWithinPartitions("doc_id", "tie")
    tokens = ordered.drop("spread").mapInArrow(_encoder(tokenizer_path, end_id), "doc_id long, tie long, tokens array<int>")
    tokens.write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, tie, tokens) of the files; a filter on doc_id reaches their statistics and Bloom filters."""
    return spark.read.schema("doc_id long, tie long, tokens array<int>").orc(path)


@lean
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "doc_id", "tie", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from token files.

    start counts the ids of all documents before, in the order of the files.  The files are read once;
    only a file's digests are ever ordered together, and the files' totals are summed ahead.
    """
    rows = read_token_files(spark, path).select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int").alias("file"), "doc_id", "tie", "tokens")
    rows = settle(rows.mapInArrow(_digest, "file int, doc_id long, tie long, n_tokens long, ids_crc32 long"), "digests")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "tie", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(base, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_orc(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write docs as token files in the shared folder and read their index back.

    Null and empty texts have the end id alone.  Repeated rows are written as often as they occur;
    rows that share a doc_id follow each other in a fixed order; null ids come first.  Columns other than doc_id
    and text are ignored.  No rows give no rows.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id)
    return token_index(docs.sparkSession, path)
