"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most `capacity` tokens.  The plan is made on counts: lengths fall, and
each count of equal pieces goes to the sequences with the least space that still holds them.  Pieces
then take the planned places by their rank within their length.  Ranks come from counts per length
and hash bucket, so a length that a third of all pieces share is never ordered in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import chunks
from .storage import settle
from .tokens import TOKEN_CHUNK_BYTES, WordTokenizer
from .workers import bounded_batches, lean

#: Hash buckets in which the pieces of one length are ranked.
RANK_BUCKETS = 256
#: Salts of pieces, and how many pieces a bucket has on average at most.
SALTS, BUCKET_PIECES = 65521, 1 << 20


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in each sequence, offset), ordered by length and rank.

    Piece r of a length, in the row with the last first rank up to r, goes to sequence
    first + (r - first rank) // pieces, at offset + (r - first rank) % pieces * length.
    The rows are bounded by the lengths and the splits they make, not by the pieces.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # space left: ranges (first sequence, sequences)
    spaces: list[int] = []  # the keys of free, ascending
    rows, next_sequence = [], 0

    def give(space: int, first: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in free:
                free[space] = []
                bisect.insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[i]
                new = False
            else:
                space, first, n, new = capacity, next_sequence, -1, True
            each = space // length
            n = -(-left // each) if new else n
            next_sequence += n if new else 0
            full = min(n, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - space))
                give(space - each * length, first, full)
                rank += full * each
                left -= full * each
            if full < n and left:
                rows.append((length, rank, first + full, left, capacity - space))
                give(space - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            give(space, first + full, n - full)
    return np.array(rows, np.int64).reshape(-1, 5)


def _piecer(path: str, capacity: int, end_id: int) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.at(path)
        for table in chunks(batches, limit=TOKEN_CHUNK_BYTES):
            ids, offsets = tokenizer.encode(table["text"])
            body = np.insert(ids, offsets[1:], end_id).astype("<u4")
            size = np.diff(offsets) + 1
            base = np.concatenate([[0], np.cumsum(size)])
            pieces = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = size - (pieces - 1) * capacity  # the first piece has what the others leave
            start = np.where(number == 0, 0, short[owner] + (number - 1) * capacity)
            length = np.where(number == 0, short[owner], capacity)
            raw = memoryview(body.tobytes())
            at = base[owner] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            ids_of = table["doc_id"].combine_chunks().take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _placer(plan) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        lengths = np.unique(rows[:, 0])
        lo, hi = np.searchsorted(rows[:, 0], lengths), np.searchsorted(rows[:, 0], lengths, "right")
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            row = np.empty(len(rank), np.int64)
            which = np.searchsorted(lengths, length)
            by = np.argsort(which, kind="stable")
            edges = np.searchsorted(which[by], np.arange(len(lengths) + 1))
            for i in np.flatnonzero(np.diff(edges)):
                own = by[edges[i] : edges[i + 1]]
                row[own] = lo[i] + np.searchsorted(rows[lo[i] : hi[i], 1], rank[own], "right") - 1
            within = rank - rows[row, 1]
            sequence = rows[row, 2] + within // rows[row, 3]
            offset = rows[row, 4] + within % rows[row, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs (doc_id, text).

    A text (null: empty) gives its ids and end_id.  Longer ones are cut into pieces of `capacity`
    tokens, of which the first may be shorter.  Every sequence is filled gapless from 0.  Repeated
    rows are packed as often as they occur; a null doc_id is packed too.  Other columns are ignored.
    No rows give no pieces.
    """
    bounded_batches(docs.sparkSession)
    pieces = docs.select("doc_id", "text").mapInArrow(_piecer(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # written down with a salt, so that repeated rows and null ids spread over the buckets that ranks are counted in
    pieces = settle(pieces.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")), "pieces")
    buckets = max(RANK_BUCKETS, pieces.count() // BUCKET_PIECES)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(buckets)).cast("int"))
    counted = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    running = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = settle(counted.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))), "counts")
    # at most one row for each length up to the capacity
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(best_fit(totals, capacity))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("inside", inside).join(counted.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).alias("rank"))
    return ranked.mapInArrow(_placer(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
