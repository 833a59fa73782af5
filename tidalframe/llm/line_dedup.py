"""Repeated passages: units of lines hashed, grouped globally, all but the earliest occurrence removed.

A unit is a line, cut after words that end in . ! ? , ; or : so that a long paragraph line does not hide a
repeated passage, wherever it begins.  Units are normalised (A-Z lower-cased, white space collapsed) and
hashed to 128 bits.  By default every repeated unit goes.  Where only passages shall go, a least number of
words can be asked of the units that have digests of their own (a shorter one is hashed together with its
neighbours, once with those after it and once with those before it, so that a passage of short lines
is found too) and of repeated units in a row.  Occurrences rank by (doc_id, row, number of the first unit), rows being numbered
once when the documents are written down, so that null and shared ids mix up nothing.  Within each chunk of rows only the earliest
occurrence of a digest travels, packed with others of its hash bucket; later ones are known to be
repeats at once, so a line that every document holds costs a task one entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, chunks, flatten, mix, segment_sum, word_bounds, word_hashes
from .storage import settle
from .workers import bounded_batches, lean

#: For passages: units of fewer words have digests with their neighbours only, up to this many words, and go between two
#: removed units; repeated units in a row go if they have this many words together.
PASSAGE_UNIT, PASSAGE_RUN = 3, 25
_NO_ID = 2**63 - 1
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?,;:"]] = True
_FLUSH = 1 << 18


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all units: first byte, end byte, text number, number in the text, words, and two digests."""
    starts, ends, docs = word_bounds(data, offsets)
    if not len(starts):
        none, nothing = np.zeros(0, np.int64), np.zeros(0, U64)
        return none, none, none, none, none, nothing, nothing
    lines = np.cumsum(data == 10, dtype=np.int64)
    opens = np.ones(len(starts), bool)
    opens[1:] = (docs[1:] != docs[:-1]) | (lines[starts[1:]] > lines[ends[:-1] - 1]) | _END[data[ends[:-1] - 1]]
    first = np.flatnonzero(opens)
    at = np.append(first, len(starts))
    words = np.diff(at)
    owner = docs[first]
    number = np.arange(len(first)) - np.searchsorted(owner, owner, "left")
    place = (np.arange(len(starts)) - np.repeat(first, words)).astype(U64)
    hashed = word_hashes(data, starts, ends)
    one = mix(segment_sum(mix(hashed + place * U64(0x9E3779B97F4A7C15)), at) + words.astype(U64))
    two = mix(segment_sum(mix((hashed ^ U64(0xD6E8FEB86659FD93)) + place * U64(0xC2B2AE3D27D4EB4F)), at) ^ words.astype(U64))
    return starts[first], ends[at[1:] - 1], owner, number, words, one, two


def spans(owner: np.ndarray, words: np.ndarray, one: np.ndarray, two: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all that has a digest: first unit, units after it, and two digests.

    That is each unit of at least `least` words, and the shortest rows of that many words that start or end with a shorter unit.
    """
    long, short = np.flatnonzero(words >= least), np.flatnonzero(words < least)
    codes = [long * least]
    for way in (1, -1):
        far, total = short.copy(), words[short].copy()
        for _ in range(least - 1):
            after = np.clip(far + way, 0, len(words) - 1)
            more = (total < least) & (after != far) & (owner[after] == owner[short])
            far = np.where(more, after, far)
            total += np.where(more, words[after], 0)
        whole = total >= least
        first = np.minimum(short, far)[whole]
        codes.append(first * least + np.abs(far - short)[whole])
    first, rest = np.divmod(np.unique(np.concatenate(codes)), least)
    one_of, two_of = one[first], two[first]
    for k in range(1, least):
        at = np.flatnonzero(rest >= k)
        one_of[at] = mix(one_of[at] * U64(0x9E3779B97F4A7C15) + one[first[at] + k])
        two_of[at] = mix(two_of[at] * U64(0xC2B2AE3D27D4EB4F) ^ two[first[at] + k])
    return first, rest, one_of, two_of


def _units_of(row: np.ndarray, code: np.ndarray, lead_row: np.ndarray, lead_code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, unit) of the units of repeats, without those that the earliest occurrence itself holds; code is first unit * least + units after it."""
    first, rest = np.divmod(code, least)
    lead_last = lead_code // least + lead_code % least
    last = first + rest
    first = np.where(row == lead_row, np.maximum(first, lead_last + 1), first)
    count = np.maximum(last - first + 1, 0)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(row, count), np.repeat(first, count) + place


def _again(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted occurrences: which are the earliest of their digest, and the number of that for each."""
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return new, np.flatnonzero(new)[np.cumsum(new) - 1]


def _packed(columns: list[np.ndarray], bucket: np.ndarray, buckets: int, kind: int) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(edges))
    columns = [np.ascontiguousarray(c[order]).view(np.int64) for c in columns]
    blobs = [b"".join(c[edges[i] : edges[i + 1]].tobytes() for c in columns) for i in used]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), kind), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def _digest(buckets: int, least: int) -> Callable:
    shift = U64(64 - buckets.bit_length() + 1)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            one, two, doc, row, code = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((code, row, doc, two, one))
            one, two, doc, row, code = one[order], two[order], doc[order], row[order], code[order]
            new, lead = _again(one, two)
            again = np.flatnonzero(~new)
            yield _packed([one[new], two[new], doc[new], row[new], code[new]], (one[new] >> shift).astype(np.int64), buckets, 0)
            gone, unit = _units_of(row[again], code[again], row[lead[again]], code[lead[again]], least)
            if len(gone):
                yield _packed([gone, unit], (mix(gone.view(U64)) >> shift).astype(np.int64), buckets, 1)

        size = 0
        for table in chunks(batches):
            data, at = flatten(table["text"])
            ids = table["doc_id"].combine_chunks().fill_null(_NO_ID).to_numpy()
            _, _, owner, number, words, one, two = units(data, at)
            first, rest, one, two = spans(owner, words, one, two, least)
            rows = table["row"].combine_chunks().to_numpy()
            held.append([one, two, ids[owner[first]], rows[owner[first]], number[first] * least + rest])
            size += len(first)
            if size >= _FLUSH:
                yield from flush()
                held.clear()
                size = 0
        if size:
            yield from flush()

    return run


def _repeats(least: int) -> Callable:
    """(row, unit) of the units of all but the earliest occurrence of each digest; reads blobs sorted by bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            rows, numbers = [], []
            for kind, blob in held:
                if kind == 1:
                    both = np.frombuffer(blob, np.int64).reshape(2, -1)
                    rows.append(both[0])
                    numbers.append(both[1])
            if sets := [np.frombuffer(blob, np.int64).reshape(5, -1) for kind, blob in held if kind == 0]:
                one, two, doc, row, code = np.concatenate(sets, 1)
                order = np.argsort(one, kind="stable")
                same = np.zeros(len(one), bool)
                ranked = one[order]
                same[1:] = ranked[1:] == ranked[:-1]
                same[:-1] |= same[1:]
                order = order[same]
                one, two, doc, row, code = one[order], two[order], doc[order], row[order], code[order]
                order = np.lexsort((code, row, doc, two, one))
                one, two, doc, row, code = one[order], two[order], doc[order], row[order], code[order]
                if len(one):
                    new, lead = _again(one, two)
                    again = np.flatnonzero(~new)
                    gone, unit = _units_of(row[again], code[again], row[lead[again]], code[lead[again]], least)
                    rows.append(gone)
                    numbers.append(unit)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(numbers))], names=["row", "unit"])

        held: list[tuple[int, bytes]] = []
        now = None
        for batch in batches:
            for bucket, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now and held:
                    yield from close(held)
                    held = []
                now = bucket
                held.append((kind, blob))
        if held:
            yield from close(held)

    return run


def repeated_units(numbered: DataFrame, unit_words: int = 1) -> DataFrame:
    """(row, repeats: array of unit numbers) of rows of numbered (row, doc_id, text; row unique) with a unit that occurs earlier; a null doc_id ranks last."""
    spark = numbered.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(8, (2 * parts - 1).bit_length())
    blobs = numbered.select("row", "doc_id", "text").mapInArrow(_digest(buckets, unit_words), "bucket int, kind int, blob binary")
    found = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeats(unit_words), "row long, unit long")
    return settle(found.groupBy("row").agg(F.collect_set("unit").alias("repeats")), "repeats")


def _runs_to_cut(data: np.ndarray, offsets: np.ndarray, flagged: pa.Array, unit_words: int, run_words: int) -> list[list[tuple[int, int, int, int]]]:
    """For each text the runs that go: first byte, end byte, first byte of what follows, words."""
    start, end, owner, number, words, _, _ = units(data, offsets)
    n = len(offsets) - 1
    first = np.searchsorted(owner, np.arange(n + 1))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
    for d, marks in enumerate(flagged.to_pylist()):
        if not marks:
            continue
        a, b = first[d], first[d + 1]
        gone = np.zeros(b - a, bool)
        at = np.array(marks, np.int64)
        gone[at] = True
        short = words[a:b] < unit_words
        i = 0
        while i < b - a:
            if not gone[i]:
                i += 1
                continue
            last = j = i
            while j < b - a and (gone[j] or short[j]):
                last = j if gone[j] else last
                j += 1
            total = int(words[a + i : a + last + 1].sum())
            if total >= run_words:
                follows = int(start[a + last + 1]) if last + 1 < b - a else int(offsets[d + 1])
                out[d].append((int(start[a + i]), int(end[a + last]), follows, total))
            i = last + 1
    return out


def _cutter(unit_words: int, run_words: int) -> Callable:
    """Texts without their repeats; the last column has the flagged units, and gives way to the removed spans."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])
        for table in chunks(batches):
            data, offsets = flatten(table["text"])
            raw = data.tobytes()
            # code points before each byte: continuation bytes are 10xxxxxx
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            texts, spans = table["text"].to_pylist(), []
            for d, runs in enumerate(_runs_to_cut(data, offsets, table["repeats"].combine_chunks(), unit_words, run_words)):
                base = points[offsets[d]]
                spans.append([{"start": int(points[a] - base), "end": int(points[b] - base), "words": w} for a, b, _, w in runs])
                if runs:
                    kept, at = [], int(offsets[d])
                    for a, _, follows, _ in runs:
                        kept.append(raw[at:a])
                        at = follows
                    kept.append(raw[at : offsets[d + 1]])
                    texts[d] = b"".join(kept).decode("utf-8", "replace")
            at = table.schema.get_field_index("text")
            table = table.set_column(at, "text", pa.array(texts, pa.string()))
            table = table.set_column(table.schema.get_field_index("repeats"), "repeats", pa.array(spans, pa.list_(span)))
            yield from table.rename_columns([*table.schema.names[:-1], "removed"]).combine_chunks().to_batches()

    return run


def without_repeats(docs: DataFrame, only_changed: bool = False, unit_words: int = 1, run_words: int = 1) -> DataFrame:
    """docs with repeated passages removed, and a column removed: array of (start, end, words).

    start and end are code points of the original text.  Runs of units that each occur earlier
    (smaller doc_id, or earlier in the same text) go if they have run_words words together; by
    default every repeated unit goes.  Units of under unit_words words count with their neighbours.
    Texts may be of any length.  Null and empty texts stay as they are with nothing removed.  Every row counts for
    itself: of repeated rows, and of rows that share a doc_id, the one read first is the earlier; a null doc_id ranks
    last.  Extra columns are carried through, whatever their names, but for one named removed, which is replaced.
    """
    docs = docs.drop("removed")
    names = docs.columns
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)])
    numbered = settle(inner.withColumn("row", F.monotonically_increasing_id()), "numbered")
    flagged = repeated_units(numbered, unit_words)
    # a sort-merge join whatever the size: the flagged rows grow with the documents
    joined = numbered.join(flagged.hint("merge"), "row", "inner" if only_changed else "left").drop("row")
    shape = ", ".join(f"`{c}` {t}" for c, t in joined.dtypes[:-1]) + ", removed array<struct<start: long, end: long, words: long>>"
    out = joined.mapInArrow(_cutter(unit_words, run_words), shape).toDF(*names, "removed")
    return out.where("size(removed) > 0") if only_changed else out
