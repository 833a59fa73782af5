"""Spelling variants: pairs of words one edit apart, from blocks of a forward and a reversed sorted dictionary.

One edit leaves a half of a word intact.  For the shorter length l of a pair, words are sorted by their first
l // 2 code points (forward) and by their last l - l // 2, read backwards (reversed); words that share such a half are a range
of that dictionary, and only words of one range are compared.  Ranges of more than LIMIT words are subdivided: of the part
that isn't known to be shared, again one half is intact, so the range is sorted by a longer prefix and, apart,
by a longer suffix.  At the end one code point is open, and words of one length in a range are no more than there are
letters.  A pair is reported in the one range that its common prefix leads to, so nothing is found twice.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import _LOWER, chunks, flatten, word_hashes
from .storage import discard, settle
from .workers import bounded_batches, lean

#: Fixed values of the contract: runs whose crc32 this divides lose a code point; least code points and occurrences of a word; how many times
#: more frequent than a word its form is.
SLIP, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Words of a range that are compared with one another; more are subdivided.
LIMIT = 64
#: Keys of ranges to subdivide that are broadcast at most; more meet their words by a sort-merge join.
BROADCAST_KEYS = 100_000
#: Text counted at once, pairs compared at once, code points of words that are compared in one table.
_CHUNK, _PAIRS, _TABLE_WIDTH = 2 << 20, 1 << 19, 64
#: Words that a task counts before it sends them on.
_HELD_WORDS = 300_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of A-Z, a-z and U+00C0 to U+00FF, whose UTF-8 starts with byte C3."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def run_checksums(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes, carried on from its seed."""
    out = seeds.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -255, "left"))  # runs of more than 255 bytes
    for i in order[:long].tolist():
        out[i] = zlib.crc32(lower[starts[i] : ends[i]].tobytes(), int(seeds[i])) ^ 0xFFFFFFFF
    order = order[long:]
    state, at = out[order], starts[order]
    live = np.searchsorted(-size[order], -np.arange(256), "left")  # runs with more than k bytes
    for k in range(255):
        m = int(live[k])
        if not m:
            break
        state[:m] = _CRC[(state[:m] ^ lower[at[:m] + k]) & 255] ^ (state[:m] >> 8)
    out[order] = state
    return out ^ np.uint32(0xFFFFFFFF)


@lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts; a word may occur again once _HELD_WORDS others were seen."""
    counts: Counter[str] = Counter()

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for table in chunks(batches, limit=_CHUNK):
        data, offsets = flatten(table["text"])
        starts, ends, owner = letter_runs(data, offsets)
        lower = _LOWER[data]
        ids = ["" if i is None else str(i) for i in table["doc_id"].to_pylist()]
        seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        points = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        length = points[ends] - points[starts]
        long = length >= LEAST_LENGTH  # shorter runs are no words, changed or not
        starts, ends, owner, length = starts[long], ends[long], owner[long], length[long]
        checks = run_checksums(lower, starts, ends, seeds[owner])
        slipped = checks % SLIP == 0
        for i in np.flatnonzero(slipped & (length > LEAST_LENGTH)).tolist():
            word = lower[starts[i] : ends[i]].tobytes().decode()
            gone = int(checks[i]) % len(word)
            counts[word[:gone] + word[gone + 1 :]] += 1
        whole = np.flatnonzero(~slipped)
        _, first, n = np.unique(word_hashes(data, starts[whole], ends[whole]), return_index=True, return_counts=True)
        raw = lower.tobytes()
        for x, y, k in zip(starts[whole][first].tolist(), ends[whole][first].tolist(), n.tolist(), strict=True):
            counts[raw[x:y].decode()] += k
        if len(counts) > _HELD_WORDS:
            yield sent()
            counts.clear()
    if counts:
        yield sent()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with LEAST_COUNT occurrences."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- the dictionaries -------------------------------------------------------------------------------------------------

#: way: the halves chosen so far; least: the shorter length of the pairs sought; front, back: code points of it known to be shared at the start and the
#: end; bound: pairs with a common prefix as long as this belong elsewhere.
_ENTRY = ("way", "least", "front", "back", "bound", "key", "word", "n")


def _halved(entries: DataFrame) -> DataFrame:
    """Each entry in the forward and in the reversed dictionary of the half that isn't known to be shared."""
    open_ = F.col("least") - F.col("front") - F.col("back")
    front, back = F.col("front") + F.floor(open_ / 2).cast("int"), F.col("back") + F.ceil(open_ / 2).cast("int")
    ways = F.array(
        F.struct(F.concat("way", F.lit("F")).alias("way"), front.alias("front"), F.col("back").alias("back"), F.col("bound").alias("bound")),
        F.struct(F.concat("way", F.lit("R")).alias("way"), F.col("front").alias("front"), back.alias("back"), F.least("bound", front).alias("bound")),
    )
    out = entries.select("least", "word", "n", F.explode(ways).alias("w")).select("w.way", "least", "w.front", "w.back", "w.bound", "word", "n")
    return out.withColumn("key", _key()).select(*_ENTRY)


def _key() -> Column:
    """The shared start, and the shared end read backwards."""
    end = F.expr("reverse(right(word, back))")
    return F.concat(F.expr("left(word, front)"), F.lit("/"), end)


def _ranges(words: DataFrame, limit: int) -> DataFrame:
    """Entries of both dictionaries, subdivided until each range is small or has one open code point."""
    least = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("least")
    zero = F.lit(0)
    start = words.select("word", "n", least).select("*", F.lit("").alias("way"), zero.alias("front"), zero.alias("back"), F.lit(2**31 - 1).alias("bound"))
    entries, done = _halved(start), None
    while True:
        sizes = entries.groupBy("way", "least", "key").agg(F.count("*").alias("size"), F.first(F.col("least") - F.col("front") - F.col("back")).alias("open"))
        large = settle(sizes.where((F.col("size") > limit) & (F.col("open") > 1)).select("way", "least", "key"), "large")
        many = large.count()
        listed = F.broadcast(large) if many <= BROADCAST_KEYS else large.hint("merge")  # hot ranges are split by the skew join
        small = entries if not many else entries.join(listed, ["way", "least", "key"], "left_anti").select(*_ENTRY)
        done = small if done is None else done.unionByName(small)
        if not many:
            return done
        entries = settle(_halved(entries.join(listed, ["way", "least", "key"], "left_semi")), "entries")


def _common(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common prefix and suffix of each two words."""
    start, end = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        m = min(len(a), len(b))
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        apart = np.flatnonzero(x[:m] != y[:m])
        start[i] = apart[0] if len(apart) else m
        apart = np.flatnonzero(x[::-1][:m] != y[::-1][:m])
        end[i] = apart[0] if len(apart) else m
    return start, end


def _near(words: list[bytes], tables: tuple[np.ndarray, np.ndarray] | None, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether words i and j are one edit apart, and the length of their common prefix."""
    shorter = np.minimum(length[i], length[j])
    if tables is None:
        start, end = _common([words[k] for k in i.tolist()], [words[k] for k in j.tolist()])
    else:
        start, end = ((t[i] != t[j]) for t in tables)
        start, end = start.argmax(1), end.argmax(1)  # all words end in unlike signs, see _tables
        start, end = np.minimum(start, shorter), np.minimum(end, shorter)
    one = np.where(length[i] == length[j], start + end >= shorter - 1, (start + end >= shorter) & (np.abs(length[i] - length[j]) == 1))
    return one, start


def _tables(words: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Words as rows of code points from their starts and from their ends; what follows differs from row to row by its number."""
    width = int(length.max()) + 3
    if width > _TABLE_WIDTH:
        return None
    flat = np.frombuffer(b"".join(words), np.uint8)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    row, place = np.repeat(np.arange(len(words)), length), np.arange(len(flat)) - np.repeat(first, length)
    out = []
    for at in (place, np.repeat(length, length) - 1 - place):
        table = np.zeros((len(words), width), np.uint8)
        number = np.arange(len(words))
        table[:, -3], table[:, -2], table[:, -1] = number & 255, (number >> 8) & 255, (number >> 16) & 255
        table[row, at] = flat
        out.append(table)
    return tuple(out)


def _pairs(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All two members i < j of each range edges[k]:edges[k + 1]."""
    size = np.diff(edges)
    last = np.repeat(edges[1:], size)
    first = np.arange(edges[0], edges[-1])
    count = last - first - 1
    i = np.repeat(first, count)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


@lean
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) both ways of all near pairs within ranges; rows are sorted by range."""

    def closed(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts = table["word"].to_pylist()
        words = [w.encode("latin-1") for w in texts]
        n, least, bound = (table[c].to_numpy() for c in ("n", "least", "bound"))
        length = np.fromiter(map(len, words), np.int64, len(words))
        cost = np.concatenate([[0], np.cumsum(np.diff(edges) * (np.diff(edges) - 1) // 2)])
        at = 0
        while at + 1 < len(edges):
            upto = max(at + 1, int(np.searchsorted(cost, cost[at] + _PAIRS, "right")) - 1)
            low, high = int(edges[at]), int(edges[upto])
            i, j = _pairs(edges[at : upto + 1] - low)
            own = length[low:high]
            fits = np.minimum(own[i], own[j]) == least[low:high][i]  # two of the longer length meet in another range
            i, j = i[fits], j[fits]
            if len(i):
                near, start = _near(words[low:high], _tables(words[low:high], own), own, i, j)
                near &= start < bound[low:high][i]
                i, j = i[near] + low, j[near] + low
                a, b = np.concatenate([i, j]), np.concatenate([j, i])
                yield pa.RecordBatch.from_arrays([pa.array([texts[k] for k in a.tolist()], pa.string()), pa.array([texts[k] for k in b.tolist()], pa.string()), pa.array(n[b])], names=["word", "near", "near_n"])
            at = upto

    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        new = np.ones(now.num_rows, bool)
        new[1:] = False
        for c in ("way", "least", "key"):
            codes = now[c].combine_chunks()
            codes = codes.dictionary_encode().indices.to_numpy() if pa.types.is_string(codes.type) else codes.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        edges = np.flatnonzero(new)
        if len(edges) > 1:
            yield from closed(now.slice(0, edges[-1]), edges)
        rest = now.slice(edges[-1])
    if rest is not None:
        yield from closed(rest, np.array([0, rest.num_rows]))


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, near, near_n) for every ordered pair of words (word, n; distinct) one inserted, deleted or replaced code point apart."""
    sorted_ = _ranges(words, limit).repartitionByRange(F.col("way"), F.col("least"), F.col("key")).sortWithinPartitions("way", "least", "key")
    return sorted_.mapInArrow(_scan, "word string, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of each link (word, form): where following forms ends. Each round doubles the steps taken."""
    now = settle(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        then = settle(now.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        discard(now)
        now = then
        if not now.where("went").head(1):
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text).

    Words are runs of letters, A-Z lower-cased; a run whose crc32 of <doc_id>:<run> SLIP divides loses the code point that
    this number points at.  A null doc_id stands for nothing before the colon; null and empty texts have no words; a repeated
    row counts again; runs and texts may be of any length; other columns are ignored; no words give no rows.  Of
    near words of the same n the smallest in code-point order is the form.
    """
    words = settle(word_counts(docs), "words")
    near = near_pairs(words, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    frequent = -F.col("best.less") >= TIMES * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    formed = settle(formed, "formed")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
