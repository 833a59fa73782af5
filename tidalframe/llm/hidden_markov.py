"""Hidden Markov language model: Baum-Welch counts summed over partitions, scaled forward recursion for likelihoods.

Texts are token sequences of words and one end.  A latent state emits one of CLASSES word classes (the upper bits of a
word's hash; the end is a class of its own) and the class emits the word by its count in the training texts, so
the states' tables have a fixed size while the counts that words are scored by grow with the corpus.  A class
also emits words it never saw, with a tenth of a count, so the probabilities of all words add up to 1.

The texts become chunk rows once: per chunk its distinct words and each token's place among them.  Word counts
meet in buckets by hash and return to the chunks that asked.  Baum-Welch reads the chunk rows in place; each task
sends one table of expected counts, which are summed in a fixed order.  The states start as "the last of the most
frequent words seen", which tells languages and topics apart at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, chunks, flatten, word_bounds, word_hashes
from .storage import settle
from .workers import bounded_batches, lean

#: Word classes (a power of two), latent states, rounds of Baum-Welch.
CLASS_BITS, STATES, ROUNDS = 16, 16, 3
#: Pseudo-counts of each word class, spread over states by their shares, and of each start and transition.
CLASS_PRIOR, STEP_PRIOR = 2.0, 1.0
#: Text of a chunk row, tokens of a block of the recursion, tokens recursed over at once, entries of a bucket of word counts.
CHUNK_TEXT, BLOCK, AT_ONCE, BUCKET_ENTRIES = 8 << 20, 2048, 1 << 20, 4 << 20
END = 1 << CLASS_BITS
_TABLES = 64  # rows that a table of expected counts travels in


@dataclass
class Hmm:
    """start (states), step (states x states), emit (classes + 1 x states): probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


# --- chunk rows -------------------------------------------------------------------------------------------------------

CHUNK_ROW = "chunk long, docs binary, absent binary, lengths binary, held binary, places binary, words binary, counts binary"


def _chunk_row(number: int, table: pa.Table) -> pa.RecordBatch:
    data, offsets = flatten(table["text"])
    starts, ends, owner = word_bounds(data, offsets)
    hashed = word_hashes(data, starts, ends)
    words, place = np.unique(hashed, return_inverse=True)
    ids = table["doc_id"].combine_chunks()
    held = table["held_out"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    lengths = np.bincount(owner, minlength=table.num_rows)
    counts = np.bincount(place[~held[owner]], minlength=len(words)) if len(words) else np.zeros(0)
    packed = [
        ids.fill_null(0).to_numpy().astype(np.int64), np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool), lengths.astype(np.int64), held,
        place.astype(np.uint32), words, counts.astype(np.uint32),
    ]
    return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([p.tobytes()], pa.binary()) for p in packed)], names=[f.split()[0] for f in CHUNK_ROW.split(", ")])


@lean
def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of blobs for each chunk of texts; its number has the partition in the upper bits."""
    first = TaskContext.get().partitionId() << 32
    for i, table in enumerate(chunks(batches, limit=CHUNK_TEXT)):
        yield _chunk_row(first + i, table)


def _bytes(batch: pa.RecordBatch | pa.Table, name: str, kind: type, row: int = 0) -> np.ndarray:
    return np.frombuffer(batch[name][row].as_py(), kind)


def _classes(words: np.ndarray) -> np.ndarray:
    return (words >> U64(64 - CLASS_BITS)).astype(np.int32)


def _sequences(places: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of every token, with the ends put in, and the n + 1 offsets of texts."""
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(offsets[-1], END, np.int32)
    if len(places):
        out[np.arange(len(places)) + np.repeat(np.arange(len(lengths)), lengths)] = classes[places]
    return out, offsets


# --- the recursion ----------------------------------------------------------------------------------------------------


@dataclass
class Expected:
    """Expected counts of starts, steps and emissions."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def none() -> "Expected":
        return Expected(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((END + 1, STATES)))


def _by_size(first: np.ndarray, size: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of blocks by falling size, at_once tokens a group, and for each step how many of them have a token there."""
    order = np.argsort(-size, kind="stable")
    low = 0
    while low < len(order):
        own = order[low : low + max(1, at_once // max(1, int(size[order[low]])))]
        low += len(own)
        yield own, np.searchsorted(-size[own], -np.arange(int(size[own[0]])), "left")


def _transfers(tokens: np.ndarray, first: np.ndarray, size: np.ndarray, model: Hmm) -> np.ndarray:
    """For blocks that follow others: the product of their step and emission matrices, each scaled now and then."""
    out = np.empty((len(first), STATES, STATES), np.float32)
    for own, live in _by_size(first, size, AT_ONCE // 4):
        now = np.broadcast_to(np.eye(STATES, dtype=np.float32), (len(own), STATES, STATES)).copy()
        for k, m in enumerate(live.tolist()):
            value = (now[:m].reshape(-1, STATES) @ model.step).reshape(m, STATES, STATES)
            value *= model.emit[tokens[first[own[:m]] + k]][:, None, :]
            if k % 2:
                value /= value.max((1, 2), keepdims=True)
            now[:m] = value
        out[own] = now / now.max((1, 2), keepdims=True)
    return out


def _ends(tokens: np.ndarray, first: np.ndarray, size: np.ndarray, model: Hmm) -> np.ndarray:
    """Scaled forward vectors at the ends of blocks that open their texts."""
    out = np.empty((len(first), STATES), np.float32)
    for own, live in _by_size(first, size, AT_ONCE):
        now = np.broadcast_to(model.start, (len(own), STATES)).copy()
        for k, m in enumerate(live.tolist()):
            value = (now[:m] @ model.step if k else now[:m]) * model.emit[tokens[first[own[:m]] + k]]
            now[:m] = value / value.sum(1, keepdims=True)
        out[own] = now
    return out


def recurse(tokens: np.ndarray, offsets: np.ndarray, model: Hmm, counts: Expected | None = None) -> np.ndarray:
    """Natural log likelihood of each text; adds its expected counts where asked.

    Texts longer than a block are cut: the forward vector before each block and the backward vector after it come
    from the products of the blocks' matrices, and all blocks are then recursed over side by side.
    """
    n = len(offsets) - 1
    likelihood = np.zeros(n)
    lengths = np.diff(offsets)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    doc = np.repeat(np.arange(n), blocks)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = offsets[doc] + number * BLOCK
    size = np.minimum(BLOCK, offsets[doc + 1] - first)
    last = number + 1 == blocks[doc]
    before = np.zeros((len(doc), STATES), np.float32)  # the scaled forward vector at the end of the block before
    after = np.ones((len(doc), STATES), np.float32)
    heads = np.flatnonzero((number == 0) & ~last)
    if len(heads):
        before[heads + 1] = _ends(tokens, first[heads], size[heads], model)
        inner = np.flatnonzero((number > 0) & ((counts is not None) | ~last))
        moved = dict(zip(inner.tolist(), _transfers(tokens, first[inner], size[inner], model), strict=True))
        for i in inner.tolist():
            if not last[i]:
                state = before[i] @ moved[i]
                before[i + 1] = state / state.sum()
        if counts is not None:
            for i in inner[::-1].tolist():
                state = moved[i] @ after[i]
                after[i - 1] = state / state.max()
    for own, live in _by_size(first, size, AT_ONCE):
        _side_by_side(tokens, doc[own], number[own] == 0, first[own], live, before[own], after[own], model, likelihood, counts)
    return likelihood


def _side_by_side(tokens, doc, opens, first, live, before, after, model: Hmm, likelihood: np.ndarray, counts: Expected | None) -> None:
    """Forward, and with counts backward, over blocks by falling size; live: blocks with a token at each step."""
    at = np.concatenate([[0], np.cumsum(live)])
    steps = live.tolist()
    seen = tokens[np.concatenate([first[:m] + k for k, m in enumerate(steps)])]
    scale = np.empty((at[-1], 1), np.float32)
    forward = np.empty((at[-1] if counts is not None else 0, STATES), np.float32)
    state = np.where(opens[:, None], model.start, before @ model.step)
    for k, m in enumerate(steps):
        if k:
            state = state[:m] @ model.step
        state *= model.emit[seen[at[k] : at[k + 1]]]
        z = scale[at[k] : at[k + 1]]
        state.sum(1, keepdims=True, out=z)
        state /= z
        if counts is not None:
            forward[at[k] : at[k + 1]] = state
    log = np.log(scale[:, 0], dtype=float)
    np.add.at(likelihood, doc, np.bincount(np.arange(at[-1]) - np.repeat(at[:-1], live), weights=log, minlength=len(doc)))
    if counts is None:
        return
    back = np.zeros((0, STATES), np.float32)
    for k in range(len(steps) - 1, -1, -1):
        own = forward[at[k] : at[k + 1]]
        if len(back) < len(own):  # blocks that end here
            ended = slice(len(back), len(own))
            back = np.concatenate([back, after[ended] / (own[ended] * after[ended]).sum(1, keepdims=True)])
        weighed = back * model.emit[seen[at[k] : at[k + 1]]]
        weighed /= scale[at[k] : at[k + 1]]
        own *= back  # from here on the shares of the states
        if k:
            counts.step += _crossed(forward[at[k - 1] : at[k - 1] + len(own)], weighed) * model.step
            back = weighed @ model.step.T
        else:
            counts.step += _crossed(before[~opens], weighed[~opens]) * model.step
            counts.start += own[opens].sum(0, dtype=float)
    ends = seen == END
    counts.emit[END] += forward[ends].sum(0, dtype=float)
    words = np.flatnonzero(~ends)
    words = words[np.argsort(seen[words].astype(np.uint16), kind="stable")]
    for low in range(0, len(words), 1 << 17):
        part = words[low : low + (1 << 17)]
        of = seen[part]
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        counts.emit[of[edges]] += np.add.reduceat(forward[part], edges)


def _crossed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.T @ right).astype(float)


def first_counts(tokens: np.ndarray, offsets: np.ndarray, anchors: np.ndarray, places: np.ndarray, lengths: np.ndarray, counts: Expected) -> None:
    """Counts with the state of a token set to the last anchor before it; anchors has a state (or -1) for each distinct word of the chunk."""
    anchor = np.full(len(tokens), -1)
    if len(places):
        anchor[np.arange(len(places)) + np.repeat(np.arange(len(lengths)), lengths)] = anchors[places]
    told = np.concatenate([[0], anchor[:-1]]) if len(anchor) else anchor
    told[offsets[:-1]] = 0
    last = np.maximum.accumulate(np.where(told >= 0, np.arange(len(told)), 0))
    state = told[last]
    counts.emit += np.bincount(tokens * np.int64(STATES) + state, minlength=(END + 1) * STATES).reshape(-1, STATES)
    follows = np.ones(len(tokens), bool)
    follows[offsets[:-1]] = False
    at = np.flatnonzero(follows)
    counts.step += np.bincount(state[at - 1] * STATES + state[at], minlength=STATES * STATES).reshape(STATES, STATES)
    counts.start[0] += len(offsets) - 1


def fitted(counts: Expected) -> Hmm:
    """The model of the greatest posterior; states that nothing was seen in get the priors alone."""
    share = (counts.emit.sum(0) + 1.0) / (counts.emit.sum() + STATES)
    seen = counts.emit.sum(1, keepdims=True)
    used = np.count_nonzero(seen)
    unseen = 0.1 * min(1.0, (used + 1) / max(1, len(seen) - used))  # together no more than a tenth of the used classes' priors
    emit = counts.emit + CLASS_PRIOR * share * np.maximum(unseen, np.minimum(1.0, seen))
    emit /= emit.sum(0)
    step = counts.step + STEP_PRIOR
    start = counts.start + STEP_PRIOR
    as32 = lambda x: np.ascontiguousarray(x, np.float32)
    return Hmm(as32(start / start.sum()), as32(step / step.sum(1, keepdims=True)), as32(emit))


# --- counts over partitions -------------------------------------------------------------------------------------------


def _counting(visit: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Expected], None]) -> Callable:
    """A task's expected counts over the training texts of its chunk rows, sent as _TABLES sparse rows and one of starts and steps."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_row = Expected.none(), False
        for batch in batches:
            for row in range(batch.num_rows):
                any_row = True
                held, lengths = _bytes(batch, "held", bool, row), _bytes(batch, "lengths", np.int64, row)
                places, words = _bytes(batch, "places", np.uint32, row), _bytes(batch, "words", U64, row)
                places, lengths = places[np.repeat(~held, lengths)], lengths[~held]
                tokens, offsets = _sequences(places, _classes(words), lengths)
                if len(lengths):
                    visit(tokens, offsets, places, lengths, words, counts)
        if any_row:
            source = TaskContext.get().partitionId()
            used = np.flatnonzero(counts.emit.any(1))
            part = used % _TABLES
            keys, blobs = [_TABLES], [np.concatenate([counts.start, counts.step.ravel()]).tobytes()]
            for p in range(_TABLES):
                own = used[part == p]
                keys.append(p)
                blobs.append(own.astype(np.int32).tobytes() + counts.emit[own].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([source] * len(keys), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "source", "blob"])

    return run


@lean
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part from rows sorted by (part, source)."""
    now, total = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "blob"])

    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if part != now:
                if now is not None:
                    yield closed()
                now, total = part, np.zeros(STATES + STATES * STATES) if part == _TABLES else np.zeros((-(-(END + 1 - part) // _TABLES), STATES))
            if part == _TABLES:
                total += np.frombuffer(blob, np.float64)
            else:
                n = len(blob) // (4 + 4 * STATES)
                total[np.frombuffer(blob[: 4 * n], np.int32) // _TABLES] += np.frombuffer(blob[4 * n :], np.float32).reshape(n, STATES)
    if now is not None:
        yield closed()


def counts_of(chunk_rows: DataFrame, visit: Callable) -> Expected:
    """The expected counts of all training texts: a table of fixed size, 8 bytes x CLASSES x STATES."""
    sent = chunk_rows.select("held", "lengths", "places", "words").mapInArrow(_counting(visit), "part int, source long, blob binary")
    out = Expected.none()
    for row in sent.repartition(_TABLES, "part").sortWithinPartitions("part", "source").mapInArrow(_summed, "part int, blob binary").collect():
        if row["part"] == _TABLES:
            both = np.frombuffer(row["blob"])
            out.start, out.step = both[:STATES].copy(), both[STATES:].reshape(STATES, STATES).copy()
        else:
            out.emit[row["part"] :: _TABLES] = np.frombuffer(row["blob"]).reshape(-1, STATES)
    return out


# --- word counts ------------------------------------------------------------------------------------------------------


def _dealt(buckets: int) -> Callable:
    """The distinct words of each chunk and their counts, by bucket of their hashes."""
    shift = 64 - (buckets - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, counts = _bytes(batch, "words", U64, row), _bytes(batch, "counts", np.uint32, row)
                own = (words >> U64(shift)).astype(np.int64) if buckets > 1 else np.zeros(len(words), np.int64)
                edges = np.searchsorted(own, np.arange(buckets + 1))  # words are sorted
                used = np.flatnonzero(np.diff(edges))
                if len(used):
                    blobs = [words[edges[b] : edges[b + 1]].tobytes() + counts[edges[b] : edges[b + 1]].tobytes() for b in used]
                    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([batch["chunk"][row].as_py()] * len(used)), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of one bucket after another: each chunk's words with their total counts (kind 0), the classes' counts and numbers of
    words (kind 1), and the most frequent words (kind 2: hash in chunk, count in bucket's place)."""
    fields = ["kind", "chunk", "bucket", "blob"]

    def closed(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        sizes = [len(blob) // 12 for _, blob in held]
        words = np.concatenate([np.frombuffer(blob[: 8 * n], U64) for (_, blob), n in zip(held, sizes, strict=True)])
        counts = np.concatenate([np.frombuffer(blob[8 * n :], np.uint32) for (_, blob), n in zip(held, sizes, strict=True)])
        known, place = np.unique(words, return_inverse=True)
        total = np.bincount(place, weights=counts).astype(np.int64)
        answers = total[place]
        at = 0
        for (chunk, _), n in zip(held, sizes, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([chunk]), pa.array([bucket], pa.int64()), pa.array([answers[at : at + n].tobytes()], pa.binary())], names=fields)
            at += n
        learnt = total > 0
        classes = _classes(known[learnt])
        low, size = (int(classes[0]), int(classes[-1]) - int(classes[0]) + 1) if len(classes) else (0, 0)
        table = np.stack([np.bincount(classes - low, weights=total[learnt], minlength=size), np.bincount(classes - low, minlength=size)]) if size else np.zeros((2, 0))
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([low], pa.int64()), pa.array([bucket], pa.int64()), pa.array([table.astype(float).tobytes()], pa.binary())], names=fields)
        best = np.lexsort((known, -total))[: STATES - 1]
        best = best[total[best] > 0]
        yield pa.RecordBatch.from_arrays([pa.array([2] * len(best), pa.int32()), pa.array(known[best].view(np.int64)), pa.array(total[best]), pa.array([b""] * len(best), pa.binary())], names=fields)

    held: list[tuple[int, bytes]] = []
    now = None
    for batch in batches:
        for bucket, chunk, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != now and held:
                yield from closed(now, held)
                held = []
            now = bucket
            held.append((chunk, blob))
    if held:
        yield from closed(now, held)


def word_totals(chunk_rows: DataFrame, entries: int = BUCKET_ENTRIES) -> DataFrame:
    """(kind, chunk, bucket, blob): see _totals. Buckets are as many as the distinct words of all chunks ask for, at least one for each shuffle partition."""
    parts = int(chunk_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = chunk_rows.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    buckets = 1 << max(parts - 1, int(asked // entries)).bit_length()
    dealt = chunk_rows.select("chunk", "words", "counts").mapInArrow(_dealt(buckets), "bucket int, chunk long, blob binary")
    found = dealt.repartition(max(parts, min(buckets, 1 << 16)), "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(lean(_totals), "kind int, chunk long, bucket long, blob binary")
    return settle(found, "totals")


# --- scores -----------------------------------------------------------------------------------------------------------


@dataclass
class Scorer:
    """What all tasks score by; fixed in size. class_log: log10 of what a word's smoothed count is divided by, per class."""

    model: Hmm
    class_log: np.ndarray
    tokens: int
    words: int
    ends: int


def _score_chunk(shared) -> Callable:
    def run(rows: pa.Table, totals: pa.Table) -> pa.Table:
        own: Scorer = shared.value
        chunk = {name: rows[name][0].as_py() for name in ("docs", "absent", "lengths", "held", "places", "words")}
        docs, absent, held = np.frombuffer(chunk["docs"], np.int64), np.frombuffer(chunk["absent"], bool), np.frombuffer(chunk["held"], bool)
        lengths, places = np.frombuffer(chunk["lengths"], np.int64), np.frombuffer(chunk["places"], np.uint32)
        classes = _classes(np.frombuffer(chunk["words"], U64))
        order = np.argsort(totals["bucket"].to_numpy(), kind="stable")  # buckets are ranges of hashes, as the words are sorted
        blobs = totals["blob"].to_pylist()
        count = np.concatenate([np.frombuffer(blobs[i], np.int64) for i in order]) if len(order) else np.zeros(0, np.int64)
        log = np.log10(count + 0.1)
        at = np.concatenate([[0], np.cumsum(lengths)])

        def per_text(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(lengths))
            full = np.flatnonzero(lengths)
            if len(full):
                out[full] = np.add.reduceat(values, at[full])
            return out

        known = per_text((count > 0).astype(np.int64)[places]).astype(np.int64) + int(own.ends > 0)
        plain = per_text(log[places]) + np.log10(own.ends + 0.1)
        base = plain - (lengths + 1) * np.log10(own.tokens + 0.1 * (own.words + 1))
        tokens, offsets = _sequences(places, classes, lengths)
        inside = per_text((log - own.class_log[classes])[places])  # the end is the only word of its class
        score = recurse(tokens, offsets, own.model) / np.log(10) + inside
        ids = pa.array(docs, mask=absent)
        return pa.table({
            "doc_id": ids, "held_out": held, "n_tokens": lengths + 1, "n_known": known, "train_tokens": np.full(len(lengths), own.tokens), "base_score": base, "score": score,
        })

    return run


def hidden_markov_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text).

    Texts are lower-cased in A-Z; tokens are words between white space and one end.  The model learns from rows whose
    crc32(doc_id as text) mod 10 isn't 0; a row with a null doc_id is learnt from.  base_score is the log10
    probability under smoothed word counts, score that under the hidden Markov model, which is exact for its
    parameters: no path or text is pruned.  A null or empty text is one end.  Repeated rows count as often as they
    occur and score alike; words are told by 64-bit hashes; texts may be of any length; other columns are ignored;
    where all rows are held out, all words are unknown; no rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = settle(docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_chunked, CHUNK_ROW), "chunks")
    totals = word_totals(rows)
    class_counts, class_words = np.zeros(END), np.zeros(END)
    for row in totals.where("kind = 1").collect():  # the classes' tables: 16 bytes x CLASSES in all, buckets being ranges of classes
        counts, words = np.frombuffer(row["blob"]).reshape(2, -1)
        class_counts[row["chunk"] : row["chunk"] + len(counts)] += counts
        class_words[row["chunk"] : row["chunk"] + len(counts)] += words
    top = totals.where("kind = 2").orderBy(F.desc("bucket"), "chunk").limit(STATES - 1).collect()
    anchors = np.array([r["chunk"] for r in top], np.int64).view(U64)
    state = np.arange(1, len(anchors) + 1)[np.argsort(anchors)]
    anchors = np.sort(anchors)

    def first_visit(tokens, offsets, places, lengths, words, counts) -> None:
        of_word = np.full(len(words), -1)
        if len(anchors) and len(words):
            at = np.minimum(np.searchsorted(anchors, words), len(anchors) - 1)
            of_word = np.where(anchors[at] == words, state[at], -1)
        first_counts(tokens, offsets, of_word, places, lengths, counts)

    counts = counts_of(rows, first_visit)
    ends = int(counts.start[0])
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(fitted(counts))

        def visit(tokens, offsets, places, lengths, words, counts, model=model) -> None:
            recurse(tokens, offsets, model.value, counts)

        counts = counts_of(rows, visit)
    known = int(class_words.sum()) + (ends > 0)
    scorer = Scorer(fitted(counts), np.log10(class_counts + 0.1 * (class_words + 1)), int(class_counts.sum()) + ends, known, ends)
    shared = spark.sparkContext.broadcast(scorer)
    answers = totals.where("kind = 0").select("chunk", "bucket", "blob")
    texts = rows.select("chunk", "docs", "absent", "lengths", "held", "places", "words")
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score_chunk(shared), shape)
