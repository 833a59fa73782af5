"""Near-duplicate texts by Jaccard similarity of word shingles, found with PartEnum signatures.

Sets are dealt into size bands so that similar sets lie in one window of two neighbouring bands.
Within a window two similar sets differ in at most K elements.  The shingle domain is hashed into
n1 partitions of three parts each, with 2 * n1 > K: some partition then holds at most one
difference, so the sets agree on two of its three parts, and the three subsets of two parts of
each partition are the signatures.  No similar pair is lost up to 38 partitions a window (sets of about 220
shingles); larger sets have more partitions, of which 38 are enumerated: a pair at the very
threshold agrees within each with a chance over 0.52, so all miss it with one below 1e-12.
Smaller sets repeat the partition under further hash seeds up to as many partitions.

A signature that more than 64 sets share says little: it is made of shingles of a passage that
many texts hold.  Sets stay in such crowds, for those may be all that a set shares with a similar one.

Signatures travel as packed arrays.  Texts with equal sets share one key, so copies meet nowhere.
Candidate groups are then thinned by an exact lower bound on the difference (1024 parity bits) and
each remaining pair is checked on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, chunks, distinct_sets, flatten, mix, segment_sum, shingle_hashes, word_bounds, word_hashes
from .components import connected_components
from .storage import discard, settle
from .workers import bounded_batches, lean

#: Partitions enumerated for one window, and parts of each partition.
ENUMERATED, PARTS = 38, 3
_SUBSETS = ((0, 1), (0, 2), (1, 2))
#: Groups up to this size give all their pairs at once, larger ones (crowds) a star and then nearest pairs.
SMALL_GROUP = 64
SKETCH_BITS = 1024
#: Groups above this size are worked on in pairs of blocks of about this size.
BLOCK = 2048
#: Partners that a member of a large group names in each round after the first; None is all.
ROUNDS = (256, None)
#: Bits of the filter over documents whose sets are fetched: its size is fixed.
FILTER_BITS = 1 << 23
_FLUSH = 24 << 20
#: Hash buckets in which the pairs of all groups are brought together.
_PAIR_BUCKETS = 256


def windows(threshold: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lowest size of each band; for each window its partitions n1 (0: only equal sets are similar) and hash seeds."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(lows[-1] * 100 // threshold + 1)
    lows.append(lows[-1] * 100 // threshold + 1)
    low = np.array(lows, np.int64)
    high = np.append(low[1:] - 1, low[-1] * 100 // threshold)
    differ = (high + high * 100 // threshold) * (100 - threshold) // (100 + threshold)
    n1 = np.where(differ > 0, (differ + 2) // 2, 0)
    return low, n1, -(-ENUMERATED // np.maximum(n1, 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray, keys: np.ndarray, threshold: int, partitions: int | None = ENUMERATED) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets and the key of the set each comes from; of a window's partitions the first `partitions`, None being all.

    The lowest bit of a signature is 1 if the set is of the window's upper band.
    """
    sizes = np.diff(offsets)
    low, n1, seeds = windows(threshold, int(sizes.max(initial=1)))
    most = int(n1.max()) if partitions is None else partitions
    band = np.searchsorted(low, sizes, "right") - 1
    out, owners = [], []
    for upper in (0, 1):
        window = band - upper
        usable = (sizes > 0) & (window >= 0)
        usable &= n1[np.maximum(window, 0)] > 0
        for seed in range(int(seeds.max())):
            docs = np.flatnonzero(usable & (seeds[np.maximum(window, 0)] > seed))
            if not len(docs):
                break
            length = sizes[docs]
            at = np.repeat(offsets[docs] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            owner = np.repeat(np.arange(len(docs)), length)
            x = mix(hashes[at] ^ mix(np.full(1, seed + 1, U64))[0])
            part = ((x >> U64(32)) * n1[window[docs]].astype(U64)[owner] >> U64(32)).astype(np.int64)
            near = part < most
            x, part, owner = x[near], part[near], owner[near]
            third = ((x & U64(0xFFFFFFFF)) * U64(PARTS) >> U64(32)).astype(np.int64)
            cells = np.zeros((len(docs), most, PARTS), U64)
            np.add.at(cells.reshape(-1), (owner * most + part) * PARTS + third, mix(x))
            place = (window[docs].astype(U64)[:, None] << U64(32)) + U64(seed << 20) + np.arange(most, dtype=U64)[None, :] * U64(4)
            for number, (a, b) in enumerate(_SUBSETS):
                one, two = cells[:, :, a], cells[:, :, b]
                doc, cell = np.nonzero((one != 0) | (two != 0))
                found = mix((one[doc, cell] + two[doc, cell]) ^ mix(place[doc, cell] + U64(number)))
                out.append(found & ~U64(1) | U64(upper))
                owners.append(keys[docs][doc])
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owners)


def shingle_sets(texts: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle sets of texts, their offsets, and a key of each set (0 if empty)."""
    data, at = flatten(texts)
    starts, ends, docs = word_bounds(data, at)
    sets, offsets = distinct_sets(*shingle_hashes(word_hashes(data, starts, ends), docs, len(at) - 1, k))
    total = segment_sum(mix(sets ^ U64(0x5851F42D4C957F2D)), offsets)
    keys = mix(total + np.diff(offsets).astype(U64)).view(np.int64).copy()
    keys[np.diff(offsets) == 0] = 0
    return sets, offsets, keys


def _signer(k: int, threshold: int, buckets: int, partitions: int | None) -> Callable:
    shift = U64(64 - buckets.bit_length() + 1)

    def pack(held: list[tuple[np.ndarray, np.ndarray]], kind: int) -> pa.RecordBatch:
        first, second = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        bucket = ((first if kind == 0 else mix(first.view(U64))) >> shift).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(edges))
        first, second = first[order], second[order]
        blobs = [first[edges[i] : edges[i + 1]].tobytes() + second[edges[i] : edges[i + 1]].tobytes() for i in used]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), kind), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])

    @lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, seen = 0, np.zeros(0, np.int64)
        for table in chunks(batches):
            sets, offsets, keys = shingle_sets(table["text"], k)
            new, first = np.unique(keys, return_index=True)
            fresh = np.sort(first[~np.isin(new, seen) & (new != 0)])
            seen = np.union1d(seen, new) if len(seen) < 1 << 20 else new
            length = np.diff(offsets)[fresh]
            at = np.concatenate([[0], np.cumsum(length)])
            take = np.repeat(offsets[fresh] - at[:-1], length) + np.arange(at[-1])
            held.append(signatures(sets[take], at, keys[fresh], threshold, partitions))
            size += len(held[-1][0]) * 16
            if size >= _FLUSH:
                yield pack(held, 0)
                held, size = [], 0
        if size:
            yield pack(held, 0)

    return sign


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in sorted x, and its length at the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)) if len(x) else np.zeros(1, np.int64)


def _groups(signature: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, key, crowd) of sets that share a signature, one of them of the lower band.

    Groups up to SMALL_GROUP are named by their members, so that equal ones are found once; crowds by their signature.
    """
    order = np.argsort(signature >> U64(1), kind="stable")
    signature, key = signature[order], key[order]
    at = _runs(signature >> U64(1))
    many = np.repeat(np.diff(at) > 1, np.diff(at))
    signature, key = signature[many], key[many]
    order = np.lexsort((key, signature >> U64(1)))
    signature, key = signature[order], key[order]
    base = signature >> U64(1)
    lower = (signature & U64(1)) == 0
    keep = np.ones(len(key), bool)
    keep[1:] = (base[1:] != base[:-1]) | (key[1:] != key[:-1])
    if not keep.all():  # the same set from several tasks
        base, key, lower = base[keep], key[keep], lower[keep]
    at = _runs(base)
    if len(at) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    size = np.diff(at)
    crowd = size > SMALL_GROUP
    name = np.where(crowd, base[at[:-1]], mix(segment_sum(mix(key.view(U64)), at)))
    good = (size > 1) & (segment_sum(lower.astype(np.int64), at) > 0)
    _, once = np.unique(name, return_index=True)
    mask = np.zeros(len(good), bool)
    mask[once] = True
    good &= mask
    member = np.repeat(good, size)
    return np.repeat(name, size)[member].view(np.int64), key[member], np.repeat(crowd, size)[member]


@lean
def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads blobs sorted by bucket; works on one bucket at a time."""

    def close(blobs: list[bytes]) -> pa.RecordBatch:
        halves = [np.frombuffer(x, U64).reshape(2, -1) for x in blobs]
        group, key, crowd = _groups(np.concatenate([x[0] for x in halves]), np.concatenate([x[1] for x in halves]).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(key, pa.int64()), pa.array(crowd)], names=["gid", "key", "crowd"])

    held: list[bytes] = []
    now = None
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now and held:
                yield close(held)
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield close(held)


def _keys_of(k: int) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            _, offsets, keys = shingle_sets(table["text"], k)
            ids = table["doc_id"].combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets), pa.int64()), pa.array(keys, mask=keys == 0)], names=["doc_id", "n_shingles", "key"])

    return run


def _sketch(elements: np.ndarray) -> bytes:
    return np.packbits((np.bincount((mix(elements ^ U64(77)) & U64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def _fetcher(k: int, bits) -> Callable:
    """Sets of the documents that the filter lets through."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).fill_null(-1).to_numpy()
                hit = _probe(words, ids)
                if hit.any():
                    yield batch.filter(pa.array(hit))

        for table in chunks(chosen()):
            sets, offsets, keys = shingle_sets(table["text"], k)
            _, first = np.unique(keys, return_index=True)
            first = first[keys[first] != 0]
            rows = [sets[offsets[i] : offsets[i + 1]] for i in first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[first], pa.int64()), pa.array([len(x) for x in rows], pa.int64()), pa.array([_sketch(x) for x in rows], pa.binary()), pa.array([x.tobytes() for x in rows], pa.binary())],
                names=["key", "n", "sketch", "elements"],
            )

    return run


def _probe(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    x = mix(ids.astype(np.int64).view(U64))
    hit = np.ones(len(ids), bool)
    for at in (x & U64(FILTER_BITS - 1), (x >> U64(32)) & U64(FILTER_BITS - 1)):
        hit &= (words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
    return hit


@lean
def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = np.zeros(FILTER_BITS >> 6, U64)
    for batch in batches:
        x = mix(batch.column(0).to_numpy().view(U64))
        for at in (x & U64(FILTER_BITS - 1), (x >> U64(32)) & U64(FILTER_BITS - 1)):
            np.bitwise_or.at(words, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
    used = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(words[used].view(np.int64))], names=["word", "bits"])


def id_filter(ids: DataFrame):
    """A broadcast bit filter of a fixed size over the long column of ids; it may let others through, never the reverse."""
    rows = ids.mapInArrow(_filter_words, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS >> 6, U64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(U64)
    return ids.sparkSession.sparkContext.broadcast(words)


def _group_pairs(key, n, sketch, comp, side, threshold, most, star) -> tuple[list[np.ndarray], bool]:
    """Pairs of one group that may be similar and aren't linked yet; whether some were left for a later round."""
    same = (side == side[0]).all()
    left = np.arange(len(key)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    out, cut = [], False
    if star and not same:
        return out, True
    if star and len(key) > SMALL_GROUP:
        common = (np.unpackbits(sketch.view(np.uint8), axis=1).mean(0) > 0.5).astype(np.uint8)
        left = np.array([int(np.bitwise_count(sketch ^ np.packbits(common).view(U64)).sum(1).argmin())])
        cut = True
    for lo in range(0, len(left), 64):
        rows = left[lo : lo + 256]
        far = np.bitwise_count(sketch[rows][:, None, :] ^ sketch[right][None, :, :]).sum(2, dtype=np.int64)
        total = n[rows][:, None] + n[right][None, :]
        ok = (far * (100 + threshold) <= (100 - threshold) * total) & (comp[rows][:, None] != comp[right][None, :])
        ok &= np.minimum(n[rows][:, None], n[right][None, :]) * 100 >= threshold * np.maximum(n[rows][:, None], n[right][None, :])
        if most is not None and len(key) > SMALL_GROUP and not star and (crowded := np.flatnonzero(ok.sum(1) > most)).size:
            cut = True
            order = np.argsort(np.where(ok[crowded], far[crowded], 1 << 40), axis=1, kind="stable")[:, :most]
            ok[crowded] = False
            ok[crowded[:, None], order] = True
        a, b = np.nonzero(ok)
        a, b = key[rows[a]], key[right[b]]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
    return out, cut


def _pairs_of(threshold: int, most: int | None, star: bool) -> Callable:
    """Reads members sorted by group and block pair; gives packed pairs, and a row with no pairs if some were put off."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        cut = False
        rest = None

        def work(table: pa.Table) -> None:
            nonlocal cut
            key, n, comp, side = (table[c].to_numpy() for c in ("key", "n", "comp", "side"))
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), U64).reshape(-1, SKETCH_BITS // 64)
            found, left = _group_pairs(key, n, sketch, comp, side, threshold, most, star)
            out.extend(found)
            cut |= left

        def whole(table: pa.Table, last: bool) -> pa.Table:
            at = [table[c].to_numpy() for c in ("gid", "block")]
            edge = np.append(np.flatnonzero(np.concatenate([[True], (at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1])])), table.num_rows)
            for i in range(len(edge) - 1 if last else len(edge) - 2):
                if edge[i + 1] - edge[i] > 1:
                    work(table.slice(edge[i], edge[i + 1] - edge[i]).combine_chunks())
            return table.slice(edge[-2])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                rest = whole(pa.concat_tables([rest, table]) if rest is not None else table, False)
                if sum(x.shape[1] for x in out) > 1 << 18:
                    out[:] = [np.unique(np.concatenate(out, 1), axis=1)]
        if rest is not None and rest.num_rows:
            whole(rest, True)
        pairs = np.unique(np.concatenate(out, 1), axis=1) if out else np.zeros((2, 0), np.int64)
        bucket = (mix(pairs[0].view(U64) ^ mix(pairs[1].view(U64))) % U64(_PAIR_BUCKETS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(_PAIR_BUCKETS + 1))
        used = np.flatnonzero(np.diff(edges)).tolist()
        blobs = [pairs[:, order[edges[i] : edges[i + 1]]].tobytes() for i in used]
        rows = ([*used, 0], [*blobs, b""], [False] * len(used) + [True]) if cut else (used, blobs, [False] * len(used))
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.bool_())], names=["bucket", "blob", "cut"])

    return run


@lean
def _distinct_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair once, of blobs sorted by bucket; a last row if some were put off."""

    def close(held: list[bytes]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in held], 1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.zeros(pairs.shape[1], bool))], names=["a", "b", "cut"])

    held: list[bytes] = []
    now, cut = None, False
    for batch in batches:
        for bucket, blob, mark in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            cut |= mark
            if bucket != now and held:
                yield close(held)
                held = []
            now = bucket
            if blob:
                held.append(blob)
    if held:
        yield close(held)
    if cut:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([True])], names=["a", "b", "cut"])


def _checker(threshold: int) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, two = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(one) > len(two):
                    one, two = two, one
                at = np.searchsorted(two, one)
                at[at == len(two)] = 0
                common = int((two[at] == one).sum()) if len(two) else 0
                good[i] = 100 * common >= threshold * (len(one) + len(two) - common)
            kept = batch.select([0, 1]).filter(pa.array(good))
            if kept.num_rows:
                yield kept

    return run


def similar_sets(docs: DataFrame, k: int = 5, threshold: int = 75, partitions: int | None = ENUMERATED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, key) of every row of docs (doc_id, text), and (node, component) over keys of linked sets."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(8, (2 * parts - 1).bit_length())
    blobs = docs.mapInArrow(_signer(k, threshold, buckets, partitions), "bucket int, kind int, blob binary")
    met = blobs.select("bucket", "blob").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_collide, "gid long, key long, crowd boolean")
    met = settle(met.distinct(), "met")
    named = met.groupBy("gid").agg(F.count("*").alias("size"), F.expr("bit_xor(xxhash64(key))").alias("members")).where("size > 1")
    named = named.groupBy("size", "members").agg(F.min("gid").alias("gid")).select("gid", (F.col("size") > SMALL_GROUP).alias("large"), F.when(F.col("size") > BLOCK, F.ceil(F.col("size") / BLOCK)).otherwise(1).cast("int").alias("blocks"))
    groups = settle(met.select("gid", "key").join(named, "gid"), "groups")
    keyed = settle(docs.mapInArrow(_keys_of(k), "doc_id long, n_shingles long, key long"), "keys")
    wanted = keyed.join(groups.select("key").distinct(), "key").groupBy("key").agg(F.coalesce(F.min("doc_id"), F.lit(-1)).alias("doc_id"))
    bits = id_filter(wanted.select("doc_id"))
    sets = docs.mapInArrow(_fetcher(k, bits), "key long, n long, sketch binary, elements binary").dropDuplicates(["key"])
    sets = settle(sets.join(groups.select("key").distinct(), "key", "left_semi"), "sets")

    members = groups.join(sets.select("key", "n", "sketch"), "key")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    members = members.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(
        "gid", "large", "key", "n", "sketch", (F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")).alias("block"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side")
    )
    members = settle(members, "members")
    discard(groups)
    discard(met)

    edges, linked, tested = None, None, None
    for turn, most in enumerate((0, *ROUNDS)):
        if linked is None:
            now = members.withColumn("comp", F.col("key"))
        else:  # groups that fit one round are done
            now = members.where("large").join(linked, members["key"] == linked["node"], "left").withColumn("comp", F.coalesce("component", "key"))
        now = now.select("gid", "key", "n", "sketch", "block", "side", "comp")
        pairs = now.repartition(parts, "gid", "block").sortWithinPartitions("gid", "block").mapInArrow(_pairs_of(threshold, most, turn == 0), "bucket int, blob binary, cut boolean")
        pairs = pairs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_distinct_pairs, "a long, b long, cut boolean")
        if tested is not None:
            pairs = pairs.join(tested.where("not cut"), ["a", "b", "cut"], "left_anti")
        pairs = settle(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        one, two = (sets.select(F.col("key").alias(side), F.col("elements").alias(f"{side}_elements")) for side in "ab")
        checked = pairs.where("not cut").join(one, "a").join(two, "b").select("a", "b", "a_elements", "b_elements").mapInArrow(_checker(threshold), "a long, b long")
        before, edges = edges, settle(checked if edges is None else edges.unionByName(checked), "links")
        if before is not None:
            discard(before)
        linked = connected_components(edges)
        if not pairs.where("cut").head(1):
            break
    for used in (members, sets, tested, edges):
        discard(used)
    return keyed, linked


def ngram_jaccard_components(docs: DataFrame, k: int = 5, threshold: int = 75, partitions: int | None = ENUMERATED) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id long, text string).

    Texts link when 100 * common >= threshold * all of their sets of k-word shingles (A-Z lower-cased);
    component_id is the smallest doc_id reachable by links.  A text with fewer than k words is one
    shingle; null, empty and blank texts have none and link with nothing (component_id is doc_id).
    Repeated rows are returned as often as they occur and link with each other.  A null doc_id is
    returned, and never names a component that has another.  Other columns are ignored; no rows give no rows.
    partitions: see the module; None enumerates all, at about three times the signatures.
    """
    keyed, linked = similar_sets(docs, k, threshold, partitions)
    named = keyed.join(linked, keyed["key"] == linked["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "key").alias("group"))
    least = named.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return named.join(least, "group", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, k: int = 5, threshold: int = 75) -> DataFrame:
    """docs without near copies: of each group of linked texts, the row with the smallest doc_id stays.

    Rows without words are kept.  Rows repeated whole stay once; different texts under one doc_id
    that is the smallest of its group all stay.  Columns are those of docs.
    """
    found = ngram_jaccard_components(docs, k, threshold)
    kept = found.where("n_shingles = 0 or doc_id <=> component_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("kept_times"))
    kept = settle(kept, "kept")
    names = docs.columns
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)])
    # a sort-merge join whatever the size: the ids kept grow with the documents
    joined = inner.join(kept.hint("merge"), inner["doc_id"].eqNullSafe(kept["kept_id"]))
    if not kept.where("kept_times > 1").head(1):  # no doc_id repeats: nothing to bring together
        return joined.select(*inner.columns).toDF(*names)
    once = joined.where("kept_times = 1").select(*inner.columns)
    return once.unionByName(joined.where("kept_times > 1").select(*inner.columns).distinct()).toDF(*names)
