"""Near copies among embeddings by randomised-rotation binary codes.

Unit vectors are rotated at random.  The signs of the result are a vector's binary code; the code's inner
product with its own vector is stored beside it as correction factor, and so are the rotated components
in four bits, rounded at random so that they are right on average.  A code's inner product with another
vector's components, divided by the factor, is an unbiased estimate of the cosine, and its deviation is
known: a pair is recomputed exactly only where the confidence bounds of both of its estimates reach the
threshold.  Every link is decided by the exact cosine.

Only codes (about 60 bytes for 64 dimensions) are dealt out and compared; vectors follow for those with a
pair to recompute.  Candidates share the signs of a few random projections of the stored components in
one of several tables, as many as a pair at the threshold needs to meet with the stated recall.
Projections have whole numbers, so every task sees the same signs.  Equal vectors are one, and a pair counts in
the first table in which it meets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .arrow_text import U64, groups_of, mix
from .components import connected_components, forest
from .storage import discard, settle
from .workers import lean

#: Chance that a pair at the threshold meets in some table.
RECALL = 0.9995
#: Vectors per bucket aimed at: the number of signs follows from a label's size.
PER_BUCKET = 256
#: Half-width of the confidence bounds, in standard deviations of the estimate; vectors of fewer dimensions are all recomputed.
SIGMAS, LEAST_DIMENSIONS = 4.0, 32
#: Buckets with more vectors are compared in pairs of blocks of about this size, this many rows at a time.
BLOCK, _TILE = 2048, 512
_MOST_SIGNS = 62


def _generator(dim: int, what: int) -> np.random.Generator:
    return np.random.default_rng([20240917, dim, what])


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(_generator(dim, 0).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def tables_for(n: int, threshold: float, dim: int) -> tuple[int, int]:
    """Signs per table, and tables, for n vectors of one label; the rounding of both vectors widens their angle."""
    signs = int(min(_MOST_SIGNS, max(2, round(math.log2(max(n, 1) / PER_BUCKET)))))
    angle = math.sqrt(math.acos(threshold) ** 2 + 4 * math.log(max(dim, 2)) / 337)
    meet = (1 - angle / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))


def table_signs(levels: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """(vectors, tables) of sign patterns of whole-number components; the first tables are the same whatever their number."""
    out = np.empty((len(levels), tables), np.int64)
    whole = levels.astype(np.float64)
    for t in range(tables):
        planes = np.rint(_generator(levels.shape[1], 1 + t).standard_normal((levels.shape[1], _MOST_SIGNS))[:, :signs] * 4096)
        out[:, t] = (whole @ planes > 0) @ (1 << np.arange(signs))
    return out


class Codes:
    """Binary codes, correction factors and four-bit components of vectors of one dimension."""

    def __init__(self, bits: np.ndarray, levels: np.ndarray, factor: np.ndarray, top: np.ndarray):
        self.bits, self.levels, self.factor, self.top = bits, levels, factor, top  # levels: odd numbers from -15 to 15, of which 15 is top

    @staticmethod
    def of(unit: np.ndarray, names: list[bytes] | None = None) -> "Codes":
        """names: what each vector's random rounding is seeded by, its own bytes if not given; a vector's code is the same whatever stands beside it."""
        dim = unit.shape[1]
        turned = unit @ rotation(dim)
        bits = turned > 0
        factor = np.abs(turned).sum(1) / math.sqrt(dim)
        top = np.abs(turned).max(1).astype(np.float32)
        own = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in (names if names is not None else map(bytes, np.ascontiguousarray(unit)))], U64)
        chance = (mix(own[:, None] + mix(np.arange(1, dim + 1, dtype=U64))[None, :]) >> U64(11)) * 2.0**-53
        steps = np.clip(np.floor((turned / top[:, None] + 1) * 7.5 + chance), 0, 15)
        return Codes(bits, (2 * steps - 15).astype(np.int8), factor.astype(np.float32), top)

    def pack(self) -> list[bytes]:
        n, dim = self.bits.shape
        nibbles = ((self.levels + 15) // 2).astype(np.uint8)
        nibbles = np.concatenate([nibbles, np.zeros((n, dim % 2), np.uint8)], 1)
        parts = [np.full((n, 1), dim, "<u4").view(np.uint8), self.factor.reshape(n, 1).view(np.uint8), self.top.reshape(n, 1).view(np.uint8), np.packbits(self.bits, axis=1), nibbles[:, ::2] << 4 | nibbles[:, 1::2]]
        return [row.tobytes() for row in np.concatenate(parts, 1)]

    @staticmethod
    def unpack(rows: list[bytes]) -> "Codes":
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        dim = int(raw[0, :4].copy().view("<u4")[0])
        factor, top = (np.ascontiguousarray(raw[:, a : a + 4]).view(np.float32)[:, 0] for a in (4, 8))
        edge = 12 + -(-dim // 8)
        nibbles = np.stack([raw[:, edge:] >> 4, raw[:, edge:] & 15], 2).reshape(len(rows), -1)[:, :dim]
        return Codes(np.unpackbits(raw[:, 12:edge], axis=1, count=dim).astype(bool), nibbles.astype(np.int8) * 2 - 15, factor, top)

    def estimates(self, rows: np.ndarray, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines, from the components of rows and the codes of columns, and how far below the cosine they may lie.

        The part of a code off its own vector meets only the part of the other vector off it, which at a
        cosine of the threshold or more is sqrt(1 - threshold ** 2) long at most.
        """
        dim = self.bits.shape[1]
        values = self.levels[rows] * (self.top[rows] / 15)[:, None]
        signs = np.where(self.bits[columns], np.float32(1 / math.sqrt(dim)), np.float32(-1 / math.sqrt(dim)))
        factor = self.factor[columns].astype(np.float64)
        off = (1 - threshold**2) * np.maximum(1 - factor**2, 0.0) / (factor**2 * max(dim - 1, 1))
        rounding = (2 * self.top[rows] / 15)[:, None] ** 2 / (6 * factor**2)[None, :]
        return (values.astype(np.float32) @ signs.T) / factor[None, :], SIGMAS * np.sqrt(off[None, :] + rounding)

    def undecided(self, rows: np.ndarray, columns: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the bounds of both estimates of a pair reach the threshold."""
        if self.bits.shape[1] < LEAST_DIMENSIONS:
            return np.ones((len(rows), len(columns)), bool)
        one, width = self.estimates(rows, columns, threshold)
        two, other = self.estimates(columns, rows, threshold)
        return (one + width >= threshold) & (two + other >= threshold).T


def _units(vectors: list[bytes], kind: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # no overflow or underflow in the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _keyed(kind: str) -> Callable:
    """vec_id, label, a 128-bit name of the label's vector and its floats; null name for vectors that link with nothing."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).cast(pa.large_list(pa.float64()))
            labels = batch.column(2).to_pylist()
            flat = lists.values.to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy()
            fine = np.isfinite(flat) & ~pc.is_null(lists.values).to_numpy(zero_copy_only=False)
            bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~fine, fine & (flat != 0)))
            good = (bad[bounds[1:]] == bad[bounds[:-1]]) & (some[bounds[1:]] > some[bounds[:-1]])
            good &= batch.column(1).is_valid().to_numpy(zero_copy_only=False) & batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            body = memoryview((np.where(fine, flat, 0.0) + 0.0).astype(kind).tobytes())  # no negative zeros
            size = np.dtype(kind).itemsize
            raw = [bytes(body[a * size : b * size]) if ok else None for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), good.tolist(), strict=True)]
            name = [None if x is None else hashlib.blake2b(x, digest_size=16, key=hashlib.blake2b(c.encode()).digest()).digest() for x, c in zip(raw, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(name, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "name", "vector"])

    return run


def _coder(kind: str) -> Callable:
    """node, lab, n and code from node, lab, n and vector."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3).to_pylist()
            sizes = np.array([len(x) for x in vectors], np.int64)
            code: list[bytes] = [b""] * len(vectors)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size).tolist()
                for i, packed in zip(rows, Codes.of(_units([vectors[i] for i in rows], kind), [vectors[i] for i in rows]).pack(), strict=True):
                    code[i] = packed
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(code, pa.binary())], names=["node", "lab", "n", "code"])

    return run


def _dealer(threshold: float, sizes_only: bool) -> Callable:
    """Codes once per table, or the number of codes in each bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, lab, n = (batch.column(i).to_numpy() for i in range(3))
            code = batch.column(3)
            plain = code.to_pylist()
            for of in np.unique(lab).tolist():
                rows = np.flatnonzero(lab == of)
                own = Codes.unpack([plain[i] for i in rows.tolist()])
                signs, tables = tables_for(int(n[rows[0]]), threshold, own.bits.shape[1])
                pattern = table_signs(own.levels, signs, tables)
                gid = mix(mix(pattern.astype(U64)) + mix(np.arange(tables, dtype=U64) + mix(np.full(1, of, np.int64).view(U64)))).view(np.int64)
                for t in range(tables):
                    if sizes_only:
                        group, count = np.unique(gid[:, t], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(count.astype(np.int64))], names=["gid", "n"])
                    else:
                        head = np.full(len(rows), t * 64 + signs, np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(gid[:, t].copy()), pa.array(lab[rows]), pa.array(head), pa.array(node[rows]), code.take(pa.array(rows))], names=["gid", "lab", "turn", "node", "code"])

    return run


class _Bucket:
    """The members of one bucket's block pair, and their pairs to recompute that meet in no earlier table."""

    def __init__(self, table: pa.Table, threshold: float):
        self.codes = Codes.unpack(table["code"].to_pylist())
        self.turn, self.signs = divmod(table["turn"][0].as_py(), 64)
        self.threshold = threshold
        side = table["side"].to_numpy()
        self.same = bool((side == side[0]).all())
        self.left = np.arange(len(side)) if self.same else np.flatnonzero(side == 0)
        self.right = self.left if self.same else np.flatnonzero(side == 1)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        earlier: np.ndarray | None = None
        for lo in range(0, len(self.left), _TILE):
            rows = self.left[lo : lo + _TILE]
            need = self.codes.undecided(rows, self.right, self.threshold)
            if self.same:
                need &= rows[:, None] < self.right[None, :]
            a, b = np.nonzero(need)
            a, b = rows[a], self.right[b]
            if self.turn and len(a):
                if earlier is None:
                    earlier = table_signs(self.codes.levels, self.signs, self.turn)
                met = np.zeros(len(a), bool)
                for t in range(self.turn):
                    met |= earlier[a, t] == earlier[b, t]
                a, b = a[~met], b[~met]
            if len(a):
                yield a, b


_KEYS = ("gid", "lab", "block")


def _screen(threshold: float) -> Callable:
    """The members, of buckets sorted by their keys, that have a pair to recompute."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for table in groups_of(batches, _KEYS):
            if table.num_rows < 2:
                continue
            used = np.zeros(table.num_rows, bool)
            for a, b in _Bucket(table, threshold).pairs():
                used[a] = used[b] = True
            if used.any():
                held.append(table.filter(pa.array(used)))
                if len(held) >= 256:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held = []
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return run


def _comparer(threshold: float, kind: str) -> Callable:
    """Links (kind 0: node, number) and the edges of a spanning forest (kind 1: node, node) of members with vectors, sorted by bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, _KEYS):
            node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
            unit = _units(table["vector"].to_pylist(), kind)
            links = np.zeros(len(node), np.int64)
            ea, eb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in _Bucket(table, threshold).pairs():
                met = np.ones(len(a), bool)
                for k in range(0, len(a), 65536):
                    part = slice(k, k + 65536)
                    met[part] = np.einsum("ij,ij->i", unit[a[part]], unit[b[part]]) >= threshold
                a, b = a[met], b[met]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                ea.append(node[a])
                eb.append(node[b])
            a, b = np.concatenate(ea), np.concatenate(eb)
            if len(a):
                a, b = forest(a, b)
                used = links > 0
                which = np.repeat(np.array([0, 1], np.int32), [int(used.sum()), len(a)])
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.concatenate([node[used], a])), pa.array(np.concatenate([links[used], b]))], names=["kind", "a", "b"])

    return run


def embedding_components(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Rows of one label (not null, of any type that casts to a string) and dimension link at a cosine >= threshold in
    double precision.  Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing.  Equal vectors (by 128-bit digests) link; repeated rows count as vectors of their own.
    component_id is the smallest vec_id reachable by links; a null vec_id never names a component that
    has another.  kept: vec_id is component_id.  Other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    element = vectors.schema["embedding"].dataType
    kind = "<f4" if isinstance(element, ArrayType) and isinstance(element.elementType, FloatType) else "<f8"
    keyed = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string").alias("label")).mapInArrow(_keyed(kind), "vec_id long, label string, name binary, vector binary")
    ids = settle(keyed.select("vec_id", "name"), "ids")
    distinct = keyed.where("name is not null").groupBy("name").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    # numbered once, when written: unique, and the same for all that read the table
    distinct = settle(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    labelled = distinct.select("node", F.xxhash64("label", F.octet_length("vector")).alias("lab"), "vector")
    sizes = settle(labelled.groupBy("lab").agg(F.count("*").alias("n")), "sizes")
    codes = settle(labelled.join(sizes, "lab").select("node", "lab", "n", "vector").mapInArrow(_coder(kind), "node long, lab long, n long, code binary"), "codes")

    crowds = codes.mapInArrow(_dealer(threshold, True), "gid long, n long").groupBy("gid").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    crowds = settle(crowds.select("gid", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowds")
    dealt = codes.mapInArrow(_dealer(threshold, False), "gid long, lab long, turn int, node long, code binary").join(crowds, "gid", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    block = F.least("own", "other") * (1 << 31) + F.greatest("own", "other")
    dealt = dealt.select("gid", "lab", block.alias("block"), (F.col("own") > F.col("other")).cast("int").alias("side"), "turn", "node", "code")
    shape = "gid long, lab long, block long, side int, turn int, node long, code binary"
    near = dealt.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_screen(threshold), shape)
    near = near.join(distinct.select("node", "vector", "copies"), "node").repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS)
    found = settle(near.mapInArrow(_comparer(threshold, kind), "kind int, a long, b long"), "found")

    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    linked = connected_components(found.where("kind = 1").select("a", "b"))
    named = distinct.select("node", "name", "least", "copies").join(linked.withColumnRenamed("node", "linked_node"), F.col("node") == F.col("linked_node"), "left").join(links, F.col("node") == F.col("a"), "left")
    named = settle(named.select("name", "least", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    for used in (distinct, sizes, codes, crowds, found):
        discard(used)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(F.col("name").alias("of"), "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    out = ids.join(named, ids["name"] == named["of"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
