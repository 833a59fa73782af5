"""Cross-products of many columns in one pass: pairwise counts, means and centred products that know missing values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block: a pair of blocks is one row of four matrices, 2 MB at most.
BLOCK = 256
#: Rows of partial sums that one task of the first step adds up.
FAN_IN = 64

_SHAPE = "a int, b int, part int, blob binary"


@dataclass
class Moments:
    """Of columns i (left) and j (right), over the rows that have both: n, mean of i, mean of j, centred sums of products, of squares of i, of j."""

    n: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cross: np.ndarray
    left2: np.ndarray
    right2: np.ndarray

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray) -> "Moments":
        """From rows of two blocks of columns, NaN for missing; centred on the columns' means first."""
        (xc, xm, x0), (yc, ym, y0) = (_centred(v) for v in (x, y))
        n = xm.T @ ym
        some = np.maximum(n, 1)
        sx, sy = xc.T @ ym, xm.T @ yc
        return Moments(n, x0[:, None] + sx / some, y0[None, :] + sy / some, xc.T @ yc - sx * sy / some, (xc * xc).T @ ym - sx * sx / some, xm.T @ (yc * yc) - sy * sy / some)

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        some = np.maximum(n, 1)
        u, v = other.left - self.left, other.right - self.right
        w = self.n * other.n / some
        share = other.n / some
        return Moments(n, self.left + u * share, self.right + v * share, self.cross + other.cross + u * v * w, self.left2 + other.left2 + u * u * w, self.right2 + other.right2 + v * v * w)

    def tobytes(self) -> bytes:
        return np.array(self.n.shape, np.int64).tobytes() + np.stack([self.n, self.left, self.right, self.cross, self.left2, self.right2]).tobytes()

    @staticmethod
    def frombytes(raw: bytes) -> "Moments":
        shape = np.frombuffer(raw[:16], np.int64)
        return Moments(*np.frombuffer(raw[16:]).reshape(6, *shape))

    def correlations(self) -> np.ndarray:
        """NaN where a column is constant over the pair's rows: its squares are no more than rounding."""
        still = (self.left2 <= 1e-20 * self.n * self.left**2) | (self.right2 <= 1e-20 * self.n * self.right**2) | (self.n < 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            rho = self.cross / (np.sqrt(np.maximum(self.left2, 0)) * np.sqrt(np.maximum(self.right2, 0)))
        return np.where(still, np.nan, np.clip(rho, -1, 1))


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    there = ~np.isnan(x)
    mean = np.where(there, x, 0).sum(0) / np.maximum(there.sum(0), 1)
    return np.where(there, x - mean, 0.0), there.astype(float), mean


def column_moments(df: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """(a, b, part, blob): the Moments of each pair of column blocks a <= b, from one pass over the rows.

    Partitions send one row a pair of blocks; these are added up by tasks of FAN_IN rows, then by one task a pair, so neither
    rows nor partitions make a large task.
    """
    blocks = [columns[i : i + block] for i in range(0, len(columns), block)]
    at = np.cumsum([0, *map(len, blocks)]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], Moments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            parts = [x[:, a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            for i, left in enumerate(parts):
                for j in range(i, len(parts)):
                    own = Moments.of(left, parts[j])
                    sums[i, j] = sums[i, j] + own if (i, j) in sums else own
        part = TaskContext.get().partitionId()
        for (i, j), total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((i, pa.int32()), (j, pa.int32()), (part, pa.int32()), (total.tobytes(), pa.binary()))], names=["a", "b", "part", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, head = None, None
        for batch in batches:
            for row in batch.to_pylist():
                own = Moments.frombytes(row["blob"])
                total, head = (own if total is None else total + own), row
        if head is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((head["a"], pa.int32()), (head["b"], pa.int32()), (head["part"] // FAN_IN, pa.int32()), (total.tobytes(), pa.binary()))], names=["a", "b", "part", "blob"])

    sent = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, _SHAPE)
    once = sent.groupBy("a", "b", F.floor(F.col("part") / FAN_IN)).applyInArrow(add, _SHAPE)
    return once.groupBy("a", "b").applyInArrow(add, _SHAPE)


def pair_table(moments: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """(a, b, n, rho) of all ordered pairs of columns; rho is null where a column is constant."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = Moments.frombytes(row["blob"])
                rho = m.correlations()
                i, j = np.meshgrid(np.arange(rho.shape[0]) + row["a"] * block, np.arange(rho.shape[1]) + row["b"] * block, indexing="ij")
                i, j, rho, n = i.ravel(), j.ravel(), rho.ravel(), m.n.ravel().astype(np.int64)
                if row["a"] != row["b"]:
                    i, j, rho, n = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(rho, 2), np.tile(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in i.tolist()]), pa.array([names[k] for k in j.tolist()]), pa.array(n), pa.array(rho, mask=np.isnan(rho))], names=["a", "b", "n", "rho"])

    return moments.mapInArrow(run, "a string, b string, n long, rho double")


def correlation_matrix(df: DataFrame, columns: list[str], block: int = BLOCK) -> np.ndarray:
    """The matrix on the driver: 8 bytes for each pair of columns, whatever the rows."""
    out = np.full((len(columns), len(columns)), np.nan)
    for row in column_moments(df, columns, block).toLocalIterator():
        rho = Moments.frombytes(row["blob"]).correlations()
        i, j = row["a"] * block, row["b"] * block
        out[i : i + rho.shape[0], j : j + rho.shape[1]] = rho
        out[j : j + rho.shape[1], i : i + rho.shape[0]] = rho.T
    return out
