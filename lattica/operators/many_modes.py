"""Spherical k-means with many modes.

Rows lie in the shared folder with their mode and its product, and meet centres in matrix products. A product with a centre that
hasn't moved stays as it was, so a row meets the moved centres only, or all of them where its own has moved away from it: the
nearest centre of every row is found, without products that can't change it. The centres (k rows) are held by the driver and
sent to every task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles
from ..sources import shared_folder

#: Products that differ by less are equals.
SAME = 1e-12
#: Centres that move by less (1 - cosine) stand still, as in MLlib.
STILL = 1e-4
#: Rows and centres of one product, which a core's cache should hold.
ROWS, CENTRES = 512, 1024
#: Bytes of vectors in a task.
TASK_BYTES = 16 << 20

_STATE = "vec array<double>, h long, mode int, sim double, was int"


def _vectors(batch: pa.RecordBatch, name: str = "vec") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def _nearest(x: np.ndarray, mode: np.ndarray, best: np.ndarray, centres: np.ndarray, names: np.ndarray) -> None:
    """Sets mode and best where one of the centres (names: their modes, ascending) is nearer; the first of equals."""
    for r in range(0, len(x), ROWS):
        rows, m, b = x[r : r + ROWS], mode[r : r + ROWS], best[r : r + ROWS]
        at = np.arange(len(rows))
        for c in range(0, len(centres), CENTRES):
            p = rows @ centres[c : c + CENTRES].T
            j = p.argmax(1)
            s, new = p[at, j], names[c + j]
            use = (s > b + SAME) | ((s >= b - SAME) & (new < m))
            m[use], b[use] = new[use], s[use]


def units(df: DataFrame, vec: str, seed: int = 0) -> DataFrame:
    """Vectors that have a direction, at length 1, and h, a number drawn for each direction (coordinates to nine places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch)
            n = np.linalg.norm(x, axis=1) if x.size else np.zeros(len(x))
            good = np.isfinite(n) & (n > 0)
            if good.any():
                x = x[good] / n[good, None]
                keys = [k.tobytes() for k in np.round(x * 1e9).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([_arrays(x), pa.array(keys, pa.binary())], ["vec", "key"])

    full = df.select(as_doubles(F.col(vec)).alias("vec")).where(F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull()))
    return full.mapInArrow(run, "vec array<double>, key binary").select("vec", F.xxhash64("key", F.lit(seed)).alias("h"))


def sizes(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Number of rows nearest to each of a few centres, the first of equals."""
    k = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, names = np.zeros(k, np.int64), np.arange(k, dtype=np.int32)
        for batch in batches:
            mode = np.full(batch.num_rows, k, np.int32)
            _nearest(_vectors(batch), mode, np.full(len(mode), -np.inf), centres, names)
            n += np.bincount(mode, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], ["mode", "n"])

    found = rows.mapInArrow(run, "mode int, n long").groupBy("mode").agg(F.sum("n")).collect()
    return np.array([n for _, n in sorted(map(tuple, found))], np.int64)


def _first(rows: DataFrame, sent) -> DataFrame:
    """The state of rows before any centre has moved: those in a centre's direction are its own, all others look for theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, drawn = sent.value
        names = np.arange(len(centres), dtype=np.int32)
        for batch in batches:
            x, h = _vectors(batch), batch.column("h").to_numpy()
            mode = np.minimum(np.searchsorted(drawn, h), len(drawn) - 1).astype(np.int32)
            own = drawn[mode] == h
            mode[~own] = -1
            best = np.where(own, np.einsum("ij,ij->i", x, centres[mode]), -np.inf) if len(x) else np.zeros(0)
            was, rest = mode.copy(), np.flatnonzero(~own)
            m, b = mode[rest], best[rest]
            _nearest(x[rest], m, b, centres, names)
            mode[rest], best[rest] = m, b
            yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("h"), pa.array(mode), pa.array(best), pa.array(was)], ["vec", "h", "mode", "sim", "was"])

    return rows.mapInArrow(run, _STATE)


def _next(state: DataFrame, sent) -> DataFrame:
    """The state of rows after some centres have moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, moved = sent.value
        names = np.arange(len(centres), dtype=np.int32)
        some, which = centres[moved], names[moved]
        for batch in batches:
            x, was, best = _vectors(batch), batch.column("mode").to_numpy(), batch.column("sim").to_numpy().copy()
            mode, own = was.copy(), np.flatnonzero(moved[was])
            before = best[own]
            best[own] = np.einsum("ij,ij->i", x[own], centres[was[own]]) if len(own) else 0.0
            every = np.zeros(len(was), bool)
            every[own] = best[own] <= before + SAME
            for rows, c, n in ((np.flatnonzero(every), centres, names), (np.flatnonzero(~every), some, which)):
                m, b = mode[rows], best[rows]
                _nearest(x[rows], m, b, c, n)
                mode[rows], best[rows] = m, b
            yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("h"), pa.array(mode), pa.array(best), pa.array(was)], ["vec", "h", "mode", "sim", "was"])

    return state.mapInArrow(run, _STATE)


def _tally(state: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each mode, and whether it has won or lost any in the last step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, other = np.zeros(k, np.int64), np.zeros(k, bool)
        for batch in batches:
            mode, was = batch.column("mode").to_numpy(), batch.column("was").to_numpy()
            n += np.bincount(mode, minlength=k)
            new = mode != was
            other[mode[new]] = True
            other[was[new & (was >= 0)]] = True
        some = np.flatnonzero((n > 0) | other)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(other[some])], ["mode", "n", "other"])

    found = state.select("mode", "was").mapInArrow(run, "mode int, n long, other boolean").groupBy("mode").agg(F.sum("n").alias("n"), F.max("other").alias("other")).toArrow()
    n, other, at = np.zeros(k, np.int64), np.zeros(k, bool), found["mode"].to_numpy()
    n[at], other[at] = found["n"].to_numpy(), found["other"].to_numpy()
    return n, other


def _sums(state: DataFrame, wanted, shape: tuple[int, int], parts: int) -> np.ndarray:
    """Sums of the vectors of the modes wanted."""

    def add(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mode = batch.column("mode").to_numpy()
            rows = np.flatnonzero(use(mode))
            rows = rows[np.argsort(mode[rows], kind="stable")]
            if len(rows):
                at = np.flatnonzero(np.diff(mode[rows], prepend=-1))
                sums = np.add.reduceat(_vectors(batch)[rows], at, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(mode[rows][at]), pa.array(batch.column("h").to_numpy()[rows][at]), _arrays(sums)], ["mode", "h", "vec"])

    schema = "mode int, h long, vec array<double>"
    own = state.select("mode", "h", "vec").mapInArrow(lambda batches: add(batches, lambda m: wanted.value[m]), schema)
    met = own.repartition(parts, "mode").sortWithinPartitions("mode", "h").mapInArrow(lambda batches: add(batches, lambda m: np.ones(len(m), bool)), schema)
    out = np.zeros(shape)
    for batch in met.toArrow().to_batches():
        np.add.at(out, batch.column("mode").to_numpy(), _vectors(batch))
    return out


def _worst(state: DataFrame, n: int) -> np.ndarray:
    """The n directions farthest from their centres, of those that aren't their centre's own."""
    off = state.where(F.col("sim") < 1 - SAME)
    drawn = np.array([r[0] for r in off.groupBy("h").agg(F.min("sim").alias("sim")).orderBy("sim", "h").limit(n).collect()], np.int64)
    if not len(drawn):
        return np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.isin(batch.column("h").to_numpy(), drawn)))

    return _of_directions(off.select("vec", "h").mapInArrow(run, "vec array<double>, h long"))


def _of_directions(rows: DataFrame) -> np.ndarray:
    """A vector of each direction, in the order of h."""
    found = rows.dropDuplicates(["h"]).select("h", "vec").toArrow().combine_chunks().sort_by("h").combine_chunks()
    return _vectors(found.to_batches()[0]).copy()


def fit(df: DataFrame, k: int, vec: str = "vec", seed: int = 0, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Centres (length 1) and the number of rows nearest to each.

    The first centres are k rows of different directions, drawn by the seed; fewer where the table has fewer. A mode that is left
    without rows moves to the row farthest from its centre, at the end until no mode is empty, or every row lies on its centre."""
    spark = df.sparkSession
    context, folder, steps = spark.sparkContext, f"{shared_folder(spark)}/modes-{uuid.uuid4().hex}", 0

    def drop(path: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(made: DataFrame) -> DataFrame:
        """The table written and read back, in place of the one before it."""
        nonlocal steps
        made.write.parquet(f"{folder}/{steps + 1}")
        drop(f"{folder}/{steps}")
        steps += 1
        return spark.read.schema(made.schema).parquet(f"{folder}/{steps}")

    def step(make, before: DataFrame, *values) -> DataFrame:
        sent = context.broadcast(values)
        try:
            return keep(make(before, sent))
        finally:
            sent.destroy()

    try:
        rows = keep(units(df, vec, seed))
        drawn = np.array([r[0] for r in rows.select("h").distinct().orderBy("h").limit(k).collect()], np.int64)
        if not len(drawn):
            return np.zeros((0, 0)), np.zeros(0, np.int64)
        centres = _of_directions(rows.where(F.col("h") <= int(drawn[-1])))
        k, width = centres.shape
        parts = max(2 * context.defaultParallelism, math.ceil(rows.count() * width * 8 / TASK_BYTES))
        rows = keep(rows.repartition(parts))
        state = step(_first, rows, centres, drawn)
        for _ in range(rounds):
            n, changed = _tally(state, k)
            new = centres.copy()
            if changed.any():
                wanted = context.broadcast(changed)
                sums = _sums(state, wanted, centres.shape, parts)
                wanted.destroy()
                length = np.linalg.norm(sums, axis=1)
                good = changed & (length > SAME * n) & (n > 0)  # vectors that cancel out leave their centre where it is
                new[good] = sums[good] / length[good, None]
            empty = np.flatnonzero(n == 0)
            if len(empty):
                found = _worst(state, len(empty))
                if len(found):
                    new[empty[: len(found)]] = found
            moved = (new != centres).any(axis=1)
            far = 1 - np.einsum("ij,ij->i", new, centres) > STILL
            centres = new
            if not moved.any():
                break
            state = step(_next, state, centres, moved)
            if not far.any():
                break
        while True:
            n, _ = _tally(state, k)
            empty = np.flatnonzero(n == 0)
            found = _worst(state, len(empty)) if len(empty) else empty
            if not len(found):
                return centres, n
            empty, moved = empty[: len(found)], np.zeros(k, bool)
            centres[empty], moved[empty] = found, True
            state = step(_next, state, centres, moved)
    finally:
        drop(folder)
