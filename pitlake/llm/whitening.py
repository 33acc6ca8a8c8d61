"""Whitening of embeddings from an exact integer covariance, counted by bit-sliced scatter.

Entries become fixed-point integers x = floor(256 * c). In blocks of rows every dimension is shifted by its minimum in the block and cut into bit
planes, each packed across the rows into words; the bit counts of the conjunctions of two planes, weighted by their places, add up to the exact
cross-product of two dimensions. Undoing the shifts keeps everything integer; blocks and tasks are added as integers (in 32-bit limbs, so no sum
can overflow). Only sums and cross-products, d * (d + 3) / 2 numbers for d dimensions, reach the driver, where n * X - S * S' centres them as
integers before they are divided once and decomposed.

Cases: rows whose vector is null, empty, or holds a null or a non-finite entry are left out, and so are vectors that have not the commonest length
(of equally common ones the longest is kept), since they have no covariance with the rest. Integers beyond 64 bits end at its limits. Equal vectors
count once in the fit, however many rows hold them, and every row gets its own result; null ids and repeated ids stay. A component whose eigenvalue
is nothing but rounding (a constant or dependent direction, fewer vectors than dimensions, a single row) has no scale: its ``whitened`` is null, and
it is left out of ``identity_error``; without any variance ``explained`` is null too. An empty table, or one without usable vectors, gives no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import row_batches
from pitlake.session import stage

SCALE = 256
COMPONENTS = 4
BLOCK_ROWS = 1 << 14
BLOCK_ENTRIES = 1 << 22
ROUNDING = 1e-12
LIMB_BITS, LIMBS = 32, 6
LARGEST = (1 << 62) - 1
DIGITS = 38


def fixed_point(vector: Column) -> Column:
    """Entries as whole 256ths, rounded down; null unless all of them are finite."""
    entries = vector.cast("array<double>")
    usable = (F.size(entries) > 0) & ~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(usable, F.transform(entries, lambda c: F.floor(c * SCALE) + F.lit(0).cast("long")))


def fixed_rows(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x of the usable rows, all of one length, written once."""
    found = stage(embeddings.select(F.col(key).alias("vec_id"), fixed_point(F.col(vector)).alias("x")).where("x is not null"), "fixed")
    lengths = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found.where(F.size("x") == (lengths[0].d if lengths else 0))


# --- scatter -----------------------------------------------------------------------------------------------------------------------


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of an (rows, dimensions) array of uint64, packed across rows into words; and the dimension and bit of each plane."""
    words = -(-len(shifted) // 64)
    widths = [int(top).bit_length() for top in shifted.max(axis=0)]
    dims = np.repeat(np.arange(len(widths)), widths)
    bits = np.concatenate([np.arange(w) for w in widths]).astype(np.uint64) if len(dims) else np.empty(0, np.uint64)
    packed = np.zeros((len(dims), words * 8), np.uint8)
    for at, (dim, bit) in enumerate(zip(dims, bits, strict=True)):
        line = np.packbits((shifted[:, dim] >> bit & np.uint64(1)).astype(bool))
        packed[at, :len(line)] = line
    return packed.view(np.uint64), dims, bits


def block_scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (d) and cross-products (d x d) of int64 rows, as Python integers."""
    n, d = x.shape
    low = x.min(axis=0)
    sliced, dims, bits = planes(x.astype(np.uint64) - low.astype(np.uint64))
    narrow = 2 * int(bits.max(initial=0)) + 2 + n.bit_length() <= 62
    weights = (np.uint64(1) << bits).astype(np.int64) if narrow else np.array([1 << int(b) for b in bits], object)
    starts = np.searchsorted(dims, np.arange(d + 1))

    def by_dimension(counts: np.ndarray) -> np.ndarray:
        upto = np.concatenate([np.zeros(1, weights.dtype), np.cumsum(counts.astype(weights.dtype) * weights)])
        return upto[starts[1:]] - upto[starts[:-1]]

    sums = by_dimension(np.bitwise_count(sliced).sum(axis=1, dtype=np.int64)).astype(object)
    cross = np.zeros((d, d), object)
    for i in range(d):
        counts = np.zeros(len(sliced), np.int64)
        row = np.zeros(d, object)
        for at in range(starts[i], starts[i + 1]):
            counts[starts[i]:] = np.bitwise_count(sliced[at] & sliced[starts[i]:]).sum(axis=1, dtype=np.int64)
            row += by_dimension(counts).astype(object) * int(weights[at])
        cross[i, i:] = cross[i:, i] = row[i:]
    shift = low.astype(object)
    lifted = np.outer(shift, sums)
    return sums + n * shift, cross + lifted + lifted.T + n * np.outer(shift, shift)


def limbs(value: int) -> list[int]:
    """Two's complement digits of 32 bits; the last one carries the sign."""
    low = [(value >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1) for k in range(LIMBS - 1)]
    return [*low, value >> (LIMB_BITS * (LIMBS - 1))]


def scatter(fit: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross-products over the column ``x`` of ``fit``; tasks send sums only."""
    names = [f"limb{k}" for k in range(LIMBS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, 0, 0
        for batch in row_batches(batches, block_rows):
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            step = max(64, BLOCK_ENTRIES // x.shape[1] // 64 * 64)
            for start in range(0, len(x), step):
                s, c = block_scatter(x[start:start + step])
                n, sums, cross = n + len(x[start:start + step]), sums + s, cross + c
        if n:
            d = len(sums)
            cells = [(-1, -1, n), *[(-1, i, sums[i]) for i in range(d)], *[(i, j, cross[i, j]) for i in range(d) for j in range(i, d)]]
            columns = [[i for i, _, _ in cells], [j for _, j, _ in cells], *map(list, zip(*[limbs(int(v)) for _, _, v in cells], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], ["i", "j", *names])

    parts = fit.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"{n} long" for n in names))
    total = {(r.i, r.j): sum(r[n] << (LIMB_BITS * k) for k, n in enumerate(names)) for r in parts.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names]).collect()}
    d = sum(1 for i, j in total if i == -1 and j >= 0)
    sums = np.array([total[-1, j] for j in range(d)], object)
    cross = np.array([[total[min(i, j), max(i, j)] for j in range(d)] for i in range(d)], object).reshape(d, d)
    return total.get((-1, -1), 0), sums, cross


# --- whitening ---------------------------------------------------------------------------------------------------------------------


def principal(n: int, sums: np.ndarray, cross: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading unit eigenvectors (rows), their eigenvalues and the trace of the covariance, centred as integers."""
    centred = n * cross - np.outer(sums, sums)
    covariance = np.array([[value / (n * n) for value in row] for row in centred.tolist()], float)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    return vectors.T[order], values[order], int(np.trace(centred)) / (n * n)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exact sum over the dimensions of (n * x - S) squared, for each row."""
    top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    widest = max([abs(int(s)) for s in sums], default=0)
    if top * max(top, widest) * x.shape[1] <= LARGEST:
        squares, products = (x * x).sum(axis=1), x @ sums.astype(np.int64)
    else:
        squares, products = (x.astype(object) ** 2).sum(axis=1), x.astype(object) @ sums
    own = int((sums * sums).sum())
    return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, products, strict=True)]


def whiten(embeddings: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal, null beyond 38 digits), whitened, explained and identity_error of all usable rows."""
    spark = embeddings.sparkSession
    rows = fixed_rows(embeddings, key, vector)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal({DIGITS},0), whitened double, explained double, identity_error double"
    fit = stage(rows.select("x").distinct(), "fit")
    n, sums, cross = scatter(fit)
    if not n:
        return spark.createDataFrame([], schema)
    axes, values, trace = principal(n, sums, cross, components)
    sound = [k for k, e in enumerate(values) if e > ROUNDING * trace and e > 0]
    mean = np.array([int(s) / n for s in sums], float)
    scaled = np.array([axes[k] / np.sqrt(values[k]) for k in sound], float).reshape(len(sound), len(mean))

    def projected(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return x, (x - mean) @ scaled.T

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, 4096):
            _, w = projected(batch, 0)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(len(sound))], [f"w{k}" for k in sound])

    error = None
    if sound:
        w = fit.select("x").mapInArrow(fitted, ", ".join(f"w{k} double" for k in sound))
        measured = w.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a in sound for b in sound if a <= b]).collect()[0]
        error = max(abs(measured[f"c{a}_{b}"] - (a == b)) for a in sound for b in sound if a <= b)
    shares = [e / trace if trace > 0 else None for e in values]
    limit = 10**DIGITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = len(shares)
        for batch in row_batches(batches, 4096):
            x, w = projected(batch, 1)
            full = np.full((len(x), each), np.nan)
            full[:, sound] = w
            spread = deviations(x, n, sums)
            small = max(spread, default=0) <= LARGEST
            exact = pa.array(spread, pa.int64()).cast(pa.decimal128(DIGITS, 0)) if small else pa.array([Decimal(v) if v < limit else None for v in spread], pa.decimal128(DIGITS, 0))
            places = pa.array(np.repeat(np.arange(len(x)), each))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(places), pa.array(np.tile(np.arange(1, each + 1), len(x)), pa.int32()), pa.array(np.full(each * len(x), n), pa.int64()),
                exact.take(places), pa.array(full.ravel(), from_pandas=True), pa.array(shares * len(x), pa.float64()), pa.array([error] * (each * len(x)), pa.float64()),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
