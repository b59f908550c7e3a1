"""Whitening of embeddings by components of the exact characteristic polynomial of their scatter.

1. Entries become whole numbers, ``floor(64 * c)``; a vector is kept as the shortest bytes that
   hold it, so that equal vectors are equal keys and each distinct one counts once. The constant
   1000000 added to every number is left out here: centring takes it away again.
2. The fit list gives counts, sums and sums of products, exact whatever their size: tasks add up
   limbs of 20 bits whose products of a batch stay below 2**53, Spark adds up limbs of 40 bits.
   ``n * products - sums * sums`` is the integer scatter, n**2 times the covariance.
3. Its characteristic polynomial is computed modulo primes, a task for a few primes, by reduction
   to Hessenberg form, and put together by Chinese remaindering. As all its roots are real, the
   rule of signs counts them exactly; bisection isolates the largest ones. A task per root refines
   it to 256 bits and finds its null space by inverse iteration in long fixed point.
4. Rows are projected with exact centring; the covariance of the result over the fit list is
   measured in a pass of its own.

Driver and tasks hold one matrix of the dimension (64 x 64 here) and the coefficients of its
polynomial; no rows are collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spectrum
from .scratch import Tables

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
BATCH = 4096        #: rows whose products of 20-bit limbs add up to less than 2**53
LIMB, STORED = 20, 40
LIMBS = 6           #: of 40 bits, for sums of products
_LIMIT = 1 << 62    #: numbers are held within it, infinite ones do not occur

OUTPUT = "vec_id {id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_digits string"


def _numbers(column: pa.Array, wanted: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a whole vector, and their numbers, one row each; shorter ones end in zeros."""
    if not pa.types.is_large_list(column.type):
        column = column.cast(pa.large_list(column.type.value_type))
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
    valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(valid, lengths, 0)
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False) if not flat.null_count else flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), lengths)
    bad = np.zeros(len(column), bool)
    bad[owner[~np.isfinite(values)]] = True
    kept = np.flatnonzero(valid & ~bad)
    width = wanted if wanted is not None else int(lengths[kept].max(initial=0))
    out = np.zeros((len(kept), width), np.int64)
    place = np.full(len(column), -1)
    place[kept] = np.arange(len(kept))
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place[owner] >= 0
    with np.errstate(over="ignore"):
        whole = np.floor(values[inside] * SCALE)
    out[place[owner[inside]], at[inside]] = np.clip(whole, -_LIMIT, _LIMIT).astype(np.int64)
    return kept, out


def _keys(numbers: np.ndarray) -> list[bytes]:
    """Equal bytes for equal vectors; numbers take 1, 2, 4 or 8 bytes, as the largest needs."""
    if not numbers.shape[1]:
        return [b""] * len(numbers)
    low, high = numbers.min(1), numbers.max(1)
    out: list[bytes] = [b""] * len(numbers)
    left = np.ones(len(numbers), bool)
    for kind in (np.int8, np.int16, np.int32, np.int64):
        info = np.iinfo(kind)
        fits = np.flatnonzero(left & (low >= info.min) & (high <= info.max))
        if len(fits):
            left[fits] = False
            for i, row in zip(fits.tolist(), numbers[fits].astype(kind)):
                out[i] = bytes([row.itemsize]) + row.tobytes()
    return out


def _from_keys(keys: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(keys), width), np.int64)
    if width:
        kinds = np.array([k[0] for k in keys])
        for size in set(kinds.tolist()):
            rows = np.flatnonzero(kinds == size)
            out[rows] = np.frombuffer(b"".join(keys[i][1:] for i in rows), f"<i{size}").reshape(len(rows), width)
    return out


def _limbs(numbers: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum over 2**(20 * place) is the number; as few as the numbers need."""
    out, rest = [], numbers
    while True:
        last = np.abs(rest).max(initial=0) < 1 << LIMB
        own = rest if last else rest - ((rest >> LIMB) << LIMB)
        out.append(own.astype(float))
        if last:
            return out
        rest = rest >> LIMB


def _fit_rows(vectors: DataFrame, width: int) -> DataFrame:
    """Each distinct vector once, as key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_keys(_numbers(batch.column(0), width)[1]), pa.binary())], ["key"])

    return vectors.mapInArrow(run, "key binary").distinct()


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, sums and sums of products of their numbers."""
    size = width + 1  # products with a constant 1 are the sums and the count
    names = [f"l{i}" for i in range(LIMBS)]
    mask = (1 << STORED) - 1
    upper = [(i, j) for i in range(size) for j in range(i, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), BATCH):
                own = _from_keys(keys[at: at + BATCH], width)
                limbs = _limbs(np.hstack([own, np.ones((len(own), 1), np.int64)]))
                for a, left in enumerate(limbs):
                    for b, right in enumerate(limbs):
                        total = total + (left.T @ right).astype(np.int64).astype(object) * (1 << LIMB * (a + b))
        flat = [int(total[i, j]) for i, j in upper]
        parts = [pa.array([(v >> STORED * place) & mask if place < LIMBS - 1 else v >> STORED * place for v in flat], pa.int64()) for place in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(upper)), pa.int32()), *parts], ["entry", *names])

    rows = fit.select("key").mapInArrow(run, "entry int, " + ", ".join(f"{c} bigint" for c in names)).groupBy("entry").agg(
        *[F.sum(c).alias(c) for c in names]).collect()  # one row per entry of the matrix
    whole = {upper[r["entry"]]: sum(r[c] << STORED * place for place, c in enumerate(names)) for r in rows}
    n = whole.get((width, width), 0)
    sums = [whole.get((i, width), 0) for i in range(width)]
    return n, sums, [[whole.get((min(i, j), max(i, j)), 0) for j in range(width)] for i in range(width)]


def _polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Characteristic polynomial, constant first; a task takes a few primes."""
    primes = spectrum.enough_primes(spectrum.coefficient_bound(matrix))
    shared = spark.sparkContext.broadcast(matrix)  # of the dimension's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"prime": own, "residues": [spectrum.polynomial_modulo(shared.value, p) for p in own]})

    tasks = max(1, min(len(primes) // 4, 64))
    rows = spark.createDataFrame([(p,) for p in primes], "prime bigint").repartition(tasks, "prime").mapInArrow(
        run, "prime bigint, residues array<bigint>").collect()
    return spectrum.combine([r["residues"] for r in rows], [r["prime"] for r in rows])


def _components(spark, matrix: list[list[int]], wanted: int) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit vector) of the largest positive eigenvalues, falling; a task per root."""
    poly = _polynomial(spark, matrix)
    top = max(1, -poly[-2]).bit_length()
    roots = spectrum.isolate(poly, wanted)
    shared = spark.sparkContext.broadcast((matrix, poly))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                square, own = shared.value
                low, bits = spectrum.refine(own, int(row["low"]), row["bits"], row["times"], top)
                vectors = spectrum.eigenvectors(square, low, bits, row["times"])
                yield pa.RecordBatch.from_pydict({"place": [row["place"]], "low": [str(low)], "bits": [bits], "vectors": [vectors]})

    if not roots:
        return []
    rows = spark.createDataFrame([(i, str(a), b, c) for i, (a, b, c) in enumerate(roots)], "place bigint, low string, bits bigint, times bigint").repartition(
        len(roots), "place").mapInArrow(run, "place bigint, low string, bits bigint, vectors array<array<double>>").collect()
    found = [(Fraction(int(r["low"])) / Fraction(2) ** r["bits"], v) for r in sorted(rows, key=lambda r: r["place"]) for v in r["vectors"]]
    return found[:wanted]


def _centred(numbers: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * number - sum, exact: in 64 bits where these hold it, else in whole numbers of any size."""
    largest = n * int(np.abs(numbers).max(initial=0)) + max((abs(s) for s in sums), default=0)
    kind = np.int64 if largest < 1 << 62 else object
    return numbers.astype(kind) * (n if kind is object else np.int64(n)) - np.array(sums, kind)


def _deviations(centred: np.ndarray) -> list[int]:
    largest = int(np.abs(centred).max(initial=0))
    if largest * largest * max(1, centred.shape[1]) >= 1 << 62:
        centred = centred.astype(object)
    return [int(v) for v in (centred * centred).sum(1)]


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits.

    One row per vector and component, for the up to `components` largest eigenvalues above zero.
    Vectors that are null or hold nulls, NaN or infinities are left out. A shorter vector than
    the longest one reads as zero where it ends. Numbers beyond 2**62 count as 2**62. Repeated
    vectors count once in the fit and each has its rows; a null or repeated vec_id stays as it
    is. Equal eigenvalues take any orthogonal vectors of their space. deviation is null where it
    does not fit in 64 bits; deviation_digits always has all its digits. Fewer than two different
    vectors have no component, and no rows come out; the same holds for an empty table. Columns
    beside the two named ones are not looked at.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    schema = OUTPUT.format(id=own.schema["vec_id"].dataType.simpleString())
    width = own.agg(F.max(F.when(~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.size("embedding")))).first()[0] or 0
    tables = Tables(spark, "whitening")
    fit = tables.write(_fit_rows(own.select("embedding"), width))
    n, sums, products = _sums(fit, width)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    found = _components(spark, scatter, components) if n > 1 and width else []
    if not found:
        return spark.createDataFrame([], schema)
    trace = sum(scatter[i][i] for i in range(width))
    explained = [float(value / trace) for value, _ in found]
    # centred numbers are n times too large, as is the root of the eigenvalue
    matrix = np.array([[x / float(value) ** 0.5 for x in vector] for value, vector in found]).T
    many = len(found)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number of vectors, sums and sums of products of the whitened fit list."""
        total = np.zeros((many + 1, many + 1))
        for batch in batches:
            white = _centred(_from_keys(batch.column(0).to_pylist(), width), n, sums).astype(float) @ matrix
            white = np.hstack([white, np.ones((len(white), 1))])
            total += white.T @ white
        at = [(i, j) for i in range(many + 1) for j in range(i, many + 1)]
        yield pa.RecordBatch.from_pydict({"i": [i for i, _ in at], "j": [j for _, j in at], "x": [float(total[i, j]) for i, j in at]})

    rows = fit.mapInArrow(project, "i bigint, j bigint, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    moments = {(r["i"], r["j"]): r["x"] / n for r in rows}
    error = max(abs(moments[i, j] - moments[i, many] * moments[j, many] - (i == j)) for i in range(many) for j in range(i, many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, numbers = _numbers(batch.column(1), width)
            centred = _centred(numbers, n, sums)
            digits = _deviations(centred)
            white = (centred.astype(float) @ matrix).ravel()
            rows = np.repeat(np.arange(len(kept)), many)
            deviation = pa.array([d if d < 1 << 63 else None for d in digits], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(kept[rows])), pa.array(np.tile(np.arange(1, many + 1), len(kept)), pa.int32()),
                pa.array(np.full(len(rows), n), pa.int64()), deviation.take(pa.array(rows)), pa.array(white),
                pa.array(np.tile(explained, len(kept))), pa.array(np.full(len(rows), error)), pa.array([str(d) for d in digits]).take(pa.array(rows))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])

    return own.mapInArrow(run, schema)
