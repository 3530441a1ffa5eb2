"""Embedding whitening with MLlib block matrices.

Each task packs its vectors into row blocks, which are stored once.  Sums over the
blocks give the centre; the centred blocks are a ``BlockMatrix`` whose transposed
product with itself is the scatter.  That matrix, as wide as a vector is long, is the
only one that comes to the driver, where ``eigh`` splits it; a second block product
with the whitening matrix projects the rows, and a third checks their covariance.

Entries become whole numbers first (``x = floor(1024 c) + 100000``), so sums and
deviations are exact and ``(n x - S) / n`` is rounded once.  A block holds at most
``BLOCK_VALUES`` entries and is numbered by its task, so numbering moves no rows;
a product's middle dimension is cut so that one task multiplies ``BLOCKS_A_SPLIT``
blocks.  The driver learns one coordinate pair a block.

Defined cases: a vector that is null, empty, or holds null or non-finite entries is
left out, and so is one whose length is not the commonest (of equal counts the
greatest), since it lacks entries; null and repeated identifiers and repeated rows
stay; a component whose eigenvalue is at most ``LEAST_SHARE`` of the trace has no
whitened direction and gives no rows, so equal vectors, a single vector and an empty
table give none; of equal eigenvalues any basis may come; a deviation beyond 64 bits
is null; entries must stay below 2**40; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelens.functions.storage import materialise
from pacelens.llm.common import map_batches, table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK_VALUES = 1 << 20
BLOCKS_A_SPLIT = 8
LEAST_SHARE = 1e-12

#: The row layout MLlib reads and writes block matrices in.
BLOCKS = T.StructType([
    T.StructField("_1", T.StructType([T.StructField("_1", T.LongType(), False), T.StructField("_2", T.LongType(), False)])),
    T.StructField("_2", MatrixUDT()),
])
PLACE = pa.struct([("_1", pa.int64()), ("_2", pa.int64())])
MATRIX = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def whole(vector: Column) -> Column:
    """A vector's entries as the whole numbers that are whitened."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))) + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every entry a finite number."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def rows_a_block(width: int) -> int:
    return max(1, BLOCK_VALUES // width)


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pack(vectors: DataFrame, vector: str, identifier: str) -> DataFrame:
    """(task, serial, width, n, ids, x, sums): the vectors of each task in blocks of one width."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, held = TaskContext.get().partitionId(), 0, {}

        def block(width: int) -> pa.RecordBatch:
            ids, parts = held.pop(width)
            x = np.concatenate(parts)
            columns = [pa.array([task], pa.int64()), pa.array([serial], pa.int64()), pa.array([width], pa.int32()), pa.array([len(x)], pa.int32()), one_list(pa.concat_arrays(ids)), one_list(pa.array(x.ravel())), one_list(pa.array(x.sum(axis=0)))]
            return pa.RecordBatch.from_arrays(columns, names=["task", "serial", "width", "n", "ids", "x", "sums"])

        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            widths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                own, at = ids.take(pa.array(rows)), 0
                while at < len(x):
                    ids_held, parts = held.setdefault(width, ([], []))
                    room = rows_a_block(width) - sum(map(len, parts))
                    ids_held.append(own.slice(at, room))
                    parts.append(x[at : at + room])
                    at += room
                    if sum(map(len, parts)) == rows_a_block(width):
                        yield block(width)
                        serial += 1
        for width in list(held):
            yield block(width)
            serial += 1

    kind = vectors.schema[identifier].dataType
    schema = T.StructType([T.StructField(c, t) for c, t in (("task", T.LongType()), ("serial", T.LongType()), ("width", T.IntegerType()), ("n", T.IntegerType()), ("ids", T.ArrayType(kind)), ("x", T.ArrayType(T.LongType())), ("sums", T.ArrayType(T.LongType())))])
    kept = vectors.where(usable(F.col(vector))).select(F.col(identifier).alias("id"), whole(F.col(vector)).alias("x"))
    return map_batches(kept, packed, schema)


def matrix_rows(numbers: list[int], matrices: list[np.ndarray]) -> pa.RecordBatch:
    """Row blocks in the layout that MLlib reads."""
    places = pa.array([{"_1": k, "_2": 0} for k in numbers], PLACE)
    sizes = pa.array(np.cumsum([0, *[m.size for m in matrices]]), pa.int32())
    none = pa.nulls(len(matrices), pa.list_(pa.int32()))
    values = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([m.ravel() for m in matrices])))
    columns = [pa.array([1] * len(matrices), pa.int8()), pa.array([len(m) for m in matrices], pa.int32()), pa.array([m.shape[1] for m in matrices], pa.int32()), none, none, values, pa.array([True] * len(matrices))]
    return pa.RecordBatch.from_arrays([places, pa.StructArray.from_arrays(columns, fields=list(MATRIX))], names=["_1", "_2"])


def block_matrix(blocks: DataFrame, width: int, count: int) -> BlockMatrix:
    """A matrix of up to ``count`` row blocks as wide as a row."""
    rows = rows_a_block(width)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, rows, width, rows * count, width), rows, width)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left.multiply(right)`` with the middle dimension cut into ``splits`` tasks, which only the JVM signature offers."""
    model = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(model, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix, count: int) -> np.ndarray:
    """The transposed product of a matrix with itself, on the driver: a row and a column for each entry of a vector."""
    kept = matrix.persist(StorageLevel.MEMORY_AND_DISK)
    found = product(kept.transpose(), kept, -(-count // BLOCKS_A_SPLIT) | 1).toLocalMatrix().toArray()
    kept._java_matrix_wrapper._java_model.blocks().unpersist(False)
    return (found + found.T) / 2


@dataclass(frozen=True)
class Whitening:
    """Stored row blocks with their centre and components; ``directions`` are columns over the root of their eigenvalue."""

    blocks: DataFrame
    serials: int
    count: int
    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    directions: np.ndarray
    trace: float

    def numbered(self) -> DataFrame:
        return self.blocks.withColumn("number", F.col("task") * F.lit(self.serials) + F.col("serial"))


def centred(blocks: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """Centred row blocks (number, x) as MLlib reads them."""
    width = len(sums)

    def run_batches(batches):
        for batch in batches:
            for number, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield matrix_rows([number], [(x.values.to_numpy().reshape(-1, width) * n - sums) / n])

    return map_batches(blocks.select("number", "x"), run_batches, BLOCKS)


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", identifier: str = "vec_id") -> Whitening | None:
    """Centre and components of all usable vectors; None where there are none."""
    stored = materialise(pack(vectors, vector, identifier))
    widths = stored.groupBy("width").agg(F.sum(F.col("n").cast("long")).alias("n"), F.max("task").alias("task"), F.max("serial").alias("serial"))
    commonest = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if commonest is None:
        return None
    width, n, serials = commonest["width"], commonest["n"], commonest["serial"] + 1
    count = (commonest["task"] + 1) * serials
    if count >= 2**31:
        raise ValueError(f"{count} row blocks are more than a block matrix can number")
    blocks = stored.where(F.col("width") == width).drop("width", "n")
    totals = blocks.select(F.posexplode("sums").alias("dimension", "s")).groupBy("dimension").agg(F.sum("s").alias("s")).orderBy("dimension")
    sums = np.array([r["s"] for r in totals.collect()], dtype=np.int64)
    model = Whitening(blocks.drop("sums"), serials, count, n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    covariance = scatter(block_matrix(centred(model.numbered(), n, sums), width, count), count) / n
    eigenvalues, vectors_ = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = [k for k in np.argsort(-eigenvalues, kind="stable")[:components] if eigenvalues[k] > LEAST_SHARE * trace]
    return Whitening(model.blocks, serials, count, n, sums, eigenvalues[order], vectors_[:, order] / np.sqrt(eigenvalues[order]), trace)


def project(model: Whitening) -> DataFrame:
    """(number, values): whitened rows of each block, row after row."""
    spark = model.blocks.sparkSession
    width, kept = model.directions.shape
    rows = rows_a_block(width)
    turn = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(width, kept, model.directions.ravel(order="F")))], 1), width, kept, width, kept)
    whitened = product(block_matrix(centred(model.numbered(), model.n, model.sums), width, model.count), turn, 1)
    assert whitened.rowsPerBlock == rows

    def run_batches(batches):
        for batch in batches:
            places, matrices = batch.column(0).field(0), batch.column(1)
            for number, m in zip(places.to_pylist(), matrices):
                values = m["values"].values.to_numpy().reshape((m["numCols"].as_py(), m["numRows"].as_py()) if not m["isTransposed"].as_py() else (m["numRows"].as_py(), m["numCols"].as_py()))
                values = values if m["isTransposed"].as_py() else values.T
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one_list(pa.array(np.ascontiguousarray(values).ravel()))], names=["number", "values"])

    return map_batches(callMLlibFunc("getMatrixBlocks", whitened._java_matrix_wrapper._java_model), run_batches, "number long, values array<double>")


def identity_error(model: Whitening, projected: DataFrame) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    kept, n = len(model.eigenvalues), model.n
    by_component = F.pmod(F.col("at"), F.lit(kept))
    totals = projected.select(F.posexplode("values").alias("at", "w")).groupBy(by_component.alias("k")).agg(F.sum("w").alias("w")).collect()
    means = np.zeros(kept)
    for r in totals:
        means[r["k"]] = r["w"] / n

    def run_batches(batches):
        for batch in batches:
            for number, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield matrix_rows([number], [values.values.to_numpy().reshape(-1, kept) - means])

    rows = rows_a_block(len(model.sums))
    blocks = map_batches(projected, run_batches, BLOCKS)
    matrix = BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, rows, kept, rows * model.count, kept), rows, kept)
    return float(np.abs(scatter(matrix, model.count) / n - np.eye(kept)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sum over dimensions of (n x - S)^2 of each row, exactly; null beyond 64 bits."""
    off = x * n - sums
    if len(off) == 0 or int(np.abs(off).max()) ** 2 * x.shape[1] < 2**63:
        return pa.array((off * off).sum(axis=1), pa.int64())
    exact = [sum(v * v for v in row) for row in off.tolist()]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", identifier: str = "vec_id") -> DataFrame:
    """(identifier, component, n, deviation, whitened, explained, identity_error) of each usable vector and component."""
    spark, kind = vectors.sparkSession, vectors.schema[identifier].dataType
    parts = ((identifier, kind), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))
    schema = T.StructType([T.StructField(c, t) for c, t in parts])
    model = fit(vectors, components, vector, identifier)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    projected = materialise(project(model))
    error = identity_error(model, projected)
    n, sums, kept = model.n, model.sums, len(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def with_deviation(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, x = batch.column(1).slice(at, 1), batch.column(2)[at].values.to_numpy().reshape(-1, len(sums))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), ids, one_list(deviations(x, n, sums))], names=["number", "ids", "deviation"])

    def per_component(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, off, values = (batch.column(k)[at].values for k in range(3))
                w, rows = values.to_numpy().reshape(-1, kept), len(ids)
                for k in range(kept):
                    columns = [ids, pa.array(np.full(rows, k + 1, np.int32)), pa.array(np.full(rows, n)), off, pa.array(np.ascontiguousarray(w[:, k])), pa.array(np.full(rows, explained[k])), pa.array(np.full(rows, error))]
                    yield pa.RecordBatch.from_arrays(columns, names=[c for c, _ in parts])

    listed = T.StructType([T.StructField("number", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("deviation", T.ArrayType(T.LongType()))])
    left = map_batches(model.numbered().select("number", "ids", "x"), with_deviation, listed)
    joined = left.join(projected.withColumnRenamed("number", "p"), F.col("number") == F.col("p")).select("ids", "deviation", "values")
    return map_batches(joined, per_component, schema)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
