"""Embedding whitening: centred rows in a distributed block matrix, transpose-multiplied, and projected by a second product."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumloom.llm.common import partitions, stored


@dataclass(frozen=True)
class Whitening:
    """Entries become floor(scale * c) + shift; ``most`` components; ``block`` rows in a block of the matrix."""

    scale: int = 64
    shift: int = 1_000_000
    most: int = 32
    block: int = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> vec_id, c: rows whose vector is not null, not empty and all of whose entries are finite."""
    c = F.col("embedding").cast("array<double>")
    odd = F.exists("c", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", c.alias("c")).where("c IS NOT NULL AND size(c) > 0").where(~odd)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number``, gapless from 0; ``rows`` is a stored table with the ``mark`` of its rows when it was written.

    The high bits of a mark are the number of the partition that wrote the row, the low ones the place in it. One row
    per partition carries the offset.
    """
    part = F.shiftrightunsigned(F.col("mark"), 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = F.col("mark").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("number", (F.col("offset") + inside).cast("int")).drop("part", "offset", "mark")


def centred_blocks(kept: DataFrame, sums: list[int], n: int, block: int) -> DataFrame:
    """(vec_id, x) -> ids, deviations, y: blocks of ``block`` rows made where the rows are.

    y holds the rows (n * x - S) / n one after the other, the numerator exact; a block that is not full ends in
    zero rows, which add nothing to a scatter matrix and are passed over when rows are read back.
    """
    dims, total = len(sums), np.array(sums, dtype=np.int64)
    kind = dict(kept.dtypes)["vec_id"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, have = [], [], 0

        def put() -> pa.RecordBatch:
            over = np.concatenate(held)
            if len(over) and float(np.abs(over).max()) ** 2 * dims >= 2**63:
                raise OverflowError("deviations do not fit 64 bits")
            y = np.zeros((block, dims))
            y[: len(over)] = over / n
            columns = [_one_list(pa.concat_arrays(ids)), _one_list(pa.array((over * over).sum(axis=1))), pa.array([y.tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "deviations", "y"])

        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, dims)
            at = 0
            while at < len(x):
                take = min(block - have, len(x) - at)
                if float(np.abs(x[at : at + take]).max()) * n >= 2**62:
                    raise OverflowError("centred entries do not fit 64 bits")
                held.append(x[at : at + take] * n - total)
                ids.append(batch.column("vec_id").slice(at, take))
                at, have = at + take, have + take
                if have == block:
                    yield put()
                    ids, held, have = [], [], 0
        if have:
            yield put()

    return kept.select("vec_id", "x").mapInArrow(made, f"ids array<{kind}>, deviations array<bigint>, y binary")


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def block_matrix(blocks: DataFrame, values: str, dims: int, block: int, count: int, shift: np.ndarray | None = None) -> BlockMatrix:
    """(number, bytes of rows, rows) -> the distributed matrix of these blocks; ``shift`` is taken from each of the first ``rows`` rows."""

    def matrix(r) -> tuple[tuple[int, int], DenseMatrix]:
        y = np.frombuffer(r[1]).reshape(block, dims)
        if shift is not None:
            y = np.where(np.arange(block)[:, None] < r[2], y - shift, 0.0)
        return (r[0], 0), DenseMatrix(block, dims, y.ravel(), isTransposed=True)

    return BlockMatrix(blocks.select("number", values, "rows").rdd.map(matrix), block, dims, count * block, dims)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Sum of the outer products of the rows: the transpose times the matrix, summed up by as many tasks as there are partitions.

    All products belong to one block of the result. Splitting the middle dimension, which the wrapper's own multiply
    does not offer, lets each task sum up its share of the blocks of rows before the shares meet.
    """
    java = matrix._java_matrix_wrapper
    splits = max(1, min(matrix.numRowBlocks, partitions(_session())))
    out = matrix.transpose()._java_matrix_wrapper.call("multiply", java._java_model, splits)
    s = BlockMatrix(out, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return (s + s.T) / 2


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest on and unit eigenvectors as columns; those that rounding alone makes positive are left out."""
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, int((e > max(e[0], 0) * len(e) * 1e-14).sum())) if len(e) else 0
    return e[:k], q[:, :k]


def whitened(vectors: DataFrame, p: Whitening = Whitening()) -> DataFrame:
    """(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error.

    The vectors left by ``usable`` become whole numbers x; n and the sums S per dimension are exact. Rows centred as
    (n * x - S) / n go into a block matrix in which a block's place is its index and its ids lie beside it; its transpose times itself over n is the covariance, whose
    eigenvectors, over the root of the eigenvalues, are multiplied on from the right. The whitened rows are centred
    and transpose-multiplied in the same way for identity_error. To the driver go only sums and matrices of dimension
    by dimension.

    Components whose eigenvalue is nothing but rounding are left out, so one vector, or equal vectors only, give no
    rows; so does an empty table. Null vec_ids and repeated ones are rows of their own. Empty vectors are dropped like
    null ones, and so are vectors of another length than the commonest (of several the longest), which have no place in
    a matrix. Entries or deviations beyond 64 bits are errors. Other columns are not read.
    """
    spark = vectors.sparkSession
    marked = stored(usable(vectors).withColumn("dims", F.size("c")), "vectors")
    common = marked.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    schema = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    none = spark.createDataFrame([], schema.format(dict(vectors.dtypes)["vec_id"]))
    if common is None:
        return none
    dims, n = common["dims"], common["n"]
    x = F.transform("c", lambda c: F.floor(c * p.scale) + p.shift)
    kept = stored(marked.where(F.col("dims") == dims).select("vec_id", x.alias("x")), "whole")
    sums = list(kept.agg(*[F.sum(F.get("x", F.lit(d))).alias(f"s{d}") for d in range(dims)]).first())
    blocks = stored(centred_blocks(kept, sums, n, p.block).withColumn("mark", F.monotonically_increasing_id()), "blocks")
    blocks = numbered(blocks.withColumn("rows", F.size("ids")))
    count = blocks.count()
    matrix = block_matrix(blocks, "y", dims, p.block, count)
    v = scatter(matrix) / n
    e, q = principal(v, p.most)
    k = len(e)
    if not k:
        return none
    w = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, k, (q / np.sqrt(e)).flatten("F")))], 1), dims, k)
    products = matrix.multiply(w).blocks.map(lambda b: (b[0][0], bytearray(np.ascontiguousarray(b[1].toArray()).tobytes())))
    z = spark.createDataFrame(products, "number int, z binary")
    z = stored(z.join(blocks.select("number", "rows", "ids", "deviations"), "number"), "projected")

    def block_sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for rows, own in zip(part["rows"], part["z"]):
                yield pd.DataFrame({"k": np.arange(k), "total": np.frombuffer(own).reshape(p.block, k)[:rows].sum(axis=0)})

    totals = z.select("rows", "z").mapInPandas(block_sums, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).orderBy("k")
    means = np.array([r["total"] for r in totals.collect()]) / n  # k numbers
    error = float(np.abs(scatter(block_matrix(z, "z", k, p.block, count, means)) / n - np.eye(k)).max())
    share, size, names = e / np.trace(v), p.block, none.columns

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, deviations, own in zip(*[batch.column(c) for c in ("rows", "ids", "deviations", "z")]):
                m = rows.as_py()
                columns = [
                    ids.values.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(deviations.values.to_numpy(), k)),
                    pa.array(np.frombuffer(own.as_py()).reshape(size, k)[:m].ravel()),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return z.select("rows", "ids", "deviations", "z").mapInArrow(opened, none.schema)
