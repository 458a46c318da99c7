"""Approximate nearest neighbours by cross-polytope hashing.

A fast Hadamard pseudo-rotation turns each vector; its nearest signed axis is its bucket in that table. A query probes its
nearest axes of every table, and what it finds is ranked by the exact inner product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowassay.session import materialize

TABLES = 8
#: Rows that one task compares with its queries at once; a fuller bucket is salted into blocks of about this size.
BLOCK = 20_000
#: Queries that the number of probes is fitted on, and the share of their true neighbours it must find.
SAMPLE, TARGET = 64, 0.97


class Rotations:
    """``TABLES`` rotations of vectors with ``dim`` components, lifted to equal norms if ``norm`` is given.

    With x' = (x, sqrt(norm² - |x|²)) and q' = (q, 0), the angle between q' and x' orders rows by inner product.
    """

    def __init__(self, dim: int, norm: float | None, tables: int = TABLES, seed: int = 20):
        self.norm, self.tables = norm, tables
        self.size = 1 << (dim + (norm is not None) - 1).bit_length() if dim + (norm is not None) > 1 else 2
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size)).astype(np.float32)

    def axes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """How near each row is to each signed axis: (tables, rows, 2 * size)."""
        lifted = np.zeros((len(x), self.size), np.float32)
        lifted[:, : x.shape[1]] = x
        if self.norm is not None and not query:
            lifted[:, x.shape[1]] = np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))
        out = []
        for signs in self.signs:
            y = lifted
            for s in signs:
                y, step = y * s, 1
                while step < self.size:
                    y = y.reshape(len(x), -1, 2, step)
                    y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), -1)
                    step *= 2
            out.append(np.concatenate([y, -y], axis=1))
        return np.stack(out)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(q_ids, q, r_ids, r, k):
    """Of each query, the k rows with the largest inner product, ties to the smaller id, itself never: parallel arrays.

    A matrix product finds the rows to look at; the score is then summed component by component in a fixed order, so a pair
    has the same score wherever it is met.
    """
    found = []
    for a in range(0, len(q), 256):
        own = q[a : a + 256]
        near = own @ r.T
        near[q_ids[a : a + 256, None] == r_ids] = -np.inf
        if len(r) > k:
            least = np.partition(near, len(r) - k, axis=1)[:, len(r) - k]
            slack = 1e-9 * (1 + np.abs(least))
            row, col = np.nonzero((near >= (least - slack)[:, None]) & (near > -np.inf))
        else:
            row, col = np.nonzero(near > -np.inf)
        score = (own[row] * r[col]).sum(axis=1)
        order = np.lexsort((r_ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((q_ids[a + row[keep]], r_ids[col[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Ids and vectors (arrays of double) that take part: not null, not zero, no null or non-finite component, and as long
    as most vectors are."""
    v = F.col("vector")
    sound = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = sound.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    dim = sound.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    return sound.filter(F.size(v) == (dim["dim"] if dim else 0))


def search(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """The ``k`` nearest rows of each query row by inner product: query_id, rank (from 1), ``id_col``, score.

    ``is_query`` is a condition on ``id_col``. Candidates are all rows but the query's own; all are indexed, and a query has
    fewer than k results only if there are fewer rows. How many axes a query probes is fitted on ``SAMPLE`` queries against
    all rows, so that ``TARGET`` of their true neighbours are found; queries that come back short probe twice as many, in the
    end all. Vectors that are null, zero, of an odd length or hold a
    null or non-finite component take no part; of equal vectors the k + 1 smallest ids suffice as candidates. Ties go to the
    smaller id. An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    every = materialize(usable(df, id_col, vector_col), "vectors")
    sums = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    stats = every.agg(F.max(F.size("vector")).alias("dim"), F.sqrt(F.max(sums)).alias("most"), F.sqrt(F.min(sums)).alias("least")).head()
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    if stats["dim"] is None:
        return spark.createDataFrame([], schema)
    rotations = Rotations(stats["dim"], stats["most"] if stats["most"] - stats["least"] > 1e-5 * stats["most"] else None)
    # equal vectors: the first k + 1 ids hold every result
    same = Window.partitionBy("vector").orderBy("id")
    rows = every.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).select("id", "vector")
    queries = every.withColumnRenamed("id", id_col).filter(is_query).withColumnRenamed(id_col, "id")
    probes = _fit_probes(rows, queries, rotations, k)

    def spread(query: bool, each: int):
        def run(batches):
            for batch in batches:
                x = _matrix(batch.column(1)) if len(batch) else np.zeros((0, stats["dim"]))
                for a in range(0, len(x), 512):
                    near = rotations.axes(x[a : a + 512].astype(np.float32), query)
                    # all axes of one table hold every row
                    axis = np.argpartition(-near, each - 1, axis=2)[:, :, :each] if each < near.shape[2] else np.broadcast_to(np.arange(near.shape[2]), near[:1].shape)
                    bucket = (axis + np.arange(len(axis))[:, None, None] * near.shape[2]).transpose(1, 0, 2).reshape(near.shape[1], -1)
                    part = batch.slice(a, 512)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bucket.size + 1, bucket.shape[1], dtype=np.int32)), pa.array(bucket.astype(np.int32).ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "vector", "buckets"])

        return lambda x: x.mapInArrow(run, "id long, vector array<double>, buckets array<int>").select("id", "vector", F.explode("buckets").alias("bucket"))

    placed = rows.transform(spread(False, 1))
    # the bucket sizes are a small table: tables times axes
    blocks = placed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    salted = placed.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            q, r, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            vectors = [_matrix(t["vector"].combine_chunks()) for t in (asked, held)]
            q, r, s = _nearest(asked["id"].to_numpy(), vectors[0], held["id"].to_numpy(), vectors[1], k)
        return pa.table({"query_id": q, id_col: r, "score": s})

    keys = ["bucket", "block"]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)

    def probe(queries: DataFrame, each: int) -> DataFrame:
        asked = queries.transform(spread(True, each)).join(blocks, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = asked.select(*keys, "id", "vector").groupBy(*keys).cogroup(salted.select(*keys, "id", "vector").groupBy(*keys)).applyInArrow(compare, f"query_id long, `{id_col}` long, score double")
        ranked = found.dropDuplicates(["query_id", id_col]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return ranked.select("query_id", "rank", id_col, "score")

    found = materialize(probe(queries, probes), "found")
    full = min(k, rows.select("id").distinct().limit(k + 1).count() - 1)
    while probes < 2 * rotations.size:
        counts = found.groupBy("query_id").count()
        short = materialize(queries.join(counts, F.col("id") == F.col("query_id"), "left").filter(F.coalesce("count", F.lit(0)) < full).select("id", "vector"), "short")
        if short.isEmpty():
            break
        probes = min(2 * probes, 2 * rotations.size)
        found = materialize(found.join(short, F.col("query_id") == F.col("id"), "left_anti").union(probe(short, probes)), "found")
    return found


def _fit_probes(rows: DataFrame, queries: DataFrame, rotations: Rotations, k: int) -> int:
    """The fewest axes of each table that find ``TARGET`` of the true neighbours of a bounded sample of distinct queries."""
    sample = queries.groupBy("vector").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if sample.empty:
        return 1
    q_ids, q = sample["id"].to_numpy(), np.stack(sample["vector"].to_numpy())
    near = rotations.axes(q.astype(np.float32), True)
    order = np.argsort(-near, axis=2)
    turn = np.empty_like(order)  # turn[t, query, axis]: when the query gets to the axis
    np.put_along_axis(turn, order, np.broadcast_to(np.arange(near.shape[2]), near.shape), axis=2)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            r_ids, r = batch.column(0).to_numpy(), _matrix(batch.column(1))
            i, j, score = _nearest(q_ids, q, r_ids, r, k)
            place, other = np.searchsorted(np.sort(q_ids), i), np.searchsorted(np.sort(r_ids), j)
            place, other = np.argsort(q_ids)[place], np.argsort(r_ids)[other]
            axis = np.concatenate([rotations.axes(r[a : a + 512].astype(np.float32), False).argmax(axis=2) for a in range(0, len(r), 512)], axis=1)
            first = turn[np.arange(rotations.tables)[:, None], place, axis[:, other]].min(axis=0)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"q": i, "r": j, "score": score, "turn": first.astype(np.int32)}), preserve_index=False)

    best = Window.partitionBy("q").orderBy(F.desc("score"), "r")
    true = rows.mapInArrow(run, "q long, r long, score double, turn int").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    turns = {r["turn"]: r["count"] for r in true.groupBy("turn").count().collect()}  # as many as there are axes
    need, seen = TARGET * sum(turns.values()), 0
    for turn_ in sorted(turns):
        seen += turns[turn_]
        if seen >= need:
            return turn_ + 1
    return 1
