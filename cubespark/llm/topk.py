"""Exact top-k inner products with a bit-sliced index.

Components are floor(256 x). Vectors lie in blocks of rows; of each block and dimension the
values above the block's least are kept as bit slices: bitmap i holds bit i of every row. A
query is added up slice by slice: each set bit of a query's component adds the dimension's
slices at that weight, with carries as bitmap arithmetic (negative components add the
complement). What comes out is a bit-sliced sum for all rows at once. The best k are taken
from the most significant slice downward: rows that stay in either are surely among the best
or tied so far; rows tied at the end are resolved by their id. Each block gives at most k
rows per query, and these are ranked once more.

Queries are a stated subset of the rows, in blocks too; each pair of blocks is one unit of
work, so no task holds all queries or all rows.

Vectors that are null, empty or hold null or non-finite components take no part, neither do
null ids. Vectors meet only those of their own length. Repeated ids are rows of their own;
a query skips every row of its id. Scores must fit a 64-bit integer; larger components
raise an error. A table without vectors or without queries gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubespark.llm.steps import Steps

ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 128
LARGEST = 1 << 24  # of a component, so that sums of products stay exact


def quantised(df: DataFrame, id_column: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(id, v) with integer components of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).where((F.size(vector) > 0) & finite)
    return rows.select(
        F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


def slices(values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least value and bitmaps (bit, words of 64 rows) of each dimension of rows x dimensions."""
    least = values.min(0)
    above = (values - least).astype(np.uint64)
    out = []
    for d in range(values.shape[1]):
        bits = int(above[:, d].max()).bit_length()
        planes = [np.packbits((above[:, d] >> np.uint64(i)) & np.uint64(1) != 0, bitorder="little") for i in range(bits)]
        out.append(np.array([_words(p, len(values)) for p in planes], np.uint64).reshape(bits, -(-len(values) // 64)))
    return least, out


def _words(packed: np.ndarray, rows: int) -> np.ndarray:
    padded = np.zeros(-(-rows // 64) * 8, np.uint8)
    padded[: len(packed)] = packed
    return padded.view(np.uint64)


def add_up(query: np.ndarray, planes: list[np.ndarray], words: int) -> list[np.ndarray]:
    """Bit slices, lowest first, of the query's products with all rows, up to a constant of the query."""
    columns: list[list[np.ndarray]] = []
    for q, dimension in zip(query.tolist(), planes):
        negative, q = q < 0, abs(q)
        own = ~dimension if negative else dimension
        for shift in range(q.bit_length()):
            if q >> shift & 1:
                while len(columns) < shift + len(own):
                    columns.append([])
                for i, plane in enumerate(own):
                    columns[shift + i].append(plane)
    sums, weight = [], 0
    while weight < len(columns):
        column = columns[weight]
        if len(column) > 1 and weight + 1 == len(columns):
            columns.append([])
        # three bitmaps of one weight become a sum and a carry
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            ab = a ^ b
            column.insert(0, ab ^ c)
            columns[weight + 1].append((a & b) | (ab & c))
        if len(column) == 2:
            a, b = column
            columns[weight + 1].append(a & b)
            column = [a ^ b]
        sums.append(column[0] if column else np.zeros(words, np.uint64))
        weight += 1
    return sums


def best(sums: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps of rows that are surely among the k best and of rows tied at the boundary, and how many of those to take."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    taken = 0
    if int(np.bitwise_count(tied).sum()) <= k:
        return tied, sure, 0
    for plane in reversed(sums):
        top = tied & plane
        n = taken + int(np.bitwise_count(top).sum())
        if n > k:
            tied = top
        else:
            sure |= top
            taken = n
            tied &= ~plane
            if n == k:
                return sure, np.zeros_like(tied), 0
    return sure, tied, k - taken


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Index:
    """Bit slices of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        if np.abs(values).max() > LARGEST:
            raise ValueError("a component is too large for exact scores")
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.least, self.planes = slices(self.values)
        self.all = _words(np.packbits(np.ones(len(ids), bool), bitorder="little"), len(ids))

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to the smaller id."""
        allowed = self.all.copy()
        for row in range(*np.searchsorted(self.ids, [query_id, query_id + 1])):
            allowed[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        sure, tied, more = best(add_up(query, self.planes, len(allowed)), allowed, k)
        rows = np.concatenate([_rows_of(sure), _rows_of(tied)[:more]]) if more else _rows_of(sure)
        return self.ids[rows], self.values[rows] @ query


def _pair_rows(k: int):
    """Rows come block pair by block pair: first the block's vectors, then the queries'."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, values, query_ids, queries in zip(*(batch.column(n) for n in ("ids", "values", "query_ids", "queries"))):
                ids, query_ids = _flat(ids), _flat(query_ids)
                index = Index(ids, _flat(values).reshape(len(ids), -1))
                found = [
                    (np.full(len(i), q), i, s)
                    for q, v in zip(query_ids, _flat(queries).reshape(len(query_ids), -1))
                    for i, s in [index.search(int(q), v, k)]
                ]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=schema)

    return run


def _flat(values: pa.ListScalar) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(rows: DataFrame, per_block: int, ids: str, values: str) -> DataFrame:
    """(dim, block, ids, values): rows of one length in blocks of bounded size, by a hash of their id."""
    n = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))  # one row per length
    of = F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / per_block)).alias("block")
    return (
        rows.withColumn("dim", F.size("v"))
        .join(n, "dim")
        .select("dim", of, "id", "v")
        .groupBy("dim", "block")
        .agg(F.collect_list(F.struct("id", "v")).alias("rows"))
        .select("dim", "block", F.col("rows.id").alias(ids), F.flatten("rows.v").alias(values))
    )


def top_k(df: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest score of each query, its own id aside."""
    steps = Steps(df.sparkSession)
    candidates = steps.kept(_blocks(quantised(df, id_column, vector), ROWS_PER_BLOCK, "ids", "values"), "row-blocks")
    asked = steps.kept(_blocks(quantised(queries, id_column, vector), QUERIES_PER_BLOCK, "query_ids", "queries"), "query-blocks")
    # every block of queries meets every block of rows: the stated query set against all rows
    pairs = asked.withColumnRenamed("block", "query_block").join(candidates, "dim")
    pairs = pairs.repartition("block", "query_block").select("ids", "values", "query_ids", "queries")
    found = pairs.mapInArrow(_pair_rows(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as query_id, b.vec_id,
    cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q))
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
