"""Exact top-k by inner product: columnar branch and bound over blocks of vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block of candidates and of a block of queries, and blocks of a group of each.
BLOCK, QUERY_BLOCK, GROUP_BLOCKS, QUERY_GROUP_BLOCKS = 2048, 256, 16, 256
#: Dimensions added up before candidates are dropped.
STEP = 16
#: What a long holds.
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1

PACKED = "id_block binary, vectors binary, dims int, n int"


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` vectors in vertical layout: all first components, all second, ...

    A component x becomes floor(256 x). Vectors that are null or empty of meaning (a null
    or non-finite component) and rows without an id take no part. Shorter vectors of a
    block are filled up with zeros. A block holds 32-bit numbers, or doubles where one
    doesn't fit them.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: list, vectors: list) -> pa.RecordBatch:
            dims = max(len(v) for v in vectors)
            largest = max((np.abs(v).max() for v in vectors if len(v)), default=0)
            table = np.zeros((dims, len(vectors)), np.int32 if largest < 2**31 else np.float64)
            for k, v in enumerate(vectors):
                table[: len(v), k] = v
            values = [np.array(ids, np.int64).tobytes(), table.tobytes(), dims, len(ids)]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, (pa.binary(), pa.binary(), pa.int32(), pa.int32()))], ["id_block", "vectors", "dims", "n"])

        ids: list = []
        vectors: list = []
        for batch in batches:
            column = batch.column("embedding")
            flat, off = column.values, column.offsets.to_numpy().astype(np.int64)
            valid = pc.is_valid(flat).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
            x = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
            good = np.concatenate(([0], np.cumsum(~(valid & np.isfinite(x)))))
            whole = np.floor(np.where(np.isfinite(x), x, 0) * 256) + 0.0
            for k, (i, present) in enumerate(zip(batch.column("vec_id").to_pylist(), column.is_valid().to_pylist())):
                a, b = off[k], off[k + 1]
                if i is not None and present and good[a] == good[b]:
                    ids.append(i)
                    vectors.append(whole[a:b])
                    if len(ids) == size:
                        yield block(ids, vectors)
                        ids, vectors = [], []
        if ids:
            yield block(ids, vectors)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(of, PACKED)


class Block:
    def __init__(self, ids: bytes, vectors: bytes, dims: int, n: int):
        self.ids = np.frombuffer(ids, np.int64)
        kind = np.int32 if len(vectors) == 4 * dims * n else np.float64
        self.table = np.frombuffer(vectors, kind).reshape(dims, n).astype(np.float64)
        self.dims, self.n = dims, n
        squares = np.vstack((self.table**2, np.zeros((1, n))))
        #: Length of what a vector has left from each dimension on.
        self.rest = np.sqrt(squares[::-1].cumsum(axis=0)[::-1])
        self.largest = float(np.abs(self.table).max()) if self.table.size else 0.0


def best(q: Block, c: Block, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query that has some: its best ``k`` of the block, by falling score, rising id.

    ``floor``: of each query a score that k known candidates reach; only those below it are
    dropped, so ties stay. Dimensions are added in steps; after each, a candidate goes if
    even its remaining length (by Cauchy and Schwarz) can't lift it to the floor. Scores are
    exact: longs where doubles don't hold them, Python's numbers where longs don't either.
    """
    dims = min(q.dims, c.dims)
    most = q.largest * c.largest * max(1, dims)
    exact, wide = most < 2.0**52, most >= 2.0**62
    sums = np.zeros((q.n, c.n))
    live = np.ones((q.n, c.n), bool)
    live &= q.ids[:, None] != c.ids[None, :]
    columns, at = np.arange(c.n), 0
    whole = c.table
    while at < dims:
        stop = min(dims, at + STEP)
        sums += q.table[at:stop].T @ whole[at:stop]
        at = stop
        if at < dims and len(columns):
            slack = 1 + 1e-9 * np.abs(floor[:, None])
            if not exact:  # what rounding may have taken from the sums
                slack = slack + dims * 2.0**-50 * q.rest[0][:, None] * c.rest[0][columns][None, :]
            bound = sums + q.rest[at][:, None] * c.rest[at][columns][None, :] + slack
            live &= bound >= floor[:, None]
            keep = live.any(axis=0)
            if keep.mean() < 0.7:  # compact what survives
                columns, sums, live, whole = columns[keep], sums[:, keep], live[:, keep], whole[:, keep]
    if wide:
        whole_numbers = np.vectorize(int, otypes=[object])
        others = whole_numbers(whole[:dims])
        for i in range(q.n):
            at = np.flatnonzero(live[i])
            if len(at):
                score = whole_numbers(q.table[:dims, i]) @ others[:, at]
                top = sorted(zip(score.tolist(), c.ids[columns[at]].tolist()), key=lambda x: (-x[0], x[1]))[:k]
                yield i, np.array([v for _, v in top]), np.array([s for s, _ in top], object)
        return
    if not exact:  # beyond what doubles hold, add in whole numbers
        sums = q.table[:dims].T.astype(np.int64) @ whole[:dims].astype(np.int64)
    for i in range(q.n):
        rows = np.flatnonzero(live[i] & (sums[i] >= floor[i]))
        if len(rows):
            ids, score = c.ids[columns[rows]], sums[i, rows].astype(np.int64)
            if len(rows) > k:  # all that tie with the k-th, then by id
                least = np.partition(score, len(score) - k)[len(score) - k]
                near = score >= least
                ids, score = ids[near], score[near]
            order = np.lexsort((ids, -score))[:k]
            yield i, ids[order], score[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of every query.

    Both have ``vec_id`` and ``embedding``. Score: the integer inner product; ties go to
    the smaller vec_id; a candidate with the query's vec_id is its own row and left out.
    Queries with one vec_id and different vectors are asked each; equal ones once. A
    candidate row that is there twice counts twice. An empty side gives no rows. A score
    that a long can't hold is ranked by its exact value and shown as the nearest long.

    Both sides are packed into blocks and dealt to groups: about 16 blocks of candidates,
    about 256 of queries. Each two groups meet once (a join on their numbers, whose rows are
    blocks), so neither the rows of a key nor the work of a task grows with the input. A
    task holds two blocks and passes its floor on from block to block of a group. Only the
    best k of each query and group are shuffled again.
    """
    blocks = packed(candidates, BLOCK)
    n_groups = max(1, candidates.count() // (BLOCK * GROUP_BLOCKS))
    n_asking = max(1, queries.count() // (QUERY_BLOCK * QUERY_GROUP_BLOCKS))
    asked = packed(queries.dropDuplicates(["vec_id", "embedding"]).coalesce(max(1, n_groups)), QUERY_BLOCK)
    dealt = lambda n: F.pmod(F.xxhash64("id_block", "vectors"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select(
        *[F.col(c).alias(f"q_{c}") for c in ("id_block", "vectors", "dims", "n")],
        every(n_groups).alias("group"), dealt(n_asking).alias("asking"),
    )
    pairs = asked.join(blocks.select("*", dealt(n_groups).alias("group"), every(n_asking).alias("asking")), ["group", "asking"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, q, found, floor, key = None, None, [], np.zeros(0), []

        def results() -> pa.RecordBatch:
            held = lambda s: min(max(s, LEAST_LONG), MOST_LONG)
            # numbers as text of one length that sorts like them
            beyond = lambda s: f"{10**100 + s:0102d}" if abs(s) >= MOST_LONG else None
            rows = [(int(q.ids[i]), int(v), held(int(s)), key[i], beyond(int(s))) for i, f in enumerate(found) for s, v in f]
            kinds = (*(pa.int64(),) * 4, pa.string())
            return pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["query_id", "vec_id", "score", "ask", "beyond"])

        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                if (row["q_id_block"], row["q_vectors"]) != name:
                    if q is not None:
                        yield results()
                    name = (row["q_id_block"], row["q_vectors"])
                    q = Block(row["q_id_block"], row["q_vectors"], row["q_dims"], row["q_n"])
                    found, floor = [[] for _ in range(q.n)], np.full(q.n, -np.inf)
                    key = [zlib.crc32(q.table[:, i].tobytes().rstrip(b"\0")) for i in range(q.n)]
                c = Block(row["id_block"], row["vectors"], row["dims"], row["n"])
                for i, ids, score in best(q, c, k, floor):
                    found[i] = sorted([*found[i], *zip(score.tolist(), ids.tolist())], key=lambda x: (-x[0], x[1]))[:k]
                    if len(found[i]) == k:
                        floor[i] = found[i][-1][0]
        if q is not None:
            yield results()

    some = pairs.mapInArrow(of, "query_id long, vec_id long, score long, ask long, beyond string")
    rank = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return some.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The best ``k`` of all rows for each row whose vec_id is divisible by 50."""
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k)
