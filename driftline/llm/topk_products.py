"""Exact top-k inner products by buckets of equal length.

Vectors are stored by falling length and searched bucket by bucket. With a lower bound theta of a
query's k-th score, a vector p of a bucket whose longest has length l can only matter if the cosine
of p and q is theta / (|q| l) or more: the bucket's local threshold. Above 1 the bucket is left out;
a high one prunes by coordinates, since each coordinate of the direction of p then lies in an
interval around that of q; a low one prunes by length alone, so that a prefix of the bucket is left.
What is left is verified by its product.

The bound starts from the longest vectors and tightens over strata of the table, each GROWTH times
the one before, so that a query meets few vectors that it has to hand on, however many there are.
Queries go in blocks of bounded size, and equal vectors are searched, and searched for, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftline.llm.common import cut, new_path, shuffle_partitions

#: Components of all queries of a block, at eight bytes each; vectors that give the first bounds; growth of strata.
BLOCK, HEAD, GROWTH = 2_000_000, 4096, 16
#: A bucket has so many vectors at most, none shorter than this part of its longest.
ROWS, RATIO = 1024, 0.9
#: Local thresholds from which coordinates are tried, coordinates looked at, and what part of a bucket they may leave.
COSINE, FOCUS, LEFT = 0.7, 4, 0.125
SLACK = 1e-9
#: Scores of so many pairs are held at once.
PAIRS = 1 << 20


def scaled(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, vector) of the rows that take part: floor(scale * x) of each component.

    Null vectors and those with a null or non-finite component take no part.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return embeddings.filter(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def laid_out(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with the `keep` smallest of their ids (nulls last), length, and place, in files by falling length.

    No vector needs more ids than that, so those of one with very many rows are dropped before any shuffle.
    """
    order = Window.partitionBy("vector").orderBy(F.asc_nulls_last("vec_id"))
    few = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= keep)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("nth", "vec_id"))), lambda x: x.vec_id)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    made = few.groupBy("vector").agg(ids.alias("ids")).withColumns({"dim": F.size("vector"), "norm": norm})
    parts = shuffle_partitions(rows.sparkSession)
    placed = made.repartitionByRange(parts, F.desc("norm"), F.xxhash64("vector")).sortWithinPartitions("dim", F.desc("norm"))
    return cut(placed.withColumn("place", F.spark_partition_id()))


class Vectors:
    """Rows of one dimension as a matrix: float64 while all products are exact in it, else int64."""

    def __init__(self, column: pa.ListArray, norm: np.ndarray):
        n = len(column)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        self.whole, self.norm = flat.reshape(n, len(flat) // n if n else 0), norm
        self.float = self.whole.astype(np.float64)

    def take(self, rows) -> Vectors:
        part = object.__new__(Vectors)
        part.whole, part.float, part.norm = self.whole[rows], self.float[rows], self.norm[rows]
        return part


def products(q: Vectors, p: Vectors) -> np.ndarray:
    """All inner products, exact; an error where one might not fit in 64 bits."""
    bound = q.norm.max(initial=0) * p.norm.max(initial=0)
    if bound < 2**52:
        return (q.float @ p.float.T).astype(np.int64)
    if bound < 2**62:
        return q.whole @ p.whole.T
    raise ValueError("an inner product of these vectors may not fit in 64 bits")


class Best:
    """The `keep` best rows of each query: by score, then id (nulls last)."""

    def __init__(self, theta: np.ndarray, keep: int):
        self.theta, self.keep, self.waiting = theta.copy(), keep, 0
        self.parts: list[tuple] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),) * 2]

    def add(self, query: np.ndarray, score: np.ndarray, same: np.ndarray, ids: pa.ListArray) -> None:
        """Hits of queries; each stands for as many rows as it has ids."""
        count = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = ids.flatten()
        missing = flat.is_null().to_numpy(zero_copy_only=False)
        number = flat.fill_null(0).to_numpy(zero_copy_only=False)
        self.parts.append((*(np.repeat(x, count) for x in (query, score)), number, missing, np.repeat(same, count)))
        self.waiting += len(number)
        if self.waiting > max(self.keep * len(self.theta), PAIRS):
            self.settle()

    def settle(self) -> tuple:
        query, score, number, missing, same = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((number, missing, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        top = order[rank < self.keep]
        self.parts = [(query[rank < self.keep], score[top], number[top], missing[top], same[top])]
        full = rank == self.keep - 1
        self.theta[query[full]] = np.maximum(self.theta[query[full]], score[order[full]])
        self.waiting = 0
        return self.parts[0]


def buckets(norm: np.ndarray) -> Iterator[slice]:
    """Stretches of falling lengths: ROWS at most, none shorter than RATIO of the first."""
    start = 0
    while start < len(norm):
        stop = min(len(norm), start + ROWS)
        stop = start + max(1, int(np.searchsorted(-norm[start:stop], -norm[start] * RATIO, side="right")))
        yield slice(start, stop)
        start = stop


def by_coordinates(q: Vectors, t: np.ndarray, p: Vectors) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which queries, of local thresholds t, coordinates prune enough, and for each of those the rows that are left.

    The direction of a row within arccos(t) of that of q has coordinate f within the interval of
    cosines of the angle to axis f, give or take arccos(t).
    """
    ways = p.float / np.maximum(p.norm, 1e-300)[:, None]
    rank = np.argsort(ways, axis=0)
    ordered = np.take_along_axis(ways, rank, axis=0)
    aim = q.float / q.norm[:, None]
    focus = np.argsort(-np.abs(aim), axis=1)[:, :FOCUS]
    c = np.take_along_axis(aim, focus, axis=1)
    half = np.sqrt(np.maximum(0, (1 - t[:, None] ** 2) * (1 - c**2)))
    low = np.where(c <= -t[:, None], -1.0, c * t[:, None] - half) - SLACK
    high = np.where(c >= t[:, None], 1.0, c * t[:, None] + half) + SLACK
    begin, end = np.zeros(c.shape, np.int64), np.zeros(c.shape, np.int64)
    for f in np.unique(focus):
        at = focus == f
        begin[at] = np.searchsorted(ordered[:, f], low[at], side="left")
        end[at] = np.searchsorted(ordered[:, f], high[at], side="right")
    shortest = np.argmin(end - begin, axis=1)
    rows = np.arange(len(c))
    chosen = (end - begin)[rows, shortest] <= LEFT * len(p.norm)
    left = []
    for k in np.flatnonzero(chosen):
        s = shortest[k]
        found = rank[begin[k, s] : end[k, s], focus[k, s]]
        for x in range(c.shape[1]):
            if x != s:
                found = found[(ways[found, focus[k, x]] >= low[k, x]) & (ways[found, focus[k, x]] <= high[k, x])]
        left.append(found)
    return chosen, left


def probe(q: Vectors, best: Best, p: Vectors, ids: pa.ListArray) -> None:
    """One bucket, rows by falling length, against all queries."""

    def verified(query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        same = score == (q.float[query] ** 2).sum(axis=1)
        at = np.flatnonzero(same)
        same[at] = (q.whole[query[at]] == p.whole[row[at]]).all(axis=1)
        best.add(query, score, same, ids.take(pa.array(row)))

    theta, longest = best.theta, p.norm[0]
    scale = q.norm * longest
    positive = (theta > 0) & (scale > 0)
    t = np.where(positive, theta / np.where(scale > 0, scale, 1), np.where(theta > 0, 2.0, -1.0))
    alive = np.flatnonzero(t <= 1 + SLACK)
    high = alive[t[alive] >= COSINE]
    if len(high):
        chosen, left = by_coordinates(q.take(high), np.minimum(t[high], 1.0), p)
        for k, rows in zip(high[chosen], left):
            if len(rows):
                score = products(q.take(slice(k, k + 1)), p.take(rows))[0]
                hit = score >= theta[k]
                verified(np.full(hit.sum(), k), rows[hit], score[hit])
        alive = np.setdiff1d(alive, high[chosen], assume_unique=True)
    need = np.where(positive[alive], theta[alive] / np.maximum(q.norm[alive], 1e-300), -np.inf) * (1 - SLACK)
    prefix = np.searchsorted(-p.norm, -need, side="right")
    order = np.argsort(prefix)
    step = max(1, PAIRS // len(p.norm))
    for k in range(0, len(order), step):
        group = order[k : k + step]
        some, most = alive[group], int(prefix[group].max())
        score = products(q.take(some), p.take(slice(0, most)))
        a, b = np.nonzero(score >= theta[some][:, None])
        verified(some[a], b, score[a, b])


def start_bounds(queries: DataFrame, table: DataFrame, keep: int) -> DataFrame:
    """queries, distinct vectors, with dim, norm, theta (a bound that `keep` rows reach; null: none known), block and q.

    The bound comes from the HEAD longest vectors. Blocks have queries of one dimension that need about the same length.
    """
    spark = queries.sparkSession
    head = table.orderBy(F.desc("norm")).select("vector", "ids", "dim", "norm").limit(HEAD).toArrow()
    shared = spark.sparkContext.broadcast(head)
    schema = T.StructType([*queries.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("norm", T.DoubleType()), T.StructField("theta", T.LongType())])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for dim in set(shared.value.column("dim").to_pylist()):
            own = shared.value.filter(pa.array(np.equal(shared.value.column("dim").to_numpy(), dim))).combine_chunks()
            count = own.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            known[dim] = Vectors(own.column("vector").combine_chunks(), own.column("norm").to_numpy()), count
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                dims = piece.column("vector").value_lengths().to_numpy(zero_copy_only=False)
                norms, theta = np.zeros(len(dims)), np.full(len(dims), np.iinfo(np.int64).min)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    part = piece.column("vector").take(pa.array(at))
                    norms[at] = np.sqrt((part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim).astype(float) ** 2).sum(axis=1))
                    if dim in known:
                        vectors, count = known[dim]
                        score = products(Vectors(part, norms[at]), vectors)
                        order = np.argsort(-score, axis=1, kind="stable")
                        upto = np.cumsum(count[order], axis=1) >= keep
                        some = np.flatnonzero(upto[:, -1])
                        theta[at[some]] = score[some, order[some, upto[some].argmax(axis=1)]]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(dims, pa.int32()), pa.array(norms), pa.array(theta, mask=theta == np.iinfo(np.int64).min)], names=schema.names
                )

    bounded = cut(queries.mapInArrow(bound, schema))
    need = F.when((F.col("theta") > 0) & (F.col("norm") > 0), F.col("theta") / F.col("norm")).otherwise(F.lit(0.0))
    ordered = bounded.withColumn("need", need)
    size = bounded.agg(F.sum(F.greatest("dim", F.lit(1)))).first()[0] or 0
    ordered = ordered.repartitionByRange(max(1, size // BLOCK), "dim", "need", F.xxhash64("vector")).sortWithinPartitions("dim", "need")
    numbered = T.StructType([*ordered.schema.fields, T.StructField("block", T.LongType()), T.StructField("q", T.IntegerType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, used, now = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            start = 0
            while start < len(dims):
                most = max(1, BLOCK // max(1, int(dims[start])))
                if now != dims[start] or used >= most:
                    block, used, now = block + 1, 0, dims[start]
                stop = min(start + int(np.searchsorted(dims[start:], now, side="right")), start + most - used)
                places = [pa.array(np.full(stop - start, block)), pa.array(np.arange(used, used + stop - start), pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns, *places], names=numbered.names)
                used, start = used + stop - start, stop

    return cut(ordered.mapInArrow(number, numbered))


FOUND = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("q", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("same", T.BooleanType())]
)


def searched(table: DataFrame, block: pa.Table, theta: np.ndarray, keep: int) -> DataFrame:
    """(block, q, score, vec_id, same): of each task, the `keep` best rows of each query of `block` that reach its bound."""
    shared = table.sparkSession.sparkContext.broadcast((block, theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, theta = shared.value
        q = Vectors(block.column("vector").combine_chunks(), block.column("norm").to_numpy())
        best = Best(theta, keep)
        for batch in batches:
            norm = batch.column("norm").to_numpy()
            vectors, ids = Vectors(batch.column("vector"), norm), batch.column("ids")
            for rows in buckets(norm):
                probe(q, best, vectors.take(rows), ids.slice(rows.start, rows.stop - rows.start))
        query, score, number, missing, same = best.settle()
        place = [block.column(c).combine_chunks().take(pa.array(query)) for c in ("block", "q")]
        yield pa.RecordBatch.from_arrays([*place, pa.array(score), pa.array(number, mask=missing), pa.array(same)], names=FOUND.names)

    return table.select("vector", "ids", "norm").mapInArrow(run, FOUND)


def best_of(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= keep)


def strata(table: DataFrame) -> list[tuple[int, int]]:
    """Ranges (from, to) of places, each with about GROWTH times the vectors of all before it."""
    found, total, start, size = [], HEAD, 0, 0
    sizes = sorted(table.groupBy("place").count().collect())
    for place, n in sizes:
        size += n
        if size >= (GROWTH - 1) * total:
            found.append((start, place + 1))
            total, start, size = total + size, place + 1, 0
    if size:
        found.append((start, sizes[-1][0] + 1))
    return found


def together(bounds: DataFrame) -> list[tuple[int, int, int]]:
    """(dim, first block, last block): neighbouring blocks of one dimension that are searched at once, as partitions may leave small ones."""
    found, used = [], 0
    for block, dim, n in sorted(bounds.groupBy("block", "dim").count().collect()):
        size = n * max(1, dim)
        if found and found[-1][0] == dim and used + size <= BLOCK:
            found[-1], used = (dim, found[-1][1], block), used + size
        else:
            found.append((dim, block, block))
            used = size
    return found


def answers(queries: DataFrame, table: DataFrame, keep: int) -> DataFrame:
    """(vector, best): for each distinct query vector its `keep` best rows (score, vec_id, same), in order."""
    spark = queries.sparkSession
    bounds, ranges = start_bounds(queries, table, keep), strata(table)
    path = new_path(spark)
    kind = T.StructType([*FOUND.fields, T.StructField("nth", T.IntegerType())])
    spark.createDataFrame([], kind).write.parquet(path)
    for dim, low, high in together(bounds):
        own = bounds.filter(F.col("block").between(low, high)).select("block", "q", "vector", "norm", "theta", "need").toArrow()
        own = own.sort_by([("block", "ascending"), ("q", "ascending")])
        index = {p: n for n, p in enumerate(zip(*[own.column(c).to_pylist() for c in ("block", "q")]))}
        theta = own.column("theta").fill_null(np.iinfo(np.int64).min).to_numpy().copy()
        need = np.where((theta > 0) & (own.column("norm").to_numpy() > 0), own.column("need").to_numpy(), 0.0)
        best = None
        for k, (first, last) in enumerate(ranges):
            least = float(need.min()) * (1 - 1e-6)
            part = table.filter((F.col("dim") == dim) & F.col("place").between(first, last - 1) & (F.col("norm") >= least))
            found = searched(part, own, theta, keep)
            best = best_of(found if best is None else best.drop("nth").unionByName(found), keep)
            if k < len(ranges) - 1:
                best = cut(best)
                full = best.filter(F.col("nth") == keep).select("block", "q", "score").toArrow()
                at = np.array([index[p] for p in zip(*[full.column(c).to_pylist() for c in ("block", "q")])], np.int64)
                theta[at] = np.maximum(theta[at], full.column("score").to_numpy())
                norm = own.column("norm").to_numpy()
                need = np.where((theta > 0) & (norm > 0), theta / np.maximum(norm, 1e-300), 0.0)
        if best is not None:
            best.select(*FOUND.names, "nth").write.mode("append").parquet(path)
    lists = F.sort_array(F.collect_list(F.struct("nth", "score", "vec_id", "same")))
    made = spark.read.schema(kind).parquet(path).groupBy("block", "q").agg(lists.alias("best"))
    return made.join(bounds.select("block", "q", "vector"), ["block", "q"]).select("vector", "best")


def top_products(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of `rows` for each row of `queries`, its own row left out.

    Both have (vec_id long, vector array of long), and queries are rows of `rows`. Best are the
    largest inner products, ties by the smaller vec_id, rows without one last. A query meets only
    vectors of its own dimension. Repeated rows are rows like others: each is a candidate of the
    other, and as a query each has its results. An error where a product may not fit in 64 bits.
    """
    keep = k + 1  # its own row may be among them
    table = laid_out(rows, keep)
    found = answers(queries.select("vector").distinct(), table, keep)
    both = queries.select(F.col("vec_id").alias("query_id"), "vector").join(found, "vector")
    own = F.expr("array_position(transform(best, x -> x.same AND x.vec_id <=> query_id), true)")
    others = F.expr(f"slice(filter(best, (x, i) -> i + 1 != own), 1, {k})")
    return (
        both.select("query_id", "best", own.alias("own"))
        .select("query_id", F.posexplode(others).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
    )


def report(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """`top_products` of all vectors of the table, for the rows whose vec_id is divisible by `every`.

    Rows without a vec_id ask nothing. Other columns are not looked at; an empty table gives no rows.
    """
    rows = scaled(embeddings)
    return top_products(rows, rows.filter(F.col("vec_id") % every == 0), k)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS r FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id,
        coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 20
"""
