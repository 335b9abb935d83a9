"""Nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals, searched by bounds.

Centroids and the residuals' codebooks are fitted on the SAMPLE vectors of least hash; every vector is then indexed: its
list (nearest centroid), the codes of its residual, and the length of what its codes leave out. The nearest of the sample, scored exactly,
give a score that a query's nearest reach at least. By Cauchy and Schwarz no vector of a list scores more than the centroid
and the list's radius allow, and none more than its codes and what they leave out allow: a query goes to all lists, and scores exactly, on
the original vectors in double precision, all vectors that may reach that score. So none of the nearest is missed, whatever the vectors are like; where they have no clusters,
more are scored. Lists are packed into parts of about PART vectors, long lists split, and a query goes once to each part that has one of its lists. The
nearest of all parts are merged. Ties go to the smaller vec_id at each step.

Vectors that are null, all zero, of another than the commonest length, or that hold null or non-finite components take no
part, nor do rows with a null vec_id. Rows of one vec_id are all candidates, but never for that vec_id; equal rows
of a query are asked once. Other columns are not
read. Fewer candidates than asked for: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, PART, LEAST_PART = 16_384, 32_768, 2_048
MOST_LISTS = 4_096
#: Of a query's vectors in a list so many of the best codes are scored first, if more may reach the score asked for.
PIECES, RERANKED, NEAREST, EVERY = 16, 200, 20, 20
#: Products that are worked on at a time, and what rounding may add to a bound, as a share of the vectors' lengths.
BLOCK, ROUNDING = 1 << 20, 1e-11


def kmeans(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k centroids (fewer for fewer points), from points spread evenly over the given order; the same for the same points."""
    k = min(k, len(points))
    centroids = points[np.linspace(0, len(points) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        near = nearest(points, centroids)
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=points[:, d], minlength=k) for d in range(points.shape[1])], 1)
        used = count > 0
        centroids[used] = (sums[used] / count[used, None]).astype(np.float32)
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each point's nearest centroid by Euclidean distance."""
    half = (centroids.astype(np.float64) ** 2).sum(1) / 2
    return np.concatenate([np.argmin(half - points[i : i + 8192] @ centroids.T, axis=1) for i in range(0, len(points), 8192)] or [np.zeros(0, np.int64)])


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the last axis, also where squares would overflow or vanish."""
    most = np.abs(vectors).max(-1, initial=0)
    scale = np.where(most > 0, most, 1)
    return most * np.sqrt(((vectors / scale[..., None]) ** 2).sum(-1))


@dataclass
class Quantiser:
    centroids: np.ndarray
    codebooks: np.ndarray  # pieces, 256 at most, length of a piece
    pad: int  # zeros after a vector, so that it can be cut into equal pieces
    scale: float  # a power of two, by which vectors are divided before they are compared in single precision

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, scale: float = 1.0) -> Quantiser:
        sample = (sample / scale).astype(np.float32)
        centroids = kmeans(sample, lists)
        pieces = min(PIECES, sample.shape[1])
        pad = -sample.shape[1] % pieces
        residual = np.pad(sample - centroids[nearest(sample, centroids)], ((0, 0), (0, pad)))
        parts = residual.reshape(len(sample), pieces, -1)
        return cls(centroids, np.stack([kmeans(np.ascontiguousarray(parts[:, p]), 256) for p in range(pieces)]), pad, scale)

    def middles(self) -> np.ndarray:
        """The centroids in the vectors' own measure."""
        return self.centroids.astype(np.float64) * self.scale

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists and codes, found in single precision; the distance from the centroid and that from centroid and codes together, not less than exact ones."""
        small = (vectors / self.scale).astype(np.float32)
        near = nearest(small, self.centroids)
        parts = np.pad(small - self.centroids[near], ((0, 0), (0, self.pad))).reshape(len(vectors), len(self.codebooks), -1)
        codes = np.stack([nearest(np.ascontiguousarray(parts[:, p]), book) for p, book in enumerate(self.codebooks)], 1)
        middle = self.middles()[near]
        coded = self.codebooks[np.arange(len(self.codebooks)), codes].astype(np.float64).reshape(len(vectors), -1)[:, : vectors.shape[1]] * self.scale
        slack = ROUNDING * (lengths(vectors) + lengths(middle) + lengths(coded))
        return near, codes.astype(np.uint8), lengths(vectors - middle) + slack, lengths(vectors - middle - coded) + slack

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's pieces with all codes: queries, pieces, codes."""
        parts = np.pad(queries, ((0, 0), (0, self.pad))).reshape(len(queries), len(self.codebooks), -1)
        return np.einsum("qpd,pcd->qpc", parts, self.codebooks.astype(np.float64) * self.scale)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column of binary values of equal length."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(length: int) -> Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & (F.size(v) == length) & finite & F.exists(v, lambda x: x != 0)


def _rows(batches: Iterator[pa.RecordBatch], quantiser: Quantiser) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            vectors = _floats(batch.column("embedding"))
            near, codes, radius, left = quantiser.encode(vectors)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near.astype(np.int32)), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (codes, vectors.astype("<f8"))), pa.array(radius), pa.array(left)], _INDEX_NAMES)


_INDEX = "vec_id long, list int, codes binary, vector binary, radius double, left double"
_INDEX_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def reachable(queries: np.ndarray, middles: np.ndarray, radii: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a list may hold a vector of the least score asked for: queries x lists."""
    with np.errstate(over="ignore", invalid="ignore"):
        return ~(queries @ middles.T + lengths(queries)[:, None] * radii < least[:, None])


def least_scores(names: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """A score that each query's n nearest reach, if it has so many: the n-th best among some of the candidates, less what rounding may add."""
    out = np.full(len(queries), -np.inf)
    most = lengths(vectors).max(initial=0)
    width = max(1, BLOCK // max(1, len(ids)))
    for i in range(0, len(queries) if len(ids) > n else 0, width):
        with np.errstate(over="ignore", invalid="ignore"):
            scores = queries[i : i + width] @ vectors.T
            scores[(names[i : i + width, None] == ids) | np.isnan(scores)] = -np.inf
            nth = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n] - ROUNDING * most * lengths(queries[i : i + width])
        out[i : i + width] = np.where(np.isnan(nth), -np.inf, nth)
    return out


def _probes(batches: Iterator[pa.RecordBatch], quantiser: Quantiser, radii: np.ndarray, homes: np.ndarray, sample: tuple[np.ndarray, np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """Of each query a row for each part that has some of a list that it goes to. homes: of each list its first part and the number of its parts."""
    parts = int(homes.sum(1).max())
    for batch in batches:
        if batch.num_rows:
            vectors, names = _matrix(batch.column("vector")), batch.column("vec_id").to_numpy()
            least = least_scores(names, vectors, *sample, n)
            # a part is gone to if a list that begins before its end and ends after its start is: by running sums over the parts
            some = np.zeros((len(names), parts + 1), np.int32)
            lists = reachable(vectors, quantiser.middles(), radii, least) & (homes[:, 1] > 0)
            for k in np.flatnonzero(lists.any(0)):
                some[:, homes[k, 0]] += lists[:, k]
                some[:, homes[k, 0] + homes[k, 1]] -= lists[:, k]
            query, part = np.nonzero(np.cumsum(some, axis=1)[:, :parts] > 0)
            taken = pa.array(query)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(taken), pa.array(part.astype(np.int32)), batch.column("vector").take(taken), pa.array(least[query])], ["vec_id", "part", "vector", "left"])


def distinct_enough(vectors: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of the rows of the first n vec_ids of each group of equal vectors, and of n rows of each at most: the others can't be among any query's n - 1 nearest, as ties go by vec_id. ids are in order."""
    rows = pd.Series(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel().tolist())
    group = pd.factorize(rows)[0]
    both = pd.DataFrame({"group": group, "id": ids})
    again = both.groupby(["group", "id"], sort=False).cumcount().to_numpy()
    fresh = pd.Series((again == 0).astype(np.int64))
    rank = fresh.groupby(group, sort=False).cumsum().to_numpy() - 1
    return np.flatnonzero((rank < n) & (again < n))


@dataclass
class _Part:
    """A part's vectors in order of list: where each list lies in it, and what bounds its vectors' scores."""

    ids: np.ndarray
    codes: np.ndarray  # pieces x vectors
    left: np.ndarray
    vectors: np.ndarray
    lists: np.ndarray
    bounds: np.ndarray
    radii: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], n: int) -> _Part:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, vectors = table["vec_id"].to_numpy(), _matrix(table["vector"])
        lists = table["list"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        kept = np.sort(by_id[distinct_enough(vectors[by_id], ids[by_id], n + 1)])
        lists = lists[kept]
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)[kept]
        starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        radii = np.maximum.reduceat(table["radius"].to_numpy()[kept], starts)
        return cls(ids[kept], np.ascontiguousarray(codes.T).astype(np.intp), table["left"].to_numpy()[kept], vectors[kept], lists[starts], np.append(starts, len(lists)), radii)

    def exact(self, queries: np.ndarray, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of pairs, by row: equal vectors have equal scores."""
        width = max(1, BLOCK // queries.shape[1])
        with np.errstate(over="ignore", invalid="ignore"):
            return np.concatenate([(self.vectors[at[i : i + width]] * queries[query[i : i + width]]).sum(1) for i in range(0, len(at), width)] or [np.zeros(0)])

    def search(self, names: np.ndarray, queries: np.ndarray, least: np.ndarray, quantiser: Quantiser, n: int) -> pa.RecordBatch:
        middles, size, tables = quantiser.middles()[self.lists], lengths(queries), quantiser.tables(queries)
        with np.errstate(over="ignore", invalid="ignore"):
            centre = queries @ middles.T
        goes = reachable(queries, middles, self.radii, least)
        least = least.copy()
        query, at, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for k, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            asked = np.flatnonzero(goes[:, k])
            width = max(1, BLOCK // (b - a))
            for i in range(0, len(asked), width):
                q = asked[i : i + width]
                with np.errstate(over="ignore", invalid="ignore"):
                    most = centre[q, k][:, None] + size[q][:, None] * self.left[a:b]
                    for p, codes in enumerate(self.codes[:, a:b]):
                        most += np.take(tables[q, p], codes, axis=1)
                most[names[q][:, None] == self.ids[a:b]] = -np.inf
                may = ~(most < least[q][:, None])
                may &= ~np.isneginf(most)
                for j in np.flatnonzero(may.sum(1) > 2 * RERANKED):  # the n-th best of the most promising keeps others out
                    first = np.argpartition(most[j], b - a - RERANKED)[b - a - RERANKED :]
                    first = first[self.ids[a:b][first] != names[q[j]]]
                    nth = np.sort(self.exact(queries, np.full(len(first), q[j]), a + first))[-n] if len(first) >= n else -np.inf
                    if nth > least[q[j]]:
                        least[q[j]] = nth
                        may[j] &= ~(most[j] < nth)
                own, place = np.nonzero(may)
                exact = self.exact(queries, q[own], a + place)
                near = ~(exact < least[q[own]])
                query.append(q[own[near]])
                at.append(a + place[near])
                score.append(exact[near])
        query, at, score = np.concatenate(query), np.concatenate(at), np.concatenate(score)
        order = np.lexsort((self.ids[at], -score, query))
        query, at, score = query[order], at[order], score[order]
        starts = np.searchsorted(query, np.arange(len(names)))
        top = np.arange(len(query)) - starts[query] < n
        return pa.RecordBatch.from_arrays([pa.array(names[query[top]]), pa.array(self.ids[at[top]]), pa.array(score[top])], ["query_id", "vec_id", "score"])


def _searched(batches: Iterator[pa.RecordBatch], quantiser: Quantiser, n: int) -> Iterator[pa.RecordBatch]:
    """From rows in order of part, kind (vectors, then queries) and list: each query's nearest of each part."""
    key, held, part = None, [], None
    for batch in batches:
        where = batch.column("part").to_numpy().astype(np.int64) << 1 | batch.column("query").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(where) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = batch.slice(a, b - a)
            if where[a] >> 1 != key:
                key, held, part = where[a] >> 1, [], None
            if not where[a] & 1:
                held.append(rows)
            elif held or part:
                if part is None:  # the part's first queries
                    part, held = _Part.of(held, n), []
                yield part.search(rows.column("vec_id").to_numpy(), _matrix(rows.column("vector")), rows.column("left").to_numpy(), quantiser, n)


def packed_lists(counts: np.ndarray, part: int) -> np.ndarray:
    """Of each list its first part and the number of its parts: short lists share one, long ones are split; empty lists have none."""
    out = np.zeros((len(counts), 2), np.int64)
    at, room = 0, part
    for k in np.flatnonzero(counts):
        if counts[k] > room:
            at, room = at + (room < part), part
        pieces = int(-(-counts[k] // part))
        out[k] = at, pieces
        at, room = (at, room - counts[k]) if pieces == 1 else (at + pieces, part)
    return out


def search(table: DataFrame, queries: Column, n: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the n nearest of each vector that the condition queries holds for."""
    spark = table.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    columns = table.select(F.col("vec_id").cast("long"), "embedding")
    usual = columns.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    good = columns.where(_usable(usual["n"] if usual else 0))
    total, most = good.agg(F.count("*"), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    vectors = _floats(sample["embedding"].combine_chunks())
    quantiser = Quantiser.fit(vectors, int(min(MOST_LISTS, max(1, total**0.5 / 2))), float(2.0 ** (np.frexp(most)[1] - 1)))
    sent = spark.sparkContext.broadcast((quantiser, (sample["vec_id"].to_numpy(), vectors)))
    index = good.mapInArrow(lambda batches: _rows(batches, sent.value[0]), _INDEX)
    counts, radii = np.zeros((2, len(quantiser.centroids)))
    for row in index.groupBy("list").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect():  # a row for each list
        counts[row["list"]], radii[row["list"]] = row["n"], row["radius"]
    tasks = 2 * spark.sparkContext.defaultParallelism
    homes = packed_lists(counts.astype(np.int64), int(min(PART, max(LEAST_PART, -(-total // tasks)))))
    parts = int(homes.sum(1).max())
    of_list = lambda i: F.element_at(F.array(*(F.lit(int(h[i])) for h in homes)), F.col("list") + 1)
    part = (of_list(0) + F.pmod(F.xxhash64("vec_id"), of_list(1))).cast("int")
    stored = index.withColumn("part", part).withColumn("query", F.lit(0))
    asked = good.where(queries).mapInArrow(lambda batches: _rows(batches, sent.value[0]), _INDEX).select("vec_id", "vector").dropDuplicates()
    probes = asked.mapInArrow(lambda batches: _probes(batches, sent.value[0], radii, homes, sent.value[1], n), "vec_id long, part int, vector binary, left double").withColumn("query", F.lit(1))
    met = stored.unionByName(probes, allowMissingColumns=True).repartitionById(parts, "part").sortWithinPartitions("part", "query", "list", "vec_id")
    found = met.mapInArrow(lambda batches: _searched(batches, sent.value[0], n), "query_id long, vec_id long, score double")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op1_neighbours": op1_neighbours}
SQL: dict[str, str] = {}
