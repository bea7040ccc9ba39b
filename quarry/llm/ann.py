"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Fitting takes at most SAMPLE vectors, chosen by hash: k-means finds the coarse centroids, about the square root of the number
of vectors and at most MOST_LISTS, and, in each of PARTS parts of the dimensions, CODES centroids of the residuals of the
first FITTED vectors of the sample. Every vector is then indexed: its list is its nearest centroid, its code the nearest part centroids of its residual. Lists are cut into
blocks of about BLOCK_ROWS vectors by hash of the id, so a hot list is many tasks.

Lists keep their radius, the greatest distance of a member from the centroid, so a query leaves out those that can't hold one
of its k nearest. If the sample is all of the vectors, it visits all other lists, and finds exactly the nearest. Else it visits
the others among the lists of its nearest centroids: as many as hold ENOUGH of the nearest in the sample of ASKED of the queries,
and `probe` at least, as a share of all. Since the sample is thinner, the nearest of all vectors stand nearer than those.

In each block, tables of distances from the query's residual to the part centroids give every code's distance (asymmetric: the
query is not quantised); the best RERANK of the block are ranked by exact distance on the original vectors in double precision,
and so are all others whose code's distance, less the error of their own code, is within the k-th of these: no vector of a visited
list is missed. The best k of the block go on to be merged, ties to smaller ids. A list's queries are cut into blocks of about
QUERY_BLOCK too, and each block of them meets each of the list's in a task of its own, by an equi-join. Distances from centroids
are taken from the sample's medians on, which an offset or a few huge vectors don't move.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, or differ in length from most,
neither search nor are found; a null vec_id neither. Repeated ids are separate vectors, and each searches for itself; a
query's own id is never a candidate of it. Fewer than k candidates give fewer rows. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common

SAMPLE, FITTED, MOST_LISTS, PARTS, CODES = 16_384, 8192, 4096, 16, 256
BLOCK_ROWS, QUERY_BLOCK, QUERY_ROWS, RERANK = 4096, 8192, 256, 200
#: Queries that tell how many lists to visit, and the share of their nearest that those must hold.
ASKED, ENOUGH = 256, 0.99
#: What bounds of distances may be wrong by, as a share of their size.
SLACK = 1e-9


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, embedding (array<float>) of the vectors that take part."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(e, lambda x: x != 0)
    return vectors.filter(F.col(vec_id).isNotNull() & good).select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        order = np.argsort(near, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(near[order]) > 0]))
        sums = np.add.reduceat(x[order], begins, axis=0)
        counts = np.diff(np.concatenate([begins, [len(x)]]))
        c[near[order][begins]] = sums / counts[:, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Index:
    """Coarse centroids and the codebook of residuals; bounded by MOST_LISTS and CODES, whatever the number of vectors."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        self.dim = sample.shape[1]
        self.middle = np.median(sample, axis=0)
        sample = sample - self.middle
        self.coarse = k_means(sample, lists, 10, seed)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.cuts = np.linspace(0, self.dim, min(PARTS, self.dim) + 1).astype(int)
        self.books = [k_means(np.ascontiguousarray(rest[:FITTED, a:b]), CODES, 8, seed + i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))]

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x - self.middle, self.coarse)

    def codes_of(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of vectors, their distances from what these stand for, and from the centroids."""
        rest = x - self.middle - self.coarse[lists]
        parts = list(zip(zip(self.cuts, self.cuts[1:], strict=False), self.books, strict=True))
        codes = np.stack([_nearest(rest[:, a:b], c) for (a, b), c in parts], axis=1).astype(np.uint8)
        wrong = sum(((rest[:, a:b] - c[codes[:, i]]) ** 2).sum(1) for i, ((a, b), c) in enumerate(parts))
        return codes, np.sqrt(wrong), np.sqrt((rest**2).sum(1))

    def distances_of(self, q: np.ndarray) -> np.ndarray:
        """From queries to centroids, a few queries at a time."""
        q = q - self.middle
        return np.sqrt(np.concatenate([((q[i : i + 8, None] - self.coarse) ** 2).sum(2) for i in range(0, len(q), 8)]))

    def probes_of(self, q: np.ndarray, n: int, k: int, sizes: np.ndarray, radii: np.ndarray) -> list[np.ndarray]:
        """For each query the lists, nearest centroids first: of the first n, those that can hold one of its k nearest."""
        out = []
        for d in self.distances_of(q):
            far = d + radii
            order = np.argsort(far)
            at = min(int(np.searchsorted(np.cumsum(sizes[order]), k)), len(order) - 1)
            within = d - radii <= far[order[at]] + SLACK * (d + far[order[at]])
            near = np.argsort(d, kind="stable")[:n]
            out.append(near[(within & (sizes > 0))[near]])
        return out

    def tables_of(self, q: np.ndarray, list_: int) -> list[np.ndarray]:
        """For each part, the squared distance of each query's residual to each part centroid."""
        rest = q - self.middle - self.coarse[list_]
        return [((rest[:, None, a:b] - c[None]) ** 2).sum(2) for (a, b), c in zip(zip(self.cuts, self.cuts[1:], strict=False), self.books, strict=True)]


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Index | None:
    """vectors: usable ones. None if there are none."""
    x = _sample(vectors, sample)[1]
    return Index(x, _n_lists(vectors.count())) if len(x) else None


def _sample(vectors: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of n rows by hash, those of the most common length."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()
    lengths = [len(r["embedding"]) for r in rows]
    dim = max(sorted(set(lengths)), key=lengths.count, default=0)
    rows = [r for r in rows if len(r["embedding"]) == dim]
    return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["embedding"] for r in rows], float).reshape(len(rows), dim)


def _n_lists(n: int) -> int:
    return max(1, min(MOST_LISTS, round(n**0.5)))


def _lists_needed(index: Index, ids: np.ndarray, x: np.ndarray, asking: np.ndarray, q: np.ndarray, k: int) -> int:
    """How many of the lists of nearest centroids hold ENOUGH of the queries' k nearest in the sample (ids, x)."""
    lists = index.lists_of(x)
    places = [np.zeros(1, np.int64)]
    for own, v, d in zip(asking, q, index.distances_of(q), strict=True):
        place = np.empty(len(d), np.int64)
        place[np.argsort(d, kind="stable")] = np.arange(len(d))
        exact = np.where(ids == own, np.inf, ((x - v) ** 2).sum(1))
        places.append(place[lists[np.argsort(exact, kind="stable")[: min(k, int((ids != own).sum()))]]])
    return int(np.quantile(np.concatenate(places), ENOUGH, method="higher")) + 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, is_query, k: int = 10, probe: float = 0.6, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each vector for which the condition is_query (on vec_id) holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    known, x = _sample(vectors, sample)
    if not len(x):
        return spark.createDataFrame([], schema)
    total = vectors.count()
    index, dim = Index(x, _n_lists(total)), x.shape[1]
    vectors = vectors.filter(F.size("embedding") == dim)
    needed = len(index.coarse)
    if total > sample:
        asking, q = _sample(vectors.filter(is_query), ASKED)
        if not len(q):
            return spark.createDataFrame([], schema)
        needed = _lists_needed(index, known, x, asking, q, k)
    # rows of one id aren't candidates of each other
    same = vectors.filter(is_query).groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            lists = index.lists_of(x)
            codes, wrong, apart = index.codes_of(x, lists)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(wrong), pa.array(apart), pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary())], names=["list", "vec_id", "code", "wrong", "apart", "vector"])

    lists = vectors.mapInArrow(common.tidy(indexed), "list long, vec_id long, code binary, wrong double, apart double, vector binary")
    many = common.materialise(lists.groupBy("list").agg(F.count(F.lit(1)).alias("count"), F.max("apart").alias("radius")), "lists")
    # as many lists as hold more than k vectors, whichever they are; a row for each of at most MOST_LISTS lists
    sizes, radii = np.zeros(len(index.coarse), np.int64), np.zeros(len(index.coarse))
    for r in many.collect():
        sizes[r["list"]], radii[r["list"]] = r["count"], r["radius"]
    enough = int(np.searchsorted(np.cumsum(np.sort(sizes)), k + same)) + 1
    n_probe = min(len(index.coarse), max(1, round(len(index.coarse) * probe), enough, needed))

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            x = _matrix(b.column(1), dim)
            if not len(x):
                continue
            p = index.probes_of(x, n_probe, k + same, sizes, radii)
            n = [len(y) for y in p]
            ids = np.repeat(b.column(0).to_numpy(), n)
            asks = np.repeat(np.arange(row, row + len(x)), n)
            row += len(x)
            raw = [v.tobytes() for v in x.astype("<f8")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), pa.int64()), pa.array(asks), pa.array(ids), pa.array([r for r, m in zip(raw, n, strict=True) for _ in range(m)], pa.binary())], names=["list", "ask", "query_id", "query"])

    asked = vectors.filter(is_query).mapInArrow(common.tidy(probing), "list long, ask long, query_id long, query binary")
    # both sides in blocks: a list's rows by id, its queries by number, each block of queries with each block of rows
    asking = common.materialise(asked.groupBy("list").count(), "asking")
    cut = many.join(asking.withColumnRenamed("count", "asks"), "list").select("list", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks"), F.ceil(F.col("asks") / QUERY_BLOCK).alias("parts"))
    cut = common.materialise(cut, "cuts")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = lists.join(common.few(cut), "list").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks"))).select("list", "block", each("parts").alias("part"), "vec_id", "code", "wrong", "vector")
    asked = asked.join(common.few(cut), "list").withColumn("part", F.pmod(F.xxhash64("ask"), F.col("parts"))).select("list", each("blocks").alias("block"), "part", "ask", "query_id", "query")

    def scan(key, left: pa.Table, right: pa.Table) -> pa.Table:
        list_ = key[0].as_py()
        ids = left["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 1), np.uint8)
        wrong = left["wrong"].to_numpy()[order]
        x = np.frombuffer(b"".join(left["vector"].to_pylist()), "<f8").reshape(-1, dim)[order]
        asks, asking = right["ask"].to_numpy(), right["query_id"].to_numpy()
        q = np.frombuffer(b"".join(right["query"].to_pylist()), "<f8").reshape(-1, dim)
        out: list[tuple] = []
        for lo in range(0, len(asking) if len(ids) else 0, QUERY_ROWS):
            tables = index.tables_of(q[lo : lo + QUERY_ROWS], list_)
            near = np.zeros((len(tables[0]), len(ids)))
            for part, t in enumerate(tables):
                near += t[:, codes[:, part]]
            for i, d in enumerate(np.sqrt(near)):
                query = asking[lo + i]
                best = np.flatnonzero(ids != query)
                if len(best) > max(rerank, k):
                    d = d[best]
                    first = best[np.argpartition(d, max(rerank, k))[: max(rerank, k)]]
                    edge = np.partition(((x[first] - q[lo + i]) ** 2).sum(1), k - 1)[k - 1] ** 0.5
                    # no vector is nearer than its code less its code's error
                    best = best[d - wrong[best] <= edge + SLACK * (edge + d)]
                exact = np.sqrt(((x[best] - q[lo + i]) ** 2).sum(1))
                top = np.lexsort((ids[best], exact))[:k]
                out += [(int(asks[lo + i]), int(query), int(ids[best[j]]), float(exact[j])) for j in top.tolist()]
        c = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({"ask": pa.array(c[0], pa.int64()), "query_id": pa.array(c[1], pa.int64()), "vec_id": pa.array(c[2], pa.int64()), "score": pa.array(c[3], pa.float64())})

    found = rows.groupBy("list", "block", "part").cogroup(asked.groupBy("list", "block", "part")).applyInArrow(scan, "ask long, query_id long, vec_id long, score double")
    w = Window.partitionBy("ask").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
