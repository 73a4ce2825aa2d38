"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best-bin-first.

The tree is fitted on a bounded sample of distinct vectors (`sample`), each extended by one coordinate that makes
all lengths equal, so that larger inner product means smaller distance. Every vector is then placed in its leaf.
A query walks the tree through a priority queue of nodes by distance to their centres and opens leaves in that
order. How many leaves it may open is calibrated: the exact answers of up to `probes` queries over the whole table
say how many it takes to find the share `recall` of them.

The search has two passes. The first opens the nearest leaves and gives each query a bound, its (k + 1)-th best score
so far. The second opens the other leaves, but for those whose ball (centre and radius) cannot reach the bound, and
returns only what does. Equal vectors are collapsed with the k + 1 smallest ids, which is all that an answer can
hold. Leaves are searched in blocks of bounded size. The tree has at most sample / 8 leaves, so beyond
sample * leaf_rows / 8 rows leaves grow with the table.

Defined cases: vectors that are null, zero or hold null or non-finite components, or have a null id, take no part;
vectors are compared with those of their own length; ties go to the smaller id; a query with fewer candidates gets
all of them; repeated rows (one id, one vector) are candidates each, of which a query leaves out one, itself, and
ask once; an empty table, or one without queries, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .vectors import matrix, usable


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)


class KMeansTree:
    """children[n]: node numbers; leaf[n]: leaf number or -1; centre[n]."""

    def __init__(self, x: np.ndarray, leaf_size: int, branch: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.centre, self.children, self.leaf, self.leaves = [x.mean(0)], [[]], [-1], 0
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            ways = min(branch, -(-len(rows) // max(1, leaf_size)))
            if ways > 1:
                centres, near = _kmeans(x[rows], ways, rng)
                parts = [(centres[c], rows[near == c]) for c in range(ways) if (near == c).any()]
                if len(parts) > 1:
                    for c, part in parts:
                        self.children[node].append(len(self.centre))
                        todo.append((len(self.centre), part))
                        self.centre.append(c)
                        self.children.append([])
                        self.leaf.append(-1)
                    continue
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        self.centre = np.array(self.centre)
        self.of_leaf = self.centre[[n for _, n in sorted((l, n) for n, l in enumerate(self.leaf) if l >= 0)]]
        self.square = (self.centre**2).sum(1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the nearest centres."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            near = (self.square[kids][None] - 2 * x[rows] @ self.centre[kids].T).argmin(1)
            todo += [(kid, rows[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[list[int]]:
        """For each query the first `most` leaves, best bin first."""
        far = self.square[None] - 2 * q @ self.centre.T
        out = []
        for d in far:
            heap, found = [(0.0, 0)], []
            while heap and len(found) < most:
                _, node = heapq.heappop(heap)
                if self.leaf[node] >= 0:
                    found.append(self.leaf[node])
                for kid in self.children[node]:
                    heapq.heappush(heap, (d[kid], kid))
            out.append(found)
        return out


def top_rows(score: np.ndarray, least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, point) of the scores that are at least `least` of the query, of each query the `most` best and what ties with them."""
    if score.shape[1] > most:
        least = np.maximum(least, -np.partition(-score, most - 1, axis=1)[:, most - 1])
    return np.nonzero(score >= least[:, None])


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, sample: int = 20_000, leaf_rows: int = 512, block: int = 4096, probes: int = 128) -> DataFrame:
    """rows (vec_id, embedding), queries (vec_id, a subset of rows): query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    small_batches(spark, 4096)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.select(F.size("embedding").alias("dim")).distinct().collect():  # a row for each length of vectors
        out = out.union(_nearest(rows.where(F.size("embedding") == r["dim"]), asked, k, recall, sample, leaf_rows, block, probes))
    return out


def _nearest(rows: DataFrame, asked: DataFrame, k: int, recall: float, sample: int, leaf_rows: int, block: int, probes: int) -> DataFrame:
    spark = rows.sparkSession
    kind = rows.schema["embedding"].dataType.simpleString()

    def smallest(batches):  # of each batch: the k + 1 smallest ids of a vector
        for b in batches:
            key = [np.asarray(v).tobytes() for v in b["embedding"]]
            if len(set(key)) == len(key):
                yield pd.DataFrame({"embedding": b["embedding"], "ids": [[i] for i in b["vec_id"]]})
            else:
                yield pd.DataFrame([(x["embedding"].iat[0], np.sort(x["vec_id"].to_numpy())[: k + 1]) for _, x in b.groupby(key)], columns=["embedding", "ids"])

    partial = rows.select("vec_id", "embedding").mapInPandas(smallest, f"embedding {kind}, ids array<long>")
    groups = partial.groupBy("embedding").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    groups = written(groups.withColumn("gid", F.monotonically_increasing_id()))
    head = groups.agg(F.count("*").alias("n"), F.max(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v)).alias("m")).first()
    fit = matrix(groups.orderBy(F.xxhash64("embedding"), "gid").limit(sample).select("embedding").toPandas()["embedding"])
    top = head["m"]

    def longer(x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))]

    leaves = max(1, min(head["n"] // leaf_rows, len(fit) // 8))
    tree = KMeansTree(longer(fit), max(1, len(fit) // leaves))
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def place(batches):
        for b in batches:
            x = matrix(b["embedding"])
            leaf = shared.value.place(longer(x))
            yield b.assign(leaf=leaf, far=np.sqrt(((x - shared.value.of_leaf[leaf, :-1]) ** 2).sum(1)))

    points = written(groups.select("gid", "ids", "embedding").mapInPandas(place, f"gid long, ids array<long>, embedding {kind}, leaf long, far double"))
    sizes = {r["leaf"]: (r["n"], r["far"]) for r in points.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row for each leaf
    radius = np.array([sizes.get(i, (0, 0.0))[1] for i in range(tree.leaves)])
    # a query stands for all queries with its vector
    wanted = written(rows.join(asked, "vec_id", "left_semi").distinct().join(groups.select("embedding", "gid"), "embedding").select("vec_id", "gid"))
    vectors = written(groups.join(wanted.select("gid").distinct(), "gid", "left_semi").select("gid", "embedding"))
    visits = _visits(tree, points, vectors, k, recall, probes)

    def walk(batches):
        for b in batches:
            q = matrix(b["embedding"])
            yield b.assign(leaf=shared.value.visits(np.c_[q, np.zeros(len(q))], visits))

    walked = written(vectors.mapInPandas(walk, f"gid long, embedding {kind}, leaf array<long>"))

    def searched(todo: DataFrame) -> DataFrame:
        """todo (gid, embedding, least, leaf): what reaches `least` in that leaf, as rows (gid, cand, vec_id, score)."""
        cuts = spark.createDataFrame([(i, -(-n // block)) for i, (n, _) in sizes.items()], "leaf long, pb long")
        cuts = cuts.join(todo.groupBy("leaf").agg(F.ceil(F.count("*") / block).alias("qb")), "leaf")

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            df = df.join(F.broadcast(cuts), "leaf")  # a row for each leaf: bounded by the sample
            return df.withColumn(own[0], F.pmod(F.xxhash64("gid"), F.col(own))).withColumn(other[0], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("pb", "qb")

        def search(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(p) or not len(q):
                return pd.DataFrame({"gid": [], "cand": [], "vec_id": [], "score": []})
            score = matrix(q["embedding"]) @ matrix(p["embedding"]).T
            i, j = top_rows(score, q["least"].to_numpy(), k + 1)
            ids = p["ids"].to_numpy()
            n = np.array([len(x) for x in ids])
            every, first = np.concatenate(ids), np.cumsum(n) - n
            many = n[j]
            at = np.repeat(first[j], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            return pd.DataFrame({"gid": np.repeat(q["gid"].to_numpy()[i], many), "cand": np.repeat(p["gid"].to_numpy()[j], many), "vec_id": every[at], "score": np.repeat(score[i, j], many)})

        return dealt(points.drop("far"), "pb", "qb").groupBy("leaf", "p", "q").cogroup(dealt(todo, "qb", "pb").groupBy("leaf", "p", "q")).applyInPandas(search, "gid long, cand long, vec_id long, score double")

    near = 2
    one = walked.select("gid", "embedding", F.lit(float("-inf")).alias("least"), F.explode(F.slice("leaf", 1, near)).alias("leaf"))
    found = written(searched(one))
    bound = found.groupBy("gid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("gid", F.coalesce(F.get("s", F.lit(k)), F.lit(float("-inf"))).alias("least"))

    def reach(batches):
        for b in batches:
            q = matrix(b["embedding"])
            most = q @ shared.value.of_leaf[:, :-1].T + np.sqrt((q * q).sum(1))[:, None] * radius[None]
            most += 1e-9 * np.abs(most)  # rounding
            yield b.assign(leaf=[x[near:][most[i, x[near:]] >= least] for i, (x, least) in enumerate(zip(b["leaf"], b["least"]))])

    rest = walked.where(F.size("leaf") > near).join(bound, "gid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = rest.select("gid", "embedding", "least", "leaf").mapInPandas(reach, f"gid long, embedding {kind}, least double, leaf array<long>")
    rest = written(rest.withColumn("leaf", F.explode("leaf")))
    found = found.union(searched(rest))
    best = found.groupBy("gid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "cand"))), 1, k + 1).alias("best"))
    out = wanted.join(best, "gid").select(F.col("vec_id").alias("query_id"), "gid", "best")
    own = F.array_position(F.transform("best", lambda x: (x["vec_id"] == F.col("query_id")) & (x["cand"] == F.col("gid"))), F.lit(True))
    out = out.withColumn("own", own)
    ranked = F.slice(F.filter("best", lambda x, i: (i + 1) != F.col("own")), 1, k)
    return out.select("query_id", F.posexplode(ranked).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def _visits(tree: KMeansTree, points: DataFrame, vectors: DataFrame, k: int, recall: float, probes: int) -> int:
    """The least number of leaves that finds this share of the exact k nearest, in the whole table, of the probed queries."""
    probe = vectors.orderBy(F.xxhash64("embedding"), "gid").limit(probes).toPandas()  # bounded
    if not len(probe):
        return 1
    q, gid = matrix(probe["embedding"]), probe["gid"].to_numpy()

    def exact(batches):
        score, leaf = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for b in batches:
            s = q @ matrix(b["embedding"]).T
            s[gid[:, None] == b["gid"].to_numpy()[None]] = -np.inf
            score, leaf = np.c_[score, s], np.c_[leaf, np.broadcast_to(b["leaf"].to_numpy(), s.shape)]
            keep = np.argsort(-score, axis=1)[:, :k]
            score, leaf = np.take_along_axis(score, keep, 1), np.take_along_axis(leaf, keep, 1)
        at = np.repeat(np.arange(len(q)), score.shape[1])
        yield pd.DataFrame({"at": at, "score": score.ravel(), "leaf": leaf.ravel()})

    best = points.select("gid", "embedding", "leaf").mapInPandas(exact, "at int, score double, leaf long").where(F.col("score") > float("-inf"))
    best = best.groupBy("at").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "leaf")), asc=False), 1, k).alias("x")).select("at", F.explode("x.leaf").alias("leaf")).toPandas()
    if not len(best):
        return 1
    rank = np.full((len(q), tree.leaves), tree.leaves)
    for i, order in enumerate(tree.visits(np.c_[q, np.zeros(len(q))], tree.leaves)):
        rank[i, order] = np.arange(len(order))
    need = np.sort(rank[best["at"], best["leaf"]])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1


def nearest_report(rows: DataFrame) -> DataFrame:
    return nearest(rows, rows.where("vec_id % 20 = 0"))
