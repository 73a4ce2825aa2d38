"""Embedding near-duplicates: an exact metric range join.

Cosine at least s is, for unit vectors, a distance of at most r = sqrt(2 - 2s). Equal vectors of a label are
collapsed first. Labels with many vectors are cut into the Voronoi cells of pivots, and every vector goes to its own
cell only. Two cells meet unless the triangle inequality sets them apart: their pivots are further from each other
than r and both radii. Where they meet, distances to the hyperplane between the pivots, of a vector on either side,
add up to r at most for partners; so only vectors near the border are compared, in strips. They are compared first by
a few coordinates along the main axes of the pivots and the length of the rest, which is a cosine from above, and in
double precision where that leaves a pair open.

Cells are dealt as packs of at most `block` vectors. Near cells form groups of at most `group` vectors; a task holds
one group and lets the packs pass by that the group has to meet, so a vector is sent once for every other group that
it may meet, at most about half of the groups of its label. Tasks are independent, and `group` bounds their memory.
Only spanning links leave a task; classes are connected components.

In high dimensions without clusters distances concentrate and the work grows as the square of a label's size, less
what the borders save (more with more pivots); the result stays exact.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label or
vec_id, link with nothing and are kept; rows with one vec_id and one vector count each as a vector; vectors of
different lengths never link; extra columns are ignored; an empty table gives no rows. Rows find the results of their
vector by a 128-bit hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, partitions, small_batches, written
from .vectors import matrix, unit, usable

#: What single-precision filters may be wrong by, with room to spare; the last word is in double precision.
SLACK = 2e-5
_PLACE = ["label", "dim", "cell"]
_PACKS = "label long, dim int, cell int, seq int, n int, far double, gids binary, copies binary, hashes binary, vectors binary"


def _pivots(valid: DataFrame, cell: int, most: int) -> dict[tuple[int, int], np.ndarray]:
    """Pivots by (label, dimension) for the labels that are cut; at most about 2 * most in all."""
    sizes = valid.groupBy("label", "dim").count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    sizes = sizes.where(F.col("count") > max(cell, total // most)).collect()  # at most `most` rows
    if not sizes:
        return {}
    share = min(1.0, most * cell / max(1, total)) / cell
    cut = valid.sparkSession.createDataFrame([(r["label"], r["dim"]) for r in sizes], "label long, dim int")
    draw = F.xxhash64("embedding", F.lit("pivot"))
    chosen = valid.join(F.broadcast(cut), ["label", "dim"]).where(F.pmod(draw, F.lit(1 << 30)) < share * (1 << 30)).select("label", "dim", "embedding").distinct()
    found = chosen.orderBy(draw).limit(2 * most).toPandas()
    return {(int(k[0]), int(k[1])): unit(matrix(x["embedding"])) for k, x in found.groupby(["label", "dim"]) if len(x) > 1}


def _axes(p: np.ndarray, least: float) -> np.ndarray:
    """The main axes of half of the pivots, as few as leave few pairs of the others open; work, not results, hangs on it."""
    axes = np.linalg.svd(p[::2], full_matrices=True)[2].T
    some = p[1:2000:2]
    apart = np.triu(some @ some.T < least, 1)
    for k in range(8, p.shape[1] - 7, 8):
        x = _shortened(some, axes[:, :k])
        above = (x @ x.T)[apart]
        if len(above) and (above >= least).mean() <= 1 / 2000 and above.mean() + 3.5 * above.std() < least:
            return axes[:, :k]
    return axes


def _shortened(u: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Unit vectors of fewer coordinates whose cosines are those of u at least."""
    if axes is None or axes.shape[1] == u.shape[1]:
        return u.astype(np.float32)
    x = u @ axes
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))]).astype(np.float32)


def _order(p: np.ndarray) -> list[int]:
    """The pivots so that near ones follow each other: halved along the main axis again and again."""

    def halved(at: np.ndarray) -> list[int]:
        if len(at) <= 8:
            return at.tolist()
        x = p[at] - p[at].mean(axis=0)
        side = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")
        return halved(at[side[: len(at) // 2]]) + halved(at[side[len(at) // 2 :]])

    return halved(np.arange(len(p)))


def _angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def _plan(pivots: dict, cells: list, size: int, angle: float) -> list[tuple]:
    """Rows (label, dim, cell, parts, part, task, passing): which task holds a part of a cell, which ones it passes by."""
    out = []
    known: dict = {}
    for r in cells:
        known.setdefault((r["label"], r["dim"]), {})[r["cell"]] = (r["n"], r["far"])
    for key, mine in known.items():
        p = pivots[key]
        units, task, held = [], 0, 0  # (cell, parts, part, task)
        for c in (c for c in _order(p) if c in mine):
            parts = -(-mine[c][0] // size)
            for part in range(parts):
                n = mine[c][0] / parts
                if held and held + n > size:
                    task, held = task + 1, 0
                held += n
                units.append((c, parts, part, task))
        groups = [sorted({c for c, _, _, t in units if t == s}) for s in range(task + 1)]
        far = np.array([mine[c][1] if c in mine else 0.0 for c in range(len(p))])
        near = [(_angles(p @ p[g].T) <= far[:, None] + far[g] + angle).any(axis=1) for g in groups]
        for c, parts, part, s in units:
            out.append((*key, c, parts, part, s, False))
            others = (t for t in range(task + 1) if t != s and (t < s) == ((t - s) % 2 == 1))
            out += [(*key, c, parts, part, t, True) for t in others if near[t][c]]
    return out


class _Pack:
    """Vectors of one cell: scaled by powers of two, inverse norms, shortened unit vectors, what was found."""

    def __init__(self, row, dtype, known: tuple | None) -> None:
        self.cell, self.far = row["cell"], row["far"]
        self.gid, self.copies = np.frombuffer(row["gids"], np.int64), np.frombuffer(row["copies"], np.int64)
        self.x = np.frombuffer(row["vectors"], dtype).reshape(row["n"], -1)
        x = self.x.astype(np.float64)
        self.scale = 1 / np.sqrt((x * x).sum(axis=1))
        x *= self.scale[:, None]
        self.short = _shortened(x, known and known[1])
        self.own = None if known is None else (x @ known[0][self.cell]).astype(np.float32)

    def dots(self, pivots: np.ndarray) -> np.ndarray:
        """Cosines with each of the pivots, by pivot."""
        return (pivots.astype(self.x.dtype) @ self.x.T * self.scale).astype(np.float32)

    def units(self, at: np.ndarray) -> np.ndarray:
        return self.x[at] * self.scale[at][:, None]


class _Meeting:
    """Compares packs of one label; collects numbers of links and spanning links."""

    def __init__(self, least: float, shared: tuple | None) -> None:
        self.least, self.r = least, math.sqrt(2 - 2 * least) + SLACK
        self.angle = 2 * math.asin(min(1.0, self.r / 2)) + SLACK
        self.pivots = None if shared is None else shared[0]
        self.room = np.empty(1 << 19, np.float32)
        self.rows = [np.empty((0, 0), np.float32)] * 2
        self.out: list[pd.DataFrame] = []

    def some(self, side: int, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of x in memory that is used again."""
        if len(self.rows[side]) < len(at):
            self.rows[side] = np.empty((2 * len(at), x.shape[1]), np.float32)
        return np.take(x, at, axis=0, out=self.rows[side][: len(at)], mode="clip")

    def found(self, a: _Pack, b: _Pack, i: np.ndarray, j: np.ndarray) -> None:
        """Links between the vectors i of a and j of b, without repeats."""
        if not len(i):
            return
        (left, i), (right, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        both = np.concatenate([a.gid[left], b.gid[right]])
        links = np.concatenate([np.bincount(i, b.copies[right][j]), np.bincount(j, a.copies[left][i])]).astype(np.int64)
        root = both.copy()
        while True:  # the smallest gid that links reach
            before = root.copy()
            low = np.minimum(root[i], root[len(left) + j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, len(left) + j, low)
            if (root == before).all():
                break
        self.out.append(pd.DataFrame({"gid": both, "links": links, "root": root}))

    def compare(self, a: _Pack, ia: np.ndarray, b: _Pack, ib: np.ndarray, fb: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of linked vectors among ia of a and ib of b, whose shortened vectors are fb."""
        left, right = [], []
        fb = self.some(1, b.short, ib) if fb is None else fb
        width = min(len(ib), 1024)
        step = len(self.room) // max(1, width)
        for s in range(0, len(ia), step):
            fa = self.some(0, a.short, ia[s : s + step])
            for t in range(0, len(ib), width):
                y = fb[t : t + width]
                met = np.matmul(fa, y.T, out=self.room[: len(fa) * len(y)].reshape(len(fa), len(y)))
                if met.max() < self.least - SLACK:
                    continue
                i, j = np.divmod(np.flatnonzero(met.ravel() >= self.least - SLACK), len(y))
                pa, pb = ia[s : s + step], ib[t : t + width]
                if len(i) * 16 > met.size:
                    i, j = np.divmod(np.flatnonzero((a.units(pa) @ b.units(pb).T).ravel() >= self.least), len(y))
                else:
                    keep = np.concatenate([np.einsum("ij,ij->i", a.units(pa[i[k : k + 8192]]), b.units(pb[j[k : k + 8192]])) >= self.least for k in range(0, len(i), 8192)])
                    i, j = i[keep], j[keep]
                left.append(pa[i])
                right.append(pb[j])
        return (np.concatenate(left), np.concatenate(right)) if left else (ia[:0], ib[:0])

    def inside(self, a: _Pack) -> None:
        every = np.arange(len(a.gid))
        i, j = self.compare(a, every, a, every)
        once = i < j
        self.found(a, a, i[once], j[once])

    def across(self, arrived: list[_Pack], held: list[_Pack]) -> None:
        """The links of packs that arrived with those held."""
        if not arrived or not held:
            return
        if self.pivots is None:
            for b in arrived:
                for a in held:
                    self.found(a, b, *self.compare(a, np.arange(len(a.gid)), b, np.arange(len(b.gid))))
            return
        p, q = (self.pivots[[x.cell for x in side]] for side in (held, arrived))
        near = _angles(p @ q.T) <= np.array([a.far for a in held])[:, None] + [b.far for b in arrived] + self.angle
        apart = np.sqrt(np.maximum(0, 2 - 2 * p @ q.T))
        at = [b.dots(p) for b in arrived]
        for k in np.flatnonzero(near.any(axis=1)):
            a = held[k]
            there = a.dots(q)
            for t in np.flatnonzero(near[k]):
                self.border(a, arrived[t], there[t], at[t][k], apart[k, t])

    def border(self, a: _Pack, b: _Pack, aq: np.ndarray, bp: np.ndarray, apart: float) -> None:
        """The links of a and b, given the cosines of each with the other's pivot and the distance of the pivots."""
        if a.cell == b.cell or apart < 1e-3:
            self.found(a, b, *self.compare(a, np.arange(len(a.gid)), b, np.arange(len(b.gid))))
            return
        da, db = (a.own - aq) / np.float32(apart), (b.own - bp) / np.float32(apart)  # distances to the border, on either side
        r = np.float32(self.r + SLACK / apart)
        ia, ib = np.flatnonzero(da <= r - db.min()), np.flatnonzero(db <= r - da.min())
        if not len(ia) or not len(ib):
            return
        ia, ib = ia[np.argsort(da[ia])], ib[np.argsort(db[ib])]
        da, db, fb = da[ia], db[ib], self.some(1, b.short, ib)
        edges = [0] + [e for e in (len(ia) >> k for k in range(6, 0, -1)) if e >= 16] + [len(ia)]
        got = []
        for s, e in zip(edges, edges[1:]):  # the few nearest to the border meet most
            n = np.searchsorted(db, r - da[s], side="right")
            if n:
                got.append(self.compare(a, ia[s:e], b, ib[:n], fb[:n]))
        if got:
            self.found(a, b, np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))


def similar_vectors(rows: DataFrame, least: float = 0.93, cell: int = 1024, block: int = 2048, pivots: int = 16384, group: int = 1 << 19) -> DataFrame:
    """Per row of rows (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    small_batches(spark, 4096)
    kind = rows.schema["embedding"].dataType.simpleString()
    dtype = np.float32 if kind == "array<float>" else np.float64
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    takes_part = F.coalesce(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    valid = rows.where(takes_part).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast(kind[6:-1])))  # no negative zeros
    valid = valid.withColumn("dim", F.size("embedding"))
    hashes = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding", F.reverse("embedding")).alias("h2")]
    chosen = _pivots(valid, cell, pivots)
    shared = spark.sparkContext.broadcast({k: (p, _axes(p, least)) for k, p in chosen.items()})  # bounded by `pivots`
    groups = valid.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("gid"), F.count("*").alias("copies")).select("*", *hashes)

    def assign(batches):
        for b in batches:
            out = []
            for key, x in b.groupby(["label", "dim"]):
                known = shared.value.get(key)
                if known is None:
                    out.append(x.assign(cell=0, away=0.0))
                    continue
                cos = unit(matrix(x["embedding"])) @ known[0].T
                own = cos.argmax(axis=1)
                out.append(x.assign(cell=own, away=_angles(cos[np.arange(len(x)), own])))
            if out:
                yield pd.concat(out)

    def pack(batches):
        def rows_of(x: pd.DataFrame):
            v = matrix(x["embedding"])
            v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]).astype(dtype)
            return (*x[_PLACE].iloc[0].tolist(), seq, len(x), x["away"].max(), *(x[c].to_numpy(np.int64).tobytes() for c in ("gid", "copies")), x[["h1", "h2"]].to_numpy(np.int64).tobytes(), v.tobytes())

        names = [c.split()[0] for c in _PACKS.split(", ")]
        rest, last, seq = None, None, 0
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            rest, ready = None, []
            edges = np.flatnonzero((b[_PLACE] != b[_PLACE].shift()).any(axis=1)).tolist() + [len(b)]
            for s, e in zip(edges, edges[1:]):
                place = tuple(b[_PLACE].iloc[s])
                last, seq = (last, seq) if place == last else (place, 0)
                while s < e and (e < len(b) or e - s >= block):
                    ready.append(rows_of(b.iloc[s : min(e, s + block)]))
                    s, seq = s + block, seq + 1
                if s < e:
                    rest = b.iloc[s:e]
            if ready:
                yield pd.DataFrame(ready, columns=names)
        if rest is not None and len(rest):
            yield pd.DataFrame([rows_of(rest)], columns=names)

    placed = groups.mapInPandas(assign, f"label long, dim int, embedding {kind}, gid long, copies long, h1 long, h2 long, cell int, away double")
    packs = written(placed.repartition(partitions(spark), *_PLACE).sortWithinPartitions(*_PLACE).mapInPandas(pack, _PACKS))
    angle = 2 * math.asin(min(1.0, math.sqrt(2 - 2 * least) / 2)) + 1e-6
    plan = []
    if chosen:
        cut = F.broadcast(spark.createDataFrame(list(chosen), "label long, dim int"))
        plan = _plan(chosen, packs.join(cut, ["label", "dim"]).groupBy(*_PLACE).agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect(), group, angle)
    plans = spark.createDataFrame(plan, "label long, dim int, cell int, parts int, part int, task int, passing boolean")
    at = packs.alias("k").join(F.broadcast(plans.alias("p")), F.expr("k.label = p.label AND k.dim = p.dim AND k.cell = p.cell AND k.seq % p.parts = p.part"), "left")
    sent = at.select("k.label", "k.dim", F.coalesce("task", F.lit(0)).alias("task"), F.coalesce("passing", F.lit(False)).alias("passing"), "k.cell", "k.n", "k.far", "k.gids", "k.copies", "k.vectors")

    def meet(batches):
        key, held, now = None, [], None
        for b in batches:
            for task, x in b.groupby(["label", "dim", "task"], sort=False):  # tasks follow each other, packs held come first
                known = shared.value.get(task[:2])
                if key != task:
                    key, held, now = task, [], _Meeting(least, known)
                arrived = [(r["passing"], _Pack(r, dtype, known)) for r in x.to_dict("records")]
                now.across([y for _, y in arrived], held)
                fresh = []
                for passing, y in arrived:
                    now.across([y], fresh)
                    if not passing:
                        now.inside(y)
                        fresh.append(y)
                held = held + fresh
                if now.out:
                    yield pd.concat(now.out)
                    now.out = []

    tasks = len({(p[0], p[1], p[5]) for p in plan})
    small_batches(spark, 16)
    sent = sent.repartition(max(partitions(spark), 4 * tasks), "label", "dim", "task").sortWithinPartitions("label", "dim", "task", "passing")
    found = written(sent.mapInPandas(meet, "gid long, links long, root long"))
    small_batches(spark, 4096)
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("gid").alias("u"), F.col("root").alias("v")))

    def unpack(batches):
        for b in batches:
            for label, *x in b.itertuples(index=False):
                gid, copies, h = (np.frombuffer(c, np.int64) for c in x)
                yield pd.DataFrame({"label": label, "gid": gid, "copies": copies, "h1": h[::2], "h2": h[1::2]})

    known = packs.select("label", "gids", "copies", "hashes").mapInPandas(unpack, "label long, gid long, copies long, h1 long, h2 long")
    known = known.join(links, "gid", "left").join(classes, F.col("gid") == F.col("node"), "left")
    known = known.select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "gid").alias("component_id"))
    linked = valid.select("vec_id", "label", *hashes).join(known, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
