"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its words (lower-cased letters and digits). A sketch takes, under each of `sketches`
hash functions, the `per_sketch` smallest occurrence-labelled five-word k-mers and keeps their text order; each
becomes a bucket key, so that documents with small edit distance are likely to meet. Pairs that share a bucket are
candidates; a pair is linked when a banded alignment of its words in order matches m of them with
2 m / (a + b) >= threshold. Classes are the connected components of the links.

Copies (equal word sequences) are collapsed first. In a bucket, members are first held against its hub - the member
that most others share buckets with. The pairs of a bucket that the links so far leave apart are then compared in
blocks: each member's best partner is aligned first, then every pair still apart. An exact bound (the two-word runs
that an alignment above the threshold must share, counted in bins) rules out pairs that cannot link; all others are
aligned, without a cap.

Defined cases: texts without a word (null, empty, punctuation) link with nothing and are a class of their own; texts
of fewer than five words are one k-mer, so only copies of them link; rows count by their own text also where they
share a doc_id; of repeated rows one is kept; a class is named by its smallest doc_id, rows with a null doc_id take
part and come last (a class of such rows only has a null name); the empty table gives no rows; very long texts are
taken whole; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, labelled, mix, runs_of, small_batches, word_hashes, written


def order_minhash(labels: np.ndarray, sketches: int, per_sketch: int) -> np.ndarray:
    """One bucket key per sketch from the occurrence-labelled k-mers."""
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    take = min(per_sketch, len(labels))
    keys = seeds.copy()
    step = max(1, (1 << 18) // len(labels))  # bounds the memory for very long texts
    for lo in range(0, sketches, step):
        seed = seeds[lo : lo + step, None]
        g = (labels[None, :] ^ seed) * (seed | np.uint64(1))  # labels are well mixed
        rows, at = np.arange(len(g)), np.empty((len(g), take), np.int64)
        for k in range(take):
            at[:, k] = g.argmin(axis=1)
            g[rows, at[:, k]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at.sort(axis=1)
        for k in range(take):
            keys[lo : lo + step] = mix(keys[lo : lo + step] * np.uint64(0x9FB21C651E98DF25) + labels[at[:, k]])
    return keys


def least_matches(a: int, b: int, threshold: float) -> int:
    return math.ceil(threshold / 2 * (a + b) - 1e-9)


def banded_matches(a: list[int], b: list[int], need: int) -> int:
    """The longest common subsequence of a and b if it is at least need, else a number below need.

    Only the band of diagonals that so many matches allow is filled, a column of it at a time as the bits of one
    integer: a 0 at place i says that one more match ends at a[i].
    """
    low, high = need - len(a), len(b) - need  # j - i stays between
    if low > 0 or high < 0:
        return 0
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    found, base, stride = 0, 0, 64
    state = 0  # ones stand for places not matched; inverted, so that places above the band are 0
    for lo in range(0, len(b), stride):
        hi = min(lo + stride, len(b))
        start = max(0, min(len(a), lo - high))  # places before it are out of the band from here on
        if start > base:
            found += (state & ((1 << (start - base)) - 1)).bit_count()
            state >>= start - base
            base = start
        width = min(len(a), hi - low) - base
        if width <= 0:
            continue
        full = (1 << width) - 1
        v = full & ~state
        for x in b[lo:hi]:
            m = at.get(x)
            if m:
                u = v & (m >> base)
                if u:
                    v = ((v + u) | (v - u)) & full
        state = full & ~v
    return found + state.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the words of a and b align in order to at least the threshold."""
    need = least_matches(len(a), len(b), threshold)
    if min(len(a), len(b)) < need:
        return False
    a, b = a.tolist(), b.tolist()
    if (Counter(a) & Counter(b)).total() < need:  # bounds the matches from above
        return False
    return banded_matches(a, b, need) >= need


def profile(words: np.ndarray, bits: int = 10) -> np.ndarray:
    """Counts of the two-word runs in 2**bits bins, up to 255; the last four bytes hold what did not fit."""
    counts = np.bincount((runs_of(words, 2) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if len(words) > 1 else np.zeros(1 << bits, np.int64)
    kept = np.minimum(counts, 255).astype(np.uint8)
    return np.concatenate([kept, np.frombuffer(np.uint32((counts - kept).sum()).tobytes(), np.uint8)])


def profiles_allow(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of many may reach the threshold with one (never wrongly no), and the bound's share of what is needed.

    m matches with (a - m) + (b - m) words left over are parted in as many places at most, so they hold at least
    m - 1 - (a + b - 2m) two-word runs; no more runs can be equal than the bins have in common.
    """
    common = np.minimum(many[:, :-4], one[None, :-4]).sum(axis=1, dtype=np.int64)
    over = np.ascontiguousarray(many[:, -4:]).view(np.uint32).ravel().astype(np.int64)
    common += np.minimum(over, int(one[-4:].view(np.uint32)[0]))
    both = n_one + n_many
    need = np.ceil(threshold / 2 * both - 1e-9)
    fits = (np.minimum(n_one, n_many) >= need) & (common >= 3 * need - both - 1)
    return fits, common / np.maximum(both, 1)


def text_key() -> Column:
    """What stands for a row's text in joins."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _sketch(docs: DataFrame, k: int, sketches: int, per_sketch: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, digest, keys = [], [], []
            for text in b["text"]:
                w = word_hashes(text if isinstance(text, str) else None)
                n.append(len(w))
                digest.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest())
                keys.append(order_minhash(labelled(runs_of(w, k)), sketches, per_sketch).view(np.int64) if len(w) else np.zeros(0, np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"], "n": n, "digest": digest, "keys": keys})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return rows.mapInPandas(run, "doc_id long, text_key binary, n int, digest binary, keys array<long>").withColumn("rid", F.monotonically_increasing_id())


def _words(texts: DataFrame) -> DataFrame:
    """Rows (id, h, profile) of rows (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = [word_hashes(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "h": [x.view(np.int64) for x in w], "profile": [profile(x).tobytes() for x in w]})

    return texts.select("id", "text").mapInPandas(run, "id long, h array<long>, profile binary")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, sketches: int = 24, per_sketch: int = 2) -> DataFrame:
    """Per row of docs: doc_id, text_key (digest of the text), class_id (the smallest doc_id of its class), kept (true for one row of each class)."""
    small_batches(docs.sparkSession)
    sketch = written(_sketch(docs, k, sketches, per_sketch))
    some = sketch.where("n > 0")
    copies = some.groupBy("digest").agg(F.min(F.struct("rid", "doc_id", "text_key")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    copies = written(copies.select("digest", F.col("rep.rid").alias("id"), F.col("rep.doc_id").alias("d2"), F.col("rep.text_key").alias("k2"), "n", "keys"))
    classes = _components(docs, copies, threshold)
    named = copies.select("digest", "id").join(classes, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("class_"))
    placed = written(some.select("rid", "doc_id", "text_key", "digest").join(named, "digest").drop("digest"))
    first = written(placed.groupBy("class_").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first")))  # so that the join can be split
    out = placed.join(first, "class_").select("doc_id", "text_key", F.col("first.doc_id").alias("class_id"), (F.col("rid") == F.col("first.rid")).alias("kept"))
    alone = sketch.where("n = 0").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return out.union(alone)


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, class_id, kept."""
    return near_duplicates(docs).select("doc_id", "class_id", "kept")


def without_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class stays; columns as they are."""
    kept = written(near_duplicates(docs, threshold).where("kept").groupBy(F.col("doc_id").alias("d_"), F.col("text_key").alias("k_")).count())
    held = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("d_"), text_key().alias("k_"))
    same = lambda other: held["d_"].eqNullSafe(other["d_"]) & (held["k_"] == other["k_"])
    rows = held.join(kept, same(kept), "left_semi")
    # rows that were given several times, where fewer of them stay
    given = held.groupBy("d_", "k_").agg(F.count("*").alias("given")).where("given > 1")
    many = written(given.join(kept, given["d_"].eqNullSafe(kept["d_"]) & (given["k_"] == kept["k_"])).where("given > count").select(given["d_"], given["k_"]))
    once = rows.join(many, rows["d_"].eqNullSafe(many["d_"]) & (rows["k_"] == many["k_"]), "left_anti")
    some = rows.join(many, rows["d_"].eqNullSafe(many["d_"]) & (rows["k_"] == many["k_"]), "left_semi").dropDuplicates(["d_", "k_"])
    return once.union(some).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _components(docs: DataFrame, copies: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, component) for the representatives of copies that have links."""
    share = threshold / (2 - threshold)  # the least ratio of sizes
    each = copies.select(F.explode(F.array_distinct("keys")).alias("key"), "id", "n")
    sizes = written(each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = written(each.join(sizes, "key"))
    rank = members.groupBy("id").agg(F.sum("size").alias("shared"))
    hubs = members.join(rank, "id").groupBy("key").agg(F.max(F.struct("shared", (-F.col("id")).alias("minus"), "n")).alias("hub"))
    hubs = written(hubs.select("key", F.col("hub.shared").alias("shared"), (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("hub_n")))
    near = F.least("n", "hub_n") >= share * F.greatest("n", "hub_n") - 1e-9
    stars = written(members.join(hubs, "key").where(near & (F.col("id") != F.col("hub"))).groupBy("id", "hub").agg(F.max("shared").alias("shared")))
    wanted = copies.join(members.select("id").distinct(), "id", "left_semi").select("id", "d2", "k2")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    texts = texts.join(wanted, (F.col("text_key") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("d2"))).groupBy("id").agg(F.first("text").alias("text"))
    arrays = written(_words(texts))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that are links."""
        both = pairs.join(arrays.select(F.col("id").alias("u"), F.col("h").alias("a")), "u").join(arrays.select(F.col("id").alias("v"), F.col("h").alias("b")), "v")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                ok = [aligned(np.asarray(a), np.asarray(b), threshold) for a, b in zip(x["a"], x["b"])]
                yield x.loc[ok, ["u", "v"]]

        return both.select("u", "v", "a", "b").mapInPandas(run, "u long, v long")

    first = stars.groupBy("id").agg(F.max(F.struct("shared", (-F.col("hub")).alias("minus"))).alias("best")).select(F.col("id").alias("u"), (-F.col("best.minus")).alias("v"))
    first = written(first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    edges = written(verified(first))
    # the other stars, but for pairs that have a linked neighbour in common
    low = written(edges.select(F.col("v").alias("x"), F.col("u").alias("low")).union(edges.select(F.col("u").alias("x"), F.col("u").alias("low"))).groupBy("x").agg(F.min("low").alias("low")))
    rest = stars.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct().join(first, ["u", "v"], "left_anti")
    for c in ("u", "v"):
        rest = rest.join(low.select(F.col("x").alias(c), F.col("low").alias(f"l{c}")), c, "left")
    edges = edges.union(verified(rest.where(F.coalesce("lu", "u") != F.coalesce("lv", "v")).select("u", "v")))
    classes = connected_components(edges)
    held = copies.select("id", "keys").join(arrays, "id")
    more = written(_across(members, classes, held, threshold))
    if more.isEmpty():
        return classes
    spanning = classes.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    return connected_components(spanning.union(more))


def block_links(words: list[np.ndarray], bins: np.ndarray, keys: np.ndarray, key: int, classes: np.ndarray, halves: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """Links that join all linked members of a bucket which are in different classes; of pairs with the most in common first.

    A pair counts in the first bucket that it shares; with halves, only pairs across them count.
    """
    n = np.array(list(map(len, words)))
    earlier = keys[:, : int(np.flatnonzero(keys[0] == key)[0])]
    found = []
    for i in range(len(n)):
        js = np.flatnonzero(classes[i + 1 :] != classes[i]) + i + 1
        if halves is not None:
            js = js[halves[js] != halves[i]]
        js = js[~(earlier[js] == earlier[i]).any(axis=1)]
        if len(js):
            ok, bound = profiles_allow(bins[i], bins[js], n[i], n[js], threshold)
            found.append((np.full(int(ok.sum()), i), js[ok], bound[ok]))
    if not found:
        return []
    left, right, bound = map(np.concatenate, zip(*found))
    order = np.argsort(-bound, kind="stable")
    label = classes.copy()
    out = []
    for i, j in zip(left[order].tolist(), right[order].tolist()):
        if label[i] != label[j] and aligned(words[i], words[j], threshold):
            label[label == label[j]] = label[i]
            out.append((i, j))
    return out


def _across(members: DataFrame, classes: DataFrame, held: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """Links (u, v) between members of one bucket that are in two classes.

    A bucket is compared in pairs of blocks, which bounds a task. Pairs are aligned where the profiles do not rule
    out a link and no link found in the block has joined their classes.
    """
    placed = members.select("key", "id").join(classes, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    placed = written(placed)
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.ceil(F.count("*") / block).alias("blocks")).where("low < high").select("key", "blocks")
    placed = placed.join(written(mixed), "key").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).join(held, "id")

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        key, lo, hi = (x[name].iat[0] for name in ("key", "lo", "hi"))
        x = x.sort_values("id")
        bins = np.frombuffer(b"".join(x["profile"]), np.uint8).reshape(len(x), -1)
        found = block_links(x["h"].tolist(), bins, np.stack(x["keys"].to_numpy()), key, x["c"].to_numpy().copy(), x["mine"].to_numpy() if lo != hi else None, threshold)
        ids = x["id"].to_numpy()
        return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["u", "v"], dtype="int64")

    return spread.select("key", "lo", "hi", "mine", "id", "c", "keys", "profile", "h").groupBy("key", "lo", "hi").applyInPandas(compare, "u long, v long")
