"""Removal of repeated byte strings with suffix arrays.

A byte goes when a string of `length` bytes that covers it starts anywhere else. The search is exact and goes in
four steps.

1. Winnowing picks anchors: among the hashes of the k-byte strings in each `length` bytes the smallest is taken, so
   equal strings hold equal anchors at equal offsets. Anchors whose hash occurs once can't lie in a repeat. The inside
   of a long periodic stretch repeats itself and is marked at once; anchors stay near its ends.
2. The first text that holds an anchor leads it. Around a text's anchors of one leader the regions are cut that hold
   every string with one of them; overlapping regions are one.
3. Regions of one leader are dealt to one shard. A shard gets its suffix array by Larsson-Sadakane refinement and its
   common prefixes by Kasai's walk (along many stretches at once); strings whose common prefix with a neighbour
   reaches `length` are repeated.
4. Leaders with more than `hot_bytes` of regions (boilerplate, large families of copies) are dealt by anchor hash
   instead: contexts, equal ones collapsed, then shards by hash, merged by binary search in their sorted strings. A
   hash with more contexts than a shard holds is dealt anew by longer keys, each the bytes common to a few
   neighbouring strings, which keeps every repeat in one group.

Defined cases: null text is empty; matches never cross texts; overlapping occurrences within a text count; repeated
rows are occurrences like any others; doc_id may be null or repeat; very long texts are taken whole, in overlapping
stretches; the empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWERS, mix, prefix_sums, small_batches, written

_LOW = np.uint64((1 << 28) - 1)


def winnow(data: np.ndarray, length: int, k: int, stretch: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors: one at least in every `length` bytes, chosen by content alone."""
    if len(data) > stretch + length:  # every `length` bytes lie in one stretch
        found = [(lo, *winnow(data[lo : lo + stretch + length], length, k, stretch)) for lo in range(0, len(data) - length + 1, stretch)]
        at, first = np.unique(np.concatenate([lo + a for lo, a, _ in found]), return_index=True)
        return at, np.concatenate([h for *_, h in found])[first]
    n, w = len(data) - k + 1, length - k + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    _, down = POWERS.upto(len(sums))
    h = mix((sums[k:] - sums[:-k]) * down[:n])
    v = (h & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))  # of equal ones the last
    rows = -(-n // w)
    padded = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = v
    block = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    at = (_LOW - (least[new] & _LOW)).astype(np.int64)
    return at, h[at]


def without_periods(at: np.ndarray, fp: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The anchors without those deep inside periodic stretches, and these stretches: they repeat themselves.

    Equal anchors in a row at equal distances p make the bytes from the first to the end of the last periodic. If they
    are length + p or more, each string inside occurs p further on or back. All strings of the period lie at the
    stretch's start too, so other texts meet them at anchors that stay.
    """
    if len(at) < 8:
        return at, fp, []
    gap = np.diff(at)
    same = fp[1:] == fp[:-1]
    new = np.ones(len(gap), bool)
    new[1:] = ~(same[1:] & same[:-1] & (gap[1:] == gap[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(gap)) - 1
    spans, stay = [], np.ones(len(at), bool)
    for lo, hi in zip(first[same[first]], last[same[first]]):
        start, end, p = int(at[lo]), int(at[hi + 1]) + k, int(gap[lo])
        if p <= length - k and end - start >= length + p:
            spans.append((start, end))
            stay[lo : hi + 2] &= ~((at[lo : hi + 2] >= start + 3 * length) & (at[lo : hi + 2] + length <= end))
    return at[stay], fp[stay], spans


def _words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    return key


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: groups of equal ranks are refined by the ranks h further on, h doubling; sorted groups rest."""
    n = len(text)
    key, h = _words8(text), 8
    if (text == 0).any() and (text[-8:] == 0).any():  # padding isn't text: it could tie with real zeros
        key, h = text.astype(np.uint64), 1
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_ = _open_places(new)
    while len(open_) and h < 2 * n:
        at = order[open_]
        key = (rank[at] << 32) + np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        o = np.argsort(key)
        at, key = at[o], key[o]
        order[open_] = at
        start = np.ones(len(at), bool)
        start[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(start, open_, 0))
        alone = start.copy()
        alone[:-1] &= start[1:]
        open_ = open_[~alone]
        h *= 2
    return order


def _open_places(new: np.ndarray) -> np.ndarray:
    alone = new.copy()
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, stretch: int = 256) -> np.ndarray:
    """Kasai's walk, along many stretches at once: lcp[r] of suffixes order[r - 1] and order[r], counted up to most."""
    n = len(text)
    words = np.append(_words8(text), np.uint64(0))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    lcp = np.zeros(n, np.int64)
    starts = np.arange(0, n, stretch)
    l = np.zeros(len(starts), np.int64)
    for step in range(min(stretch, n)):
        i = starts + step
        if i[-1] >= n:
            starts, l, i = starts[:-1], l[:-1], i[:-1]
        j = before[i]
        cur = np.maximum(l - 1, 0)
        grow = np.flatnonzero((j >= 0) & (cur < most))
        while len(grow):
            at = cur[grow]
            x = words[np.minimum(i[grow] + at, n)] ^ words[np.minimum(j[grow] + at, n)]
            equal = sum((x < np.uint64(1 << (64 - 8 * b))).astype(np.int64) for b in range(1, 8)) + (x == 0)
            cur[grow] = at + equal
            grow = grow[(equal == 8) & (at + 8 < most) & (at + 8 < n - np.maximum(i[grow], j[grow]))]
        l = np.where(j >= 0, np.minimum(np.minimum(cur, most), n - np.maximum(i, j)), 0)
        lcp[i] = l
    return lcp[order]


def region_repeats(regions: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per region the merged spans that its repeated strings cover. Regions share no place of any text."""
    text = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8)
    size = np.array([len(r) + 1 for r in regions])
    ends = np.cumsum(size)
    order = suffix_array(text)
    run = np.cumsum(common_prefixes(text, order, length) < length) - 1
    which = np.repeat(np.arange(len(regions)), size)
    ok = np.arange(len(text)) + length <= (ends - 1)[which]  # strings that end in their region
    count = np.bincount(run, weights=ok[order])
    again = np.zeros(len(text), bool)
    again[order] = count[run] > 1
    hit = np.flatnonzero(again & ok)
    cut = np.searchsorted(hit, ends)
    begin = ends - size
    return [merged(hit[a:b] - s, hit[a:b] - s + length) for a, b, s in zip(np.append(0, cut[:-1]), cut, begin)]


def shard_spans(rid: np.ndarray, start: np.ndarray, ctx: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, s, e) of what repeats among a shard's regions; regions of a text that overlap become one."""
    order = np.lexsort((start, rid))
    joined: list[tuple[int, int, bytearray]] = []
    for i in order.tolist():
        r, s, c = int(rid[i]), int(start[i]), ctx[i]
        if joined and joined[-1][0] == r and s <= joined[-1][1] + len(joined[-1][2]):
            joined[-1][2].extend(c[joined[-1][1] + len(joined[-1][2]) - s :])
        else:
            joined.append((r, s, bytearray(c)))
    found = region_repeats([bytes(c) for *_, c in joined], length)
    n = [len(a) for a, _ in found]
    base = np.repeat([s for _, s, _ in joined], n)
    return np.repeat([r for r, *_ in joined], n), np.concatenate([a for a, _ in found]) + base, np.concatenate([b for _, b in found]) + base


def _shard_repeats(contexts: list[bytes], group: np.ndarray, left: np.ndarray, length: int) -> tuple[list[np.ndarray], list[tuple[bytes, int, int, int]]]:
    """For one shard: per context the starts of strings that another context of its group has at the same offset; and
    the sorted other strings, as (string, group, offset, context)."""
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    size = np.array([len(c) + 1 for c in contexts])
    starts = np.cumsum(size) - size
    order = suffix_array(text)
    lcp = common_prefixes(text, order, length)
    run = np.empty(len(text), np.int64)
    run[order] = np.cumsum(lcp < length)
    which = np.repeat(np.arange(len(contexts)), size)
    local = np.arange(len(text)) - starts[which]
    ok = local + length <= size[which] - 1
    at = np.flatnonzero(ok)
    keys = np.stack([run[at], group[which[at]], left[which[at]] - local[at]])
    o = np.lexsort(keys[::-1])
    s = keys[:, o]
    new = np.ones(len(o), bool)
    new[1:] = (s[:, 1:] != s[:, :-1]).any(axis=0)
    count = np.diff(np.append(np.flatnonzero(new), len(o)))
    many = np.empty(len(at), bool)
    many[o] = np.repeat(count, count) > 1
    found = [np.zeros(0, np.int64)] * len(contexts)
    hit = at[many]
    for c, rows in zip(*_grouped(which[hit], local[hit])):
        found[c] = rows
    return found, (text, at, which, local, keys, np.flatnonzero(new), o)


def _grouped(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(key):
        return np.zeros(0, np.int64), []
    cut = np.flatnonzero(np.diff(key)) + 1
    return key[np.append(0, cut)], np.split(value, cut)


def task_repeats(contexts: list[bytes], group: np.ndarray, left: np.ndarray, length: int, shard_bytes: int) -> list[np.ndarray]:
    """Per context the starts of its repeated strings. Contexts come ordered by group."""
    size = np.cumsum([len(c) for c in contexts])
    shard = size // shard_bytes
    cuts = np.append(np.append(0, np.flatnonzero(np.diff(shard)) + 1), len(contexts))
    out: list[np.ndarray] = []
    runs: list[tuple[list[tuple[int, int, bytes]], list[list[tuple[int, int]]]]] = []
    split = {int(group[c]) for c in cuts[1:-1] if group[c] == group[c - 1]}  # groups that two shards share
    for lo, hi in zip(cuts, cuts[1:]):
        found, (text, at, which, local, keys, firsts, o) = _shard_repeats(contexts[lo:hi], group[lo:hi], left[lo:hi], length)
        out += found
        if split:
            bounds = np.append(firsts, len(o))
            strings: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
            for a, b in zip(bounds, bounds[1:]):
                p = at[o[a]]
                if int(keys[1, o[a]]) in split:
                    strings[(int(keys[1, o[a]]), int(keys[2, o[a]]), text[p : p + length].tobytes())] = [(int(which[at[x]]) + int(lo), int(local[at[x]])) for x in o[a:b]]
            k = sorted(strings)
            runs.append((k, [strings[x] for x in k]))
    extra: dict[int, set[int]] = {}
    for a in range(len(runs)):  # binary search of each shard's strings in the later shards' sorted ones
        for b in range(a + 1, len(runs)):
            for x, places in zip(*runs[a]):
                p = bisect_left(runs[b][0], x)
                if p < len(runs[b][0]) and runs[b][0][p] == x:
                    for c, s in places + runs[b][1][p]:
                        extra.setdefault(c, set()).add(s)
    for c, more in extra.items():
        out[c] = np.union1d(out[c], list(more)).astype(np.int64)
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as maximal runs in order."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


def _anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                raw = t.encode("utf-8", "surrogatepass")
                at, h, sure = without_periods(*winnow(np.frombuffer(raw, np.uint8), length, k), length, k)
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), at.astype(np.int32), h.view(np.int64), [x for x, _ in sure], [x for _, x in sure]))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "key": b["key"]}).join(pd.DataFrame(out, columns=["n_bytes", "sha", "at", "fp", "sure_s", "sure_e"]))

    return docs.select("doc_id", "key", "text").mapInPandas(run, "doc_id long, key string, n_bytes long, sha string, at array<int>, fp array<long>, sure_s array<int>, sure_e array<int>")


def _regions(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Rows (leader, rid, start, ctx): a text's regions around its anchors of one leader."""
    reach = length - k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, t, at, leader in zip(b["rid"], b["text"], b["at"], b["leader"]):
                raw = t.encode("utf-8", "surrogatepass")
                o = np.lexsort((at, leader))
                at, leader = at[o].astype(np.int64), leader[o]
                s, e = np.maximum(at - reach, 0), np.minimum(at + length, len(raw))
                new = np.ones(len(at), bool)
                new[1:] = (leader[1:] != leader[:-1]) | (s[1:] > e[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                out += [(x, rid, i, raw[i:j]) for x, i, j in zip(leader[first].tolist(), s[first].tolist(), e[last].tolist())]
            yield pd.DataFrame(out, columns=["leader", "rid", "start", "ctx"])

    return texts.select("rid", "text", "at", "leader").mapInPandas(run, "leader long, rid long, start int, ctx binary")


def _contexts(texts: DataFrame, length: int, k: int, bytes_too: bool) -> DataFrame:
    """Rows (fp, rid, at, left, size, digest) for the listed anchors of each text; and the context's bytes, if asked."""
    reach = length - k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rid, t, at, fp in zip(b["rid"], b["text"], b["at"], b["fp"]):
                raw = t.encode("utf-8", "surrogatepass")
                lefts = np.minimum(at, reach)
                ctx = [raw[a - l : a + length] for a, l in zip(at, lefts)]
                out = {"fp": fp, "rid": rid, "at": at, "left": lefts, "size": list(map(len, ctx)), "digest": [hashlib.blake2b(c, digest_size=16, salt=int(l).to_bytes(8, "little")).digest() for c, l in zip(ctx, lefts)]}
                yield pd.DataFrame(out | {"ctx": ctx} if bytes_too else out)

    return texts.select("rid", "text", "at", "fp").mapInPandas(run, "fp long, rid long, at int, left int, size int, digest binary" + ", ctx binary" * bytes_too)


def repeated_spans(docs: DataFrame, length: int = 200, k: int = 64, shard_bytes: int = 1 << 20, hot_bytes: int = 1 << 21) -> tuple[DataFrame, DataFrame, DataFrame]:
    """anchors (a row for each of docs), texts (rid, key, text of those with candidates), spans (rid, s, e: arrays)."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("key"))
    anchors = written(_anchors(keyed, length, k))
    # of equal texts one stands for all; from here on by a short id
    copies = anchors.where(F.col("n_bytes") >= length).groupBy("key").agg(F.min("doc_id").alias("chosen"))
    ours = anchors.select("key", "doc_id", "at", "fp", "sure_s", "sure_e").join(copies, "key").where(F.col("doc_id").eqNullSafe(F.col("chosen"))).dropDuplicates(["key"])
    ours = written(ours.withColumn("rid", F.monotonically_increasing_id()))
    each = ours.select("rid", F.explode(F.arrays_zip("at", "fp")).alias("x")).select("rid", "x.at", "x.fp")
    shared = written(each.groupBy("fp").agg(F.count("*").alias("n"), F.min("rid").alias("leader")).where("n > 1").select("fp", "leader"))
    wanted = each.join(shared, "fp").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", "fp", "leader"))).alias("x"))
    wanted = wanted.select("rid", *[F.col(f"x.{c}").alias(c) for c in ("at", "fp", "leader")])
    wanted = wanted.join(ours.select("rid", F.col("key").alias("k2"), "chosen", "sure_s", "sure_e"), "rid")
    texts = keyed.join(wanted, (F.col("key") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("chosen")))
    texts = written(texts.select("rid", "key", "text", "at", "fp", "leader", "sure_s", "sure_e"))
    regions = written(_regions(texts, length, k))
    groups = regions.groupBy("leader").agg(F.sum(F.length("ctx")).alias("bytes"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 or bytes > 0"))
    total = groups.where(F.col("bytes") <= hot_bytes).agg(F.sum("bytes")).first()[0] or 0
    tasks = int(total // (2 * shard_bytes)) + 1
    calm = regions.join(groups.where(F.col("bytes") <= hot_bytes).select("leader"), "leader", "left_semi")

    def sort_regions(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("leader", kind="stable")
        leader, size = x["leader"].to_numpy(), x["ctx"].map(len).to_numpy()
        shard = np.maximum.accumulate(np.where(np.append(True, leader[1:] != leader[:-1]), (np.cumsum(size) - size) // shard_bytes, 0))  # a leader's regions stay together
        out = []
        for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(shard)) + 1):
            rid, s, e = shard_spans(x["rid"].to_numpy()[part], x["start"].to_numpy()[part], x["ctx"].iloc[part].tolist(), length)
            out.append(pd.DataFrame({"rid": rid, "s": s, "e": e}))
        return pd.concat(out)

    calm = calm.withColumn("task", F.pmod(F.xxhash64("leader"), F.lit(tasks))).groupBy("task").applyInPandas(sort_regions, "rid long, s int, e int")
    sure = texts.select("rid", F.explode(F.arrays_zip("sure_s", "sure_e")).alias("x")).select("rid", F.col("x.sure_s").alias("s"), F.col("x.sure_e").alias("e"))
    spans = calm.union(sure)
    hot = groups.where(F.col("bytes") > hot_bytes).select("leader")
    if not hot.isEmpty():
        spans = spans.union(_hot_spans(texts, hot, length, k, shard_bytes))
    spans = spans.groupBy("rid").agg(F.collect_set(F.struct("s", "e")).alias("x"))
    return anchors, texts, spans.select("rid", F.col("x.s").alias("s"), F.col("x.e").alias("e"))


def _hot_spans(texts: DataFrame, hot: DataFrame, length: int, k: int, shard_bytes: int) -> DataFrame:
    """Rows (rid, s, e) for the anchors of hot leaders, dealt by hash."""
    each = texts.select("rid", F.explode(F.arrays_zip("at", "fp", "leader")).alias("x")).select("rid", "x.at", "x.fp", "x.leader")
    listed = each.join(hot, "leader", "left_semi").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", "fp"))).alias("x")).select("rid", F.col("x.at").alias("at"), F.col("x.fp").alias("fp"))
    texts = written(texts.select("rid", "text").join(listed, "rid"))
    members = written(_contexts(texts, length, k, False))
    classes = written(members.groupBy("fp", "digest", "left", "size").agg(F.count("*").alias("n"), F.min("rid").alias("rid")))
    whole = classes.where((F.col("n") > 1) & (F.col("size") >= length)).select("fp", "digest", (-F.col("left")).alias("a"), (F.col("size") - F.col("left")).alias("b"))
    # only hashes with two classes or more need sorting, and of each class one context
    several = classes.groupBy("fp").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes"), F.min("n").alias("least")).where("kinds > 1 and least = 1").drop("least")
    sought = written(classes.where(F.col("size") >= length).join(several, "fp").select("fp", "digest", "rid", "bytes"))
    total = sought.join(classes.select("fp", "digest", "size"), ["fp", "digest"]).agg(F.sum("size")).first()[0] or 0
    of_class = members.join(sought.withColumnRenamed("rid", "r2"), ["fp", "digest"]).where("rid = r2").groupBy("fp", "digest", "rid", "bytes").agg(F.min("at").alias("at"))
    listed = of_class.groupBy("rid").agg(F.collect_list(F.struct("at", "fp")).alias("x")).select("rid", F.col("x.at").alias("at"), F.col("x.fp").alias("fp"))
    fetched = _contexts(texts.select("rid", "text").join(listed, "rid"), length, k, True)
    open_ = fetched.join(sought.select("fp", "digest", "bytes"), ["fp", "digest"]).dropDuplicates(["fp", "digest"])
    open_ = written(open_.select("fp", "digest", "left", "ctx", "bytes"))
    calm = open_.where(F.col("bytes") <= shard_bytes).select(F.col("fp").alias("group"), "fp", "digest", "left", "ctx")
    # large groups: by the bytes that all strings from `off` to `off + width` before the anchor share
    width = 16
    off = F.explode(F.sequence(F.lit(0), F.lit(length - k), F.lit(width + 1)))
    hot = open_.where(F.col("bytes") > shard_bytes).withColumn("off", off)
    begin, end = F.greatest(F.col("left") - F.col("off") - width, F.lit(0)), F.least(F.length("ctx"), F.col("left") - F.col("off") + length)
    key_at = F.col("left") - F.col("off")
    hot = hot.where((key_at >= 0) & (key_at - width + length <= F.length("ctx")))
    hot = hot.withColumn("group", F.xxhash64("fp", "off", F.expr(f"substring(ctx, left - off + 1, {length - width})")))
    hot = hot.withColumn("sub", F.substr("ctx", begin + 1, end - begin)).select("group", "fp", "digest", (F.col("left") - begin).alias("left"), F.col("sub").alias("ctx"))
    hot = hot.where(F.length("ctx") >= length).withColumn("sub", F.unhex(F.md5("ctx")))
    hot = written(hot)
    # equal parts collapse once more: two or more are repeated as a whole
    parts = written(hot.groupBy("group", "sub", "left").agg(F.count("*").alias("n"), F.first("ctx").alias("ctx"), F.min("fp").alias("fp"), F.min("digest").alias("digest")))
    twice = hot.drop("ctx").join(parts.where("n > 1").select("group", "sub", "left", F.length("ctx").alias("size")), ["group", "sub", "left"]).select("fp", "digest", (-F.col("left")).alias("a"), (F.col("size") - F.col("left")).alias("b"))
    whole = whole.union(twice)
    met = parts.groupBy("group").count().where("count > 1").select("group")
    dealt = calm.union(parts.join(met, "group").select("group", "fp", "digest", "left", "ctx"))
    tasks = max(1, int(total // (shard_bytes * 2)) + 1)
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("group"), F.lit(tasks)))

    def search(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["group", "digest", "left"])
        found = task_repeats(x["ctx"].tolist(), x["group"].to_numpy(), x["left"].to_numpy(), length, shard_bytes)
        out = []
        for fp, digest, left, s in zip(x["fp"], x["digest"], x["left"], found):
            for a, b in zip(*merged(s, s + length)):
                out.append((fp, digest, a - left, b - left))
        return pd.DataFrame(out, columns=["fp", "digest", "a", "b"])

    sorted_ = dealt.groupBy("task").applyInPandas(search, "fp long, digest binary, a int, b int")
    covered = whole.union(sorted_).groupBy("fp", "digest").agg(F.collect_set(F.struct("a", "b")).alias("parts"))
    spans = members.select("fp", "digest", "rid", "at").join(covered, ["fp", "digest"]).select("rid", "at", F.explode("parts").alias("p"))
    return spans.select("rid", (F.col("at") + F.col("p.a")).alias("s"), (F.col("at") + F.col("p.b")).alias("e"))


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    anchors, texts, spans = repeated_spans(docs, length)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, t, s, e in zip(b["key"], b["text"], b["s"], b["e"]):
                raw = t.encode("utf-8", "surrogatepass")
                s, e = merged(np.asarray(s, np.int64), np.asarray(e, np.int64))
                kept = b"".join(raw[i:j] for i, j in zip(np.append(0, e), np.append(s, len(raw))))
                out.append((key, len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["key", "gone", "spans", "kept"])

    partial = texts.select("rid", "key", "text").join(spans, "rid").drop("rid").mapInPandas(cut, "key string, gone long, spans long, kept string").dropDuplicates(["key"])
    copies = anchors.groupBy("key").agg(F.count("*").alias("copies"))
    known = copies.join(partial, "key", "left").where("copies > 1 or gone is not null")
    out = anchors.select("doc_id", "key", "n_bytes", "sha").join(known, "key", "left")
    all_gone = F.coalesce((F.col("copies") > 1) & (F.col("n_bytes") >= length), F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    pick = lambda whole, part, none: F.when(all_gone, whole).otherwise(F.coalesce(part, none))
    return out.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("gone"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(nothing), F.col("kept"), F.col("sha")).alias("kept_sha256"),
    )
