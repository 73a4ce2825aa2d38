"""Line deduplication by pairwise alignment.

Documents that share a run of consecutive lines of `anchor_chars` characters or more become a pair: every such run,
mostly one line, leads from each later holder to its earliest holder. A pair is aligned by patience diff (lines unique
in both, longest increasing run, recursion between them) and the common blocks of `anchor_chars` characters or more go from the later document. Shared runs with lines still in place are then
held against their further earlier holders, in blocks of doubling size, until they go or no holder is left: the
result is that of all pairs. Order is by doc_id.

Defined cases: null text stays null; the empty text has no lines; repeated rows with one doc_id are one document
as far as pairs go and each keep their row; rows with a null doc_id are neither compared nor changed; lines are
compared without surrounding white space and blank lines only leave inside a block; very long texts are taken whole;
the empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import POWERS, mix, small_batches, span_hashes, written

#: What surrounds lines: the characters that str.strip takes.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of positions with equal items, increasing in both: the patience alignment of a and b."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        seen_a: dict[int, int] = {}
        seen_b: dict[int, int] = {}
        for seen, x, lo, hi in ((seen_a, a, a0, a1), (seen_b, b, b0, b1)):
            for i in range(lo, hi):
                seen[x[i]] = -1 if x[i] in seen else i
        both = [(i, seen_b[x]) for x, i in seen_a.items() if i >= 0 and seen_b.get(x, -1) >= 0]
        both.sort()
        tails: list[int] = []
        at: list[int] = []
        back = [-1] * len(both)
        for k, (_, j) in enumerate(both):
            p = bisect_left(tails, j)
            back[k] = at[p - 1] if p else -1
            tails[p : p + 1], at[p : p + 1] = [j], [k]
        k = at[-1] if at else -1
        end_a, end_b = a1, b1
        if k < 0:
            continue
        while k >= 0:
            i, j = both[k]
            out.append((i, j))
            todo.append((i + 1, end_a, j + 1, end_b))
            end_a, end_b, k = i, j, back[k]
        todo.append((a0, end_a, b0, end_b))
    return sorted(out)


def anchors(h: list[np.ndarray], n: list[np.ndarray], gone: list[np.ndarray | None], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of documents and hashes of their runs that hold a line still in place.

    The runs are the shortest from each line on, and the shortest up to each line, of `least` characters or more.
    Each line of a common block of so many characters lies in such a run of the block: that from the line on, or
    that up to the block's end.
    """
    sizes = np.array([len(x) for x in h], np.int64)
    ends = np.cumsum(sizes)
    still = np.ones(int(sizes.sum()), np.int64)
    for at, g in zip(ends - sizes, gone):
        if g is not None:
            still[at + np.asarray(g, np.int64)] = 0
    doc = np.repeat(np.arange(len(h)), sizes)
    flat = np.concatenate([np.zeros(0, np.int64), *h]).astype(np.int64)
    chars = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *n]).astype(np.int64))])
    at = np.arange(len(flat))
    on = np.searchsorted(chars, chars[:-1] + least)  # the end of the run from each line on
    upto = np.searchsorted(chars, chars[1:] - least, "right") - 1  # the start of the run up to each line
    fits_on, fits_upto = on <= ends[doc], upto >= (ends - sizes)[doc]
    start, end = np.concatenate([at[fits_on], upto[fits_upto]]), np.concatenate([on[fits_on], at[fits_upto] + 1])
    left = np.concatenate([[0], np.cumsum(still)])
    some = left[end] > left[start]
    start, end = start[some], end[some]
    up, _ = POWERS.upto(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat.view(np.uint64)) * up[: len(flat)], out=sums[1:])
    return doc[start], span_hashes(sums, start, end).view(np.int64)


def duplicate_lines(docs: DataFrame, anchor_chars: int = 20) -> DataFrame:
    """Rows (doc_id, gone: array<int>): the lines, counted from 0, that go from a document."""
    small_batches(docs.sparkSession)
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(WHITE)))
    lines = docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", F.transform(trimmed, lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("h"), F.transform(trimmed, lambda x: F.length(x)).alias("n"))
    lines = written(lines.groupBy("doc_id").agg(F.max_by("h", F.struct(F.size("h"), F.xxhash64("h"))).alias("h"), F.max_by("n", F.struct(F.size("h"), F.xxhash64("h"))).alias("n")))

    def anchor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, run = anchors(list(b["h"]), list(b["n"]), list(b["gone"]), anchor_chars)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[at], "run": run}).drop_duplicates()

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for a, later, n in zip(b["earlier"], b["later"], b["n"]):
                a, later = a.tolist(), later.tolist()
                found = patience(a, later)
                gone: list[int] = []
                block: list[tuple[int, int]] = []
                for pair in [*found, (-9, -9)]:
                    if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
                        if sum(n[j] for _, j in block) >= anchor_chars:
                            gone += [j for _, j in block]
                        block = []
                    block.append(pair)
                out.append(np.array(gone, np.int32))
            yield pd.DataFrame({"doc_id": b["doc_id"], "part": out})

    def aligned(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(lines.select("doc_id", F.col("h").alias("later"), "n"), "doc_id")
        rows = rows.join(lines.select(F.col("doc_id").alias("first"), F.col("h").alias("earlier")), "first")
        parts = rows.select("doc_id", "earlier", "later", "n").mapInPandas(align, "doc_id long, part array<int>")
        return written(parts.select("doc_id", F.explode("part").alias("line")).distinct())

    def gathered(parts: DataFrame) -> DataFrame:
        return parts.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))

    def still(links: DataFrame, parts: DataFrame) -> DataFrame:
        """The links whose anchor holds a line that is still in place."""
        some = links.select("doc_id").distinct()
        rows = lines.join(some, "doc_id", "left_semi").join(gathered(parts.join(some, "doc_id", "left_semi")), "doc_id", "left")
        return written(rows.mapInPandas(anchor, "doc_id long, run long").join(links, ["doc_id", "run"], "left_semi"))

    each = written(lines.withColumn("gone", F.lit(None).cast("array<int>")).mapInPandas(anchor, "doc_id long, run long"))
    first = written(each.groupBy("run").agg(F.min("doc_id").alias("first"), F.count("*").alias("df")).where("df > 1"))  # a join of two tables can be split where a run is common
    links = written(each.join(first, "run").where("doc_id > first").select("doc_id", "run", "first"))
    tried = written(links.select("doc_id", "first").distinct())
    gone = aligned(tried)
    left = still(links.select("doc_id", "run"), gone)
    if left.isEmpty():
        return gathered(gone)

    # Further holders of what is left. An alignment depends only on the earlier document's lines that others hold
    # and on where other lines part them: of holders alike in that, the earliest is tried.
    held = written(each.join(left.select("run").distinct(), "run", "left_semi"))
    placed = lines.join(held.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode("h").alias("at", "line"))
    shared = placed.groupBy("line").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("line", F.lit(True).alias("shared"))
    shared = written(shared)  # so that the join can be split where a line is common
    token = F.when(F.col("shared"), F.col("line")).otherwise(F.lit(1).cast("long"))
    alike = placed.join(shared, "line", "left").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", token.alias("t")))), lambda x: x["t"]).alias("t"))
    alike = alike.select("doc_id", F.xxhash64(F.filter("t", lambda x, i: (x != 1) | (i == 0) | (F.get("t", i - 1) != 1))).alias("alike"))
    ranks = held.join(alike, "doc_id").groupBy("run", "alike").agg(F.min("doc_id").alias("first"))
    ranks = written(ranks.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy("first"))).select("run", "rank", "first"))
    at = 2  # the first of each anchor has been tried
    while True:
        more = ranks.where(F.col("rank") == at).select("run", F.col("first").alias("next"))
        left = written(left.join(more, "run").where("next < doc_id").select("doc_id", "run"))
        if left.isEmpty():
            return gathered(gone)
        block = left.withColumn("rank", F.explode(F.sequence(F.lit(at), F.lit(2 * at - 1))))
        pairs = block.join(ranks, ["run", "rank"]).where("first < doc_id").select("doc_id", "first").distinct()
        pairs = written(pairs.join(tried, ["doc_id", "first"], "left_anti"))
        tried = tried.union(pairs)
        gone = gone.union(aligned(pairs))
        left = still(left, gone)
        at *= 2


def dedup_lines(docs: DataFrame, anchor_chars: int = 20, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with text and n_chars as they remain, and two further columns: lines, and lines removed.

    Columns of docs that have the names in counts are replaced; pass free names to keep them.
    """
    gone = duplicate_lines(docs, anchor_chars).select(F.col("doc_id").alias("doc_"), "gone")
    kept_columns = [c for c in docs.columns if c.lower() not in [x.lower() for x in counts]]
    rows = docs.select(F.struct(*kept_columns).alias("row")).join(gone, F.col("row.doc_id") == F.col("doc_"), "left").withColumn("all_", F.split("row.text", "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all_") - 1), F.col("gone")), lambda i: F.get("all_", i))
    some, text = F.col("gone").isNotNull(), F.col("row.text")
    n_lines = F.coalesce(F.when(text == "", F.lit(0)).otherwise(F.size("all_")), F.lit(0)).cast("long")
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    rows = rows.select("row", F.struct(F.when(some, F.array_join(kept, "\n")).otherwise(text).alias("text"), n_lines.alias("lines"), n_removed.alias("removed"), some.alias("some")).alias("new"))
    new = {"text": F.col("new.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("new.some"), F.length("new.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in kept_columns], F.col("new.lines").alias(counts[0]), F.col("new.removed").alias(counts[1]))


def line_report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
