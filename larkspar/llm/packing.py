"""Best-fit packing by hierarchical residual packing.

Documents become token ids with one end id; only documents longer than a sequence are cut, from their end, so that
the first piece is the shorter one. Level 0 packs each partition's pieces best-fit in order of decreasing length;
full and nearly full bins are done. Bins that are left become items of the next level, merged over groups of
partitions (the tree) and packed best-fit again, until one group is left. A group is split again where it would
exceed `group_items`, so no task grows with the input.

Defined cases: null text counts as empty (its one token is the end id); repeated rows are packed as often as they
occur; a null doc_id is kept; the empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, written

END_ID = 2


class FastIds:
    """Exactly the ids of the byte-level BPE file, as bytes: a cache by pre-token, filled by the same vocabulary's ranks.

    Texts with the special token's string, or with characters on which the two pattern engines differ (number
    forms that aren't decimal digits, and the like), go through the tokenizer file whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str, room: int = 250_000) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.exact = Tokenizer.from_file(tokenizer_path)
        self.piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}
        self.room = room
        letters = r"[^\W\d_]"
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.plain: set[str] = set()  # characters seen that aren't odd

    def _exactly(self, text: str) -> bool:
        new = set(text) - self.plain
        if any(map(self._odd, new)):
            return True
        self.plain |= new
        return "<|endoftext|>" in text

    @staticmethod
    def _odd(c: str) -> bool:
        """Where re's classes differ from Unicode's letter, number and space."""
        kind = unicodedata.category(c)
        if "\x1c" <= c <= "\x1f":
            return True
        ours = (c.isspace(), c.isdecimal(), c.isalnum() and not c.isdecimal())
        return kind == "Cn" or ours != (kind in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85", kind[0] == "N", kind[0] == "L")

    def __call__(self, text: str) -> bytes:
        if self._exactly(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, get = [], self.cache.get
        for t in self.split(text):
            b = get(t)
            if b is None:
                b = np.array(self.piece(t), "<u4").tobytes()
                if len(self.cache) < self.room and len(t) < 40:
                    self.cache[t] = b
            out.append(b)
        return b"".join(out)


@cache
def fast_ids(tokenizer_path: str, ranks_path: str, pattern: str) -> FastIds:
    """One for each Python worker."""
    return FastIds(tokenizer_path, ranks_path, pattern)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin number for each item: longest items first, each into the fullest bin that holds it."""
    out = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # rooms: bit r is set while some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room, n = n, capacity, n + 1
        out[i] = b
        if room - need:
            by_room[room - need].append(b)
            rooms |= 1 << (room - need)
    return out


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, size: int = 1024) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) over whole texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = fast_ids(tokenizer_path, ranks_path, pattern)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = (ids_of(text) if isinstance(text, str) else b"") + end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                rows += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, size: int = 1024, nearly: int = 1, fan: int = 8, group_items: int = 200_000) -> DataFrame:
    """items (any columns and `length`) with sequence_id and offset, in as few sequences of `size` as best-fit finds.

    nearly: bins with at most so many free places are done at once.
    """
    spark = items.sparkSession
    # an item's number: its partition in the written table, and its row there
    table = written(items)
    table = written(table.withColumn("item", F.monotonically_increasing_id()))
    whole = table.where(F.col("length") >= size).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        """A bin takes the number of its first item; offsets run over its items in order."""
        length = pdf["length"].to_numpy()
        bins = best_fit(length, size)
        order = np.lexsort((-length, bins))
        bins, length, item = bins[order], length[order], pdf["item"].to_numpy()[order]
        new = np.ones(len(bins), bool)
        new[1:] = bins[1:] != bins[:-1]
        which = np.cumsum(new) - 1
        at = np.cumsum(length) - length
        fill = np.bincount(which, weights=length).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
        return pd.DataFrame({"item": item, "bin": item[new][which], "offset": at - at[new][which], "fill": fill[which]})

    schema = "item long, bin long, offset long, fill long"
    # level 0: by partition of the table
    small = table.where(F.col("length") < size).select("item", "length", F.shiftright("item", 33).alias("part"))
    width = max(1, partitions(spark))
    split = F.concat_ws(":", F.col("group"), F.pmod(F.xxhash64("item"), F.col("ways")))
    groups = small.groupBy("part").count().where(F.col("count") > group_items)
    small = small.join(groups, "part", "left").withColumn("ways", F.coalesce(F.ceil(F.col("count") / group_items), F.lit(1))).withColumnRenamed("part", "group")
    level = written(small.select(split.alias("group"), "item", "length").groupBy("group").applyInPandas(lambda pdf: packed(pdf[["item", "length"]]), schema))
    levels, left, ways, top = [level], None, width, False
    while True:
        open_bins = level.where(F.col("fill") < size - nearly).groupBy("bin").agg(F.first("fill").alias("length"))
        open_bins = open_bins.select(F.col("bin").alias("item"), "length")
        count = open_bins.count()
        # at the root, one group has seen them all; or, of several, a round has merged next to nothing
        if count < 2 or (top and (ways == 1 or count > 0.99 * left)):
            break
        least = max(1, -(-count // group_items))
        ways = max(least, ways // fan)
        top = ways == least
        left = count
        group = F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(ways))
        level = written(open_bins.withColumn("group", group).groupBy("group").applyInPandas(lambda pdf: packed(pdf[["item", "length"]]), schema))
        levels.append(level)
    # down the tree: an item's bin is an item of the next level, unless that bin was done
    spot = levels[0].select("item", F.col("bin").alias("sequence_id"), "offset")
    for level in levels[1:]:
        up = level.select(F.col("item").alias("sequence_id"), "bin", F.col("offset").alias("more"))
        spot = spot.join(up, "sequence_id", "left").select("item", F.coalesce("bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
    return table.join(spot.union(whole), "item").drop("item")


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path(f"{name}.json"), P.path(f"{name}.tiktoken"), P.PATTERN


def packing_report(docs: DataFrame, size: int = 1024) -> DataFrame:
    out = pack(pieces(docs, *tokenizer_files(), size=size), size)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
