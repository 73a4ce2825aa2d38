"""What the corpus operators share: shared-folder tables, Arrow batch sizes, byte hashing and components."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="larkspar-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larkspar-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows with whole texts or arrays go to Python in batches of at most this many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works on uint64 arrays."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Per byte value, a fixed pseudo-random 64-bit number.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Powers:
    """Powers of the rolling base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 14, 2 * len(self.up))
            ones = np.ones(size, np.uint64)
            self.up, self.down = (np.multiply.accumulate(np.where(np.arange(size) == 0, ones, np.uint64(b))) for b in (_BASE, _INVERSE))
        return self.up, self.down


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of bytes; `span_hashes` turns them into hashes of any spans."""
    up, _ = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class _Apart(dict):
    """For str.translate: non-ASCII characters that are neither letters, digits nor marks on them become spaces."""

    def __missing__(self, c: int) -> int:
        x = chr(c)
        self[c] = c if c < 128 or x.isalnum() or unicodedata.category(x)[0] == "M" else 32
        return self[c]


_APART = _Apart()
_SOME_APART = re.compile(r"[^\w\x00-\x7f]")
#: Bytes of words once other characters are spaces: ASCII letters and digits, and every byte of non-ASCII characters.
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each lower-cased word of the text, in order."""
    text = (text or "").lower()
    if not text.isascii() and _SOME_APART.search(text):
        text = text.translate(_APART)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.diff(_WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def runs_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in a row; fewer words are one run, no words none."""
    k = min(k, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[i : i + n]
    return mix(out)


def labelled(h: np.ndarray) -> np.ndarray:
    """Tells repeats apart: the i-th occurrence of a value gets a label of its own."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    at = np.arange(len(s))
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(occurrence > 0, mix(h + occurrence * np.uint64(0xC2B2AE3D27D4EB4F)), h)


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of edges (u, v): alternating large-star and small-star.

    component is the smallest node reachable. Every round is two aggregations by key and one join, written to
    the shared folder; the number of rounds grows with the logarithm of the longest chain.
    """
    now = written(edges.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).where("lo < hi").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        least = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(now.select(F.col("lo").alias("n"), F.col("lo").alias("m")))
        least = least.groupBy("n").agg(F.min("m").alias("m"))
        large = now.join(least, F.col("lo") == F.col("n")).select(F.col("m").alias("lo"), "hi").distinct()
        large = written(large)
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root.withColumnRenamed("hi", "n"), F.col("hi") == F.col("n"))
        small = small.select("m", F.col("lo").alias("x")).where("m < x").union(root.select("m", F.col("hi").alias("x")))
        now = written(small.select(F.col("m").alias("lo"), F.col("x").alias("hi")).distinct())
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
