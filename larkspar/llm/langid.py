"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams.

Words are runs of letters. The model is fitted on a bounded sample of labelled rows: about `sample_docs` in all, dealt
evenly to the languages (at least `least_docs` each) and chosen by a hash of doc_id and text; every word of these rows
counts. The n-gram tables come from those words.

Defined cases: null text or text without a letter gives `und` with score 0; without any training label every text
is `und`; ties go to the language first in sorted order; repeated rows each give a row; very long texts are taken
whole; the empty table gives no rows; columns that have the names of the result's are replaced, others are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

UND = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def words(text: str) -> list[str]:
    """Runs of letters; number forms that `\\w` takes part them too."""
    found = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join([c if c.isalpha() else " " for c in " ".join(found)]).split()


class Frequencies:
    """Per word or n-gram the log frequency in each language; kept only for the languages that have it."""

    def __init__(self, tables: list[Counter], smooth: float) -> None:
        keys = sorted(set().union(*tables)) if tables else []
        total = np.array([sum(t.values()) + smooth * (len(keys) + 1) for t in tables])
        self.none = np.log(smooth / total).astype(np.float32) if tables else np.zeros(0, np.float32)
        at, value, ends = [], [], []
        for k in keys:
            for i, t in enumerate(tables):
                if k in t:
                    at.append(i)
                    value.append(t[k])
            ends.append(len(at))
        self.place = {k: i for i, k in enumerate(keys)}
        self.at, self.ends = np.array(at, np.int32), np.array([0, *ends], np.int64)
        self.value = np.log((np.array(value, np.float64) + smooth) / total[self.at]).astype(np.float32) if at else np.zeros(0, np.float32)

    def get(self, key: str) -> np.ndarray | None:
        i = self.place.get(key)
        return None if i is None else self.means(np.zeros(1, np.int64), np.array([i]), 1)[0]

    def means(self, of: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """For each of n words the mean vector of the entries at places; of says whose each is, and each has some."""
        langs = len(self.none)
        sizes = self.ends[places + 1] - self.ends[places]
        flat = np.repeat(self.ends[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        at = self.at[flat]
        more = np.bincount(np.repeat(of, sizes) * langs + at, weights=self.value[flat] - self.none[at], minlength=n * langs)
        return (self.none + more.reshape(n, langs) / np.bincount(of, minlength=n)[:, None]).astype(np.float32)


class BackoffModel:
    """Log frequencies per language of words and of n-grams of every order."""

    def __init__(self, counts: dict[str, dict[str, int]], orders: int = 5, smooth: float = 0.5) -> None:
        self.langs, self.orders = sorted(counts), orders
        grams = [[Counter() for _ in self.langs] for _ in range(orders)]
        for at, lang in enumerate(self.langs):
            for w, c in counts[lang].items():
                for n in range(1, orders + 1):
                    table = grams[n - 1][at]
                    for g in self.grams(w, n):
                        table[g] += c
        self.word = Frequencies([Counter(counts[lang]) for lang in self.langs], smooth)
        self.gram = [Frequencies(t, smooth) for t in grams]

    @staticmethod
    def grams(word: str, n: int) -> list[str]:
        padded = f"<{word}>"
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    def evidence(self, word: str) -> np.ndarray:
        return self.evidence_of([word])[0]

    def evidence_of(self, words: list[str]) -> np.ndarray:
        """A row a word: its own, or the mean over its known n-grams of the greatest order that has any."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        left = list(range(len(words)))
        for n in range(self.orders + 1, 0, -1):  # the words themselves, then n-grams of order n
            table = self.word if n > self.orders else self.gram[n - 1]
            get, of, places, met, rest = table.place.get, [], [], [], []
            for i in left:
                keys = (words[i],) if n > self.orders else self.grams(words[i], n)
                known = [k for g in keys if (k := get(g)) is not None]
                if known:
                    of += [len(met)] * len(known)
                    places += known
                    met.append(i)
                else:
                    rest.append(i)
            if met:
                out[met] = table.means(np.array(of, np.int64), np.array(places, np.int64), len(met))
            left = rest
        return out

    def predict(self, text: str | None, cache: dict[str, bytes], room: int = 300_000) -> tuple[str, float]:
        """cache keeps the evidence of words: at most room, and those of one text."""
        counts = Counter(words(text or ""))
        if not counts or not self.langs:
            return UND, 0.0
        if len(cache) > room:
            cache.clear()
        if new := [w for w in counts if w not in cache]:
            cache.update(zip(new, map(bytes, self.evidence_of(new))))
        rows = np.frombuffer(b"".join(map(cache.__getitem__, counts)), np.float32).reshape(len(counts), -1)
        total = np.fromiter(counts.values(), np.float64, len(counts)) @ rows.astype(np.float64)
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, sample_docs: int = 2_000, least_docs: int = 20) -> BackoffModel:
    """Fits on labelled rows that are not held out; what reaches the driver are the words of the sampled rows."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return BackoffModel({})
    most = max(least_docs, sample_docs // len(sizes))
    share = F.create_map(*[v for r in sizes for v in (F.lit(r["lang"]), F.lit(min(1.0, most / r["count"])))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit("language sample")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    each = chosen.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for r in each.groupBy("lang", "w").count().collect():  # bounded by the sample
        out[r["lang"]][r["w"]] = r["count"]
    return BackoffModel(out)


def identify(docs: DataFrame, model: BackoffModel, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns `pred` and `score`; any columns of these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    rows = docs.select(*[c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cache = shared.value, {}
        for b in batches:
            found = [m.predict(t if isinstance(t, str) else None, cache) for t in b["text"]]
            yield b.assign(**{pred: [f[0] for f in found], score: [f[1] for f in found]})

    schema = T.StructType([*rows.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return rows.mapInPandas(run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
