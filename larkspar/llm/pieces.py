"""SentencePiece encoding with the N best segmentations, and decoding.

A text becomes `_` (U+2581) marked pieces: white space U+0020 turns into the mark and one mark is put in front. The
piece lattice falls apart at the marks, as no piece has one behind another character, and wherever else no piece can
lie across (a word and the comma after it), so it is searched part by part: a forward Viterbi pass gives the best score up to every position, which is the exact heuristic of an A-star
search from the end; it yields segmentations in order of score. The N best of the text then come from the parts
whose second choice costs least: no other part can differ within the N best.

A character that is no piece falls back to its UTF-8 bytes at a fixed cost. Scores add up as log-probabilities. Those
of a unigram model are taken from the file. A BPE file has no probabilities, only the ranks of its merges; sums of
ranks mean nothing, so a piece of rank r has the probability that Zipf and Mandelbrot's law gives it, in proportion to
1 / (r + `OFFSET`). Nothing is trained. The result is the likeliest segmentation, which is not always what the merges
of the file's own encoder give; the README has figures.

Defined cases: null counts as empty (no ids); a mark in the text itself decodes as a space; repeated rows each give
a row; ties between segmentations go to the longer last piece; very long texts are taken whole, part by part; the
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
#: Mandelbrot's offset to the ranks.
OFFSET = 2.7
#: Characters that stand for digits, before which parts are not cut.
ODD = "\u00b2\u00b3\u00b9"


def additive(scores: dict[int, float]) -> dict[int, float]:
    """Log-probabilities: the scores themselves, unless they are the ranks of merges (whole numbers from 0 down)."""
    if not all(s <= 0 and s == int(s) for s in scores.values()):
        return scores
    order = sorted(scores, key=lambda i: (-scores[i], i))
    norm = math.log(sum(1 / (r + OFFSET) for r in range(len(order))))
    return {i: -math.log(r + OFFSET) - norm for r, i in enumerate(order)}


class PieceLattice:
    def __init__(self, model: str, best: int, room: int = 800_000) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.packed = [i.to_bytes(4, "little") for i in range(len(names))]
        scores = additive({i: sp.get_score(i) for i in plain})
        pieces = {names[i]: (scores[i], self.packed[i]) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has the mark inside")
        self.bytes = {b: i for i in range(len(names)) if sp.is_byte(i) for b in [int(names[i][3:5], 16)]}
        #: what each id decodes to
        self.plain = [n.encode("utf-8", "surrogatepass") for n in names]
        for b, i in self.bytes.items():
            self.plain[i] = bytes([b])
        self.fallback = min((s for s, _ in pieces.values()), default=0.0) - 10.0
        #: every prefix of a piece: (score, id) of the piece that it is, or None
        self.prefixes: dict[str, tuple[float, bytes] | None] = {p[:n]: None for p in pieces for n in range(1, len(p))} | pieces
        self.single = {p for p in pieces if len(p) == 1}
        self.finder = ahocorasick.Automaton()
        for p, (x, ids) in pieces.items():
            self.finder.add_word(p, (len(p), x, ids))
        self.finder.make_automaton()
        # no piece goes on from a letter or digit to the characters `apart`, or has a line feed inside, so the lattice falls apart there
        inside = {c for p in pieces for b, c in zip(p, p[1:]) if b.isalnum() and b not in ODD}
        apart = "".join(re.escape(c) for c in "\n\t.,;:!?\"()[]{}<>/=+*&%$#@|~^`" if c not in inside)
        line = "\n" if not any("\n" in p and p != "\n" for p in pieces) else ""
        before = rf"{MARK}*(?:(?![{ODD}])[^\W_])++(?=[{apart}])|" if apart else ""
        self.parts = re.compile((f"{line}|" if line else "") + before + f"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+").findall
        self.best, self.room = best, room
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.older: dict[str, tuple[bytes, float, float]] = {}
        self.choices: dict[str, list[tuple[float, bytes]]] = {}

    def spelled(self, c: str) -> tuple[float, bytes]:
        """Score and ids of a character that is no piece."""
        raw = c.encode("utf-8", "surrogatepass")
        return self.fallback * len(raw), b"".join([self.packed[self.bytes[b]] for b in raw])

    def edges(self, part: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end the edges into it: start, score, ids; the longest first."""
        look, n = self.prefixes.get, len(part)
        out: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            found = look(part[start]) or self.spelled(part[start])
            for end in range(start + 1, n + 1):
                if found:
                    out[end].append((start, found[0], tuple(np.frombuffer(found[1], "<u4").tolist())))
                found = look(part[start : end + 1], ())
                if found == ():
                    break
        return out

    def segmentations(self, part: str) -> list[tuple[float, bytes]]:
        """The N best (score, ids), best first: A-star from the end, the Viterbi scores ahead as its heuristic."""
        edges = self.edges(part)
        ahead = [0.0] * (len(part) + 1)
        for end in range(1, len(part) + 1):
            ahead[end] = max([ahead[s] + x for s, x, _ in edges[end]])
        out, pops = [], [0] * (len(part) + 1)
        heap, n = [(-ahead[-1], 0, len(part), 0.0, None)], 0
        while heap and len(out) < self.best:
            _, _, end, behind, path = heapq.heappop(heap)
            if pops[end] >= self.best:
                continue
            pops[end] += 1
            if end == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((behind, np.array(ids, "<u4").tobytes()))
                continue
            for start, x, piece in reversed(edges[end]):  # of equal ones the last pushed, the longest, comes first
                n -= 1
                heapq.heappush(heap, (-(ahead[start] + x + behind), n, start, x + behind, (piece, path)))
        return out

    def viterbi(self, part: str) -> tuple[bytes, float, float]:
        """Best ids, their score, and how much less the second best segmentation scores."""
        n, none = len(part), float("-inf")
        first, second, came = [0.0] + [none] * n, [none] * (n + 1), [(0, b"")] * (n + 1)
        whole = self.single.issuperset(part)
        edges = self.finder.iter(part) if whole else ((end - 1, (end - s, x, ids)) for end, found in enumerate(self.edges(part)) for s, x, ids in found)
        for end, (size, x, ids) in edges:  # by end, the longest first
            end += 1
            start = end - size
            score = first[start] + x
            if score > first[end]:
                t, u = first[end], second[start] + x
                second[end] = t if t > u else u
                first[end], came[end] = score, (start, ids)
            elif score > second[end]:
                second[end] = score
        out, at = [], n
        while at:
            at, ids = came[at]
            out.append(ids if whole else np.array(ids, "<u4").tobytes())
        return b"".join(reversed(out)), first[n], first[n] - second[n]

    def part(self, part: str) -> tuple[bytes, float, float]:
        """`viterbi` with a memory of two generations, of bounded size."""
        found = self.known.get(part) or self.older.get(part)
        if not found:
            found = self.viterbi(part)
        if len(self.known) >= self.room // 2:
            self.older, self.known = self.known, {}
        if len(part) < 40:
            self.known[part] = found
        return found

    def ranked(self, part: str) -> list[tuple[float, bytes]]:
        """`segmentations` with a memory of bounded size."""
        found = self.choices.get(part)
        if found is None:
            found = self.segmentations(part)
            if len(part) < 40:
                if len(self.choices) >= self.room // 10:
                    self.choices.clear()
                self.choices[part] = found
        return found

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The N best segmentations of a text."""
        if not text:
            return [(0.0, b"")]
        names = self.parts(MARK + text.replace(" ", MARK))
        known = self.known
        best, scores, gaps = map(list, zip(*[known.get(p) or self.part(p) for p in names]))
        score, second = sum(scores), np.array(gaps)
        few = np.argsort(second, kind="stable")[: self.best - 1] if len(second) <= 64 else np.sort(np.argpartition(second, self.best - 1)[: self.best - 1])
        choices = {at: self.ranked(names[at]) for at in sorted(few.tolist())}
        sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for found in choices.values():
            sums = heapq.nsmallest(self.best, [(cost + found[0][0] - s, (*took, c)) for cost, took in sums for c, (s, _) in enumerate(found)])
        out = []
        for cost, took in sums:
            for c, (at, found) in zip(took, choices.items()):
                best[at] = found[c][1]
            out.append((score - cost, b"".join(best)))
        return out

    def decode(self, ids: np.ndarray | bytes) -> str:
        if isinstance(ids, bytes):
            ids = np.frombuffer(ids, "<u4")
        text = b"".join(map(self.plain.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@cache
def lattice(model: str, best: int) -> PieceLattice:
    """One for each Python worker."""
    return PieceLattice(model, best)


def model_file(name: str = "piece_bpe_32k") -> str:
    import public_tokenizers as P

    return P.path(f"{name}.model")


def encode(docs: DataFrame, model: str, best: int = 3) -> DataFrame:
    """Rows (doc_id, choice from 0, score, ids) for each of the N best segmentations."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = lattice(model, best)
        for b in batches:
            rows = [(d, k, s, np.frombuffer(ids, "<u4").astype(np.int32)) for d, t in zip(b["doc_id"].astype("Int64"), b["text"]) for k, (s, ids) in enumerate(m.encode(t if isinstance(t, str) else ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "choice", "score", "ids"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, choice int, score double, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids)."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = lattice(model, 1)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": [m.decode(np.asarray(i)) if i is not None else None for i in b["ids"]]})

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInPandas(run, "doc_id long, text string")


def piece_report(docs: DataFrame, best: int = 3) -> DataFrame:
    """Per row: doc_id, n_ids and ids_crc32 of the best segmentation, scores and crc32s of the N best, round_trip."""
    small_batches(docs.sparkSession)
    model = model_file()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = lattice(model, best)
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"].astype("Int64"), b["text"]):
                t = t if isinstance(t, str) else ""
                found = m.encode(t)
                crc = [zlib.crc32(ids) for _, ids in found]
                back = m.decode(found[0][1]) == t.replace(MARK, " ")
                rows.append((d, len(found[0][1]) // 4, crc[0], [s for s, _ in found], crc, back))
            yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids_crc32", "nbest_scores", "nbest_crc32", "round_trip"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_ids long, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean")
