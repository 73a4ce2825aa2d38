import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from larkspar.llm import pieces, suffix_dedup


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for size in (1, 2, 9, 60, 400):
        for letters in (b"a", b"ab", b"\0a", bytes(range(97, 123))):
            t = bytes(rng.choice(letters) for _ in range(size))
            a = np.frombuffer(t, np.uint8)
            order = suffix_dedup.suffix_array(a)
            assert order.tolist() == sorted(range(size), key=lambda i: t[i:])
            lcp = suffix_dedup.common_prefixes(a, order, 10_000, stretch=7)
            for r in range(1, size):
                x, y = t[order[r - 1] :], t[order[r] :]
                assert lcp[r] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_winnowing_is_by_content():
    rng = np.random.default_rng(2)
    s = rng.integers(97, 101, 200, dtype=np.uint8)
    places = []
    for _ in range(20):
        lead = rng.integers(97, 101, rng.integers(0, 500), dtype=np.uint8)
        at, _ = suffix_dedup.winnow(np.concatenate([lead, s, rng.integers(97, 101, 300, dtype=np.uint8)]), 200, 64)
        places.append({int(a) - len(lead) for a in at if len(lead) <= a <= len(lead) + 136})
    assert set.intersection(*places)


def test_remove_repeats_equals_brute_force(docs, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (30, 45, 60, 120, 400)]
    texts = [prose(rng.randrange(5, 90)) + rng.choice(["", " " + rng.choice(shared)]) + " " + prose(rng.randrange(40)) + rng.choice(["", rng.choice(shared)]) for _ in range(120)]
    base = prose(150)
    for i in range(25):
        at = rng.randrange(len(base))
        texts.append(base[:at] + word() + base[at + rng.randrange(3) :])
    texts += [None, "", "x", "y" * 5000, "ab" * 300, "q" * 199, "r" * 200, "s" * 201, texts[0], texts[0], prose(20_000), shared[1][:199], shared[1][:200]]
    texts += ["z" * 200_000, "start " + "z" * 700 + " end", ("abcdefg" * 4000)[3:] + prose(9), prose(9) + "abcdefg" * 31, prose(40) + "ab" * 700 + prose(40)]
    rows = list(enumerate(texts)) + [(None, texts[5]), (3, texts[3])]
    want = sorted(map(repr, ((d, *x) for (d, _), x in zip(rows, brute([t for _, t in rows], 200)))))
    kinds = [dict(), dict(shard_bytes=2000, hot_bytes=0), dict(shard_bytes=3000, hot_bytes=2500)]
    whole = suffix_dedup.repeated_spans
    for kind in kinds:  # small shards: large groups are dealt anew and shards merged
        monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, n, kind=kind: whole(d, n, **kind))
        got = sorted(repr(tuple(r)) for r in suffix_dedup.remove_repeats(docs(rows)).collect())
        assert got == want
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


def every_segmentation(m, part):
    edges = m.edges(part)

    def back(end):
        if end == 0:
            yield 0.0, ()
        for start, x, ids in edges[end] if end else []:
            for s, before in back(start):
                yield s + x, before + ids

    return sorted((s for s, _ in back(len(part))), reverse=True)


def test_n_best_equals_every_segmentation():
    m = pieces.PieceLattice(pieces.model_file(), 6)
    for part in ["▁the", "▁thinking", "▁▁a", "▁été", "abc", "▁\U0001f680x", "▁"]:
        got = [s for s, _ in m.segmentations(part)]
        assert got == pytest.approx(every_segmentation(m, part)[: len(got)]) and len(got) == min(6, len(every_segmentation(m, part)))
    text = "the cat sat on"
    parts = [every_segmentation(m, p) for p in m.parts("▁" + text.replace(" ", "▁"))]
    want = sorted((sum(c) for c in itertools.product(*parts)), reverse=True)[:6]
    found = m.encode(text)
    assert [s for s, _ in found] == pytest.approx(want)
    assert len({ids for _, ids in found}) == 6
    assert all(m.decode(ids) == text for _, ids in found)


def test_viterbi_agrees_with_the_search_and_memory_changes_nothing():
    rng = random.Random(4)
    words = ["".join(rng.choice("aehnostlé\U0001f680") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    whole, small = (pieces.PieceLattice(pieces.model_file(), 4, room) for room in (500_000, 20))
    for w in words:
        found = whole.segmentations(pieces.MARK + w)
        ids, score, gap = whole.viterbi(pieces.MARK + w)
        assert ids == found[0][1] and score == pytest.approx(found[0][0])
        assert gap == (pytest.approx(score - found[1][0], abs=1e-9) if len(found) > 1 else float("inf"))
    for _ in range(40):
        text = " ".join(rng.choices(words, k=rng.randrange(1, 90)))
        assert whole.encode(text) == small.encode(text)
        assert len(small.known) <= 10 and len(small.older) <= 10


def test_parts_are_cut_only_where_no_piece_lies():
    m = pieces.lattice(pieces.model_file(), 3)
    text = pieces.MARK + "Word, word.\nNext (x2) a.b http://c.org/d \u00b2. don't".replace(" ", pieces.MARK)
    parts = m.parts(text)
    assert "".join(parts) == text and "\n" in parts and pieces.MARK + "Word" in parts
    cuts = set(itertools.accumulate(map(len, parts)))
    for start in range(len(text)):
        for end in range(start + 2, len(text) + 1):
            if m.prefixes.get(text[start:end]):
                assert not cuts & set(range(start + 1, end)), text[start:end]


def test_scores_are_log_probabilities():
    ranks = pieces.additive({7: 0.0, 5: -1.0, 9: -2.0})
    assert sum(map(math.exp, ranks.values())) == pytest.approx(1) and ranks[7] > ranks[5] > ranks[9]
    assert pieces.additive({1: -0.5, 2: -1.25}) == {1: -0.5, 2: -1.25}


def test_round_trip(docs, spark):
    texts = ["", "a", "  two  spaces ", "tab\tnew\nline", "é\U0001f680世界", "no" * 5000, "word " * 20_000, None]
    rows = list(enumerate(texts)) + [(0, ""), (None, "x y")]
    out = pieces.piece_report(docs(rows)).collect()
    assert len(out) == len(rows) and all(r["round_trip"] for r in out)
    ids = pieces.encode(docs(rows), pieces.model_file(), 2).where("choice = 0 and doc_id > 0")
    assert {r["doc_id"]: r["text"] for r in pieces.decode(ids, pieces.model_file()).collect()} == {i: t or "" for i, t in enumerate(texts) if i}
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert pieces.piece_report(real).where("not round_trip").count() == 0
    assert pieces.piece_report(docs([])).count() == 0
