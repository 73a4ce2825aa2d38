import random
import re
from pathlib import Path

import numpy as np

from larkspar.llm import near_dup
from larkspar.llm.ann import nearest, nearest_report
from larkspar.llm.common import connected_components, runs_of, word_hashes
from larkspar.llm.embed_dedup import similar_vectors


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = classes(201, links)
    assert got == {x: want[x] for x in {x for a, b in links if a != b for x in (a, b)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_banded_matches_equal_the_full_table():
    rng = random.Random(6)
    for _ in range(400):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 14))]
        b = [x for x in a if rng.random() > 0.15] + [rng.randrange(6) for _ in range(rng.randrange(3))]
        full = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                full[i + 1, j + 1] = full[i, j] + 1 if a[i] == b[j] else max(full[i, j + 1], full[i + 1, j])
        best = full[-1, -1]
        for need in range(0, min(len(a), len(b)) + 1):
            got = near_dup.banded_matches(a, b, need)
            assert (got >= need) == (best >= need), (a, b, need, got, best)


def alignable(a, b):
    """2 m / (a + b) by the full table over words split apart by a plain expression."""
    a, b = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0


def test_near_duplicates_equal_brute_force(docs):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(16):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 160))]
        for share in (0, 0.01, 0.03, 0.06, 0.09, 0.5):
            w = [x for x in words if rng.random() >= share / 3]
            for _ in range(int(share * len(w) / 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
                w.insert(rng.randrange(len(w)), rng.choice(vocabulary))
            texts.append(" ".join(w))
    texts += ["", None, "!!!", "Hello, World", "hello world", "one two three four", "one two three five"]
    ratio = {(i, j): alignable(texts[i], texts[j]) for i in range(len(texts)) for j in range(i)}
    want = classes(len(texts), [p for p, x in ratio.items() if x >= 0.8 and min(len((texts[i] or "").split()) for i in p) >= 5] + [(99, 100)])
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs(enumerate(texts))).collect()}
    assert all(got[i] == got[j] for (i, j), x in ratio.items() if x >= 0.9 and got[i] is not None and i < 96), "a pair above 0.9 is missed"
    assert got == dict(enumerate(want))
    assert 0 < sum(0.8 <= x < 0.9 for x in ratio.values())


def test_pairs_of_mixed_buckets_are_not_lost(docs):
    """Two families share a passage that fills most of their short texts: a hub of one is no partner of the other."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for family in range(4):
        own = [f"f{family}x{i}" for i in range(40)]
        for _ in range(6):
            w = list(own)
            w[rng.randrange(40)] = f"z{rng.random()}"
            rows.append((len(rows), " ".join(w) + " " + passage))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs(rows)).collect()}
    assert got == {i: i // 6 * 6 for i in range(24)}


def test_the_bound_never_rules_out_a_link():
    rng = random.Random(15)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(5, 60))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randrange(6)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(12))
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        if len(b) and near_dup.aligned(x, y, 0.8):
            ok, _ = near_dup.profiles_allow(near_dup.profile(x), near_dup.profile(y)[None], len(a), np.array([len(b)]), 0.8)
            assert ok[0]
    many = np.full(2000, 7, np.uint64)  # more than a bin holds
    assert near_dup.profiles_allow(near_dup.profile(many), near_dup.profile(many)[None], 2000, np.array([2000]), 0.8)[0][0]


def test_words_are_cut_at_any_punctuation(docs):
    rng = random.Random(12)
    marks = [" ", ", ", "\u3002", "\uff0c", "\u2014", "\u201c", "\u2019", "\u00a0", "_", "\u2026 ", "\u3000"]
    for _ in range(200):
        words = ["".join(rng.choice("aé9ß春眠का") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(12))]
        text = "".join(rng.choice(marks) + w for w in words) + rng.choice(marks)
        assert word_hashes(text).tolist() == word_hashes(" ".join(words)).tolist()
        assert len(runs_of(word_hashes(text), 5)) == (max(1, len(words) - 4) if words else 0)
    chinese = "\u3002".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(9)) for _ in range(120))
    typed = "he said 'one' - two words " + " ".join(f"w{i}" for i in range(40))
    rows = [(1, chinese), (2, chinese[:500] + "変" + chinese[501:]), (3, typed), (4, typed.replace(" 'one' - ", " \u2018one\u2019\u2014"))]
    got = {r["doc_id"]: r["kept"] for r in near_dup.near_duplicates(docs(rows)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_near_duplicate_edge_cases(docs):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A, b c d e f G!"), (None, "a b c d e f g"), (3, None), (4, ""), (5, "other words of another text here"), (5, "a b c d e f g")]
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in near_dup.near_duplicates(docs(rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, False), (2, 1, False), (None, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (5, 1, False)], key=str)
    assert near_dup.near_duplicates(docs([])).count() == 0
    assert [r["class_id"] for r in near_dup.near_duplicates(docs([(None, "one two three four five six")])).collect()] == [None]
    wide = docs([(*r, "x", "y", 1, "k", "d") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, k_ string, c0 string")
    left = near_dup.without_near_duplicates(wide)
    assert left.columns == wide.columns
    assert sorted((tuple(r)[:2] for r in left.collect()), key=str) == sorted([(1, "a b c d e f g"), (3, None), (4, ""), (5, "other words of another text here")], key=str)
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    assert sorted((r["doc_id"], r["class_id"]) for r in near_dup.near_duplicates(docs([(1, long), (2, long[:350_000])])).collect()) == [(1, 1), (2, 1)]


def clustered(rng, n, dim=16, centres=40, noise=0.05):
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dim))
    return x.astype(np.float32)


def test_similar_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    x = clustered(rng, 600)
    x[50:60] = x[0]
    label = rng.integers(0, 3, 600)
    rows = [(i, [float(v) for v in x[i]], int(label[i]), "extra") for i in range(600)]
    rows += [(600, None, 1, "n"), (601, [0.0] * 16, 1, "z"), (602, [float("nan")] * 16, 1, "f"), (603, rows[0][1], None, "l"), (604, [None] * 16, 1, "c"), (605, [1.0, 2.0], 1, "short")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, note string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    met = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(met, False)
    root = classes(600, zip(*np.nonzero(met)))
    for cell, block in ((4096, 2048), (40, 16)):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in similar_vectors(df, cell=cell, block=block).collect()}
        assert got == {i: (int(met[i].sum()), root[i], root[i] == i) for i in range(600)} | {i: (0, i, True) for i in range(600, 606)}
    assert similar_vectors(df.limit(0)).count() == 0


def test_similar_vectors_without_clusters_stay_exact_and_small(spark):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(2400, 64)).astype(np.float32)
    x[2000:2300] = x[:300] + 0.25 * rng.normal(size=(300, 64)).astype(np.float32)
    x[2300:2350] = x[7]
    x[2350:] = x[7] + 0.01 * rng.normal(size=(50, 64)).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    met = u @ u.T >= 0.93
    np.fill_diagonal(met, False)
    root = classes(2400, zip(*np.nonzero(met)))
    assert 100 < met[:300, 2000:2300].sum() < 600
    want = {i: (int(met[i].sum()), root[i], root[i] == i) for i in range(2400)}
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>, label int")
        before = set(folder.rglob("*.parquet"))
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in similar_vectors(df, cell=64, block=32, group=500).collect()}
        assert got == want
        made = set(folder.rglob("*.parquet")) - before
        assert max(spark.read.parquet(str(d)).count() for d in {f.parent for f in made}) < 3 * len(x)  # no row for each cell that a vector could meet


def test_nearest_reaches_recall_and_orders_ties(spark):
    rng = np.random.default_rng(10)
    x = clustered(rng, 3000, noise=0.4)
    x[100:160] = x[0]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(3000)] + [(3000, None, 1), (3020, [0.0] * 16, 1), (None, rows_ok(x[1]), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = nearest(df, df.where("vec_id % 20 = 0"), leaf_rows=64, block=256).toPandas()
    xd = x.astype(float)
    hits = total = 0
    for q in range(0, 3000, 20):
        s = xd @ xd[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        mine = out[out["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine["vec_id"])
        assert np.allclose(mine["score"], s[mine["vec_id"]], rtol=1e-12)
        order = list(zip(-mine["score"], mine["vec_id"]))
        assert order == sorted(order)
        hits, total = hits + len(set(want) & set(mine["vec_id"])), total + 20
    assert hits / total >= 0.9
    assert set(out["query_id"]) == set(range(0, 3000, 20))
    assert nearest_report(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:5], df.schema)
    assert [r["vec_id"] for r in nearest_report(few).orderBy("rank").collect()] != [] and nearest_report(few).count() == 4


def test_recall_beyond_the_sample_and_repeated_rows(spark):
    """The tree is fitted on a tenth of the rows; repeated rows are candidates; lengths do not mix."""
    rng = np.random.default_rng(3)
    x = clustered(rng, 4000, dim=12, noise=0.6)
    x[20] *= 4  # so that its twins are its nearest
    rows = [(i, rows_ok(x[i])) for i in range(4000)]
    rows += [(20, rows_ok(x[20]))] * 2 + [(40, rows_ok(x[41])), (5000, [1.0, 2.0]), (5001, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = nearest(df, df.where("vec_id % 20 = 0"), sample=400, leaf_rows=100).toPandas()
    e = np.array([r[1] for r in rows[:-2]], float)
    ids = np.array([r[0] for r in rows[:-2]])
    hits = total = 0
    for q in range(4003):
        if ids[q] % 20 or ids[q] == 40 or q > 4000:
            continue
        s = e @ e[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        mine = out[out["query_id"] == ids[q]]
        assert sorted(mine["rank"]) == list(range(1, 21))
        hits, total = hits + len(set(zip(ids[order], np.round(s[order], 6))) & set(zip(mine["vec_id"], np.round(mine["score"], 6)))), total + len(set(ids[order]))
    assert hits / total >= 0.9
    assert (out[out["query_id"] == 20]["vec_id"] == 20).sum() == 2
    assert len(out[out["query_id"] == 40]) == 40  # two vectors under one id ask each
    assert out[out["query_id"] == 5000][["rank", "vec_id"]].values.tolist() == [[1, 5001]]


def rows_ok(v):
    return [float(a) for a in v]
