import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from larkspar.llm import langid, licenses, line_dedup, packing, secrets

SF = "/root/testdata/sf0.001"


def test_license_scan_equals_brute_force(docs):
    share = 0.8

    def brute(text):
        best = (0.0, 0, None)
        for unit in [text or "", *(text or "").split("\n")]:
            b = set(licenses.bigrams(unit))
            for i, (name, t) in enumerate(licenses.TEMPLATES):
                u = set(licenses.bigrams(t))
                d = 2 * len(b & u) / (len(b) + len(u))
                best = max(best, (d, -i, name), key=lambda x: x[:2])
        return (best[2], round(best[0], 9)) if best[0] >= share else (None, None)

    rng = random.Random(1)
    texts = [None, "", "MIT", "word " * 20_000]
    for _, t in licenses.TEMPLATES:
        for drop in (0, 1, 2, 9):
            w = t.split()
            for _ in range(drop):
                w[rng.randrange(len(w))] = rng.choice(["x", "the", "license"])
            texts += [" ".join(w), "some words\n" + " ".join(w).upper() + "\nmore words", "glued " + " ".join(w)]
    got = {r["doc_id"]: (r["license"], None if r["dice"] is None else round(r["dice"], 9)) for r in licenses.license_scan(docs(enumerate(texts))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_license_notices_inside_longer_texts(docs):
    gpl = dict((n, t) for n, t in licenses.TEMPLATES if len(t) > 300)["GPL-3.0"].replace(" This program is distributed", "\n\nThis program is distributed")
    texts = [
        "Copyright 2020 Example Corp. Released under the MIT License.",
        "Copyright 2020 Example Corp. Licensed under the Apache License, Version 2.0.",
        "We were glad to see that the tool is now " + "released under the MIT License. " + "It has many users all over the world. " * 20,
        "\n".join("# " + x for x in gpl.split("\n")) + "\n\nimport os\n" + "".join(f"x{i} = os.getcwd()\n" for i in range(200)),
        "The license of my car and the general public. " * 50,
    ]
    got = {r["doc_id"]: (r["license"], r["dice"]) for r in licenses.license_report(docs(enumerate(texts))).collect()}
    assert got == {0: ("MIT", 1.0), 1: ("Apache-2.0", 1.0), 2: ("MIT", 1.0), 3: ("GPL-3.0", 1.0), 4: (None, None)}


def test_language_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_report(df).toPandas().merge(df.select("doc_id", "lang").toPandas())
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_language_edge_cases(docs):
    rows = [(i, "the cat and the dog", "en") for i in range(9)] + [(10 + i, "le chat et le chien", "fr") for i in range(9)]
    rows += [(30, None, "en"), (31, "12 34 !", "fr"), (32, "", None), (33, "thecatish", None), (None, "le chien", None), (35, "chat " * 30_000, None), (35, "chat", None)]
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.language_report(docs(rows)).collect() if r["doc_id"] is None or r["doc_id"] >= 30]
    assert sorted(got, key=str) == sorted([(30, "und"), (31, "und"), (32, "und"), (33, "en"), (None, "fr"), (35, "fr"), (35, "fr")], key=str)
    assert langid.language_report(docs([])).count() == 0
    assert [r["lang_pred"] for r in langid.language_report(docs([(1, "abc")])).collect()] == ["und"]


def test_backoff_uses_the_longest_known_grams():
    m = langid.BackoffModel({"a": {"hello": 5}, "b": {"world": 5}}, orders=3)
    assert np.allclose(m.evidence("hell"), np.mean([m.gram[2].get(g) for g in ("<he", "hel", "ell")], axis=0))
    assert np.allclose(m.evidence("zo"), m.gram[1].get("o>"))


def test_evidence_in_bulk_equals_that_of_single_words():
    m = langid.BackoffModel({"a": {"hello": 5, "help": 1}, "b": {"world": 5, "hello": 2}, "c": {"zebra": 3}}, orders=4)
    some = ["hello", "hell", "zoo", "world", "q", "zebras", "hello"]
    assert (m.evidence_of(some) == [m.evidence(w) for w in some]).all() and m.evidence_of([]).shape == (0, 3)
    none = m.word.none.astype(float)
    known = {i: np.log((c + 0.5) / (sum(t.values()) + 0.5 * 5)) for i, (t, c) in enumerate([({"hello": 5, "help": 1}, 5), ({"world": 5, "hello": 2}, 2)])}
    assert np.allclose(m.evidence("hello"), [known[0], known[1], none[2]])
    texts = ["hello world", None, "zoo q", "hell " * 9, ""]
    cache = {}
    assert [m.predict(t, cache, room=1) for t in texts] == [m.predict(t, {}) for t in texts]


def test_patience_alignment():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.patience([], [1]) == []
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        p = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in p)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))


def test_line_dedup(docs):
    long = [f"this is a long enough line number {i}" for i in range(9)]
    rows = [
        (1, "\n".join(long[:3])),
        (2, "\n".join(["own words that nobody else has got", *long[:2], "tail"])),
        (3, "\n".join(long[:3])),
        (4, "short\nshort"),
        (5, "short"),
        (6, None),
        (7, ""),
        (None, long[0]),
        (8, "\n".join([long[5], "short", long[6]])),
        (9, "\n".join([long[5], "short", long[6], "new words at the very end"])),
        (9, "\n".join([long[5], "short", long[6], "new words at the very end"])),
    ]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.line_report(docs(rows)).collect()), key=str)
    want = [(1, rows[0][1], 0), (2, "own words that nobody else has got\ntail", 2), (3, "", 3), (4, "short\nshort", 0), (5, "short", 0), (6, None, 0), (7, "", 0), (None, long[0], 0), (8, rows[8][1], 0), (9, "new words at the very end", 3), (9, "new words at the very end", 3)]
    assert got == sorted(want, key=str)
    assert line_dedup.line_report(docs([])).count() == 0


def lines_left_by_all_pairs(texts, block_ok):
    """Brute force: every earlier document is aligned with every later one."""
    cut = [[x.strip() for x in t.split("\n")] if t else [] for t in texts]
    out = []
    for d, t in enumerate(texts):
        gone = set()
        for e in range(d):
            block = []
            for i, j in [*line_dedup.patience(cut[e], cut[d]), (-9, -9)]:
                if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                    if block_ok([cut[d][y] for _, y in block]):
                        gone |= {y for _, y in block}
                    block = []
                block.append((i, j))
        out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))
    return out


def test_line_dedup_equals_all_pairs_of_long_lines(docs):
    rng = random.Random(8)
    pool = [f"line of more than twenty characters {i}" for i in range(7)]
    own = (f"words of one document only, number {i}" for i in range(10_000))
    texts = [f"{pool[0]}\n{next(own)}\n{pool[0]}", f"{next(own)}\n{pool[0]}\n{next(own)}", f"{next(own)}\n{next(own)}\n{pool[0]}\n{next(own)}"]
    texts += ["\n".join(rng.choice(pool) if rng.random() < 0.6 else next(own) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_report(docs(enumerate(texts))).collect()}
    assert pool[0] not in got[2]
    assert [got[i] for i in range(len(texts))] == lines_left_by_all_pairs(texts, lambda block: any(len(x) >= 20 for x in block))


def test_line_dedup_aligns_short_lines_and_any_white_space(docs):
    rng = random.Random(9)
    pool = ["春眠不覺曉", "處處聞啼鳥", "夜來風雨聲", "to be", "or not to be", "", "a line that makes an anchor alone"]
    texts = ["\n".join(f"{x} {i}" for i in range(60)) for x in ("verse", "verse", "other")]
    texts += ["first line of this document\nsecond line of it\nthird", "first line of this document\r\n\tsecond line of it\u3000\r\nthird\r\nown"]
    texts += ["\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {rng.random()}" for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_report(docs(enumerate(texts))).collect()}
    assert (got[1], got[2], got[4]) == ("", texts[2], "own")
    assert [got[i] for i in range(len(texts))] == lines_left_by_all_pairs(texts, lambda block: sum(map(len, block)) >= 20)


def test_columns_of_any_name_are_kept(spark):
    names = "doc_id text gone doc_ all_ n_lines n_removed found h score lang_pred row d4 h4 n_chars"
    kinds = ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in names.split())
    row = lambda i, t: (i, t, *[f"{c}!" for c in names.split()[2:-1]], 5)
    text = "a line that is long enough to be an anchor\npassword = abcdefgh12\nmore of it"
    df = spark.createDataFrame([row(1, text), row(2, text + "\nown words"), row(3, None)], kinds)
    out = line_dedup.dedup_lines(df, counts=("lines_", "removed_"))
    assert out.columns == [*df.columns, "lines_", "removed_"]
    assert {r["doc_id"]: (r["text"], r["removed_"], r["gone"], r["n_lines"], r["all_"]) for r in out.collect()} == {1: (text, 0, "gone!", "n_lines!", "all_!"), 2: ("own words", 3, "gone!", "n_lines!", "all_!"), 3: (None, 0, "gone!", "n_lines!", "all_!")}
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["found"], r["h"], r["row"], r["d4"], r["n_chars"]) for r in clean.collect()}
    want = text.replace("password = abcdefgh12", "[secret]")
    assert got[1] == (want, "found!", "h!", "row!", "d4!", len(want)) and got[3] == (None, "found!", "h!", "row!", "d4!", 5)
    told = langid.identify(df, langid.BackoffModel({"en": {"line": 3}}), "p", "q")
    assert told.columns == [*df.columns, "p", "q"] and {r["score"] for r in told.collect()} == {"score!"}


def test_letters_beside_number_forms_count(spark, docs):
    model = langid.BackoffModel({"en": {"the": 5, "cat": 2}, "fr": {"le": 5, "chat": 2}})
    assert langid.words("x² the² Ⅷa 12 _b_") == ["x", "the", "a", "b"]
    for text in ("x²", "the²", "Ⅷa"):
        assert model.predict(text, {})[0] in ("en", "fr")
    assert model.predict("the²", {})[0] == "en" and model.predict("²Ⅷ 12", {}) == ("und", 0.0)
    long = "le chat " * 50_000
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs([(1, long), (2, None), (3, ""), (4, "the")]), model).collect()}
    assert got == {1: "fr", 2: "und", 3: "und", 4: "en"}
    assert langid.language_report(docs([])).count() == 0


def test_all_sampled_words_are_known(docs):
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = [(i, f"wort{name(i)} und noch eines", "de") for i in range(300)] + [(1000 + i, f"word{name(i)} and one more", "en") for i in range(300)]
    model = langid.fit(docs(rows))
    for i, text, _ in rows:
        assert (model.word.get(text.split()[0]) is not None) == (zlib.crc32(str(i).encode()) % 3 != 1)


def test_fast_ids_equal_the_tokenizer():
    ids = packing.fast_ids(*packing.tokenizer_files())
    rng = random.Random(3)
    texts = ["<|endoftext|> x", "a\x1cb", "²³ Ⅷ x", "it's  we'll\n\n x", *pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:60]]
    pool = [range(32, 127), range(0, 0x400), range(0x2000, 0x3100), range(0xE000, 0x1FFFF), [9, 10, 11, 12, 13, 32, 39, 0x85, 0x1C, 0xB2, 0x2160, 0x301]]
    texts += ["".join(chr(rng.choice(rng.choice(pool))) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    for t in texts:
        assert ids(t) == np.array(ids.exact.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_packing(docs, spark):
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [None, "", "x", "long words " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "abc")]
    out = packing.packing_report(docs(rows)).collect()
    exact = packing.fast_ids(*packing.tokenizer_files()).exact
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array(exact.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted(by[i], key=lambda r: r["piece"])
        mine = mine[:: 2 if i == 0 else 1]
        assert [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine])[:-1])
        assert sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 1024 for r in mine[1:])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)
        assert len(mine) == -(-len(ids) // 1024)
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    best = -(-sum(r["length"] for r in out) // 1024)
    assert len(seqs) <= best * 1.03 + 2
    assert packing.packing_report(docs([])).count() == 0


@pytest.mark.xfail(reason="open: with groups of only 125 items packing ends 4.1 % above the bound, not 3 %")
def test_packing_levels_meet_across_partitions(spark):
    items = spark.range(4000).selectExpr("id", "cast(1 + pmod(id * 7919, 1023) as bigint) as length").repartition(16)
    out = packing.pack(items, group_items=150).collect()
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert len(out) == 4000 and max(fill.values()) <= 1024
    assert len(fill) <= sum(fill.values()) / 1024 * 1.03 + 1


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit(np.array([6, 5, 4, 3]), 10).tolist() == [0, 1, 0, 1]
