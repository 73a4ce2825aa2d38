import hashlib
import random
import re

import pytest

from larkspar.llm.secrets import redact, secret_report

HEAD = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""


def base_spans(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(HEAD + r"([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def expected(text):
    spans = base_spans(text or "")
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return tuple(sum(x[0] == k for x in spans) for k in ("assign", "access", "hex")) + (hashlib.sha256(joined.encode()).hexdigest(), joined)


CASES = [
    None, "", "no secret here", "token=api_key : longvalue99", 'PassWord: "abcdefgh" secret=short', "token=secret=abcdefghij", "x\u0001token=abcdefgh1\u0001y",
    "é😀 api_key = 'ZZZZZZZZ9' AKIAABCDEFGHIJKL AKIAA", "a" * 31 + " " + "b" * 32 + "g" + "0123456789abcdef" * 3, "token=12345678token=12345678", "AKIA" * 5 + "secret:=x_______",
    "ſecret=abcdefghi", "token   =   \"abcdefghijk\"", "hello " * 20_000 + "passwd=12345678901",
]


def random_text(rng):
    bits = ["token", "=", ":", " ", '"', "'", "secret", "Api_Key", "apikey", "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", "é", "\n", "xyz", "-", "."]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(40)))


def test_base_spans_equal_brute_force(docs):
    rng = random.Random(5)
    texts = CASES + [random_text(rng) for _ in range(400)]
    found = {r["doc_id"]: r for r in secret_report(docs(enumerate(texts))).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        n_assign, n_access, n_hex, digest, joined = expected(t)
        r = found[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (n_assign, n_access, n_hex, digest), t
        assert ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")) == joined


def test_weak_candidates_need_a_complement(docs):
    key = "aB3" * 13 + "x"
    rows = [
        (1, f"see {key} alone"),
        (2, f"username=bob and {key}"),
        (3, f"username=bob {'z ' * 150} {key}"),
        (4, "https://example.com/path only"),
        (5, "https://example.com/path token=abcdefgh"),
        (5, "https://example.com/path token=abcdefgh"),
        (None, "login: meg secret=abcdefgh"),
    ]
    got = sorted((str(r["doc_id"]), r["spans"]) for r in secret_report(docs(rows)).collect())
    assert got == [
        ("1", ""),
        ("2", "weak_id:0:12,weak_key:17:57"),
        ("3", ""),
        ("4", ""),
        ("5", "endpoint:0:24,assign:25:39"),
        ("5", "endpoint:0:24,assign:25:39"),
        ("None", "weak_id:0:10,assign:11:26"),
    ]


def test_long_weak_keys_link(docs):
    key = ("aB3/xY9+" * 11)[:86]
    text = f"account_id=store1 AccountKey={key}== https://store1.example.net/"
    at = text.index(key)
    rows = [(1, text), (2, f"AccountKey={key}==")]
    got = {r["doc_id"]: r["spans"] for r in secret_report(docs(rows)).collect()}
    assert got == {1: f"weak_id:0:17,weak_key:{at}:{at + 86},endpoint:{at + 89}:{len(text)}", 2: ""}
    assert key not in {r["doc_id"]: r["text"] for r in redact(docs(rows)).collect()}[1]


def test_redaction_replaces_only_spans(docs):
    rows = [(1, "a token=abcdefgh b", "en", "s", 18), (2, "clean", "en", "s", 5), (3, None, None, None, None), (4, "é token=" + "0a" * 20 + " z")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in redact(docs(rows)).collect()}
    assert got == {1: ("a [secret] b", 12), 2: ("clean", 5), 3: (None, None), 4: ("é [secret] z", 12)}


@pytest.mark.parametrize("op", [secret_report])
def test_empty_table(docs, op):
    assert op(docs([])).count() == 0
