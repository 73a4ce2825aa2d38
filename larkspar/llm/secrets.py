"""Secret scans by multipart credential linking, with DataFrame functions only.

Three base patterns find secrets that stand for themselves; "either case" means ASCII letters. Access identifiers,
secrets and endpoints are also parts of one credential: weak candidates of the three classes are reported only when a complementary part lies
within `scope` characters. Parts are intervals of code points; an equi-join on scope-wide buckets, then the exact
distance, links them, so the pairs of a bucket are bounded by the scope and not by the document.

Defined cases: null text counts as empty; a null doc_id is kept as null; repeated rows each give a row; columns
beside doc_id and text are ignored by the scan and kept by `redact`, whatever their names; very long texts are taken
whole. The empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The patterns of the base kinds and of the weak candidates.
KEYWORDS = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN_HEAD = KEYWORDS + r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the maximal runs of 32 or more
WEAK_KEY = r"[A-Za-z0-9+/]{40,}"
WEAK_ID = r"""(?i:client_id|access_id|account_id|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@%&=+-]+"""
KINDS = ["assign", "access", "hex", "weak_key", "weak_id", "endpoint"]
CLASS = {"assign": "secret", "hex": "secret", "weak_key": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}
#: What must be near a weak candidate of a kind.
COMPLEMENTS = {"weak_key": ["id", "endpoint"], "weak_id": ["secret"], "endpoint": ["secret"]}
SPAN = "struct<s:int,k:int,e:int>"
PART = 128


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans of the leftmost non-overlapping matches that `keep` accepts: marks around matches, then running lengths."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", "\u0001$1\u0001"), "\u0001", -1)
    sized = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), ((i % 2 == 1) & keep(p)).alias("hit")))
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("part"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    at = KINDS.index(kind)

    def step(acc: Column, p: Column) -> Column:
        """Spans are gathered in parts of bounded size, as an array is copied by each append."""
        end = acc["at"] + p["n"]
        part = F.concat(acc["part"], F.array(F.struct(acc["at"].alias("s"), F.lit(at).alias("k"), end.alias("e")).cast(SPAN)))
        full = p["hit"] & (F.size(acc["part"]) >= PART - 1)
        grown = F.when(full, none).when(p["hit"], part).otherwise(acc["part"])
        return F.struct(end.alias("at"), grown.alias("part"), F.when(full, F.concat(acc["out"], F.array(part))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sized, start, step, lambda acc: F.concat(F.flatten(acc["out"]), acc["part"]))


def _parts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the digest h of the text, and an array of spans per kind."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    t = F.translate(raw, "\u0001", "\u0002")  # the mark itself is in no pattern
    low = F.lower(t)
    has = lambda *words: _any(F.contains(low, F.lit(w)) for w in words)  # noqa: E731  a cheap test that every match passes
    none = F.array().cast(f"array<{SPAN}>")
    rules = {
        "assign": (ASSIGN, has("passw", "secret", "token", "api"), lambda p: F.length(F.regexp_replace(p, "^" + ASSIGN_HEAD, "")) >= 8),
        "access": (ACCESS, F.contains(t, F.lit("AKIA")), lambda p: F.length(p) >= 16),
        "hex": (HEX, t.rlike("[0-9a-f]{32}"), lambda p: F.lit(True)),
        "weak_key": (WEAK_KEY, t.rlike("[A-Za-z0-9+/]{40}"), lambda p: p.rlike("[0-9]") & p.rlike("[a-z]") & p.rlike("[A-Z]")),
        "weak_id": (WEAK_ID, has("client_id", "access_id", "account_id", "username", "login"), lambda p: F.lit(True)),
        "endpoint": (ENDPOINT, F.contains(t, F.lit("://")), lambda p: F.lit(True)),
    }
    cols = [F.when(test, _spans(t, pattern, kind, keep)).otherwise(none).alias(kind) for kind, (pattern, test, keep) in rules.items()]
    return docs.select("doc_id", F.xxhash64(raw).alias("h"), *cols)


def _any(tests) -> Column:
    out = None
    for x in tests:
        out = x if out is None else out | x
    return out


def _label(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def linked(parts: DataFrame, scope: int) -> DataFrame:
    """Rows (doc_id, h, weak: spans) of the weak candidates that have a complementary part within scope."""
    weak_kinds = [k for k in KINDS if k in COMPLEMENTS]
    some = parts.where(_any(F.size(k) > 0 for k in weak_kinds)).where(_any(F.size(k) > 0 for k in KINDS))
    each = some.select("doc_id", "h", F.explode(F.concat(*KINDS)).alias("x")).select("doc_id", "h", "x.*").distinct()
    number = F.create_map(*[v for i, k in enumerate(KINDS) for v in (F.lit(i), F.lit(CLASS[k]))])
    each = each.withColumn("class", number[F.col("k")])
    bucket = lambda c: F.floor(c / scope)
    right = each.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("class").alias("class2"), F.explode(F.sequence(bucket(F.col("s")), bucket(F.col("e")))).alias("b2"))
    left = each.where(F.col("k").isin([KINDS.index(k) for k in weak_kinds])).withColumn("b", F.explode(F.sequence(bucket(F.col("s") - scope), bucket(F.col("e") + scope))))
    allowed = _any((F.col("k") == KINDS.index(k)) & F.col("class2").isin(v) for k, v in COMPLEMENTS.items())
    near = (F.col("s2") <= F.col("e") + scope) & (F.col("e2") >= F.col("s") - scope)
    hit = left.join(right, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("b") == F.col("b2")) & allowed & near, "left_semi")
    return hit.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "k", "e").cast(SPAN)).alias("weak"))


def scan_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Per row: doc_id, h (digest of the text), base and found: sorted arrays of spans (s, k, e); k numbers KINDS."""
    parts = written(_parts(docs))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    weak = linked(parts, scope).select(F.col("doc_id").alias("d3"), F.col("h").alias("h3"), "weak")
    both = parts.select("doc_id", "h", base.alias("base"), *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")])
    both = both.join(weak, F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("h") == F.col("h3")), "left")
    extra = F.coalesce("weak", F.array().cast(f"array<{SPAN}>"))
    return both.select("doc_id", "h", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", extra)).alias("found"))


def secret_report(docs: DataFrame, scope: int = 200) -> DataFrame:
    """The digest columns per row of docs."""
    found = scan_secrets(docs, scope)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_label(F.col("base")), 256).alias("base_sha256"), _label(F.col("found")).alias("spans"))


def redact(docs: DataFrame, scope: int = 200, mark: str = "[secret]") -> DataFrame:
    """docs with every reported span replaced by mark and n_chars set anew; documents without spans stay as they are."""
    found = scan_secrets(docs, scope).where(F.size("found") > 0).groupBy(F.col("doc_id").alias("d4"), F.col("h").alias("h4")).agg(F.first("found").alias("found"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # no name of docs meets one of ours
    raw = F.col("row.text")
    joined = rows.withColumn("h", F.xxhash64(F.coalesce(raw, F.lit("")))).join(found, F.col("row.doc_id").eqNullSafe(F.col("d4")) & (F.col("h") == F.col("h4")), "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:  # overlapping spans share one mark
        fresh = x["s"] >= acc["at"]
        gap = F.substr(raw, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("found", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(raw, acc["at"] + 1)))
    some = F.col("found").isNotNull()
    joined = joined.select("row", F.struct(F.when(some, clean).otherwise(raw).alias("text"), some.alias("some")).alias("new"))
    new = {"text": F.col("new.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("new.some"), F.length("new.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return joined.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
