"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong patterns (BASE) are reported wherever they match.  Weak ones (WEAK: identifiers, bare key material and
endpoints that mean little alone) are reported only when complementary parts stand in the same scope, SCOPE
characters around them in the same text: an identifier needs a secret, key material needs an identifier, an
endpoint needs both.  Parts meet by an interval join on (row, bucket of SCOPE characters) that only asks
whether a partner exists, so no pairs come out of it, and a bucket holds no more spans than SCOPE characters can.

Positions come from the text with every match set between two marks: the lengths of its pieces add up to the
spans.  A text is read once; after that only lengths and spans move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MARK, OTHER = "\x01", "\x02"  # a mark in the text itself is read as OTHER: one character too, and in no pattern
SCOPE = 240

# The base patterns of the contract and the least length of what they find.
BASE = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}

WEAK = {
    "ident": r"""(?i)(?<![a-z0-9])(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "key": r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"""(?i)(?:https?|ftp|sftp|jdbc:[a-z]+|mongodb|postgres(?:ql)?|mysql|redis|amqp)://[^\s"'<>]{3,}""",
}
KINDS = [*BASE, *WEAK]
#: What a kind can stand for, and what has to be in its scope.
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "ident": "identifier", "endpoint": "endpoint"}
NEEDS = {"ident": ["secret"], "key": ["identifier"], "endpoint": ["identifier", "secret"]}


def passes(kind: str, match: Column) -> Column:
    """Whether a match counts."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, BASE[kind], 2)) >= LEAST[kind]
    if kind in LEAST:
        return F.length(match) >= LEAST[kind]
    if kind == "key":  # words, numbers and plain hexadecimal are no key material
        return match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    return F.lit(True)


def pieces(kind: str, parts: Column) -> Column:
    """Lengths of the text's pieces, matches in the odd places, with whether they count; null without a match that does."""
    each = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), F.when(i % 2 == 1, passes(kind, p)).otherwise(False).alias("hit")))
    return F.when(F.size(parts) > 1, each)


def scan(docs: DataFrame) -> DataFrame:
    """A written table: a number for each row, its doc_id and the pieces of each kind."""
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(MARK), F.lit(OTHER))
    pattern = BASE | WEAK
    # runs under the least length never count, and a run is found whole or not at all
    pattern["hex"] = r"[0-9a-f]{%d,}" % LEAST["hex"]
    marked = docs.select("doc_id", text.alias("text"))
    parts = marked.select("doc_id", *[F.split(F.regexp_replace("text", pattern[k], f"{MARK}$0{MARK}"), MARK, -1).alias(k) for k in KINDS])
    found = parts.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[pieces(k, F.col(k)).alias(k) for k in KINDS])
    return written(found, "scanned")


def spans(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, stop) of all matches that count, weak ones too; code points, stop exclusive."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("pieces")) for k in KINDS]))
    some = scanned.where(F.coalesce(*KINDS).isNotNull()).select("row", each.alias("e")).where("e.pieces IS NOT NULL AND exists(e.pieces, p -> p.hit)")
    flat = some.select("row", "e.kind", F.posexplode("e.pieces").alias("at", "p"))
    stop = F.sum("p.n").over(Window.partitionBy("row", "kind").orderBy("at"))
    return flat.select("row", "kind", (stop - F.col("p.n")).alias("start"), stop.alias("stop"), "p.hit").where("hit").drop("hit")


def bucketed(parts: DataFrame, widen: int) -> DataFrame:
    first, last = F.floor((F.col("start") - widen) / SCOPE), F.floor((F.col("stop") + widen) / SCOPE)
    return parts.withColumn("bucket", F.explode(F.sequence(first, last)))


def linked(found: DataFrame) -> DataFrame:
    """The weak spans that have all the parts they need within SCOPE characters."""
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    have = bucketed(found.select("row", role[F.col("kind")].alias("role"), F.col("start").alias("from"), F.col("stop").alias("to"), "start", "stop"), 0).drop("start", "stop").distinct()
    out = None
    for kind, needs in NEEDS.items():
        kept = found.where(F.col("kind") == kind)
        for need in needs:
            ask = bucketed(kept, SCOPE).alias("a")
            part = have.where(F.col("role") == need).alias("h")
            near = (F.col("h.from") <= F.col("a.stop") + SCOPE) & (F.col("h.to") >= F.col("a.start") - SCOPE)
            same = (F.col("a.row") == F.col("h.row")) & (F.col("a.bucket") == F.col("h.bucket"))
            kept = ask.join(part, same & near, "left_semi").select("row", "kind", "start", "stop").distinct()
        out = kept if out is None else out.union(kept)
    return out


def joined_spans(found: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked of every row of (doc_id, text).

    spans lists kind:start:stop of base and linked spans by start, then by kind as in KINDS; base_sha256 is
    the hash of that list of the base spans alone.  A null text is empty; rows that repeat are each
    reported; other columns are ignored; an empty table gives no rows.
    """
    scanned = scan(docs)
    found = written(spans(scanned), "spans")
    base = found.where(F.col("kind").isin(list(BASE)))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    entry = F.struct("start", order.alias("place"), "kind", "stop")
    is_base = F.col("kind").isin(list(BASE))
    # the spans of one text: fewer than its characters
    rows = base.union(linked(found)).groupBy("row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined_spans(F.collect_list(F.when(is_base, entry))), 256).alias("base_sha256"),
        joined_spans(F.collect_list(entry)).alias("spans"),
        F.count_if(~is_base).alias("n_linked"),
    )
    none = F.sha2(F.lit(""), 256)
    out = scanned.select("row", "doc_id").join(rows, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[zero(f"n_{k}") for k in BASE], F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"))
