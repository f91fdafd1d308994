"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of five-word shingles gives a signature of SYMBOLS symbols of 16 bits, one for each of as many hash
functions.  The signature is cut into CHUNKS chunks.  If two signatures differ in fewer than 2 * CHUNKS
symbols, some chunk has one error at most (pigeonhole); so every chunk is indexed once for each place
of its allowed error, with that symbol left out, and two signatures that agree in such a key meet.  All
pairs at a distance under 2 * CHUNKS are sure to meet, most others of the wanted similarity too.

Rows with equal shingle sets are one class from the start, so groups of exact copies count once.  In a group that
shares a key, every member is compared with the smallest member only; links are confirmed on the full
sets and joined to components.  Where members of a group are then still in different components,
those members that share one of their rarest shingles are compared as well.  So no link between different
texts is lost, and a large group of copies costs about as many comparisons as it has members.

The pairs of a document that has very many are dealt by the other document, and a frequent shingle's rows by their number, so that no
document or shingle with most of the pairs is one task's.  A key's members and a component's links are joined to one row for each key, with rows of 16 bytes: there
the skew join of adaptive execution splits a hot key.

A pair is missed if no chunk of its signatures has under two errors, or if the quick distance of two sketches is beyond its bound:
about 3e-7 at a similarity of 0.85, 2e-5 at 0.8, and 1e-9 for the quick distance; less for pairs that are more similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, small_batches, written

SHINGLE_WORDS = 5
CHUNKS, CHUNK_SYMBOLS = 10, 6
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
SLICES = 4  # bits of each symbol that the quick distance looks at
SIMILARITY = (80, 100)
MAP_WORDS = 16  # 64-bit words of a set's bit map
MAP = [f"w{k}" for k in range(MAP_WORDS)]
WORDS_KEPT = 200_000
SALTS = 16
OFTEN = 256  # rows of a shingle for each group that they are dealt over
SETS = "doc_id long, n_shingles long, f1 long, f2 long, signature binary"

_DRAWS = np.random.default_rng(20240607)
_A = _DRAWS.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAWS.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_WEIGHT = _DRAWS.integers(0, 1 << 63, (CHUNKS, CHUNK_SYMBOLS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _DRAWS.integers(0, 1 << 63, (CHUNKS, CHUNK_SYMBOLS), dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = h
        return h


def shingles(text: str | None, hashes: WordHashes, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: n words each, or all words where they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * _STEP + w[i : len(w) - size + 1 + i]
    return np.unique(mixed(h))


def signature(own: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols of a set that is not empty."""
    low = np.full(SYMBOLS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(own), 4096):
        np.minimum(low, (own[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return (mixed(low) & np.uint64(0xFFFF)).astype("<u2")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to SETS; f1 and f2 are a 128-bit fingerprint of the whole set."""
    hashes = WordHashes()
    for batch in batches:
        n, f1, f2, sig = [], [], [], []
        for text in batch["text"].to_pylist():
            own = shingles(text, hashes)
            n.append(len(own))
            f1.append(mixed(own + _STEP).sum(dtype=np.uint64))
            f2.append(mixed(own ^ _STEP).sum(dtype=np.uint64))
            sig.append(signature(own).tobytes() if len(own) else None)
        columns = [batch["doc_id"], pa.array(n, pa.int64()), signed(np.array(f1, np.uint64)), signed(np.array(f2, np.uint64)), pa.array(sig, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "f1", "f2", "signature"])


def read_full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingles(t, hashes) for t in batch["text"].to_pylist()]
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        ends = np.cumsum([0, *map(len, sets)])
        column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(flat))
        bits = np.zeros((len(sets), 64 * MAP_WORDS), bool)
        bits[np.repeat(np.arange(len(sets)), np.diff(ends)), (flat >> np.uint64(32)) % np.uint64(64 * MAP_WORDS)] = True
        maps = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        yield pa.RecordBatch.from_arrays([batch["id"], column, *[signed(maps[:, k].copy()) for k in range(MAP_WORDS)]], ["id", "shingles", *MAP])


def index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, signature) to a row for each chunk and place of its allowed error."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            symbols = np.frombuffer(b"".join(part["signature"].to_pylist()), "<u2").astype(np.uint64).reshape(-1, CHUNKS, CHUNK_SYMBOLS)
            weighed = symbols * _WEIGHT
            keys = mixed(weighed.sum(axis=2, dtype=np.uint64)[:, :, None] - weighed + _SALT)
            ids = np.repeat(np.array(part["id"].to_pylist(), np.int64), SYMBOLS)
            yield pa.RecordBatch.from_arrays([signed(keys.reshape(-1)), pa.array(ids)], ["key", "id"])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_shingles, signature) to SLICES longs, each with one bit of every symbol."""
    place = np.uint64(1) << np.arange(SYMBOLS, dtype=np.uint64)
    for batch in batches:
        symbols = np.frombuffer(b"".join(batch["signature"].to_pylist()), "<u2").astype(np.uint64).reshape(-1, SYMBOLS)
        bits = [signed((((symbols >> np.uint64(i)) & np.uint64(1)) * place).sum(axis=1, dtype=np.uint64)) for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["n_shingles"], *bits], ["id", "n", *(f"s{i}" for i in range(SLICES))])


def most_errors(similarity: float, doubt: float = 1e-9) -> int:
    """Symbols that pairs of this similarity differ in by SLICES bits, but for one pair in 1 / doubt."""
    p, tail = (1 - similarity) * (1 - 2.0**-SLICES), 0.0
    for k in range(SYMBOLS, 0, -1):
        tail += math.comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k)
        if tail > doubt:
            return k
    return 0


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """A written table (id, shingles) of these documents, made from their whole texts."""
    texts = docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "text")
    return written(texts.mapInArrow(read_full, "id long, shingles array<long>, " + ", ".join(f"{w} long" for w in MAP)), "shingles")


def hubs(pairs: DataFrame, ends: str) -> dict[str, DataFrame]:
    """For each end ("a", "b" or both), a written table of the ids that have over OFTEN pairs (a, b) there."""
    counts = {one: pairs.groupBy(F.col(one).alias("hub")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OFTEN) for one in ends}
    return {one: written(found.select("hub"), "hubs") for one, found in counts.items()}


def attached(pairs: DataFrame, table: DataFrame, many: dict[str, DataFrame]) -> DataFrame:
    """Pairs (a, b), a written table, with the columns that the table has for both ids.

    The pairs of one of hubs() are dealt over SALTS groups by the other id, and the table's row is copied for these groups alone.
    Hubs are at most a pair in OFTEN, in a table of known size, so finding them moves no pairs while that table is small enough to broadcast.
    """
    out, copies = pairs, {}
    for one, other in (("a", "b"), ("b", "a")):
        own = table.select(*[F.col(c).alias(f"{one}_{c}") for c in table.columns])
        groups = F.array(F.lit(0))
        out = out.withColumn(f"__{one}", F.lit(0))
        if one in many:
            hub = many[one].withColumnRenamed("hub", f"__{one}_hub")
            is_hub = F.col(f"__{one}_hub").isNotNull()
            group = F.when(is_hub, F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(0)
            out = out.join(hub, F.col(one) == F.col(f"__{one}_hub"), "left").withColumn(f"__{one}", group.cast("int")).drop(f"__{one}_hub")
            own = own.join(hub, F.col(f"{one}_id") == F.col(f"__{one}_hub"), "left")
            groups = F.sequence(F.lit(0), F.when(is_hub, SALTS - 1).otherwise(0))
        copies[one] = own.withColumn(f"__{one}_group", F.explode(groups)).drop(f"__{one}_hub")
    for one in "ab":
        out = out.join(copies[one], (F.col(one) == F.col(f"{one}_id")) & (F.col(f"__{one}") == F.col(f"__{one}_group"))).drop(f"__{one}", f"__{one}_group")
    return out


def near_enough(pairs: DataFrame, brief: DataFrame, similarity: tuple[int, int], ends: str) -> DataFrame:
    """A written table of the pairs (a, b) that sizes and the quick distance leave possible; ``ends`` as in hubs()."""
    part, whole = similarity
    unlike = None
    for i in range(SLICES):
        bits = F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))
        unlike = bits if unlike is None else unlike.bitwiseOR(bits)
    near = F.bit_count(unlike) <= most_errors(part / whole)
    sizes = F.least("a_n", "b_n") * whole >= F.greatest("a_n", "b_n") * part
    many = hubs(pairs, ends)
    out = written(attached(pairs, brief, many).where(near & sizes).select("a", "b"), "pairs")
    drop_written(*many.values())
    return out


def confirmed(pairs: DataFrame, full: DataFrame, similarity: tuple[int, int], ends: str) -> DataFrame:
    """A written table of the pairs (a, b) whose full shingle sets are similar enough; ``ends`` as in hubs()."""
    part, whole = similarity
    many = hubs(pairs, ends)
    both = attached(pairs, full.select("id", "shingles"), many)
    shared = F.size(F.array_intersect("a_shingles", "b_shingles")).cast("long")
    union = F.size("a_shingles") + F.size("b_shingles") - shared
    out = written(both.where(shared * whole >= union * part).select("a", "b"), "confirmed")
    drop_written(*many.values())
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) lead to, for every id in a link.

    Large-star and small-star steps in turn, each ending in a written table, until nothing changes;
    a group's smallest id comes from an aggregate, so a node with very many links is no single task.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, was, old = written(links, "links"), None, []
    while True:
        says = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(says) == was or not says[0]:
            drop_written(*old)
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        was = tuple(says)
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old.append(now)
        now = written(small.where(F.col("u") != F.col("v")).distinct(), "links")


def group_documents(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text).

    Two documents are linked where whole * |intersection| >= part * |union| of their shingle sets;
    component_id is the smallest doc_id that links lead to.  Texts without words are linked with nothing.
    Rows with the same doc_id count as one document, linked by what any of them links.  A row with a null
    doc_id has a null component and is kept.  Other columns are ignored; an empty table gives no rows.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(rows.mapInArrow(read_sets, SETS), "sets")
    some = sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    same = ["n_shingles", "f1", "f2"]
    classes = written(some.groupBy(*same).agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature")), "classes")
    keys = classes.select("id", "signature").mapInArrow(index_keys, "key long, id long")
    groups = keys.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members"))
    shared = written(keys.join(groups.where("members > 1"), "key"), "shared")
    brief = written(classes.select("id", "n_shingles", "signature").mapInArrow(slices, "id long, n long, " + ", ".join(f"s{i} long" for i in range(SLICES))), "brief")
    star = written(shared.where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "star")
    # an id has SYMBOLS keys, so it is in no more pairs of a star than that, but where it is the first of a key
    hopeful = near_enough(star, brief, similarity, "a")
    ids = hopeful.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    full = full_sets(rows, ids)
    links = confirmed(hopeful, full, similarity, "a")
    drop_written(brief, star, hopeful, full)
    links = written(links.union(between(shared, components(links), rows, similarity)), "confirmed")
    drop_written(shared)
    classed = sets.join(classes.select(*same, "id"), same, "left")
    # an id may be in several classes where its rows have different texts
    alike = classed.where(F.col("doc_id") != F.col("id")).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    found = components(links.select("a", "b").union(alike.join(repeated(some), F.col("b") == F.col("again"), "left_semi")))
    out = classed.join(found.withColumnRenamed("id", "of"), F.col("of") == F.coalesce("id", "doc_id"), "left")
    component = F.coalesce("component", "id", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def repeated(sets: DataFrame) -> DataFrame:
    """Ids of several rows whose shingle sets differ."""
    return sets.groupBy(F.col("doc_id").alias("again")).agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo < hi").select("again")


def between(shared: DataFrame, first: DataFrame, docs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) of members of groups that are in different components so far.

    Of two similar sets, each has one of the other's among its rarest shingles (as many as it could lack,
    and one).  So only documents that share such a shingle are compared, and a copy with many
    changes of its own, whose rarest shingles are all its own, is compared with nothing.
    """
    part, whole = similarity
    member = shared.where(F.col("members") > 2).select("key", "id").join(first, "id", "left")
    member = member.select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed_keys = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    rest = written(member.join(mixed_keys, "key", "left_semi").select("id", "c").distinct(), "rest")
    full = full_sets(docs, rest.select("id"))
    each = full.join(rest, "id").select("id", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("often"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    # shingles of one component alone come first in the order of rarity: no pair looked for here shares them
    ranked = each.join(often, "s").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("often", "s")))
    ranked = ranked.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("id")))
    prefix = F.col("n") - F.floor((F.col("n") * part + whole - 1) / whole) + 1
    ways = (F.floor(F.col("often") / OFTEN) + 1).cast("int")  # groups that a shingle's rows are dealt over; each meets all rows
    prefixes = ranked.where(F.col("n") - F.col("m") + F.col("rank") <= prefix).select("id", "c", "n", "m", "s", ways.alias("ways"))
    rare = written(prefixes.join(full.select("id", *MAP), "id"), "rare")
    a, b = (rare.withColumn("salt", x).select("s", "salt", F.col("id").alias(y), *[F.col(k).alias(f"{k}{y}") for k in ["c", "n", "m", *MAP]]) for x, y in ((F.pmod(F.xxhash64("id"), F.col("ways")).cast("int"), "a"), (F.explode(F.sequence(F.lit(0), F.col("ways") - 1)), "b")))
    # they can share no more than either has of shingles that lie in several components, and none of those
    # whose bit the other's map lacks
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{w}{x}").bitwiseAND(F.bitwise_not(f"{w}{y}"))) for w in MAP), F.lit(0))
    most = F.least("ma", "mb", F.col("na") - lacks("a", "b"), F.col("nb") - lacks("b", "a"))
    sizes = most * (whole + part) >= (F.col("na") + F.col("nb")) * part
    pairs = written(a.join(b, ["s", "salt"]).where((F.col("ca") < F.col("cb")) & sizes).select("a", "b").distinct(), "between")
    links = confirmed(pairs, full, similarity, "ab")
    drop_written(rest, full, rare, pairs)
    return links
