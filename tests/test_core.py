"""Hash algebra, stream readers, strategies, chunks and archives against plain definitions and the standard codecs."""

import gzip
import io
import random
import struct
import tracemalloc
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillprint import M61, M127, HashSpec
from rillprint.functions import exprs as E
from rillprint.functions import kernels as K
from rillprint.functions.blake3 import blake3
from rillprint.operators import archive_log, cdc, cdh, lz77, monoid, verify
from rillprint.operators import tokens as T
from rillprint.plans import objects as P
from rillprint.sources import objects as S
from rillprint.sources.archives import zip_entries, zip_entry_ops
from rillprint.sources.formats import FORMATS, extract
from rillprint.sources.streams import StreamError


def plain(data, base=131, prime=M61):
    return sum((c + 1) * pow(base, len(data) - 1 - i, prime) for i, c in enumerate(data)) % prime


def contents():
    r = random.Random(42)
    yield from (b"", b"\0", b"\0\0", b"\xff", b"a", b"hello world", b"abc" * 700, b"xyz" * 300, bytes(range(256)) * 9)
    yield b"the quick brown fox jumps over the lazy dog " * 90
    yield b"".join(b"x" * 64 if k % 2 else r.randbytes(64) for k in range(40))
    yield b"0123456789abcdefghi" + bytes(range(256)) * 127 + b"0123456789abcdefghi"
    yield b"\x42" * 50000
    yield r.randbytes(5000)


ALL = list(contents())


@pytest.mark.parametrize("base,prime", [(131, M61), (257, M61), (M61 - 2, M61), (131, M127), (2, 31)])
def test_kernel_hash_is_the_definition(base, prime):
    some = [c[:3000] for c in ALL]
    assert K.hash_many(some, base, prime) == [plain(c, base, prime) for c in some]


def test_fixed_values():
    assert [K.hash_bytes(x, 131) for x in (b"", b"\0", b"\xff", b"hello world", b"abcabcab")] == [0, 1, 256, 430229793999670395, 65386361381810701]
    assert K.hash_bytes(b"hello world", 131, M127) == 0x215745F87BB7DB22C1C1
    assert cdc.gear_table()[:2] == [7614046902333618973, 9161513270852281710]


def test_phi_and_composition():
    for q in (0, 1, 2, 7, 64, 1001):
        for a in (1, 2, 131, M61 - 1):
            assert K.phi(q, a, M61) == sum(pow(a, i, M61) for i in range(q)) % M61
    a, b = b"left part", b"and the right one"
    assert K.concat(plain(a), plain(b), len(b), 131, M61) == plain(a + b)
    assert K.repeat(plain(a), len(a), 5, 131, M61) == plain(a * 5)
    assert K.overlap(plain(a), len(a), 31, plain(a[: 31 % len(a)]), 131, M61) == plain((a * 9)[:31])


def test_spec_is_checked():
    for bad in (dict(bases=()), dict(bases=(1,)), dict(bases=(131, 131)), dict(prime=M61 - 2), dict(bases=(M61,))):
        with pytest.raises(ValueError):
            HashSpec(**bad)


@pytest.mark.parametrize("base", [2, 131, 257, 40000, (1 << 31) + 11])
def test_native_hash(spark, base):
    some = [c[:400] for c in ALL] + [None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(some)], "i int, c binary")
    got = dict(df.select("i", E.poly_hash(F.col("c"), base)).collect())
    assert got == {i: None if c is None else plain(c, base) for i, c in enumerate(some)}


def test_native_algebra(spark):
    rows = [(q, a) for q in (0, 1, 2, 63, 1 << 40) for a in (0, 1, 131, M61 - 1)]
    df = spark.createDataFrame(rows, "q long, a long")
    for q, a, phi, power, mul, sub in df.select("q", "a", E.phi(F.col("q"), F.col("a")), E.power(131, F.col("q")), E.mod_mul(F.col("a"), F.lit(M61 - 1)), E.mod_sub(F.lit(5), F.col("a"))).collect():
        assert (phi, power, mul, sub) == (K.phi(q, a, M61), pow(131, q, M61), a * (M61 - 1) % M61, (5 - a) % M61)


@pytest.mark.parametrize("fmt", FORMATS)
def test_every_format_and_strategy_hashes_the_content(fmt):
    for data in ALL:
        for level in (1, 6, 9) if fmt in ("deflate", "gzip") else (1, 3, 10, 19) if fmt == "zstd" else (None,):
            ops = extract(S.encode(data, fmt, level), fmt)
            assert lz77.decode(ops) == data
        for spec in (HashSpec(), HashSpec((131, 257)), HashSpec(prime=M127)) if len(data) < 5000 else (HashSpec(),):
            want = tuple(K.hash_bytes(data, b, spec.prime) for b in spec.bases)
            assert all(cdh.cdh(ops, spec, m, *cdh.WINDOWS[fmt]) == want for m in cdh.METHODS)


def test_references_before_the_start_are_refused():
    for ops in ([b"A", (5, 1)], [(1, 1)]):
        with pytest.raises(ValueError):
            lz77.decode(ops)
        for method in cdh.METHODS:
            with pytest.raises(ValueError):
                cdh.cdh(ops, method=method)
    state = cdh.SlidingState(HashSpec(), 5, 3)
    state.literals(bytes(range(10)))
    with pytest.raises(ValueError):
        state.copy(10, 3)


def test_sliding_state_after_every_step():
    r = random.Random(3)
    state, out = cdh.SlidingState(HashSpec((131, 257)), 16, 9), bytearray()
    for _ in range(400):
        if len(out) and r.random() < 0.6:
            d, n = r.randint(1, min(16, len(out))), r.randint(1, 9)
            state.copy(d, n)
            for _ in range(n):
                out.append(out[-d])
        else:
            out.append(r.randrange(256))
            state.literals(bytes(out[-1:]))
        assert state.length == len(out) and len(state.window) <= state.size
        assert state.current() == (K.hash_bytes(bytes(out), 131), K.hash_bytes(bytes(out), 257))


def test_rope_substrings():
    rope, data = cdh.Segments(131, M61), b"abcd" + b"cd" * 6 + b"xyz" + b"dxyz"
    rope.literals(b"abcd")
    rope.copy(2, 12)
    rope.literals(b"xyz")
    rope.copy(4, 4)
    assert rope.hash == plain(data)
    for a in range(len(data) + 1):
        for b in range(a, len(data) + 1):
            assert rope.substring(a, b - a) == plain(data[a:b])


def test_strategies_over_long_runs_and_forgotten_prefixes(monkeypatch):
    r = random.Random(4)
    for known, run in ((1 << 16, 1 << 16), (3, 7)):
        monkeypatch.setattr(cdh.Segments, "KNOWN", known)
        monkeypatch.setattr(cdh.Segments, "RUN", run)
        for _ in range(60):
            ops, n = [], 0
            for _ in range(r.randint(0, 40)):
                if not n or r.random() < 0.4:
                    ops.append(r.randbytes(r.choice([1, 2, 63, 64, 65, 200])))
                    n += len(ops[-1])
                else:
                    ops.append((min(n, r.choice([1, 2, 3, r.randint(1, n)])), r.choice([1, 3, 10, r.randint(1, 300), 1500])))
                    n += ops[-1][1]
            data = lz77.decode(ops)
            for prime in (M61, (1 << 127) - 1):
                spec = HashSpec((131, 257), prime)
                want = tuple(K.hash_bytes(data, b, prime) for b in spec.bases)
                assert cdh.cdh(ops, spec, "rope") == want == cdh.cdh(ops, spec, "prefix")


def test_rope_is_no_larger_than_its_operations():
    ops = [random.Random(5).randbytes(1 << 20), (1 << 19, 1 << 19)]
    tracemalloc.start()
    h = cdh.cdh(ops, method="rope")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert h == (K.hash_bytes(lz77.decode(ops), 131),) and peak < 6 << 20


def test_encoder_is_greedy_and_reversible():
    assert lz77.encode(b"abcabcabc") == [b"abc", (3, 6)]
    assert lz77.encode(b"abcXabcYabc")[-1] == (8, 3)  # the farthest of equals
    for data in ALL:
        assert lz77.decode(lz77.encode(data[:2000])) == data[:2000]


@pytest.mark.parametrize("fmt,data", [("deflate", b""), ("deflate", b"\x07"), ("deflate", zlib.compress(b"hello hello hello")[2:6]), ("gzip", b"\x1f\x8c\x08" + bytes(20)), ("gzip", b"\x1f\x8b\x07" + bytes(20)), ("zip", b""), ("zip", random.Random(1).randbytes(300)), ("lz4_frame", b"1234567"), ("lz4_frame", b"\x04\x22\x4d\x18"), ("lz4_block", b"\x1fa\0\0")])
def test_malformed_streams_raise(fmt, data):
    with pytest.raises(ValueError):
        extract(data, fmt)


def test_gzip_header_fields():
    body, data = zlib.compressobj(6, wbits=-15), b"gzip header " * 30
    raw = body.compress(data) + body.flush()
    for flags, extra in ((4, struct.pack("<H", 3) + b"abc"), (8, b"name\0"), (16, b"note\0"), (2, b"\0\0"), (28, struct.pack("<H", 1) + b"x" + b"n\0c\0")):
        packed = b"\x1f\x8b\x08" + bytes([flags]) + bytes(6) + extra + raw + bytes(8)
        assert lz77.decode(extract(packed, "gzip")) == data
    assert lz77.decode(extract(gzip.compress(b"first") + gzip.compress(b"second"), "gzip")) == b"first"


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dir/", b"")
        for name, data in files.items():
            z.writestr(name, data, zipfile.ZIP_STORED if name.startswith("s") else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def test_zip_archives():
    data = archive(stored=b"plain" * 9, deflated=b"packed " * 50, empty=b"")
    entries = zip_entries(data)
    assert [e.filename for e in entries] == ["stored", "deflated", "empty"]
    assert [lz77.decode(zip_entry_ops(data, e)) for e in entries] == [b"plain" * 9, b"packed " * 50, b""]
    assert entries[0].crc32 == zlib.crc32(b"plain" * 9)
    locked = bytearray(data)
    locked[entries[1].local_header_offset + 6] |= 1
    with pytest.raises(StreamError):
        zip_entry_ops(bytes(locked), entries[1])


@pytest.mark.parametrize("sizes", [(256, 1024, 4096), (2048, 8192, 65536), (4, 64, 256), (10, 10, 10)])
def test_chunks(sizes):
    spec = cdc.ChunkSpec(*sizes)
    for data in [*ALL, random.Random(7).randbytes(60000)]:
        parts = cdc.chunks(data, spec)
        assert b"".join(parts) == data and all(len(p) <= spec.max_size for p in parts) and all(len(p) >= min(spec.min_size, spec.max_size) for p in parts[:-1])
        if spec.min_size > spec.bits:
            assert cdc.cut_points(data, spec) == cdc._cut_in_turn(data, spec)
    for bad in ((0, 1, 2), (5, 5, 4)):
        with pytest.raises(ValueError):
            cdc.ChunkSpec(*bad)


def test_chunk_sizes_and_stability():
    data = random.Random(600).randbytes(1_000_000)
    for avg in (4096, 8192, 16384):
        n = len(cdc.chunks(data, cdc.ChunkSpec(avg // 4, avg, avg * 4)))
        assert 0.5 < len(data) / n / avg < 2
    small = cdc.ChunkSpec(256, 1024, 4096)
    a, b = set(cdc.chunks(data[:50000], small)), set(cdc.chunks(data[:25000] + b"inserted in the middle" + data[25000:50000], small))
    assert len(a & b) > len(a) * 0.8


def test_blake3():
    # Published hashes of the empty string and of bytes 0, 1, ... 250, 0, ... of 1 and 1024 bytes.
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"\0").hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    # fixed values: the published vectors of several chunks, over bytes that count up to 250 again and again
    several = {
        1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
        1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
        2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
        8193: "bab6c09cb8ce8cf459261398d2e7aef35700bf488116ceb94a36d0f5f1b7bc3b",
    }
    assert all(blake3(bytes(i % 251 for i in range(n))).hex() == h for n, h in several.items())
    assert len(blake3(bytes(5000))) == 32 and blake3(bytes(5000)) != blake3(bytes(5001))


def test_ordered_concat_any_blocks(spark):
    r = random.Random(1)
    pieces = [(k, i, r.randbytes(r.randint(0, 9))) for k in "ab" for i in range(-5, 40)]
    df = spark.createDataFrame(pieces, "k string, i int, c binary").select("k", "i", F.octet_length("c").cast("long").alias("length"), E.poly_hash(F.col("c")).alias("h")).repartition(7)
    want = {k: (sum(len(c) for x, _, c in pieces if x == k), plain(b"".join(c for x, _, c in pieces if x == k))) for k in "ab"}
    for block in (0, 1, 4, 4096):
        assert {r["k"]: (r["length"], r["h"]) for r in monoid.ordered_concat(df, ["k"], "i", block=block).collect()} == want


def test_segments(spark):
    parts = [(b"abc", 4), (b"z", 1), (b"12345", 3)]
    data = b"".join(b * n for b, n in parts)
    df = spark.createDataFrame([("r", i, b, n) for i, (b, n) in enumerate(parts)], "rope_id string, idx long, bytes binary, reps long")
    ranges = [(a, n) for a in range(0, len(data), 3) for n in (1, 4, 11, 40)]
    asked = spark.createDataFrame([("r", a, n) for a, n in ranges], "rope_id string, start long, length long")
    cut = monoid.slice_segments(df, asked, "rope_id").withColumn("key", F.concat_ws(":", "start", "length"))
    got = {k: bytes(c) for k, c in monoid.segment_bytes(cut, ["key"]).collect()}
    assert got == {f"{a}:{n}": data[a : a + n] for a, n in ranges}
    for at in (-1, 0, 5, 13, len(data), 99):
        left, right = ([bytes(r["content"]) for r in monoid.segment_bytes(x, ["rope_id"]).collect()] for x in monoid.split_segments(df, "rope_id", at))
        cutoff = min(max(at, 0), len(data))
        assert left == [data[:cutoff]] * bool(cutoff) and right == [data[cutoff:]] * bool(data[cutoff:])
    bad = df.withColumn("length", F.lit(3))
    assert monoid.validate_segments(bad, ["rope_id"]).count() == 1


def test_objects_with_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", None, "gzip"), ("b", gzip.compress(b"text"), "gzip")], "object_id string, content binary, format string")
    got = {r["object_id"]: (r["length"], r["hash"]) for r in P.hash_objects(df).collect()}
    assert got == {"a": (None, None), "b": (4, [plain(b"text")])}
    assert P.hash_objects(df.limit(0)).count() == 0 and P.extract_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.hash_objects(df, method="other")


def test_files_and_formats(spark, tmp_path):
    data = b"a file of some text " * 30
    for name, fmt in (("a.gz", "gzip"), ("b.zst", "zstd"), ("c.lz4", "lz4_frame"), ("d.txt", "raw")):
        (tmp_path / name).write_bytes(S.encode(data, fmt))
    (tmp_path / "e.bin").write_bytes(b"\x1f\x8b")
    objects = S.with_format(S.read_objects(spark, str(tmp_path)))
    assert {r["object_id"][-1] + r["format"] for r in objects.collect()} == {"zgzip", "tzstd", "4lz4_frame", "traw", "nraw"}
    hashes = P.hash_objects(objects.where("length > 2"), HashSpec((131, 257)))
    assert [r["copies"] for r in verify.duplicate_groups(hashes).collect()] == [4]


def test_table_functions(spark):
    P.register_functions(spark)
    spark.createDataFrame([("x", gzip.compress(b"aaaaaaaaaa"))], "id string, content binary").createOrReplaceTempView("objects_for_sql")
    got = spark.sql("SELECT kind, byte, distance, length FROM objects_for_sql, LATERAL extract_tokens(content, 'gzip') ORDER BY seq").collect()
    assert T.stats(P.extract_tokens(spark.createDataFrame([("x", gzip.compress(b"aaaaaaaaaa"), "gzip")], "object_id string, content binary, format string"))).first()["decoded_size"] == 10
    assert got[0]["byte"] == 97 and got[-1]["distance"] == 1


def test_archive_log_and_stream(spark, tmp_path):
    from rillprint.streaming.archives import maintain

    log = [("x", 1, "add", b"a"), ("x", 2, "add", b"b"), ("x", 3, "add", b"c"), ("x", 4, "remove", None), ("y", 1, "add", b"q"), ("y", 2, "remove", None)]
    schema = "archive_id string, seq long, op string, chunk binary"
    df = spark.createDataFrame(log, schema)
    want = {"x": (2, 2, plain(b"ab")), "y": (0, 0, 0)}
    assert {r["archive_id"]: (r["chunks"], r["length"], r["h"]) for r in archive_log.archive_hashes(df).collect()} == want
    with pytest.raises(Exception, match="empty archive"):
        archive_log.archive_hashes(spark.createDataFrame([("x", 1, "remove", None)], schema)).collect()
    for k, part in enumerate((log[:2], log[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = maintain(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        last = {}
        run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, _: last.update({r["archive_id"]: (r["chunks"], r["length"], r["hash"][0]) for r in b.collect()})).trigger(availableNow=True).start()
        run.awaitTermination(60)
    assert last == want


def test_queries_import_without_the_subpackage():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "rillprint"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            names = [n.module or "" for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n for n in names), f


def test_hash_by_chunks(spark):
    data = [("a", b"some words " * 3000, "raw"), ("b", b"", "raw"), ("c", None, "raw"), ("d", S.encode(b"some words " * 3000, "zstd"), "zstd")]
    df = spark.createDataFrame(data, "object_id string, content binary, format string")
    spec = HashSpec((131, 257))
    got = {r["object_id"]: (r["length"], r["hash"]) for r in P.hash_chunked(df, spec).collect()}
    want = [K.hash_bytes(data[0][1], b, spec.prime) for b in spec.bases]
    assert got == {"a": (33000, want), "b": (0, [0, 0]), "c": (None, None), "d": (33000, want)}
    with pytest.raises(ValueError):
        P.hash_chunked(df, HashSpec((131,), M127))


def test_hashes_hold_a_block_at_a_time(monkeypatch):
    some = [b"ab" * 400_000, *[bytes([k % 256]) * (k % 300) for k in range(20_000)]]
    tracemalloc.start()
    got = K.hash_many(some, 131)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6  # all at once: 60 bytes for each of 3.8 million
    monkeypatch.setattr(K, "BLOCK", 64)
    K._powers61.cache_clear()
    assert got == K.hash_many(some, 131) and got[1:400] == [plain(c) for c in some[1:400]]


def test_batches_are_read_in_slices(monkeypatch):
    from rillprint.functions import batches as B

    rows = [(str(k), None if k == 7 else bytes([k]) * (4000 if k == 5 else 100)) for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.array(["raw"] * 50)], ["object_id", "content", "format"])
    monkeypatch.setattr(B, "SLICE_BYTES", 1000)
    monkeypatch.setattr(P, "SLICE_BYTES", 1000)
    for column in ("content", "object_id"):
        assert pa.Table.from_batches(list(B.slices(batch, column))).to_pydict() == batch.to_pydict()
    sizes = [[len(c or b"") for c in part["content"].to_pylist()] for part in B.slices(batch)]
    assert all(sum(s) <= 1000 or len(s) == 1 for s in sizes) and [4000] in sizes
    hashed = list(P._HashBatch(HashSpec())([batch]))
    assert len(hashed) > 5 and [h for part in hashed for h in part["hash"].to_pylist()] == [c if c is None else [plain(c)] for _, c in rows]
    packed = list(S._Encode("gzip", None)([batch]))
    made = list(P._Rows(lambda c, fmt: [(lz77.decode(extract(c, fmt)),)], pa.schema([("object_id", pa.string()), ("content", pa.binary())]))(packed))
    assert [c for part in made for c in part["content"].to_pylist()] == [c for _, c in rows]
    assert max(part.num_rows for part in made) <= 11  # ten of 100 bytes, and the null


def test_empty_batches_have_no_slices():
    batch = pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.binary())], ["object_id", "content"])
    assert not list(P._HashBatch(HashSpec())([batch]))


def test_deflate_is_not_read_bit_field_by_bit_field(monkeypatch):
    from rillprint.sources import streams

    calls, peek = [], streams.LowBits.peek
    monkeypatch.setattr(streams.LowBits, "peek", lambda self, n: calls.append(n) or peek(self, n))
    r = random.Random(8)
    for data in (bytes(r.choices(b"etaoin shrdlu", k=20_000)), ALL[9] * 40):
        ops = extract(S.encode(data, "deflate"), "deflate")
        assert lz77.decode(ops) == data
    assert len(calls) < 200  # heads of blocks alone; a call for each symbol would be over 10,000
    packed = S.encode(bytes(r.choices(b"etaoin shrdlu", k=500)), "deflate")
    for cut in range(len(packed)):
        with pytest.raises(StreamError):
            extract(packed[:cut], "deflate")


def test_info_keeps_forms_of_one_object_apart(spark):
    data = b"".join(ALL[:10])
    forms = [("o", S.encode(data, f), f) for f in ("raw", "gzip", "lz4_frame", "zstd")] + [("o", None, "gzip"), ("o", None, "raw")]
    got = P.info(spark.createDataFrame(forms, "object_id string, content binary, format string")).collect()
    assert len(got) == len(forms)
    by = {(r.format, r.file_size): r for r in got}
    for _, c, fmt in forms:
        row = by[fmt, None if c is None else len(c)]
        assert row.decoded_size == (None if c is None or fmt == "raw" else len(data))
        if c is not None and fmt != "raw":
            ops = extract(c, fmt)
            assert row.total_tokens == lz77.token_count(ops) and row.references == sum(not isinstance(op, bytes) for op in ops)
            assert row.compression_ratio == round(len(data) / len(c), 2)
        elif fmt == "raw":
            assert row.compression_ratio is None


def test_zstd_is_not_read_bit_field_by_bit_field(monkeypatch):
    from rillprint.sources import streams

    calls, peek = [], streams.HighBits.peek
    monkeypatch.setattr(streams.HighBits, "peek", lambda self, n: calls.append(n) or peek(self, n))
    r = random.Random(8)
    data = b" ".join(r.choice([b"alpha", b"beta", b"gamma", b"delta", b"epsilon%d" % r.randint(0, 99)]) for _ in range(3000))
    ops = extract(S.encode(data, "zstd"), "zstd")
    assert lz77.decode(ops) == data and cdh.cdh(ops) == (K.hash_bytes(data, 131),)
    assert len(calls) < len(ops)  # one by one, six for each sequence and one for each literal


def in_arrow(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_steps_over_archives_share_a_worker(spark):
    data = [(str(k), c) for k, c in enumerate(ALL[:12])] + [("none", None)]
    raw = spark.createDataFrame(data, "object_id string, content binary").withColumn("format", F.lit("raw"))
    want = {(f"{o}!content", len(c), plain(c)) for o, c in data if c is not None}
    for packed in (S.zip64_archives(raw), S.encode_objects(raw, "zip")):
        entries = S.entry_objects(packed)
        hashes = P.hash_objects(entries)
        assert in_arrow(packed) == in_arrow(entries) == in_arrow(hashes) == 1
        assert {(r.object_id, r.length, r.hash[0]) for r in hashes.collect()} == want
        apart = P.hash_objects(entries.where("content IS NOT NULL"))  # another table, so a worker of its own
        assert in_arrow(apart) == 2 and sorted(apart.collect()) == sorted(hashes.collect())
    kept = entries.cache()
    assert "InMemoryTableScan" in P.hash_objects(kept)._jdf.queryExecution().executedPlan().toString()
    assert sorted(P.hash_objects(kept).collect()) == sorted(hashes.collect())
    kept.unpersist()


def test_zip64_limit_is_back_between_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([b"abc"], pa.binary())], ["object_id", "content"])
    limit = zipfile.ZIP64_LIMIT
    for made in S._zip64_archives(iter([batch, batch])):
        assert zipfile.ZIP64_LIMIT == limit and b"\xff\xff\xff\xff" in made["content"][0].as_py()


def test_forms_of_objects_share_a_worker_with_what_reads_them(spark, sf_dir):
    from rillprint import queries as Q

    data = [(str(k), c) for k, c in enumerate(ALL[:8])] + [("none", None)]
    raw = spark.createDataFrame(data, "object_id string, content binary").withColumn("format", F.lit("raw"))
    got = Q.in_formats(raw, Q.FORMATS, P.decode_objects)
    assert in_arrow(got) == len(Q.FORMATS)
    assert sorted((r.object_id, r.format, r.content) for r in got.collect() if r.content is not None) == sorted((o, f, c) for o, c in data if c is not None for f in Q.FORMATS)
    assert got.where("content IS NULL").count() == len(Q.FORMATS)
    assert in_arrow(Q.decode_roundtrip(spark, sf_dir)) == len(Q.FORMATS)
    for name in ("decoded_size", "cdh_gzip_rope", "cdh_multi_sliding_lz4_block"):
        assert in_arrow(Q.QUERIES[name](spark, sf_dir)) == 1


def test_cross_format_matrix_hashes_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(o, f, 1, [int(o == "a" and f == "zstd")]) for o in "ab" for f in ("gzip", "raw", "zstd")] + [(None, "raw", 1, [0]), ("a", None, 1, [0])]
    ddl = "content_id string, format string, length long, hash array<bigint>"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/hashes")  # small files: one side is broadcast
    got = verify.cross_format_matrix(spark.read.parquet(f"{tmp_path}/hashes").mapInArrow(count, ddl)).collect()
    pairs = (("gzip", "raw"), ("gzip", "zstd"), ("raw", "zstd"))
    assert sorted(tuple(r) for r in got) == sorted((o, a, b, o == "b" or b != "zstd") for o in "ab" for a, b in pairs)
    assert seen.value == len(rows)


def test_lz4_is_not_read_call_by_call(monkeypatch):
    from rillprint.sources import lz4

    calls, extended = [], lz4._extended
    monkeypatch.setattr(lz4, "_extended", lambda *a: calls.append(a) or extended(*a))
    r = random.Random(8)
    data = b" ".join(r.choice([b"alpha", b"beta", b"gamma", b"delta", b"epsilon%d" % r.randint(0, 99)]) for _ in range(3000))
    for fmt in ("lz4_block", "lz4_frame"):
        calls.clear()
        ops = extract(S.encode(data, fmt), fmt)
        assert lz77.decode(ops) == data and len(calls) < len(ops) / 2  # one by one, two for each match
