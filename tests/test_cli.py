"""The command line over files on disk."""

import json
import zlib

import pytest

from rillprint import cli
from rillprint.functions import kernels as K
from rillprint.sources.objects import encode

TEXT = b"a line of text that repeats, a line of text that repeats\n" * 40


@pytest.fixture
def files(tmp_path):
    made = {"a.txt": TEXT, "a.gz": encode(TEXT, "gzip"), "a.zst": encode(TEXT, "zstd"), "b.gz": encode(TEXT + b"x", "gzip"), "empty": b"", "bad.gz": encode(TEXT, "gzip")[:60]}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "a.deflate").write_bytes(zlib.compress(TEXT, wbits=-15))
    return tmp_path


def call(spark, capsys, *argv):
    code = cli.main(list(map(str, argv)), spark)
    return code, capsys.readouterr()


def test_hash(spark, files, capsys):
    want = K.hash_bytes(TEXT, 131, (1 << 61) - 1)
    for name, asked in (("a.txt", ()), ("a.gz", ()), ("a.zst", ("-m", "sliding")), ("a.deflate", ("-f", "deflate", "-m", "prefix")), ("a.gz", ("--chunk",))):
        code, out = call(spark, capsys, "hash", files / name, "-q", *asked)
        assert code == 0 and out.out.strip() == str(want)
    code, out = call(spark, capsys, "hash", files / "a.gz", files / "a.txt", "-o", "json", "--bases", "131", "257", "--timing")
    rows = [json.loads(x) for x in out.out.splitlines()]
    assert code == 0 and {r["format"] for r in rows} == {"gzip", "raw"} and all(r["hash"][0] == want and r["hash_hex"][0] == format(want, "x") and len(r["hash"]) == 2 and r["length"] == len(TEXT) for r in rows)
    assert "elapsed_ms" in json.loads(out.err)
    assert call(spark, capsys, "hash", files / "empty", "-q")[1].out == ""  # Spark's reader lists no empty files
    code, out = call(spark, capsys, "hash", files / "a.txt", "-q", "--hex", "--prime", (1 << 127) - 1)
    assert out.out.strip() == format(K.hash_bytes(TEXT, 131, (1 << 127) - 1), "x")


def test_verify(spark, files, capsys):
    assert call(spark, capsys, "verify", files / "a.gz", files / "a.txt")[0] == 0
    code, out = call(spark, capsys, "verify", files / "a.gz", files / "b.gz")
    assert code == 1 and out.out == "mismatch\n"
    code, out = call(spark, capsys, "verify", files / "a.gz", files / "b.gz", "-q")
    assert code == 1 and out.out == ""
    code, out = call(spark, capsys, "verify", files / "a.deflate", files / "b.gz", "--format-a", "deflate", "-o", "json")
    assert code == 0 and json.loads(out.out)["match"] is False


def test_chunks_inspect_info_benchmark(spark, files, capsys):
    code, out = call(spark, capsys, "chunks", files / "a.txt", "--min-size", 64, "--avg-size", 256, "--max-size", 1024, "-o", "json")
    rows = [json.loads(x) for x in out.out.splitlines()]
    assert code == 0 and sum(r["size"] for r in rows) == len(TEXT) and [r["idx"] for r in rows] == list(range(len(rows)))
    code, out = call(spark, capsys, "chunks", files / "a.txt", "-q")
    assert code == 0 and out.out.split()[-2:] == [str(len(TEXT)), str(float(len(TEXT)))]
    code, out = call(spark, capsys, "inspect", files / "a.gz", "-n", 3, "-o", "json")
    assert code == 0 and [json.loads(x)["char"] for x in out.out.splitlines()] == list("a l")
    code, out = call(spark, capsys, "info", files / "a.gz", files / "a.txt", "-o", "json")
    rows = {r["format"]: r for r in map(json.loads, out.out.splitlines())}
    assert rows["gzip"]["decoded_size"] == len(TEXT) and rows["raw"]["decoded_size"] is None and rows["raw"]["file_size"] == len(TEXT)
    code, out = call(spark, capsys, "benchmark", files / "a.gz", "--trials", 1, "-o", "json")
    assert code == 0 and json.loads(out.out)["speedup"] > 0


def test_errors_and_folders(spark, files, capsys, tmp_path):
    for argv in (("inspect", files / "a.txt"), ("benchmark", files / "a.txt", "--trials", 1), ("hash", files / "none"), ("hash", files / "bad.gz"), ("hash", files / "a.txt", "--bases", 131, 131)):
        code, out = call(spark, capsys, *argv)
        assert code == 2 and out.err.startswith("error: ")
    code, _ = call(spark, capsys, "hash", files / "a*", "-f", "auto", "--to", tmp_path / "out")
    assert code == 0 and spark.read.json(str(tmp_path / "out")).count() == 4
