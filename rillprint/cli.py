"""Commands over files: hash, verify, chunks, inspect, info and benchmark, as ``python -m rillprint.cli COMMAND PATH...``.

A path is a file, a folder or a pattern; every file is a row of one Spark job.  Rows go to the standard output as text or JSON
lines, a partition at a time, or with --to as JSON files that the tasks write themselves.  Exit codes: 0; 1 for a
mismatch in text and quiet output; 2 for errors.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.kernels import value_of
from .operators.cdc import ChunkSpec
from .operators.cdh import METHODS
from .operators.verify import verify_pairs
from .plans import objects as P
from .sources.objects import read_objects, with_format
from .spec import DEFAULT_BASE, M61, HashSpec

FORMATS = ("raw", "deflate", "gzip", "zip", "lz4_block", "lz4_frame", "zstd", "auto")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("rillprint", description="Content hashes of raw and compressed files, without decompression.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        for path in paths or ("paths",):
            p.add_argument(path, nargs=None if paths else "+", help="file, folder or pattern; - for the standard input")
        p.add_argument("-f", "--format", choices=FORMATS)
        p.add_argument("-o", "--output", choices=("text", "json"), default="text")
        p.add_argument("--to", help="folder for the rows, as JSON")
        p.add_argument("-q", "--quiet", action="store_true", help="hashes or the exit code alone")
        p.add_argument("--timing", action="store_true")
        return p

    def hashing(p: argparse.ArgumentParser) -> None:
        p.add_argument("--bases", nargs="+", type=int, default=[DEFAULT_BASE])
        p.add_argument("--prime", type=int, default=M61)
        p.add_argument("-m", "--method", choices=METHODS, default="rope")

    p = command("hash", "hashes of the content")
    hashing(p)
    p.add_argument("--hex", action="store_true")
    p.add_argument("--chunk", action="store_true", help="by way of the chunks of raw files")
    p = command("verify", "whether two files hold the same content", "file_a", "file_b")
    hashing(p)
    p.add_argument("--format-a", choices=FORMATS)
    p.add_argument("--format-b", choices=FORMATS)
    p = command("chunks", "content-defined chunks, and their number and average size")
    for name, size in (("min", 2048), ("avg", 8192), ("max", 65536)):
        p.add_argument(f"--{name}-size", type=int, default=size)
    p = command("inspect", "tokens of compressed files")
    p.add_argument("-n", "--limit", type=int, default=0)
    command("info", "sizes, ratio and token counts")
    p = command("benchmark", "hashing compressed files against decoding them first")
    hashing(p)
    p.add_argument("--trials", type=int, default=3)
    return out


def objects(spark: SparkSession, paths: Iterable[str], asked: str | None) -> DataFrame:
    """object_id, content and format of all files under the paths."""
    out = None
    for path in paths:
        if path == "-":
            rows = spark.createDataFrame([("-", bytearray(sys.stdin.buffer.read()))], "object_id string, content binary")
        else:
            rows = read_objects(spark, path).select("object_id", "content")
        out = rows if out is None else out.unionByName(rows)
    return with_format(out, F.lit(asked).cast("string"))


def compressed_only(found: DataFrame) -> DataFrame:
    """The objects; raw ones are refused, as they have no tokens."""
    refused = F.when(F.col("format") == "raw", F.raise_error(F.concat(F.col("object_id"), F.lit(" is raw: it has no tokens")))).otherwise(F.col("format"))
    return found.withColumn("format", refused.cast("string"))


def hash_rows(found: DataFrame, args: argparse.Namespace) -> DataFrame:
    """object_id, format, length and hash."""
    spec = HashSpec(tuple(args.bases), args.prime)
    hashed = P.hash_chunked(found, spec) if args.chunk else P.hash_objects(found, spec, args.method)
    return hashed.join(found.select("object_id", "format"), "object_id") if args.output == "json" or args.to else hashed


def chunk_rows(found: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Chunks of raw files in order; a chunk's hash has the default base."""
    return P.chunk_objects(found, ChunkSpec(args.min_size, args.avg_size, args.max_size)).orderBy("object_id", "idx")


def benchmark_rows(spark: SparkSession, found: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Best time of each arm over the trials, in ms, and the speed-up; both arms read the tokens."""
    spec, best = HashSpec(tuple(args.bases), args.prime), {}
    found = compressed_only(found)
    for _ in range(max(args.trials, 1)):
        for name, run in (("hash_ms", lambda: P.hash_objects(found, spec, args.method)), ("decode_ms", lambda: P.hash_decoded(found, spec))):
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            best[name] = min(best.get(name, float("inf")), 1000 * (time.perf_counter() - began))
    return spark.createDataFrame([(args.method, args.trials, round(best["hash_ms"], 3), round(best["decode_ms"], 3), round(best["decode_ms"] / best["hash_ms"], 3))], "method string, trials int, hash_ms double, decode_ms double, speedup double")


def plain(row: dict, args: argparse.Namespace) -> dict:
    """A row for output: hashes as numbers, bytes as hexadecimal digits."""
    out = {k: bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v for k, v in row.items()}
    if row.get("hash") is not None:
        numbers = [value_of(h) for h in row["hash"]]
        out["hash"] = [format(n, "x") for n in numbers] if getattr(args, "hex", False) else numbers
        if args.output == "json":
            out["hash_hex"] = [format(n, "x") for n in numbers]
    return out


def emit(rows: DataFrame, args: argparse.Namespace) -> None:
    """All rows to their sink."""
    if args.to:
        rows.write.json(args.to)
        return
    for row in rows.toLocalIterator():  # a partition at a time
        shown = plain(row.asDict(), args)
        if args.output == "json":
            print(json.dumps(shown))
        elif args.quiet and "hash" in shown:
            print(", ".join(map(str, shown["hash"] or ())))
        else:
            print("\t".join(", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v) for v in shown.values()))


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    sides = [objects(spark, [p], f or args.format).withColumn("object_id", F.lit(side)) for side, p, f in (("a", args.file_a, args.format_a), ("b", args.file_b, args.format_b))]
    hashes = P.hash_objects(sides[0].unionByName(sides[1]), HashSpec(tuple(args.bases) if len(args.bases) > 1 else (131, 257), args.prime), args.method)
    match = bool(verify_pairs(spark.createDataFrame([("a", "b")], "a_id string, b_id string"), hashes).first()["match"])
    if args.output == "json":
        print(json.dumps({"file_a": args.file_a, "file_b": args.file_b, "match": match}))
        return 0
    if not args.quiet:
        print("match" if match else "mismatch")
    return 0 if match else 1


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "verify":
        return verify(spark, args)
    found = objects(spark, args.paths, args.format)
    if args.command == "hash":
        emit(hash_rows(found, args), args)
    elif args.command == "chunks":
        emit(P.chunk_stats(chunk_rows(found, args)) if args.quiet else chunk_rows(found, args), args)
    elif args.command == "inspect":
        emit(P.inspect(compressed_only(found), args.limit).orderBy("object_id", "seq"), args)
    elif args.command == "info":
        emit(P.info(found), args)
    else:
        emit(benchmark_rows(spark, found, args), args)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    began = time.perf_counter()
    try:
        code = run(spark or SparkSession.builder.appName("rillprint").getOrCreate(), args)
    except Exception as error:  # noqa: BLE001 - the command line's last resort
        print(f"error: {error}".splitlines()[0], file=sys.stderr)
        return 2
    if args.timing:
        print(json.dumps({"elapsed_ms": round(1000 * (time.perf_counter() - began), 3)}), file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
