"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query is run once to warm up and RUNS times for the figure (the median; the spread is in "spread"), into Spark's noop sink, so all
columns are worked out and nothing is collected.  cdh_* and decode_* hash the same compressed documents, without and with decoding;
native_decode has zlib decode instead of this engine's reader.
"""

import json
import os
import statistics
import sys
import time
import zlib
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
CORE = ["poly_hash", "poly_hash_batches", "concat_turns", "duplicate_groups", "cdc_chunks", "cdc_compose", "cdh_gzip_rope", "cdh_zstd_rope", "cdh_lz4_frame_rope", "verify_pairs", "incremental_log"]
STRATEGIES = ("prefix", "rope", "sliding")


def main() -> None:
    import pyarrow as pa
    from pyspark.sql import SparkSession

    from rillprint import queries as core
    from rillprint.plans import objects as P
    from rillprint.sources import objects as S

    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "4m"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: (lambda f=core.QUERIES[name]: f(spark, SF_DIR)) for name in CORE}

    # compressed documents are made once, outside the times
    packed = S.encode_objects(core.documents(spark, SF_DIR).repartition(4 * int(CPUS)), "deflate").cache()
    packed.count()
    for method in STRATEGIES:
        runs[f"cdh_documents_{method}"] = lambda m=method: P.hash_objects(packed, method=m)
    runs["decode_documents"] = lambda: P.hash_decoded(packed)

    def inflate(batches):
        for b in batches:
            content = [None if c is None else zlib.decompress(c, wbits=-15) for c in b["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["object_id"], pa.array(content, pa.binary())], ["object_id", "content"])

    runs["native_decode_documents"] = lambda: P.hash_raw(packed.select("object_id", "content").mapInArrow(inflate, "object_id string, content binary"))

    times, spread = {}, {}
    for name, f in runs.items():
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            f().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 3)
        spread[name] = round(max(took[1:]) - min(took[1:]), 3)
    print(json.dumps({"metric": "total of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "spread": spread, "sf": SF_DIR.rpartition("sf")[2], "cpus": int(CPUS), "runs": RUNS, "conf": conf}))
    spark.stop()


if __name__ == "__main__":
    main()
