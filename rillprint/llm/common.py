"""What the operators share: the shared folder, written tables and gapless numbers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The public vocabulary that the token operators use unless told otherwise.
VOCABULARY = "byte_bpe_50k.json"
#: A batch of rows for a Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public tokenizer file; a parameter wherever ids are made."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests), a temporary one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rillprint-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", f"file://{found}")
        found = f"file://{found}"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session sending rows to Python workers in batches of bounded rows and bytes (a longer text alone).

    The session keeps the setting, as plans made now are run later.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Remove tables of written() that no result depends on any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_tasks(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table that also says which task wrote them, for numbers()."""
    return written(df.withColumn("__task", F.spark_partition_id()), name)


def numbers(table: DataFrame, keys: list[str], to: str) -> DataFrame:
    """Rows of with_tasks() with gapless numbers from 0 within each key, in column ``to`` (long).

    Rows are numbered within (key, the task that wrote them), so a key that holds most rows is still
    dealt over many tasks; the numbers before each task come from the counts alone.
    """
    group = [*keys, "__task"]
    counts = table.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*group, (F.sum("__n").over(Window.partitionBy(*keys).orderBy("__task")) - F.col("__n")).alias("__before"))
    order = [F.col(c) for c, kind in table.dtypes if not kind.startswith("map")]
    own = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    joined = table.withColumn("__own", own).alias("t").join(before.alias("b"), on=same, how="inner")
    columns = [F.col(f"t.{c}") for c in table.columns if c != "__task"]
    return joined.select(*columns, (F.col("__own") + F.col("__before")).alias(to))
