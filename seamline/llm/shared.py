"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java regular expression class body.
WHITE = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent and Spark runs in one process (tests) a
    temporary folder of this machine is taken; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(shared_folder, "own", None) or "file://" + tempfile.mkdtemp(prefix="seamline-")
        shared_folder.own = found
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends here,
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/seamline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def erased(df: DataFrame) -> None:
    """Deletes a table that written() made, once all that needs it is written itself."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/seamline-" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], counted: DataFrame | None = None, most: int = 1024, least: int = 256) -> DataFrame:
    """many.join(one, keys), for a table `one` with a row for each key at most, and a table
    `many` where some keys may hold a large part of the rows: those over 1 / most of
    `counted` (the rows of many with their keys; fewer than `most` keys, so they are
    broadcast) are dealt into parts, and the rows of `one` repeated for each. Null keys meet nothing."""
    rows = many if counted is None else counted
    limit = max(least, rows.count() // most)
    hot = written(rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("_parts")), "hot-keys")
    if hot.isEmpty():
        return many.join(one, keys)
    plain = [c for c, kind in rows.dtypes if kind in ("string", "bigint", "int", "double")]
    salt = F.coalesce(F.pmod(F.xxhash64(*plain), F.col("_parts")).cast("int"), F.lit(0))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    copies = one.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text: maximal runs of characters outside WHITE; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), lambda w: w != "")
