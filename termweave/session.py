"""Session helpers: where shared scratch data goes, and how hot join keys are spread."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
DEFAULT_SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own; on a cluster an
    unset folder is an error, because a machine-local path would be lost with its machine.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_SETTING} is not set: name a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="termweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application below the shared one."""
    return f"{shared_dir(spark)}/termweave/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this application wrote to the shared folder; call it when its last result is stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Not needed when the job is submitted with the package in `--py-files`.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="termweave-ship-")) / package.name), "zip", package.parent, package.name
    )
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


#: Whether Spark removes the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files, which else stay on disk until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table that several later stages read, and return the table read back.

    Cuts the lineage and survives the loss of any executor. The shuffle files it took are removed once it is written.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Equi-join whose hot keys are spread over `salts` tasks.

    `big` rows of one key are split by a hash of `spread_by`; `small` (one row per key) is
    repeated once per salt, so its cost is `salts` times its own rows whatever the skew.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, keys: Sequence[str], order: str, into: str, chunk: int = 10_000) -> DataFrame:
    """0-based position of each row within its key by a unique integer column `order`.

    Ranks inside ranges of `chunk` consecutive values, then adds the sizes of the earlier
    ranges, so a key that holds a large share of all rows is not sorted by one task.
    """
    from pyspark.sql import Window as W

    ranged = df.withColumn("_range", F.floor(F.col(order) / chunk))
    offsets = (
        ranged.groupBy(*keys, "_range")
        .count()
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("count").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("count")
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(order)) - 1
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, [*keys, "_range"])
        .withColumn(into, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_offset", "_inside")
    )


def width(spark: SparkSession) -> int:
    """Number of tasks for steps whose work is large for the bytes they read."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of stored input to a task of a step that makes some ten times as many rows as it reads.
INPUT_A_TASK = 2 * 2**20


def input_bytes(df: DataFrame) -> int:
    """Size of the files that a table is read from; 0 for one that is not read from files."""
    spark = df.sparkSession
    names, total = df.inputFiles(), 0
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))  # names come URL-encoded
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def spread(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """Place rows by `keys` over a number of tasks that grows with the files `source` reads.

    Tables placed alike by a key are windowed, grouped and folded (`folded_join`) by it, and by it with
    further columns, where they stand.
    """
    spark = df.sparkSession
    return df.repartition(max(width(spark), input_bytes(source) // INPUT_A_TASK), *keys)


def folded_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """`left.join(right, on, how)` for how = left or left_semi: the sides are stacked and folded by key.

    A join on several columns moves sides that are placed alike by one of them; this one leaves them where they stand.
    """
    mine, theirs = ([c for c in df.columns if c not in on] for df in (left, right))
    kept = F.struct(*mine) if mine else F.struct(F.lit(None).cast("boolean").alias("_none"))
    found = F.struct(*theirs) if theirs and how == "left" else F.struct(F.lit(True).alias("_found"))
    l_type, r_type = left.select(kept.alias("v")).schema["v"].dataType, right.select(found.alias("v")).schema["v"].dataType
    known = right.dropna(subset=list(on)).select(*on, F.lit(None).cast(l_type).alias("_l"), found.alias("_r"))
    sides = left.select(*on, kept.alias("_l"), F.lit(None).cast(r_type).alias("_r")).unionByName(known)
    if how == "left_semi":
        folded = sides.groupBy(*on).agg(F.collect_list("_l").alias("_ls"), F.count("_r").alias("_n")).where("_n > 0")
        return folded.select(*on, F.explode("_ls").alias("_l")).select(*on, *[F.col("_l")[c].alias(c) for c in mine])
    folded = sides.groupBy(*on).agg(F.collect_list("_l").alias("_ls"), F.collect_list("_r").alias("_rs"))
    return (
        folded.select(*on, F.explode("_ls").alias("_l"), "_rs").select(*on, "_l", F.explode_outer("_rs").alias("_r"))
        .select(*on, *[F.col("_l")[c].alias(c) for c in mine], *[F.col("_r")[c].alias(c) for c in theirs])
    )


def rounded(c: Column, digits: int = 9) -> Column:
    """Scores are compared after rounding so that plans of different shape agree on ties."""
    return F.round(c, digits)
