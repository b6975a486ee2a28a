"""Stored tables (IO-05..IO-12): evaluation sets, release-partitioned tables, upserts, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.operators.hierarchy import RELEASE

EVAL_SET = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("gold", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """IO-05: evaluation queries, one JSON object per line."""
    return spark.read.schema(EVAL_SET).json(path)


def write_eval_set(queries: DataFrame, path: str) -> None:
    """IO-06."""
    queries.select(*EVAL_SET.fieldNames()).write.mode("overwrite").json(path)


def replace_release(rows: DataFrame, path: str, key: str, rows_per_file: int = 250_000) -> None:
    """IO-07, IO-08: the releases in `rows` replace their stored rows; other releases stay.

    A release is spread by a hash of `key` over as many files as its rows need, so no task writes more than about
    `rows_per_file`. Atomic per table: write dependent tables first and switch the release's `active` row last.
    """
    names = [f"_release_{c}" for c in RELEASE]
    parts = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(RELEASE, names)]).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(RELEASE, names)]
    sized = rows.join(parts, same[0] & same[1])
    (
        sized.repartition(*RELEASE, F.pmod(F.xxhash64(key), F.col("_files"))).drop(*names, "_files")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RELEASE).parquet(path)
    )


MANIFEST = "load bigint, canonical_url string, version string"


def publish_release(tables: dict[str, tuple[DataFrame, str]], path: str, load: int) -> None:
    """IO-07, IO-08: the tables of one or more releases become visible together.

    `tables`: name -> (rows, key). Each is written under a folder of `load`, a number above all earlier ones; the rows of the
    manifest come last, in one file. A load that fails before leaves what `read_release` returns as it was, and may be
    repeated under its number; one that is in the manifest is refused.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    newest = _manifest(spark, path).agg(F.max("load")).first()[0]
    if newest is not None and load <= newest:
        raise ValueError(f"load {load} is not above {newest}, the newest one published")
    releases = None
    for name, (rows, key) in tables.items():
        replace_release(rows, f"{path}/{name}/load={load}", key)
        found = rows.select(*RELEASE).distinct()
        releases = found if releases is None else releases.unionByName(found)
    entry = releases.distinct().select(F.lit(load).cast("bigint").alias("load"), *RELEASE)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")  # a row a release


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_release(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """The rows of table `name` as the newest published load of each release left them; empty without a load.

    A table that the newest load of a release did not bring has no rows of it.
    """
    current = _manifest(spark, path).groupBy(*RELEASE).agg(F.max("load").alias("load"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(T.StructType([*schema, T.StructField("load", T.LongType())])).parquet(f"{path}/{name}")
    return stored.join(current, [*RELEASE, "load"], "left_semi").select(*schema.fieldNames())


def upsert_code_system(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """IO-09: insert by (url, version); a known release keeps its id and creation time and becomes active.

    Of several incoming rows of a release the latest counts, then the last by name, title and publisher.
    """
    fields = ("updated_at", "name", "title", "publisher")
    latest = incoming.groupBy(*RELEASE).agg(F.max(F.struct(*fields)).alias("new"))
    new = latest.select(*RELEASE, *[F.col(f"new.{c}").alias(f"new_{c}") for c in fields])
    both = stored.join(new, RELEASE, "full_outer")
    known, hit = F.col("id").isNotNull(), F.col("new_updated_at").isNotNull()
    return both.select(
        F.when(known, F.col("id")).otherwise(F.xxhash64(*RELEASE)).alias("id"), *RELEASE,
        *[F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "title", "publisher")],
        F.when(hit, F.lit(True)).otherwise(F.col("active")).alias("active"),
        F.when(known, F.col("created_at")).otherwise(F.col("new_updated_at")).alias("created_at"),
        F.when(hit, F.col("new_updated_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def append_if_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """IO-10: the incoming rows whose key is not stored, one per key: the first by its columns as JSON."""
    fresh = incoming.join(stored.select(*keys), keys, "left_anti")
    row = F.struct(*incoming.columns)
    first = fresh.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return first.select("_row.*")


def append_eval_results(stored: DataFrame, rerun: DataFrame) -> DataFrame:
    """IO-11: earlier rows of the re-run configurations give way to the new ones."""
    return stored.join(rerun.select("config").distinct(), "config", "left_anti").unionByName(rerun)


def check_release(order: DataFrame, tabular: DataFrame, index: DataFrame, loaded: DataFrame) -> DataFrame:
    """IO-12: (severity, problem, version, n, examples); the caller raises on errors.

    order: version, code. tabular: version, code. index: version. loaded: version (of the
    releases already stored).
    """
    orders = order.select("version").distinct()
    tabulars = tabular.select("version").distinct()
    indexes = index.select("version").distinct()

    def problem(rows: DataFrame, severity: str, text: str) -> DataFrame:
        return rows.select(
            F.lit(severity).alias("severity"), F.lit(text).alias("problem"), "version",
            F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("string").alias("examples"),
        )

    named = F.coalesce("version", F.lit("")) != ""
    missing = tabular.where(named).select("version", "code").distinct().join(order.select("version", "code"), ["version", "code"], "left_anti")
    first = W.partitionBy("version").orderBy("code")
    numbered = missing.withColumn("k", F.row_number().over(first)).where("k <= 5")
    examples = numbered.groupBy("version").agg(F.array_join(F.sort_array(F.collect_list("code")), " ").alias("examples"))
    unknown = missing.groupBy("version").agg(F.count(F.lit(1)).alias("n")).join(examples, "version").select(
        F.lit("warning").alias("severity"), F.lit("tabular codes not in the order file").alias("problem"), "version", "n", "examples"
    )
    return (
        problem(tabulars.where(named).join(orders, "version", "left_anti"), "error", "order file and tabular XML differ")
        .unionByName(problem(indexes.where(named).join(loaded.select("version"), "version", "left_anti"), "error", "index of a release that is not loaded"))
        .unionByName(problem(orders.where(~named), "error", "no version found"))
        .unionByName(unknown)
    )


def raise_on_errors(problems: DataFrame) -> None:
    """Fails on the first errors of a release check; warnings pass."""
    errors = problems.where("severity = 'error'").limit(5).collect()
    if errors:
        raise ValueError("; ".join(f"{e['problem']} ({e['version']})" for e in errors))
