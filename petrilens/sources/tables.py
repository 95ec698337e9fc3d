"""Reading and writing of stage tables, bundles, inventories and ledgers."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, stem: str, schema: StructType | str | None = None) -> tuple[DataFrame | None, str | None]:
    """The table ``stem``.parquet, else ``stem``.csv (with the schema, if given), and its path; (None, None) if neither is there."""
    for path in (f"{stem}.parquet", f"{stem}.csv"):
        try:
            if path.endswith("parquet"):
                return spark.read.parquet(path), path
            reader = spark.read.option("header", True)
            return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path), path
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return None, None


def read_measurements(spark: SparkSession, paths: Sequence[str], schema: StructType | str) -> DataFrame:
    """CSV measurement files as one table, with the file of each row in ``source_file``."""
    return spark.read.schema(schema).option("header", True).csv(list(paths)).withColumn("source_file", F.input_file_name())


def save_table(df: DataFrame, stem: str) -> dict[str, str]:
    """Writes ``stem``.parquet and ``stem``.csv and returns their paths by format."""
    out = {"parquet": f"{stem}.parquet", "csv": f"{stem}.csv"}
    df.write.mode("overwrite").parquet(out["parquet"])
    df.sparkSession.read.parquet(out["parquet"]).write.mode("overwrite").option("header", True).csv(out["csv"])
    return out


def export_bundle(tables: dict[str, DataFrame], folder: str, config: dict) -> DataFrame:
    """Saves every stage table and, as ``manifest``, one row per table: name, paths, columns, rows, config (JSON)."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        paths = save_table(df, f"{folder}/{name}")
        rows.append((name, paths["parquet"], paths["csv"], json.dumps(df.dtypes), spark.read.parquet(paths["parquet"]).count(), json.dumps(config, sort_keys=True)))
    manifest = spark.createDataFrame(rows, "name string, parquet string, csv string, columns string, n_rows long, config string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def load_bundle(spark: SparkSession, folder: str, names: Sequence[str], added: dict[str, Column] | None = None) -> tuple[DataFrame, str]:
    """The first table of the names that the folder holds, with the columns of ``added`` that it lacks, and its name."""
    for name in names:
        df, _ = read_table(spark, f"{folder}/{name}")
        if df is not None:
            for col, value in (added or {}).items():
                if col not in df.columns:
                    df = df.withColumn(col, value)
            return df, name
    raise FileNotFoundError(f"none of {list(names)} in {folder}")


def natural_key(name: Column) -> Column:
    """Lower-case name with every run of digits padded to 12, so that names sort by number."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def file_inventory(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, length, modified and natural key of the files that match; contents are not read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return d.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("natural_key", natural_key(F.col("name")))


def group_files(files: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """group (first capture of the pattern), files in natural order and their number; names that don't match are left out."""
    d = files.withColumn("group", F.regexp_extract(name, pattern, 1)).where(F.col("group") != "")
    g = d.groupBy("group").agg(F.array_sort(F.collect_list(F.struct(natural_key(F.col(name)).alias("k"), F.col(name).alias("f")))).alias("_l"))
    return g.select("group", F.transform("_l", lambda s: s["f"]).alias("files"), F.size("_l").alias("n_files"))


def pending(all_keys: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that the ledger doesn't list as done."""
    return all_keys.join(ledger, list(keys), "left_anti")


def append_ledger(done: DataFrame, path: str) -> None:
    done.write.mode("append").parquet(path)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], recompute: bool = False) -> DataFrame:
    """The saved stage, or the stage made, saved and read back (which ends its lineage)."""
    if not recompute:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
