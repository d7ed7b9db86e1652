"""Readers and writers with explicit schemas, and the catalog of dataset names."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "doc_id long, text string"
PAIRS = "query string, context string, target string, source string, post_type string, full_text string, template string"
REQUESTS = "custom_id string, method string, url string, body struct<model string, messages array<struct<role string, content string>>, max_tokens int, temperature double>"
RESPONSES = "custom_id string, response struct<body struct<model string, choices array<struct<message struct<content string>>>>>"
TRAINER = "log_history array<struct<step bigint, loss double, eval_loss double>>"
TEMPLATE_INFO = "map<string,struct<description:string,tags:array<string>>>"

#: Names of the datasets that the builders write under a root folder.
CATALOG = ("raw_train", "shared_dev_grouped", "final_clean_grouped", "final_clean_pool_grouped", "final_dirty_pool_grouped", "final_dirtymatched_grouped")


def path_of(root: str, name: str) -> str:
    if name not in CATALOG:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(CATALOG)}")
    return f"{root.rstrip('/')}/{name}"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. Where none is set, one machine may take a folder of its own; a cluster may not."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "querysieve-checkpoints"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there: later passes see the same rows in the same ranges."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def put_text(spark: SparkSession, path: str, value: str) -> None:
    """A small text as one file, in whatever store the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    out.write(value.encode())
    out.close()


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str = PAIRS) -> DataFrame:
    """JSON lines of several files; lines that are no JSON give nulls and stand in _corrupt. With the file they came from."""
    out = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths)
    return out.select("*", F.col("_metadata.file_name").alias("file"))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A whole-file JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_templates(spark: SparkSession, path: str, skip: str = "!data_info.json") -> DataFrame:
    """file, pos, template of JSON files that hold arrays of strings; the metadata file is left out."""
    texts = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "array<string>").alias("t"))
    return texts.where(F.col("file") != F.replace(F.lit(skip), F.lit("!"), F.lit("%21"))).where(F.col("file") != skip).select("file", F.posexplode("t").alias("pos", "template"))


def read_template_info(spark: SparkSession, path: str) -> DataFrame:
    """file, description, tags."""
    text = spark.read.option("wholetext", True).text(path).select(F.from_json("value", TEMPLATE_INFO).alias("m"))
    return text.select(F.explode("m").alias("file", "i")).select("file", "i.description", "i.tags")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, quoted fields over several lines."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """name, file_id of lines with both, or with an id alone (name null)."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).alias("name"), F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))).alias("file_id"))


def read_chunks(spark: SparkSession, root: str, side: str, pattern: str = "chunk_*") -> DataFrame:
    """Blocks of all chunks of a side with the chunk they came from, which orders them.

    A folder is one chunk, named by its number, or holds several (write_chunks), whose rows say which.
    """
    out = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/{pattern}/{side}")
    if "chunk_id" in out.columns:
        return out
    return out.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"chunk_(\d+)", 1).cast("long").alias("chunk_id"))


def write_chunks(df: DataFrame, path: str, side: str, chunk: str = "chunk_id", most: int = 500) -> None:
    """Chunks for read_chunks: a folder is named by the first of up to `most` consecutive chunks and written by one task.

    Folders and files then grow by the rows, not by the chunks times the tasks.
    """
    first = F.floor(F.col(chunk) / most) * most
    named = df.withColumns({"chunk_id": F.col(chunk), "_folder": F.concat(F.lit("chunk_"), F.lpad(first.cast("string"), F.greatest(F.lit(6), F.length(first.cast("string"))), F.lit("0"))), "side": F.lit(side)})
    write_parquet(named.repartition("_folder").withColumnRenamed("_folder", "chunk_dir"), path, by=["chunk_dir", "side"])


def read_stream(spark: SparkSession, path: str, schema: str = RAW, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, rows_per_file: int = 20_000, by: list[str] | None = None) -> None:
    """Fails if the path exists, unless told to overwrite. Its _SUCCESS file says that it is whole."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def is_done(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_if_absent(df: DataFrame, path: str) -> bool:
    """Writes unless a whole result stands there; whether it wrote."""
    if is_done(df.sparkSession, path):
        return False
    write_parquet(df, path, overwrite=True)
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Deletes intermediate chunks."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> None:
    """A fixed header, whatever order the columns come in."""
    df.select(*columns).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def write_lists(df: DataFrame, path: str, keys: list[str], value: str, overwrite: bool = False) -> None:
    """One JSON array of values for each key, in a folder of its own."""
    df.groupBy(*keys).agg(F.to_json(F.collect_list(value)).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*keys).text(path)


def summary_json(row: DataFrame) -> str:
    """A one-row summary as JSON text."""
    import json

    return json.dumps(row.first().asDict(recursive=True), indent=2, ensure_ascii=False)


def flattened(struct: str, fields: list[str]) -> list[Column]:
    """Fields of a struct as columns struct_field."""
    return [F.col(f"{struct}.{f}").alias(f"{struct}_{f}") for f in fields]


def nested(dotted: str) -> Column:
    """A field by its dotted path."""
    return F.col(dotted)


def share(spark: SparkSession, path: str, target: str, how: str = "reference") -> str:
    """A dataset for another run: its path (reference), a copy of it (copy), or nothing (skip)."""
    if how == "reference":
        return path
    if how == "skip":
        return ""
    if how != "copy":
        raise ValueError(f"unknown way {how!r}; known: reference, copy, skip")
    write_if_absent(spark.read.parquet(path), target)
    return target
