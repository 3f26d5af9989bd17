"""File sources and sinks: name lists, business CSVs, chunks, logs, reports, file checks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradebook.functions.base import blank, strip
from tradebook.operators.quality import error_table
from tradebook.operators.records import with_missing_columns
from tradebook.sources.json_check import json_roots

LOG_SCHEMA = ("timestamp string, level string, name string, message string, "
              "metadata struct<function:string,execution_time:double,error:string>, exception string, _corrupt string")


def _csv_groups(spark: SparkSession, path: str, multi_line: bool = False, placed: bool = False) -> list[DataFrame]:
    """The CSV files of a path, one table for each different header.

    Columns belong to names, not to positions, so files are told apart by their first line; headers are few,
    and of the files only the paths reach the driver, which lists them anyway. ``placed`` adds _file, _block
    and _at, the place of a row.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.struct(
        F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), "value")
    headers = lines.groupBy("f").agg(F.min_by("value", "at").alias("h")) \
        .groupBy(F.regexp_replace("h", r"\r$", "").alias("h")).agg(F.sort_array(F.collect_list("f")).alias("files"))
    out = []
    for row in headers.orderBy(F.col("files")[0]).collect():
        df = spark.read.csv(row["files"], header=True, quote='"', escape='"', multiLine=multi_line,
                            ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        out.append(df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
                                   "_at": F.monotonically_increasing_id()}) if placed else df)
    return out


def _by_name(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number rows with _file, _block and _at from 1 in file order.

    Rows of a block lie in one task, where _at counts them one by one, so a row's number is its distance from
    the block's first row plus the rows of the blocks before. Only one row for each block is ordered in one
    place.
    """
    blocks = df.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return df.join(offsets, ["_file", "_block"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1) \
        .drop("_file", "_block", "_at", "_first", "_before")


def read_names_csv(spark: SparkSession, path: str, row_ids: bool = True, require_rows: bool = False) -> DataFrame:
    """Business names; without a ``Business Name`` column a file's first column is taken.

    ``require_rows`` runs a job that raises an error when there is no name at all.
    """
    parts = _csv_groups(spark, path, placed=row_ids)
    if not parts or not any(set(p.columns) - {"_file", "_block", "_at"} for p in parts):
        raise ValueError("Input file is empty")
    df = _by_name([p if "Business Name" in p.columns else p.withColumnRenamed(p.columns[0], "Business Name") for p in parts])
    if row_ids:
        df = with_row_ids(df)
    named = df.withColumn("business_name", strip("Business Name")).drop("Business Name").filter(~blank("business_name"))
    if require_rows and named.isEmpty():
        raise ValueError("No valid business names found in input file")
    return named


def read_business_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Business records; every file needs a ``business_name`` column, others may differ and are matched by name.

    ``multi_line`` allows line breaks inside quoted values, at the price of one task per file.
    """
    parts = _csv_groups(spark, path, multi_line)
    if not parts or any("business_name" not in p.columns for p in parts):
        raise ValueError("CSV file must contain 'business_name' column")
    return _by_name(parts)


def check_source_files(spark: SparkSession, path: str, kind: str, max_mb: float = 100) -> DataFrame:
    """(path, size_mb, issue) per file; only file listings are read, no contents."""
    schema = "path string, size_mb double, issue string"
    if kind not in ("json", "csv"):
        return spark.createDataFrame([(path, None, f"Unsupported file type: {kind}")], schema)
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or str(e)):
            raise
        return spark.createDataFrame([(path, None, "File does not exist")], schema)
    size = F.col("length") / (1024 * 1024)
    return files.select("path", size.alias("size_mb"), F.when(size > max_mb, F.format_string(
        f"File size (%.1fMB) exceeds limit ({max_mb}MB)", size)).alias("issue"))


def check_json_files(spark: SparkSession, path: str, max_items: int = 1000) -> DataFrame:
    """(path, issue) per JSON file: well-formed, an object or array at the root, not too many items.

    Files of any size are read in pieces (``json_check``). Repeated keys of an object count each; NaN and
    Infinity pass.
    """
    root, items = F.col("root"), F.col("items")
    issue = F.when(root.isNull(), "Invalid JSON") \
        .when(root == "v", "Root must be an object or array") \
        .when((root == "{") & (items > max_items), F.format_string("Too many items in object (%d)", items)) \
        .when((root == "[") & (items > max_items), F.format_string("Too many items in array (%d)", items))
    return json_roots(spark, path).select("path", issue.alias("issue"))


def check_csv_schema(spark: SparkSession, path: str) -> DataFrame:
    """(column, type, warning) of a CSV, types inferred from all rows; no columns is an error."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    if not df.columns:
        raise ValueError("File has no columns")
    usual = {"string", "int", "bigint", "double", "boolean"}
    rows = [(c, t, None if t in usual else f"Column '{c}' has unusual type: {t}") for c, t in df.dtypes]
    return spark.createDataFrame(rows, "column string, type string, warning string")


def write_chunked_csv(df: DataFrame, path: str, rows_per_file: int = 1000, gzip: bool = False,
                      mode: str = "errorifexists") -> None:
    """The six business columns in order, at most ``rows_per_file`` rows per file."""
    out = with_missing_columns(df).write.mode(mode).option("header", True).option("escape", '"') \
        .option("maxRecordsPerFile", rows_per_file)
    (out.option("compression", "gzip") if gzip else out).csv(path)


def combine_chunks(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All chunks of a folder or glob as one table with the fixed columns, matched by name.

    Chunk files are small, so by default values with line breaks can be read (a file is then one task).
    """
    return with_missing_columns(_by_name(_csv_groups(spark, path, multi_line))).withColumn("id", F.col("id").try_cast("bigint"))


def write_export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """CSV with header or JSON records."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unsupported export format {fmt!r}")


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON log lines with their known fields; the whole line stays available as a variant."""
    raw = spark.read.text(path).filter(strip("value") != "")
    parsed = raw.select("value", F.from_json(
        "value", LOG_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_r"))
    return parsed.select("_r.*", F.try_parse_json("value").alias("extras"))


def write_json_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_error_report(validated: DataFrame, path: str, row: str = "id", mode: str = "errorifexists") -> None:
    """CSV with one line per error of every failing row."""
    error_table(validated, row).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def log_files(spark: SparkSession, path: str, pattern: str = "*.log*") -> DataFrame:
    """(name, size_mb, modified) of each file of a log folder, from listings only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("length") / (1024 * 1024)).alias("size_mb"),
                        F.col("modificationTime").alias("modified"))


def log_file_stats(spark: SparkSession, path: str, pattern: str = "*.log*") -> DataFrame:
    """File count, total size, oldest and newest file of a log folder; ``log_files`` lists the files."""
    return log_files(spark, path, pattern).agg(
        F.coalesce(F.sum("size_mb"), F.lit(0.0)).alias("total_size_mb"), F.count(F.lit(1)).alias("file_count"),
        F.min_by("name", "modified").alias("oldest_file"), F.max_by("name", "modified").alias("newest_file"))
