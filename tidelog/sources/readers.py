"""Reading lines and records, as tables or streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.specs import require

RECORD_FORMATS = ("json", "parquet", "text", "orc", "csv")


def _lines(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("value").alias("line"),
        F.col("_metadata.file_modification_time").alias("ts"),
    )


def read_lines(spark: SparkSession, paths: str | Sequence[str], *, since: str | None = None) -> DataFrame:
    """``source, line, ts`` of text files; ``since`` takes only files changed after it."""
    options = {"lineSep": "\n"}
    if since:
        options["modifiedAfter"] = since
    return _lines(spark.read.options(**options).text(paths if isinstance(paths, str) else list(paths)))


def stream_lines(
    spark: SparkSession, path: str, *, since: str | None = None, max_files: int | None = None
) -> DataFrame:
    """The stream of :func:`read_lines`: each file is read once, so feed it rolled files."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = _lines(reader.text(path))
    return lines.filter(F.col("ts") >= F.lit(since).cast("timestamp")) if since else lines


def existing(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], dict[str, str]]:
    """Paths (or globs) that match something, and an error for each that does not."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    good, errors = [], {}
    for path in paths:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            found = where.getFileSystem(conf).globStatus(where)
            if found is None or len(found) == 0:
                errors[path] = "no such file"
            else:
                good.append(path)
        except Exception as error:
            errors[path] = str(error).splitlines()[0]
    return good, errors


def read_many(
    spark: SparkSession, sources: Mapping[str, str | Sequence[str]], *, since: str | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """Named sources as one table, and the paths that could not be read with their errors."""
    require(bool(sources), "sources must not be empty")
    out, errors = None, {}
    for name, paths in sources.items():
        good, bad = existing(spark, [paths] if isinstance(paths, str) else list(paths))
        errors.update(bad)
        if good:
            part = read_lines(spark, good, since=since).withColumn("source", F.lit(name))
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "source string, line string, ts timestamp")
    return out, errors


def stream_many(spark: SparkSession, sources: Mapping[str, str], **options) -> DataFrame:
    """Named directories as one stream."""
    require(bool(sources), "sources must not be empty")
    out = None
    for name, path in sources.items():
        part = stream_lines(spark, path, **options).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def read_records(
    spark: SparkSession, fmt: str, path: str | Sequence[str], *, schema: str | T.StructType | None = None,
    source: str | None = None,
) -> DataFrame:
    """A table of typed records; JSON and CSV take a schema, so no pass infers one."""
    require(fmt in RECORD_FORMATS, f"unknown format {fmt!r}")
    require(fmt not in ("json", "csv") or schema is not None, f"{fmt} needs a schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path if isinstance(path, str) else list(path))
    return df.withColumn("source", F.lit(source)) if source else df


def stream_records(
    spark: SparkSession, fmt: str, path: str, schema: str | T.StructType, *, source: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """The stream of :func:`read_records`."""
    require(fmt in RECORD_FORMATS, f"unknown format {fmt!r}")
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.load(path)
    return df.withColumn("source", F.lit(source)) if source else df
