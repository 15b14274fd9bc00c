"""JSON files the jobs read and write: domain lists, top requests, failing rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headerwise.schemas import TOP_REQUEST
from headerwise.sources.local import small_table
from headerwise.sources.versions import current_version, write_version

_CORRUPT = "_corrupt_record"
_END = "end of requests"


def domain_names(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """One row per name. A first name ``@file`` stands for the JSON array in that
    file and replaces the whole list."""
    if not names:
        raise ValueError("at least one domain name is required")
    if not names[0].startswith("@"):
        return small_table(spark, T.StructType().add("domain", "string"), [[n] for n in names])
    return (
        spark.read.text(names[0][1:], wholetext=True)
        .select(F.explode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})))
        .toDF("domain")
    )


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file`` and every line of the files that is not blank."""
    read = spark.read.option("recursiveFileLookup", True).text(paths)
    line = F.btrim("value", F.lit(" \t\r"))
    return read.select(F.col("_metadata.file_path").alias("file"), line.alias("value")).where(
        F.col("value") != ""
    )


def _is_row() -> Column:
    """Whether a line is a row of its own, or the empty array of a domain without rows."""
    return (F.col("value").startswith("{") & F.col("value").endswith("}")) | (
        F.col("value") == "[]"
    )


def file_forms(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, lines``: whether every line of the file is a row, or else one JSON value
    must take up the whole file. Files without any text are left out."""
    return _lines(spark, paths).groupBy("file").agg(F.bool_and(_is_row()).alias("lines"))


def _whole_values(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file``, its text, and ``array``: the one JSON array or object in it as an
    array; null when the text is not exactly that.

    The text is read as the first of two elements. When something follows its first
    value, the second element is not found in its place.
    """
    read = spark.read.option("recursiveFileLookup", True).text(paths, wholetext=True)
    padded = F.concat(F.lit("["), F.col("value"), F.lit(f',"{_END}"]'))
    parts = F.from_json(padded, "array<string>")
    rows = read.select(F.col("_metadata.file_path").alias("file"), "value", parts.alias("parts"))
    first = F.ltrim(F.get("parts", F.lit(0)))
    array = F.when(first.startswith("["), first).when(
        first.startswith("{"), F.concat(F.lit("["), first, F.lit("]"))
    )
    one = (F.size("parts") == 2) & (F.get("parts", F.lit(1)) == _END)
    return rows.select("file", "value", F.when(one, array).alias("array"))


def _read_arrays(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    said = F.concat(F.lit("not one JSON array of requests: "), F.col("file"))
    array = F.coalesce("array", F.raise_error(said).cast("string"))
    rows = F.from_json(array, T.ArrayType(TOP_REQUEST), {"mode": "FAILFAST"})
    return _whole_values(spark, paths).select(F.inline(rows))


def _read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return (
        spark.read.schema(TOP_REQUEST)
        .option("recursiveFileLookup", True)
        .option("mode", "FAILFAST")
        .json(paths)
    )


def read_requests(
    spark: SparkSession, paths: str | Sequence[str], array_files: bool | None = None
) -> DataFrame:
    """All top-request rows of the files (paths or globs), duplicates kept.

    A file holds either one JSON array, or one row per line as :func:`write_by_domain`
    makes them; the latter can be split. Each file's form is found out by a look at its
    lines, at the price of reading the files twice, unless ``array_files`` tells it.
    A file with a syntax error, or with anything after its array, raises an error that
    names it.
    """
    if array_files is not None:
        return (_read_arrays if array_files else _read_lines)(spark, paths)
    # as many names as Spark's own file listing holds on the driver
    forms = file_forms(spark, paths).collect()
    split = [unquote(r.file) for r in forms if r.lines]
    whole = [unquote(r.file) for r in forms if not r.lines]
    found = [read(spark, names) for read, names in ((_read_lines, split), (_read_arrays, whole)) if names]
    return reduce(DataFrame.unionAll, found) if found else small_table(spark, TOP_REQUEST, [])


def broken_request_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per file that :func:`read_requests` refuses: ``file`` and the ``rows``
    that could still be read from it."""
    whole = _whole_values(spark, paths).join(
        file_forms(spark, paths).where(~F.col("lines")).hint("merge"), "file", "left_semi"
    )
    # an object alone would be read as an array of one row
    seen = F.when(
        F.ltrim("value").startswith("["), F.size(F.from_json("value", T.ArrayType(TOP_REQUEST)))
    )
    whole = whole.where(F.col("array").isNull()).select("file", seen.cast("long").alias("seen"))
    schema = T.StructType([*TOP_REQUEST.fields, T.StructField(_CORRUPT, T.StringType())])
    lines = _lines(spark, paths).where(F.col("value") != "[]").where(_is_row())
    row = F.from_json("value", schema, {"columnNameOfCorruptRecord": _CORRUPT})
    split = lines.select("file", row.alias("row")).groupBy("file").agg(
        F.count_if(F.col(f"row.{_CORRUPT}").isNull()).alias("rows"),
        F.count(f"row.{_CORRUPT}").alias("broken"),
    )
    # a file of rows with one that is cut off is not one of lines; its other rows count
    whole = whole.join(split.select("file", "rows").hint("merge"), "file", "left").select(
        "file", F.greatest(F.lit(0), F.coalesce("seen", F.lit(0)), F.coalesce("rows", F.lit(0))).alias("rows")
    )
    split = split.join(
        file_forms(spark, paths).where("lines").hint("merge"), "file", "left_semi"
    )
    return whole.union(split.where("broken > 0").select("file", "rows"))


def write_by_domain(rows: DataFrame, path: str, domains: DataFrame | None = None) -> None:
    """Write top-request rows as JSON lines, one folder per domain.

    Domains of the run without any row get a file with an empty array, so that a
    rerun never leaves their old rows behind; other domains' folders are kept.
    With ``domains``, ``rows`` is read twice: pass a written table.
    """
    fields = [F.col(f.name) for f in TOP_REQUEST.fields]
    lines = rows.select(
        F.col("domain").alias("folder"), F.to_json(F.struct(*fields)).alias("value")
    )
    if domains is not None:
        empty = domains.select(F.col("domain").alias("folder")).distinct()
        empty = empty.join(lines.select("folder").distinct(), "folder", "left_anti")
        lines = lines.unionByName(empty.withColumn("value", F.lit("[]")))
    (
        lines.hint("rebalance", "folder")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("folder")
        .text(path)
    )


def diff_name(as_of: dt.datetime | None = None) -> str:
    as_of = as_of or dt.datetime.now(dt.timezone.utc)
    return as_of.strftime("%Y-%m-%d-%H-%M") + ".diff.json"


def write_diffs(
    diffs: DataFrame,
    folder: str,
    name: str | None = None,
    as_of: dt.datetime | None = None,
    rows: int | None = None,
) -> str | None:
    """Write the failing rows as gzipped JSON, as their four header sets are much alike;
    nothing is written (None) when there are none.

    Give their number as ``rows`` if it is known, or they are computed twice. Earlier
    rows of that name are replaced in one step once the new ones are complete, so they
    may be among what ``diffs`` is read from; read them with ``read_diffs``.
    """
    if diffs.isEmpty() if rows is None else rows == 0:
        return None
    path = f"{folder.rstrip('/')}/{name or diff_name(as_of)}"
    write_version(diffs, path, lambda df, folder: df.write.json(folder, compression="gzip"))
    return path


def read_diffs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The saved rows of a name: its current version, or all files of a plain folder."""
    path = current_version(spark, path) or path
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
