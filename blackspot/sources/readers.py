"""Readers for crash files and for directories of centroid files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from blackspot.functions.columns import to_date, to_degrees, to_whole
from blackspot.runtime import require_columns
from blackspot.sources.schema import CRASH_COLUMNS, CRASH_SCHEMA

TREE = {"pathGlobFilter": "*.csv", "recursiveFileLookup": True}


def files_by_header(spark: SparkSession, path: str | list[str], **options) -> list[list[str]]:
    """The files below ``path`` in groups with the same header line.

    One file needs no look. Several are scanned once as text for their first
    lines, each in the task that reads the file's beginning; what comes back is
    one row per different header.
    """
    files = spark.read.options(**options).text(path).inputFiles()
    if len(files) < 2:
        return [files] if files else []
    place = F.col("_metadata.file_path")
    lines = (spark.read.options(**options).text(path).filter(F.col("_metadata.file_block_start") == 0)
             .select(place.alias("file"), F.struct(F.monotonically_increasing_id().alias("at"), "value").alias("line")))
    heads = lines.groupBy("file").agg(F.min("line").alias("line"))
    rows = heads.groupBy(F.regexp_replace("line.value", "^\ufeff|\r$", "").alias("header")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    return [r["files"] for r in rows.orderBy("header").collect()]


def read_group(spark: SparkSession, files: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Files with one header, by its names; those that are in ``schema`` get their types from it."""
    names = spark.read.option("header", True).csv(files[:1]).schema
    types = {f.name: f.dataType for f in schema} if schema else {}
    typed = T.StructType([T.StructField(f.name, types.get(f.name, T.StringType())) for f in names])
    return spark.read.schema(typed).option("header", True).option("enforceSchema", False).csv(files)


# The kinds of text, each with a bit of its own in the fold over a column.
WHOLE, DOUBLE, DATE, TEXT = 1, 2, 4, 8
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def kind_of(c: Column) -> Column:
    """The bit of the narrowest type that holds a text without loss; NULL and blank text have none."""
    text = c.cast("string")
    whole = text.rlike(r"^\s*[+-]?[0-9]+\s*$")
    return (F.when(text.isNull() | (F.trim(text) == ""), 0)
            .when(whole, F.when(text.try_cast("bigint").isNotNull(), WHOLE).otherwise(TEXT))
            .when(text.rlike(NUMBER), DOUBLE)
            .when(to_date(text).isNotNull(), DATE).otherwise(TEXT))


def with_types(raw: DataFrame, *names: str) -> DataFrame:
    """``raw`` with the text columns ``names`` (all if none is given) cast to the type that fits all their values.

    One aggregate folds the kinds of all columns in one pass. Whole numbers with
    fractions among them make a double, ``month/day/year`` a date; mixed kinds and
    whole numbers beyond 64 bits stay text, as does a column without a value. Blank
    text becomes NULL in a column with another type.
    """
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    names = names or raw.columns
    found = raw.agg(*[F.bit_or(kind_of(quoted(n))).alias(str(i)) for i, n in enumerate(names)]).first()
    typed = {}
    for i, name in enumerate(names):
        kind, value = found[i], F.when(F.trim(quoted(name)) != "", F.trim(quoted(name)))
        if kind == WHOLE:
            typed[name] = value.try_cast("bigint")
        elif kind in (DOUBLE, WHOLE | DOUBLE):
            typed[name] = value.try_cast("double")
        elif kind == DATE:
            typed[name] = to_date(value)
    return raw.select(*[typed[n].alias(n) if n in typed else quoted(n) for n in raw.columns])


def read_typed(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """CSV files with header rows, joined by column name, every column with the type that fits it in all files."""
    groups = [read_group(spark, files) for files in files_by_header(spark, path, **options)]
    if not groups:
        raise ValueError(f"no files in {path}")
    return with_types(union_by_name(groups))


def read_crashes(spark: SparkSession, path: str | list[str], all_columns: bool = False) -> DataFrame:
    """Crash CSV with a header row, cut to the twelve crash columns and typed.

    Columns are matched by header name, file by file, so files may hold more
    columns in any order. No inference pass is run: everything is read as text,
    and numbers are cast; a whole number may be written with a decimal point, and
    an unreadable or fractional one becomes NULL. With ``all_columns`` the other
    columns stay, and one pass finds their types (``with_types``).
    """
    groups = [read_group(spark, files) for files in files_by_header(spark, path)]
    if not groups:
        raise ValueError(f"no files in {path}")
    for group in groups:
        require_columns(group, *CRASH_COLUMNS)
    raw = union_by_name(groups)
    typed = {
        f.name: (to_degrees(F.col(f.name)) if isinstance(f.dataType, T.DoubleType) else to_whole(F.col(f.name), f.dataType))
        for f in CRASH_SCHEMA if not isinstance(f.dataType, T.StringType)
    }
    others = [c for c in raw.columns if c not in CRASH_COLUMNS]
    if all_columns and others:
        raw = with_types(raw, *others)
    return raw.withColumns(typed) if all_columns else raw.withColumns(typed).select(*CRASH_COLUMNS)


def read_csv_directory(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` from all ``*.csv`` files below ``path``, by name; one that a file lacks is NULL there."""
    groups = files_by_header(spark, path, **TREE)
    tables = []
    for files in groups:
        table = read_group(spark, files, schema)
        tables.append(table.select(*[F.col(f"`{f.name}`") if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name)
                                     for f in schema]))
    return union_by_name(tables) if tables else spark.createDataFrame([], schema)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Concatenate tables by column name; a column missing from one of them is NULL there."""
    if not frames:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
