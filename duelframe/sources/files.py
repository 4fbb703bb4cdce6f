"""File scans and sinks: yearly CSV files with provenance, encodings, manifests, written results."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOUR_ALIASES = {"m": "atp", "men": "atp", "atp": "atp", "w": "wta", "women": "wta", "wta": "wta"}


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths under ``root`` whose file name matches; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    )


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Header of a CSV file; only its first line is read."""
    return spark.read.option("header", True).csv(path).columns


def scan_csv(
    spark: SparkSession, paths: Sequence[str], provenance: str = "source_file",
    folder_level: bool = False, encoding: str = "UTF-8",
) -> DataFrame:
    """Union of CSV files by column name, all columns text, each row tagged with its file.

    Files with the same header share one read. ``folder_level`` tags rows with
    the parent folder instead, for data sets written as folders.
    """
    if not paths:
        raise FileNotFoundError("no CSV files to scan")
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(paths):
        by_header.setdefault(tuple(csv_columns(spark, path)), []).append(path)
    part = r"([^/]+)/[^/]+$" if folder_level else r"([^/]+)$"
    out = None
    for header, group in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        read = (
            spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(group)
            .select("*", F.regexp_extract("_metadata.file_path", part, 1).alias(provenance))
        )
        out = read if out is None else out.unionByName(read, allowMissingColumns=True)
    return out


def scan_years(
    spark: SparkSession, root: str, years: Iterable[int], pattern: str = "*matches_{year}.csv", **kwargs
) -> tuple[DataFrame, list[int]]:
    """Scan the yearly files that exist; also return the years without one. None at all is an error."""
    years = list(years)
    wanted = {pattern.format(year=y): y for y in years}
    # a yearly listing is bounded by the number of years
    found = {y: [r.path for r in list_files(spark, root, p).select("path").collect()] for p, y in wanted.items()}
    paths = [p for y in years for p in found[y]]
    if not paths:
        raise FileNotFoundError(f"no files for years {years[0]}-{years[-1]} in {root}")
    return scan_csv(spark, paths, **kwargs), [y for y in years if not found[y]]


def _plain(path: str) -> str:
    """A whole path in one spelling, whether it came as a URI or not."""
    return "/" + unquote(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", path)).lstrip("/")


def yearly_files(spark: SparkSession, root: str, years: Iterable[int], year: str = r"(\d{4})\.csv$") -> tuple[list[str], list[int]]:
    """Files under ``root`` that hold something and whose path names one of ``years`` by the pattern, and the years without one. None at all is an error."""
    years = list(years)
    named = list_files(spark, root).select("path", F.regexp_extract("path", year, 1).try_cast("int").alias("year"))
    # one short row per file of the years asked for
    found = named.where(F.col("year").isin(years)).orderBy("path").collect()
    if not found:
        raise FileNotFoundError(f"no files for years {years} in {root}")
    return [r.path for r in found], sorted(set(years) - {r.year for r in found})


def survey_csv(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[tuple[str, ...], str], list[str]]:
    """Files by (header, encoding), read in one job however many and however unlike they are.

    A file that is not valid UTF-8 throughout is Latin-1, which can decode any
    byte. Empty files have no header and are left out.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), "value",
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
    )
    seen = lines.groupBy("path").agg(
        F.min_by(F.col("value").cast("binary"), "at").alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")
    )
    groups: dict[tuple[tuple[str, ...], str], list[str]] = {}
    for r in sorted(seen.collect(), key=lambda r: r.path):  # one row per file
        encoding = "UTF-8" if r.utf8 else "ISO-8859-1"
        names = next(csv.reader([bytes(r.header).decode(encoding).removeprefix("\ufeff")]), [])
        if names:
            groups.setdefault((tuple(names), encoding), []).append(unquote(r.path))
    return groups


def split_by_encoding(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """Files that are valid UTF-8, and the others, judged line by line in parallel."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("ok")
    )
    verdict = {_plain(r.path): r.ok for r in lines.groupBy("path").agg(F.bool_and("ok").alias("ok")).collect()}
    good = [p for p in paths if verdict.get(_plain(p), True)]
    return good, [p for p in paths if p not in good]


def scan_csv_any_encoding(spark: SparkSession, paths: Sequence[str], **kwargs) -> DataFrame:
    """UTF-8 files as UTF-8, the rest as Latin-1 (which can decode any byte)."""
    utf8, other = split_by_encoding(spark, paths)
    parts = []
    if utf8:
        parts.append(scan_csv(spark, utf8, **kwargs))
    if other:
        parts.append(scan_csv(spark, other, encoding="ISO-8859-1", **kwargs))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def scan_points(spark: SparkSession, root: str, tours: Iterable[str]) -> DataFrame:
    """Point files of the given tours, tagged with file and tour."""
    out = None
    for tour in tours:
        name = TOUR_ALIASES.get(tour.lower().strip())
        if name is None:
            raise ValueError(f"unknown tour {tour!r}")
        letter = "m" if name == "atp" else "w"
        paths = [r.path for r in list_files(spark, root, f"charting-{letter}-points*.csv").select("path").collect()]
        read = scan_csv(spark, paths).withColumn("tour", F.lit(name))
        out = read if out is None else out.unionByName(read, allowMissingColumns=True)
    return out


def missing_items(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected items that are not present."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")


def missing_files(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    expected = spark.createDataFrame([(n,) for n in names], "file_name string")
    return missing_items(expected, list_files(spark, root), ["file_name"])


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet table. Never give it a path the same plan reads from."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_metrics_json(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Nested metric files as columns, e.g. ``{"loss": "validation.log_loss"}``; an
    absent field gives null. Each row is tagged with its file."""
    read = spark.read.option("multiLine", True).json(path)

    def has(dotted: str) -> bool:
        node: T.DataType = read.schema
        for part in dotted.split("."):
            if not isinstance(node, T.StructType) or part not in node.names:
                return False
            node = node[part].dataType
        return True

    columns = [
        (F.col(src) if has(src) else F.lit(None)).cast("double").alias(out) for out, src in fields.items()
    ]
    return read.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("source_file"), *columns)
