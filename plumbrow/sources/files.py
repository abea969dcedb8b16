"""CSV and file scans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbrow.functions.columns import base_name, contains_any, has_suffix, is_number, path_component
from plumbrow.operators.clean import LEAKY_COLUMNS, label_from_name
from plumbrow.session import settle

# Names of the files and folders that carry the label.
HEAVY_NAME_PARTS = ("stateful", "heavy")
ATTACK_FOLDER = "Attacks"
FLOW_FILE_WORDS = ("benign-pcap", "spam", "malware", "phishing")
BENIGN_WORD = "benign"
MANIFEST_SUFFIXES = (".csv", ".zip", ".parquet")

# Spellings that CSV writers use for infinities and missing numbers.
NUMBER_TEXT = {"header": "true", "positiveInf": "inf", "negativeInf": "-inf", "nanValue": "NaN"}


def read_csv_table(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; types come from ``schema`` or from the whole input.

    A cell that does not fit its type ends the query.
    """
    reader = spark.read.options(**NUMBER_TEXT)
    reader = reader.schema(schema).option("mode", "FAILFAST") if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(path)


def infer_numeric_schema(
    spark: SparkSession, paths: str | list[str], drop: Sequence[str] = LEAKY_COLUMNS,
) -> T.StructType:
    """The numeric columns, as doubles. All rows of ``paths`` decide; a column without values is numeric."""
    frame = read_csv_table(spark, paths)
    texts = [f.name for f in frame.schema if isinstance(f.dataType, T.StringType)]
    values = frame.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in texts]).first() if texts else {}
    keep = [f.name for f in frame.schema if f.name not in drop and (is_number(f.dataType) or (f.name in texts and not values[f.name]))]
    return T.StructType([T.StructField(c, T.DoubleType()) for c in keep])


def _files(spark: SparkSession, root: str, keep: Column, suffix: str) -> DataFrame:
    """Paths below ``root`` that pass ``keep``. File contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return listing.select("path").filter(keep & F.col("path").endswith(suffix))


def _open(path: str):
    """A byte stream on the file system a path belongs to."""
    from pyarrow import fs

    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(inner)


def files_by_header(spark: SparkSession, root: str, keep: Column, suffix: str = ".csv") -> dict[str, list[str]]:
    """Matching files grouped by their first line; only the first lines are read.

    The driver receives file names, as it does for any file scan, and each distinct header once.
    """

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for path in batch["path"]:
                with _open(path) as stream:
                    line = b""
                    while b"\n" not in line and (more := stream.read(1 << 16)):
                        line += more
                lines.append(line.split(b"\n")[0].decode().rstrip("\r"))
            yield batch.assign(header=lines)

    found = settle(
        _files(spark, root, keep, suffix).mapInPandas(first_lines, "path string, header string").withColumn("h", F.sha2("header", 256))
    )
    headers = {r["h"]: r["header"] for r in found.select("h", "header").distinct().collect()}
    groups: dict[str, list[str]] = {}
    for r in found.select("path", "h").orderBy("path").toLocalIterator():
        groups.setdefault(headers[r["h"]], []).append(r["path"])
    if not groups:
        raise ValueError(f"no matching files below {root}")
    return groups


def read_labelled(
    spark: SparkSession, root: str, keep: Column, label: Column,
    schema: T.StructType | None = None, suffix: str = ".csv",
) -> DataFrame:
    """All CSV files below ``root`` whose path passes ``keep``, labelled by their path.

    ``keep`` and ``label`` are expressions over a ``path`` column. Columns are matched by
    name: files are read header by header and united, absent columns are NULL. With a
    ``schema`` only its columns are read and every file must have them.
    """
    parts = []
    for paths in files_by_header(spark, root, keep, suffix).values():
        names = spark.read.option("header", "true").csv(paths[0]).columns
        if schema is None:
            full = read_csv_table(spark, paths).schema
        else:
            missing = [c for c in schema.names if c not in names]
            if missing:
                raise ValueError(f"{paths[0]} lacks the columns {missing}")
            known = {f.name: f for f in schema}
            full = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in names])
        rows = read_csv_table(spark, paths, full).withColumn("path", F.col("_metadata.file_path"))
        rows = rows.withColumn("label", label).drop("path")
        parts.append(rows if schema is None else rows.select(*schema.names, "label"))
    return union_tables(parts)


def read_heavy_stateful(spark: SparkSession, root: str) -> DataFrame:
    """Heavy stateful captures: 1 below an attack folder, else 0."""
    name = base_name(F.col("path"))
    keep = name.contains(HEAVY_NAME_PARTS[0]) & name.contains(HEAVY_NAME_PARTS[1])
    return read_labelled(spark, root, keep, path_component(F.col("path"), ATTACK_FOLDER).cast("int"))


def read_flows(spark: SparkSession, root: str) -> DataFrame:
    """Flow files by kind: numeric columns only, 0 for benign captures, else 1."""
    path = F.col("path")
    name = base_name(path)
    keep = contains_any(name, FLOW_FILE_WORDS)
    groups = files_by_header(spark, root, keep)
    found = [infer_numeric_schema(spark, paths) for paths in groups.values()]
    names = [c for c in found[0].names if all(c in f.names for f in found)]
    headers = [header.split(",") for header in groups]
    lost = [c for c in found[0].names if not all(c in h for h in headers)]
    if lost:
        raise ValueError(f"a file below {root} lacks the columns {lost}")
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in names])
    return read_labelled(spark, root, keep, label_from_name(name, BENIGN_WORD), schema)


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; absent columns are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- content manifest


def file_manifest(
    spark: SparkSession, root: str, suffixes: Sequence[str] = MANIFEST_SUFFIXES, chunk: int = 1 << 20,
) -> DataFrame:
    """Relative name, bytes and SHA-256 of the matching files below ``root``.

    The listing carries names and sizes only. Each task opens its files through their own
    file system and hashes them in chunks, so a file may be larger than a task's memory.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", F.col("length").alias("bytes"))
        .filter(has_suffix(F.col("path"), suffixes))
    )
    files = spark.sparkContext.defaultParallelism * 4
    listing = listing.repartition(files, "path")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for path in batch["path"]:
                state = hashlib.sha256()
                with _open(path) as stream:
                    while data := stream.read(chunk):
                        state.update(data)
                sums.append(state.hexdigest())
            yield batch.assign(sha256=sums)

    out = listing.mapInPandas(hashed, "path string, bytes long, sha256 string")
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    relative = F.regexp_replace(F.substring_index("path", base + "/", -1), "^/+", "")
    return out.select(relative.alias("file"), "bytes", "sha256").orderBy("file")


def number_rows(df: DataFrame, out: str = "row_key") -> DataFrame:
    """Give rows without an identity a number and store them, so that it never changes."""
    return settle(df.withColumn(out, F.monotonically_increasing_id()))
