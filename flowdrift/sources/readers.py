"""Batch and streaming sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from flowdrift.operators.clean import drop_nonfinite
from flowdrift.schema import flow_schema

# Spellings of special numbers in flow files.
CSV_OPTIONS = {
    "header": "true",
    "mode": "PERMISSIVE",
    "nanValue": "NaN",
    "positiveInf": "inf",
    "negativeInf": "-inf",
}

# One field behind its comma: in quotes, with doubled quotes inside, or bare.
CSV_FIELD = r',(\s*"(?:[^"]|"")*"\s*(?=,|$)|[^,]*)'


def _typed(df: DataFrame, schema: T.StructType, extras: bool) -> DataFrame:
    """Text columns in the types of ``schema``, taken by name; absent ones are NULL, others stay text or go."""
    at = {c.strip(): c for c in df.columns}
    known = [
        F.col(f"`{at[f.name]}`").try_cast(f.dataType).alias(f.name) if f.name in at else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    more = [F.col(f"`{c}`").alias(name) for name, c in at.items() if name not in schema.names] if extras else []
    return df.select(*known, *more)


def read_flows(
    spark: SparkSession, path: str | list[str], fmt: str = "csv", schema: T.StructType | None = None, extras: bool | None = None
) -> DataFrame:
    """Flow files as a table; NaN and infinities are NULL.

    CSV columns are taken by their header name, in whatever order a file has them,
    and read in the types of ``schema`` (no inference pass). Columns that are not in
    the schema stay as text with ``extras``, the default without a schema. All files
    of one call must have the header of the first, else the read fails; files of
    several layouts are for :func:`merge_flow_dir`. Parquet brings its own schema.
    """
    if fmt == "csv":
        text = spark.read.options(**CSV_OPTIONS, enforceSchema="false").csv(path)
        return drop_nonfinite(_typed(text, schema or flow_schema(), schema is None if extras is None else extras))
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return drop_nonfinite(reader.format(fmt).load(path))


def stream_flows(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", files_per_trigger: int = 1, header: list[str] | None = None
) -> DataFrame:
    """Flow files arriving in a folder, a few per micro-batch; NaN and infinities are NULL.

    The columns of CSV files are ``header``, else those of the files already there,
    else those of the schema. A file with another header fails the stream instead of
    shifting its values.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if fmt != "csv":
        return reader.schema(schema).format(fmt).load(path)
    if header is None:
        try:
            header = spark.read.options(**CSV_OPTIONS).csv(path).columns or schema.names
        except AnalysisException:
            header = schema.names
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return drop_nonfinite(_typed(reader.schema(text).options(**CSV_OPTIONS, enforceSchema="false").csv(path), schema, False))


def decode_csv_payloads(df: DataFrame, schema: T.StructType, payload: str | Column = "value") -> DataFrame:
    """Rows of CSV text batches pushed by a sensor, one payload (header line first) per input row.

    Works on batch and streaming input. Fields are taken by header name, so a sensor
    may send its columns in any order; of a repeated name the first column counts.
    Quoted fields may hold commas and doubled quotes, but no line break. A field that
    does not parse, or is missing from a short line, is NULL.
    """
    text = F.col(payload) if isinstance(payload, str) else payload
    lines = F.filter(F.split(F.translate(text, "\r", ""), "\n"), lambda line: F.length(F.trim(line)) > 0)
    fields = lambda line: F.transform(
        F.filter(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CSV_FIELD), F.lit(1)), lambda f: f.isNotNull()), _unquoted
    )
    kept = [c for c in df.columns if c != payload]
    rows = df.select(*kept, lines.alias("_lines")).withColumn("_names", F.transform(fields(F.get("_lines", F.lit(0))), lambda n: F.trim(n)))
    rows = rows.withColumn("_line", F.explode(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))))
    rows = rows.withColumn("_fields", fields(F.col("_line")))
    at = lambda name: F.array_position("_names", F.lit(name)).cast("int") - 1
    return rows.select(
        *kept,
        *[F.when(at(f.name) >= 0, F.get("_fields", at(f.name))).try_cast(f.dataType).alias(f.name) for f in schema.fields],
    )


def _unquoted(field: Column) -> Column:
    """The text of a CSV field: outer quotes removed, doubled ones halved; an empty unquoted field is NULL."""
    bare = F.trim(field)
    quoted = F.replace(F.substr(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0))), F.lit('""'), F.lit('"'))
    return F.when(bare.startswith('"') & bare.endswith('"') & (F.length(bare) > 1), quoted).otherwise(F.when(field != "", field))


def merge_flow_dir(
    spark: SparkSession,
    path: str,
    timestamp: str = "timestamp",
    pattern: str = "*.csv",
    ts_format: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """All CSV files of a folder as one table, newest first.

    Files without the timestamp column are left out. Files are grouped by their
    header line, so each distinct layout is one parallel read; only the distinct
    headers and their file names reach the driver. Columns named in ``schema`` get
    its types (unreadable values and absent columns are NULL); others stay text.
    """
    first_lines = (
        spark.read.option("pathGlobFilter", pattern).text(path)
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    headers = (
        first_lines.filter(F.col("at") == 0)
        .groupBy("path")
        .agg(F.min_by("value", "_seq").alias("header"))
        .groupBy("header")
        .agg(F.collect_list("path").alias("paths"))
    )
    frames = []
    for row in headers.collect():
        names = [n.strip().strip('"') for n in row.header.split(",")]
        if timestamp not in names:
            continue
        frames.append(spark.read.options(**CSV_OPTIONS, inferSchema="false").csv(row.paths))
    if not frames:
        raise ValueError(f"no readable CSV file with a {timestamp} column in {path}")
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    when = F.col(timestamp)
    parsed = F.try_to_timestamp(when, F.lit(ts_format)) if ts_format else F.try_to_timestamp(when)
    if schema is not None:
        declared = T.StructType([f for f in schema.fields if f.name != timestamp])
        merged = drop_nonfinite(_typed(merged, declared, extras=True))
    return merged.withColumn(timestamp, parsed).orderBy(F.desc(timestamp))


def read_run_logs(
    spark: SparkSession, path: str, exclude_prefix: str = "old", pattern: str = "*.log"
) -> DataFrame:
    """Lines of all log files below a folder: ``path``, ``file``, ``folder``, ``line_no``, ``text``.

    Folders whose own name starts with ``exclude_prefix`` are skipped. Large
    files are split between tasks; the order inside a file is the byte offset
    of the split, then the order inside the split.
    """
    from flowdrift.operators.ordering import number_rows

    name = F.regexp_replace(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/"
    )
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(path)
        .select(
            name.alias("path"),
            F.col("_metadata.file_block_start").alias("_at"),
            F.monotonically_increasing_id().alias("_seq"),
            F.trim("value").alias("text"),
        )
    )
    # a pattern that ends at the last name would be tried again at every letter of the path, for every line
    folder = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    lines = lines.filter(~folder.startswith(exclude_prefix))
    return number_rows(lines, ["_at", "_seq"], ["path"], "line_no").select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file"),
        folder.alias("folder"),
        "line_no",
        "text",
    )
