"""CSV and JSON entity files, listings, tables and exports (items 1-13, 97)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import IO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from portfolia.session import scratch_dir

DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"

#: Header line, comma, trimmed fields. Rows with missing or surplus fields are tolerated.
CSV_OPTIONS = {
    "header": "true",
    "sep": ",",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "encoding": "UTF-8",
    "dateFormat": DATE_FORMAT,
    "timestampFormat": TIMESTAMP_FORMAT,
    "mode": "PERMISSIVE",
}


#: Bound on files x (columns + 50) of a table of files that is sent to all executors: about 40 MB.
FILE_CELLS = 10_000_000
#: Characters that a line without content may have, as the CSV reader sees it.
BLANK = "".join(map(chr, range(33)))


def first_line(stream: IO[bytes], step: int = 1 << 16) -> str | None:
    """The first line with content of a stream, of which no more is read than steps up to that line's end."""
    held, more = b"", True
    while more:
        more = stream.read(step)
        held += more
        lines = re.split(rb"\r\n|\r|\n", held)
        for line in lines if not more else lines[:-1]:
            if text := line.decode("utf-8", "replace").strip(BLANK):
                return text
        held = lines[-1]
    return None


def _open(path: str) -> IO[bytes]:
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    system, own = pafs.FileSystem.from_uri(path)
    return system.open_input_stream(own)


def header_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, header: the first line with content of every file, written to the scratch folder and read back.

    Tasks open the listed files themselves and read their first bytes. Only where that fails, as for a file system that
    Spark alone knows, are all lines scanned for the first ones.
    """
    paths = [path] if isinstance(path, str) else list(path)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for where in batch.column(1).to_pylist():
                try:
                    with _open(where) as stream:
                        found.append((first_line(stream), True))
                except (OSError, pa.ArrowException):
                    found.append((None, False))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in found], pa.string()), pa.array([o for _, o in found], pa.bool_())],
                names=["file", "header", "opened"])

    target = scratch_dir(spark, "headers")
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"), "path")
    listed.mapInArrow(heads, "file string, header string, opened boolean").write.parquet(f"{target}/heads")
    found = spark.read.schema("file string, header string, opened boolean").parquet(f"{target}/heads")
    if found.where("NOT opened").isEmpty():
        return found.where("header IS NOT NULL").select("file", "header")
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("no"))
    scanned = lines.where((F.col("start") == 0) & (F.btrim("value", F.lit(BLANK)) != "")).groupBy("file").agg(
        F.min_by("value", "no").alias("header"))
    scanned.write.parquet(f"{target}/scanned")
    return spark.read.schema(scanned.schema).parquet(f"{target}/scanned")


def read_csv_entity(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Item 1. With a schema, columns are matched to it by name; without, all are text.

    Every file is read by its own header line: columns meet by name in any case, whatever their order and number.
    One scan reads all files by place; where headers differ a table of one row per file says which place each column
    has there, so the plan is the same for any number of headers. Columns without a name are left out.
    """
    paths = [path] if isinstance(path, str) else list(path)
    heads = header_lines(spark, paths)
    kinds = heads.groupBy("header").agg(F.count(F.lit(1)).alias("n"))
    commas = F.length("header") - F.length(F.replace("header", F.lit(","), F.lit("")))
    size = kinds.agg(F.max(commas + 1).alias("width"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("files")).first()
    if not size.kinds:
        return spark.createDataFrame([], schema or T.StructType())
    places = [f"_c{i}" for i in range(size.width)]
    by_place = ", ".join(f"{c} string" for c in places)
    cells = F.from_csv("header", by_place, {k: v for k, v in CSV_OPTIONS.items() if k not in ("header", "encoding")})
    names = kinds.select("header", F.posexplode(F.array(*[cells[c] for c in places])).alias("at", "name")).where(
        "name IS NOT NULL").withColumn("key", F.lower("name"))
    twice = names.groupBy("header", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"column {twice.key} occurs twice when case is ignored in {twice.header}")
    if schema is not None:
        wanted = [f.name for f in schema]
    else:  # one row per column name of all files
        wanted = [r.name for r in names.groupBy("key").agg(
            F.min(F.struct("header", "at", "name")).alias("first")).select("first.*").orderBy("header", "at").collect()]
    at = names.groupBy("header").agg(F.map_from_entries(F.collect_list(F.struct("key", "at"))).alias("at")).select(
        "header", F.array(*[F.try_element_at("at", F.lit(n.lower())) for n in wanted]).alias("at"))
    raw = spark.read.options(**CSV_OPTIONS).schema(by_place).csv(paths)
    if size.kinds == 1:
        own = (at.first() or {"at": [None] * len(wanted)})["at"]
        rows = raw.select(*[(F.lit(None).cast("string") if i is None else F.col(places[i])).alias(n)
                            for n, i in zip(wanted, own, strict=True)])
    else:
        target = scratch_dir(spark, "places")
        heads.join(at, "header", "left").select("file", "at").write.parquet(target)
        found = spark.read.schema("file string, at array<int>").parquet(target)
        # Rows stay where they are while the table of files is small; beyond that Spark picks the join by size.
        found = F.broadcast(found) if size.files * (size.width + 50) < FILE_CELLS else found
        rows = raw.select(F.col("_metadata.file_path").alias("file"), F.array(*places).alias("cells")).join(
            found, "file").select(*[F.get("cells", F.get("at", F.lit(j))).alias(n) for j, n in enumerate(wanted)])
    return rows if schema is None else conform(rows, schema, strict=False)


def read_json_entity(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Item 2: a file with an outer array gives one row per element.

    Such a file cannot be split, so one task reads it; large inputs belong in many
    files.
    """
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def infer_entity_schema(spark: SparkSession, path: str, file_format: str = "csv",
                        ignore_case: bool = True) -> T.StructType:
    """Item 3: column names and types of staged files; CSV columns meet by name, whatever the files' headers."""
    found = infer_types(read_csv_entity(spark, path)) if file_format == "csv" else read_json_entity(spark, path).schema
    if not ignore_case:
        return found
    return T.StructType([T.StructField(f.name.upper(), f.dataType, f.nullable) for f in found])


def infer_types(text: DataFrame) -> T.StructType:
    """The narrowest type that all values of each text column have, in one pass; columns without values are text."""
    whole, number = r"^[-+]?[0-9]+$", r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
    fits = {
        T.IntegerType(): lambda v: v.rlike(whole) & v.try_cast("int").isNotNull(),
        T.LongType(): lambda v: v.rlike(whole) & v.try_cast("long").isNotNull(),
        T.DoubleType(): lambda v: v.rlike(number),
        T.DateType(): lambda v: v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & parse(v, T.DateType()).isNotNull(),
        T.TimestampType(): lambda v: v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]") & v.try_cast("timestamp").isNotNull(),
        T.BooleanType(): lambda v: F.lower(v).isin("true", "false")}
    checks = []
    for i, c in enumerate(text.columns):
        v = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        checks += [F.bool_and(F.when(v.isNotNull(), fit(v))).alias(f"{i}_{j}") for j, fit in enumerate(fits.values())]
    found = text.agg(*checks).first() if checks else {}
    return T.StructType([T.StructField(c, next((t for j, t in enumerate(fits) if found[f"{i}_{j}"]), T.StringType()))
                         for i, c in enumerate(text.columns)])


def describe_schema(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Item 3 as rows: one per column."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema)]
    return spark.createDataFrame(rows, "ordinal int, column_name string, type string, nullable boolean")


def create_from_template(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Item 4: an empty table of the inferred schema."""
    return spark.createDataFrame([], schema)


def sample_raw_json(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """Item 5: the first records as one variant column; equal positions go by their text."""
    raw = spark.read.option("multiLine", True).option("singleVariantColumn", "raw").json(path)
    rows = raw.lateralJoin(spark.tvf.variant_explode(F.col("raw").outer()))
    return rows.orderBy("pos", F.to_json("value")).limit(n).select(F.col("value").alias("record"))


# Typed loading ---------------------------------------------------------------------------


def parse(value: Column, to: T.DataType) -> Column:
    """Text to a type, NULL when it does not parse."""
    if isinstance(to, T.DateType):
        return F.try_to_timestamp(value, F.lit(DATE_FORMAT)).cast("date")
    if isinstance(to, T.TimestampType):
        return F.coalesce(F.try_to_timestamp(value, F.lit(TIMESTAMP_FORMAT)), value.try_cast("timestamp"))
    if isinstance(to, (T.LongType, T.IntegerType)):
        # 7.0 is the integer 7; scale 0 rounds half up.
        return value.try_cast("decimal(38,0)").try_cast(to)
    return value.try_cast(to)


def normalise_key(value: Column | str) -> Column:
    """A number written as 900085.0 becomes the text 900085; any other text stays as it is, blank is NULL."""
    return F.nullif(F.regexp_replace(F.trim(value), r"^(-?[0-9]+)\.0+$", "$1"), F.lit(""))


def _by_name(df: DataFrame, schema: T.StructType) -> list[tuple[T.StructField, Column]]:
    have = {}
    for c in df.columns:
        if c.lower() in have:
            raise ValueError(f"column {c} occurs twice when case is ignored")
        have[c.lower()] = c
    return [
        (f, F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None).cast("string"))
        for f in schema
    ]


def conform(df: DataFrame, schema: T.StructType, strict: bool = True,
            keys: Sequence[str] = ("policy_number",), raw_keys: bool = False) -> DataFrame:
    """Item 6: match columns by name in any case, cast them, fill missing ones with NULL.

    ``strict`` raises on a non-empty value that does not parse. ``raw_keys`` adds the untouched text of each
    key as ``<key>_raw``.
    """
    out = []
    for f, value in _by_name(df, schema):
        same = dict(df.dtypes).get(f.name) == f.dataType.simpleString()
        typed = value if same else parse(value.cast("string"), f.dataType)
        if strict and not same:
            bad = typed.isNull() & (F.trim(value.cast("string")) != "")
            message = F.concat(F.lit(f"cannot load {f.name}: "), value.cast("string"))
            typed = F.when(bad, F.raise_error(message)).otherwise(typed)
        if f.name in keys:
            if raw_keys:
                out.append(value.cast("string").alias(f"{f.name}_raw"))
            typed = normalise_key(value.cast("string"))
        out.append(typed.alias(f.name))
    return df.select(*out)


def copy_into_by_name(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "csv",
                      raw_keys: bool = False) -> DataFrame:
    """Item 6: bulk load of CSV or JSON files by name that stops at the first bad value."""
    raw = read_csv_entity(spark, path) if file_format == "csv" else read_json_entity(spark, path)
    return conform(raw, schema, strict=True, raw_keys=raw_keys)


def split_bad_rows(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns plus ``_bad``, the names of columns whose value did not parse."""
    checks = [
        F.when(parse(v.cast("string"), f.dataType).isNull() & (F.trim(v.cast("string")) != ""), F.lit(f.name))
        for f, v in _by_name(raw, schema)
    ]
    typed = conform(raw.withColumn("_bad", F.array_compact(F.array(*checks))),
                    T.StructType([*schema, T.StructField("_bad", T.ArrayType(T.StringType()))]),
                    strict=False)
    return typed


def load_skip_bad_rows(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Item 7: rows that parse, and quarantined rows with the failing columns.

    Short and long rows are good rows; a row is bad when a non-empty value fails.
    """
    rows = split_bad_rows(read_csv_entity(spark, path), schema)
    return rows.where(F.size("_bad") == 0).drop("_bad"), rows.where(F.size("_bad") > 0)


# Listings, tables, exports ---------------------------------------------------------------


def select_files(spark: SparkSession, folder: str, pattern: str | None = None,
                 suffixes: Sequence[str] = (), max_bytes: int | None = None) -> DataFrame:
    """Item 9: file names and sizes by regular expression, suffix and size, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select("path", "length")  # the content column is not read
    if pattern:
        files = files.where(F.col("path").rlike(pattern))
    if suffixes:
        hits = F.lit(False)
        for s in suffixes:
            hits = hits | F.lower("path").endswith(s.lower())
        files = files.where(hits)
    if max_bytes is not None:
        files = files.where(F.col("length") < max_bytes)
    name = F.split_part("path", F.lit("/"), F.lit(-1)).alias("file_name")
    return files.select(name, "path", "length").orderBy("file_name", "path")


def largest_file(spark: SparkSession, folder: str, n: int = 1) -> DataFrame:
    """The largest files of a listing."""
    return select_files(spark, folder).orderBy(F.col("length").desc(), "file_name").limit(n)


def document_scan(spark: SparkSession, folder: str, suffix: str = "*") -> DataFrame:
    """Item 10: one row per document file, with its path and text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = files.option("pathGlobFilter", suffix).load(folder)
    return files.select(
        F.split_part("path", F.lit("/"), F.lit(-1)).alias("relative_path"),
        "length",
        F.decode("content", "UTF-8").alias("raw_text"),
    )


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Item 11: create or replace a Parquet table and return it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def export_records_csv(df: DataFrame, path: str) -> None:
    """Item 12: rows as CSV files with a header."""
    df.write.mode("overwrite").options(header=True, dateFormat=DATE_FORMAT).csv(path)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Item 13: constant rows, the fallback of a feed."""
    return spark.createDataFrame(list(rows), schema)


def or_else(feed: DataFrame, fallback: DataFrame) -> DataFrame:
    """Item 13: the feed, or the fallback rows when the feed is empty."""
    empty = feed.agg(F.count(F.lit(1)) == 0).scalar()
    return feed.unionByName(fallback.where(empty))


def metadata_checks(spark: SparkSession, required: dict[str, Sequence[str]]) -> DataFrame:
    """Item 97: which required tables and columns exist, and how many rows they hold."""
    rows = []
    for name, columns in required.items():
        exists = spark.catalog.tableExists(name)
        have = {c.name.lower() for c in spark.catalog.listColumns(name)} if exists else set()
        missing = [c for c in columns if c.lower() not in have]
        rows.append((name, exists, len(have), missing))
    found = spark.createDataFrame(
        rows, "table_name string, table_exists boolean, n_columns int, missing_columns array<string>"
    )
    return found.join(record_counts(spark, list(required)), "table_name", "left")


def record_counts(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Rows of each table that exists, one row per table."""
    parts = [
        spark.table(n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("record_count"))
        for n in names if spark.catalog.tableExists(n)
    ]
    empty = spark.createDataFrame([], "table_name string, record_count long")
    return reduce(DataFrame.unionByName, parts, empty)


def exists_probe(spark: SparkSession, name: str) -> DataFrame:
    """Item 36: one row that tells whether the table is missing, and its row count if not."""
    probe = spark.createDataFrame([(name, not spark.catalog.tableExists(name))],
                                  "table_name string, table_missing boolean")
    return probe.join(record_counts(spark, [name]), "table_name", "left")
