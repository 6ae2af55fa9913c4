"""Table readers and writers by file suffix."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.operators.ordered import scan
from tessera.operators.tabular import nan_to_null

SUFFIXES = ("csv", "tsv", "parquet", "tif", "tiff")


def suffix(path: str) -> str:
    if not isinstance(path, str):
        raise TypeError("a path must be a string")
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end not in SUFFIXES:
        raise IOError(f"no reader for this file type: {path}")
    return end


Schema = T.StructType | str


def load_file(spark: SparkSession, path: str, schema: Schema | None = None) -> DataFrame:
    """Read one file, folder or glob by its suffix; NaN becomes null."""
    return load_many(spark, [path], schema, ordered=False)


def load_csv(spark: SparkSession, paths: Sequence[str] | str, schema: Schema) -> DataFrame:
    """Files with a header line each, separated by commas if that line has one,
    else by white space. Columns are found by name; one that a file lacks is
    null, and a value of the wrong type raises. All files are one scan; empty
    files give no rows."""
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = spark.read.text(paths if isinstance(paths, str) else list(paths))
    lines = text.select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("_at"),
    ).filter(F.trim("value") != "")
    heads = lines.groupBy("_file").agg(F.min_by("value", "_at").alias("_head"), F.min("_at").alias("_first"))
    rows = lines.join(heads, "_file").filter(F.col("_at") > F.col("_first"))

    def cells(line: str) -> Column:
        fields = F.when(F.contains("_head", F.lit(",")), F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')).otherwise(F.split(F.trim(line), r"\s+"))
        return F.transform(fields, lambda x: F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"))

    rows = rows.select(cells("_head").alias("_names"), cells("value").alias("_cells"))
    value = lambda f: F.nullif(F.try_element_at("_cells", F.nullif(F.array_position("_names", F.lit(f.name)), F.lit(0).cast("bigint")).cast("int")), F.lit(""))
    return rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in kinds.fields])


def load_many(spark: SparkSession, paths: Sequence[str] | str, schema: Schema | None = None, ordered: bool = True) -> DataFrame:
    """Union by name of a glob or a list of files, by one reader per kind of
    file. Columns are sorted if ``ordered``; a file that lacks one gives nulls.
    Text files need a schema."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds: dict[str, list[str]] = {}
    for p in paths:
        end = suffix(p)
        kinds.setdefault({"tsv": "csv", "tiff": "tif"}.get(end, end), []).append(p)
    tables = []
    for kind, own in kinds.items():
        if kind == "parquet":
            tables.append(nan_to_null(spark.read.option("mergeSchema", len(own) > 1).parquet(*own)))
        elif kind == "csv":
            if schema is None:
                raise ValueError("text files need a schema")
            tables.append(nan_to_null(load_csv(spark, own, schema)))
        else:
            from tessera.sources.tiles import read_tiff

            tables.append(read_tiff(spark, own))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return df.select(*sorted(df.columns)) if ordered else df


def path_keys(path: Column, plate_part: int = 4, well_part: int = 5, site: str = r"Site-(\d+)") -> dict[str, Column]:
    """Keys by their place in a path: plate and well are pieces, the site is found in the whole path."""
    parts = F.split(path, "/")
    return {
        "plate": F.try_element_at(parts, F.lit(plate_part + 1)), "well": F.try_element_at(parts, F.lit(well_part + 1)),
        "site": F.nullif(F.regexp_extract(path, site, 1), F.lit("")).cast("bigint")}


def load_with_file_keys(spark: SparkSession, glob: str, schema, plate_part: int = 4, well_part: int = 5) -> DataFrame:
    """CSV files whose path pieces and names hold the keys: plate and well by
    place in the path, site after ``Site-`` and cell before the suffix."""
    df = spark.read.schema(schema).csv(glob, header=True).withColumn("file", F.col("_metadata.file_path"))
    return df.withColumns(path_keys(F.regexp_replace("file", "^file:/+", "/"), plate_part, well_part))


def load_vectors(spark: SparkSession, path: str, width: int, sep: str = " ") -> DataFrame:
    """Headerless lines of numbers as one array per line, with a line number."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    numbers = F.transform(F.split(F.trim("value"), f"{sep}+"), lambda x: x.cast("float"))
    checked = F.when(F.size(numbers) == width, numbers).otherwise(
        F.raise_error(F.lit(f"expected {width} numbers per line")).cast("array<float>"))
    return raw.select(F.monotonically_increasing_id().alias("line"), checked.alias("features"))


def load_matrix(spark: SparkSession, path: str | Sequence[str], samples: Sequence[str], key: str = "gene", sep: str = ",") -> DataFrame:
    """A matrix of numbers whose first, unnamed column is the row key and whose
    other columns are ``samples``, in this order."""
    schema = T.StructType([T.StructField(key, T.StringType()), *(T.StructField(c, T.DoubleType()) for c in samples)])
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True, sep=sep)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 0 per file in file
    order; blocks of large files are counted in parallel."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")).alias("_at"))
    return scan(text, ["file"], [F.col("_at")], {"line": ("count", None)}).select("file", (F.col("line") - 1).alias("line"), "value")


def join_by_line(left: DataFrame, right: DataFrame, line: str = "line") -> DataFrame:
    """Put a side-car's columns next to a table's by line number; a line that
    only one side has raises."""
    a, b = left.withColumn("_a", F.lit(1)), right.withColumn("_b", F.lit(1))
    both = a.join(b, line, "full")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    checked = F.when(whole, F.col(line)).otherwise(F.raise_error(F.concat(F.lit("line without a partner: "), F.col(line).cast("string"))).cast(left.schema[line].dataType))
    return both.withColumn(line, checked).drop("_a", "_b")


def save_file(df: DataFrame, path: str, max_records: int | None = None, partition_by: Sequence[str] = ()) -> None:
    """Write by suffix; an empty table still leaves its header or schema."""
    end = suffix(path)
    writer = df.write.mode("overwrite")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if end == "parquet":
        writer.parquet(path)
    elif end in ("csv", "tsv"):
        writer.csv(path, header=True, sep="," if end == "csv" else "\t")
    else:
        raise IOError("images are written with tiles.write_tiff")


def save_fastq(records: DataFrame, path: str) -> None:
    """FASTQ text from the ``value`` column of ``fastq_records``."""
    records.select("value").write.mode("overwrite").text(path)
