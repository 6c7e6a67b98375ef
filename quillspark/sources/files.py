"""File sources: typed CSV, optional and alternative inputs, whole texts, binaries; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV of a declared schema; a row that doesn't fit fails the job. Dates are ISO."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", dateFormat="yyyy-MM-dd", escape='"', multiLine=True)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings, null as empty."""
    return read_csv(spark, path, StructType([StructField(c, StringType()) for c in columns])).na.fill("")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return read_csv(spark, path, schema) if exists(spark, path) else None


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def write_csv(df: DataFrame, path: str, force: bool = False) -> None:
    """ISO dates, header, nested columns dropped; an existing target is an error unless forced."""
    flat = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
    df.select(*flat).write.mode("overwrite" if force else "errorifexists").csv(path, header=True, dateFormat="yyyy-MM-dd", escape='"')


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, is_pdf)."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", "content", is_pdf(F.col("content")).alias("is_pdf"))


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.startswith(F.substring(content, 1, 4), F.lit(b"%PDF")), F.lit(False))


def extract_texts(binaries: DataFrame, extractor) -> DataFrame:
    """(path, text) of binaries (path, content) by a function bytes -> list of page texts, which are joined by an empty line."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=["\n\n".join(p or "" for p in extractor(bytes(c))) for c in pdf["content"]])[["path", "text"]]

    return binaries.select("path", "content").mapInPandas(run, "path string, text string")


def as_json(df: DataFrame, digits: int = 4) -> DataFrame:
    """One JSON object a row (column `json`): doubles rounded, NaN as null, ISO dates, nulls kept."""
    clean = []
    for c, kind in df.dtypes:
        x = F.col(c)
        if kind in ("double", "float"):
            x = F.bround(F.when(~F.isnan(x), x), digits)
        elif kind == "date":
            x = F.date_format(x, "yyyy-MM-dd")
        clean.append(x.alias(c))
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))
