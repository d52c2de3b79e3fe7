"""Tabular sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SURVEY_SCHEMA

NULL_TEXT = "NA"


def syntactic(name: str) -> str:
    """A column name that needs no quoting: dots and blanks become underscores."""
    return re.sub(r"[^0-9A-Za-z_]+", "_", name.strip()).lower()


def _read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = spark.read.option("header", True).csv(path).columns
    by_name = {f.name: f.dataType for f in schema.fields}
    # The file's own column order decides positions; types come from the schema.
    # A column the schema does not name is kept as text.
    declared = T.StructType(
        [T.StructField(h, by_name.get(syntactic(h), T.StringType())) for h in header]
    )
    df = (
        spark.read.schema(declared)
        .option("header", True)
        .option("nullValue", NULL_TEXT)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    df = df.toDF(*[syntactic(h) for h in header])
    # Blank text counts as missing, and NaN as missing, from here on.
    fixes = {
        f.name: F.nullif(F.col(f.name), F.lit(""))
        if isinstance(f.dataType, T.StringType)
        else F.nanvl(F.col(f.name), F.lit(None))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.StringType, T.DoubleType))
    }
    return df.withColumns(fixes)


def read_survey(spark: SparkSession, path: str, schema: str = SURVEY_SCHEMA, multi_line: bool = True) -> DataFrame:
    """Wide survey CSV with declared types; ``NA`` and blank text are NULL.

    Quoted text may hold line breaks. A file known to have none can be read with
    ``multi_line`` off, which lets Spark split it.
    """
    return _read_csv(spark, path, schema, multi_line)


def read_derived(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """A table written by ``write_outputs``: Parquet, or CSV when a schema is given."""
    if schema is None:
        return spark.read.parquet(path)
    return _read_csv(spark, path, schema)


def write_outputs(tables: Mapping[str, DataFrame], folder: str, fmt: str = "both") -> dict[str, str]:
    """Write each table below ``folder``; CSV for people, Parquet for the next stage."""
    if fmt not in ("csv", "parquet", "both"):
        raise ValueError(f"unknown format {fmt!r}")
    written = {}
    for name, df in tables.items():
        if fmt in ("parquet", "both"):
            written[f"{name}.parquet"] = f"{folder}/{name}.parquet"
            df.write.mode("error").parquet(written[f"{name}.parquet"])
        if fmt in ("csv", "both"):
            written[f"{name}.csv"] = f"{folder}/{name}.csv"
            (
                df.write.mode("error")
                .option("header", True)
                .option("nullValue", NULL_TEXT)
                .option("emptyValue", "")
                .option("escape", '"')
                .csv(written[f"{name}.csv"])
            )
    return written


def save_fit(tables: Mapping[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Store the tables of a fit, or read them back if they are there already."""
    out = {}
    for name, df in tables.items():
        path = f"{folder}/{name}"
        if not saved(df.sparkSession, path):
            df.write.mode("error").parquet(path)
        out[name] = df.sparkSession.read.parquet(path)
    return out


def saved(spark: SparkSession, path: str) -> bool:
    """True once a Spark write to ``path`` has been committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def describe_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: type, rows, non-NULL values, distinct values, least, greatest.

    One aggregation over the table, then the single result row is turned on its side.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count_distinct(c).alias(f"d{i}"),
            F.min(c).cast("string").alias(f"lo{i}"),
            F.max(c).cast("string").alias(f"hi{i}"),
        ]
    row = df.agg(*aggs)
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("n_rows"),
            F.col(f"n{i}").alias("n_values"),
            F.col(f"d{i}").alias("n_distinct"),
            F.col(f"lo{i}").alias("min_value"),
            F.col(f"hi{i}").alias("max_value"),
        )
        for i, f in enumerate(fields)
    ]
    return row.select(F.inline(F.array(*entries)))


def select_cols(df: DataFrame, want: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """The wanted columns, plus those optional ones that exist."""
    return df.select(*want, *[c for c in optional if c in df.columns and c not in want])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; every old name must exist."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed(dict(names))
