"""Helpers shared by the operators: table access and tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtext.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Lineage ends at files that every executor can read, so a lost executor
    costs no recomputation, and ids made from partition numbers stay fixed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(df: DataFrame) -> SparkSession:
    """The frame's session, with this package importable on its executors."""
    ship_package(df.sparkSession)
    return df.sparkSession


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that a helper column can't clash with one of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def keep_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents whose id and text digest are in ``chosen`` (id, digest), with all their columns; of equal ones, one."""
    keyed = docs.select(whole_row(docs), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"), F.col(id_col).alias("id"))
    same = F.col("k.digest").eqNullSafe(F.col("d.digest")) & F.col("k.id").eqNullSafe(F.col("d.id"))
    kept = keyed.alias("k").join(chosen.alias("d"), same, "left_semi")
    return kept.dropDuplicates(["digest", "id"]).select("row.*")
