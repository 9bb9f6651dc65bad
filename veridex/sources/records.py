"""Record files: JSON lines per item type, seed lists, id sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER = "id string, fullname string, location string, badges array<string>, ranking int, helpfulStat array<int>, reviewStat int, referrer string"
PRODUCT = "id string, name string, price double, cat string, avgStars double, nReviews int, salesRank int, subCatRank int, subCat string, manufact string, referrer string"
REVIEW = "id string, productId string, memberId string, helpful array<int>, starRating double, title string, date string, verifiedPurchase boolean, reviewTxt string, nComments int, vine boolean"
SCHEMAS = {"member": MEMBER, "product": PRODUCT, "review": REVIEW}


def read_items(spark: SparkSession, folder: str, item: str, streaming: bool = False) -> DataFrame:
    """Records of one item type ('member', 'product' or 'review') under ``folder``; lines that are no records come out as nulls."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(SCHEMAS[item]).option("mode", "PERMISSIVE").json(f"{folder}/item_type={item}")


def write_items(df: DataFrame, folder: str, item: str) -> None:
    """Replace the JSON lines of one item type; absent values are not written."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{folder}/item_type={item}")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(Type, ID) of a seed list in CSV with a header."""
    return spark.read.option("header", True).schema("Type string, ID string").csv(path)


def write_id_set(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("id")).distinct().write.mode("overwrite").parquet(path)


def read_id_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
