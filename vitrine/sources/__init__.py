"""Readers and guarded writers of the catalogue, its dimensions and the event logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIANT = T.StructType([
    T.StructField("color", T.StringType()), T.StructField("hex", T.StringType()), T.StructField("imgs", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.StringType())),
    T.StructField("inStock", T.BooleanType()), T.StructField("price", T.DoubleType()), T.StructField("url", T.StringType()),
])
PRODUCT = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("id", "brand", "brandSlug", "name", "category", "currency", "image", "productUrl", "source")),
    *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("genders", "styles", "images", "sizes", "colors", "colorTags")),
    *(T.StructField(n, T.DoubleType()) for n in ("price", "priceMin", "priceMax")),
    T.StructField("variants", T.ArrayType(VARIANT)), T.StructField("inStock", T.BooleanType()), T.StructField("pop", T.IntegerType()), T.StructField("day", T.IntegerType()),
])
EVENT = "at TIMESTAMP, kind STRING, brand STRING, brandSlug STRING, productId STRING, productName STRING, category STRING, targetHost STRING, price DOUBLE, session STRING"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue of JSON arrays, one or many files, gzip or not; an empty one is an error, never a result."""
    df = spark.read.schema(PRODUCT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"empty catalogue: {path}")
    return df


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event logs, one JSON object a line; lines that don't parse are skipped; day comes from the folder."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """The brand roster (name,style,url), styles separated by semicolons."""
    df = spark.read.option("header", True).schema("name STRING, style STRING, url STRING").csv(path)
    return df.withColumn("styles", F.filter(F.split("style", ";"), lambda s: s != "")).drop("style")


def woo_price(minor: F.Column, digits: F.Column) -> F.Column:
    """A price in minor units."""
    return minor.cast("double") / F.pow(F.lit(10.0), digits)


def shrinks(old: F.Column | int, new: F.Column | int, least: float = 0.6) -> F.Column | bool:
    """Whether so few rows may not replace so many."""
    return new < least * old


def write_catalog(df: DataFrame, path: str, least: float = 0.6, force: bool = False) -> int:
    """Overwrite a catalogue unless it would shrink below `least` of what is there; returns the rows written."""
    spark, new = df.sparkSession, df.count()
    try:
        old = spark.read.parquet(path).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = 0
    if shrinks(new=new, old=old, least=least) and not force:
        raise ValueError(f"{new} rows would replace {old}")
    df.write.mode("overwrite").parquet(path)
    return new


def brand_verdicts(old: DataFrame, new: DataFrame, least: float = 0.6) -> DataFrame:
    """(brand_slug, keep_old): whether a brand's new rows are too few, or lost their prices or sizes, to replace its old ones."""

    def health(df: DataFrame, tag: str) -> DataFrame:
        known = F.count_if(F.col("price").isNotNull()), F.count_if(F.size("sizes") > 0)
        return df.groupBy("brand_slug").agg(F.count("*").alias(f"{tag}_n"), *(c.alias(f"{tag}_{n}") for c, n in zip(known, ("priced", "sized"), strict=True)))

    both = health(old, "o").join(health(new, "n"), "brand_slug", "full").na.fill(0)
    lost = lambda c: (F.col(f"o_{c}") / F.col("o_n") >= 0.5) & (F.col(f"n_{c}") / F.greatest(F.col("n_n"), F.lit(1)) < 0.2)
    bad = (F.col("o_n") > 0) & ((F.col("n_n") < least * F.col("o_n")) | lost("priced") | lost("sized"))
    return both.select("brand_slug", bad.alias("keep_old"))


def keep_last_good(old: DataFrame, new: DataFrame, least: float = 0.6) -> DataFrame:
    """Per brand the new rows, or the old ones where the new ones are too few or lost their prices or sizes."""
    keep = brand_verdicts(old, new, least)
    stay = old.join(keep.filter("keep_old"), "brand_slug", "left_semi")
    return stay.unionByName(new.join(keep.filter("keep_old"), "brand_slug", "left_anti"))


def write_brands(new: DataFrame, path: str, report: str, least: float = 0.6) -> DataFrame:
    """Replace the brands of a table that is partitioned by brand_slug, but for those whose new rows may not replace the old.

    Only the partitions of accepted brands are written; files of refused brands, and of those that new has no rows of,
    are not touched.  What was decided is written to `report` (brand_slug, keep_old) first, and returned.
    """
    spark = new.sparkSession
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], new.schema)
    brand_verdicts(old.join(new.select("brand_slug").distinct(), "brand_slug", "left_semi"), new, least).coalesce(1).write.mode("overwrite").parquet(report)
    told = spark.read.parquet(report)
    accepted = new.join(told.filter("not keep_old"), "brand_slug", "left_semi")
    accepted.repartition("brand_slug").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("brand_slug").parquet(path)
    return told


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a new value wins where it is not null."""
    cols = [c for c in old.columns if c != key]
    n = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in cols))
    return old.join(n, key, "full").select(key, *(F.coalesce(f"_new_{c}", c).alias(c) for c in cols))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti"))
