"""Sources: declared schemas over JSON lines, CSV and text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUSINESS = "business_id string, city string, state string, stars double, review_count int, is_open int, latitude double, longitude double, categories string, attributes map<string,string>, hours map<string,string>"
REVIEW = "user_id string, business_id string, date string, stars double, text string"
USER = "user_id string, review_count int, average_stars double, fans int, useful int, funny int, cool int, elite string, friends string, " + ", ".join(
    f"compliment_{k} int" for k in "hot profile list note plain cool funny writer photos".split()
)
CHECKIN, PHOTO, TIP = "business_id string, time map<string,string>", "business_id string", "business_id string, user_id string, date string, text string"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def as_uri(path: str) -> str:
    """An absolute local path as a file URI; what is a URI already stays."""
    from pathlib import PurePosixPath

    return PurePosixPath(path).as_uri() if path.startswith("/") else path


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header under a declared schema; cells that don't parse are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; absent keys are null, an absent path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def first_line(lines: DataFrame) -> str | None:
    """The first line of the first file by name that has any; Spark itself reads large files first."""
    bare = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "file:/")  # both forms of a local URI occur
    for name in sorted(lines.inputFiles()):
        found = lines.where(bare == re.sub("^file:/*", "file:/", name)).first()
        if found:
            return found[0]
    found = lines.first()
    return found[0] if found else None


def csv_columns(spark: SparkSession, path: str, names: list[str], header: bool | None = True, at: list[int] | None = None) -> DataFrame:
    """Trimmed string columns by position; rows that lack one or hold a blank go.

    header: True skips the first line and every line equal to it, False none, None
    decides by whether the first line has all the names.
    """
    at = at or list(range(len(names)))
    lines = spark.read.text(path)
    wide = ", ".join(f"c{i} string" for i in range(max(at) + 1))
    if header is not False:
        head = first_line(lines)
        if head is not None and (header or all(n in head for n in names)):
            lines = lines.where(F.col("value") != head)
    row = F.from_csv("value", wide, {"mode": "PERMISSIVE"})
    cut = lines.select(row.alias("r")).select(*[F.trim(F.col(f"r.c{i}")).alias(n) for i, n in zip(at, names, strict=True)])
    for n in names:
        cut = cut.where(F.col(n).isNotNull() & (F.col(n) != "") & (F.col(n) != n))
    return cut


def ratings(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """(user_id, business_id[, stars]); rows whose stars don't parse go."""
    names = ["user_id", "business_id", *(["stars"] if labelled else [])]
    df = csv_columns(spark, path, names)
    return df.withColumn("stars", F.col("stars").try_cast("double")).where("stars IS NOT NULL") if labelled else df


def distinct_pairs(spark: SparkSession, path: str, header: bool | None = True) -> DataFrame:
    return csv_columns(spark, path, ["user_id", "business_id"], header).distinct()


def product_id(column: str):
    """Leading zeros go from ids that are whole numbers of any length; others stay."""
    bare = F.regexp_replace(F.trim(F.col(column)), "^0+(?=[0-9])", "")
    return F.when(F.trim(F.col(column)).rlike("^[0-9]+$"), bare).otherwise(F.col(column))


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """(basket, item) of a nine-column sales file: the basket is date-customer."""
    df = csv_columns(spark, path, ["TRANSACTION_DT", "CUSTOMER_ID", "PRODUCT_ID"], None, [0, 1, 5])
    return df.select(F.concat_ws("-", "TRANSACTION_DT", "CUSTOMER_ID").alias("basket"), product_id("PRODUCT_ID").alias("item"))


def points(spark: SparkSession, path: str) -> DataFrame:
    """(point, x) from lines id,label,f1,f2,...; short or blank lines go, the label is ignored."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), ",").alias("p")).where(F.size("p") >= 3)
    return parts.select(F.get("p", 0).try_cast("int").alias("point"), F.transform(F.slice("p", 3, F.size("p") - 2), lambda v: v.try_cast("double")).alias("x")).where("point IS NOT NULL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
