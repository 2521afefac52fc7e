"""Reading businesses, reviews and the parquet tables, and naming them for SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.operators.rowids import number_rows

_CORRUPT = "_corrupt_record"

BUSINESS_SCHEMA = T.StructType(
    [T.StructField("business_id", T.StringType()), T.StructField("review_count", T.LongType())]
)
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("business_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("votes", T.StructType([T.StructField("useful", T.LongType())])),
    ]
)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | None = None, view: str | None = None
) -> DataFrame:
    """JSON lines; without a schema it is inferred by a pass over the files."""
    reader = spark.read.schema(schema) if schema else spark.read
    return name_view(reader.json(path), view)


def read_businesses(
    spark: SparkSession, path: str, schema: T.StructType | None = BUSINESS_SCHEMA, view: str | None = "business"
) -> DataFrame:
    return read_json(spark, path, schema, view)


@dataclass
class Scanned:
    """What a file holds: the rows that could be read, and the lines that could not."""

    reviews: DataFrame
    rejected: DataFrame


def scan_json(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA) -> Scanned:
    """JSON lines with a rescue channel.

    A line that is no JSON object, or has a value of another type than the schema
    says, is a row of ``rejected``, as (line, reason), and not of ``reviews``.
    Blank lines are neither.
    """
    column = "_line"
    kept = T.StructType([*schema.fields, T.StructField(column, T.StringType())])
    lines = spark.read.text(path).where(F.length(F.trim("value", F.lit(" \t\r\n"))) > 0)
    # Only an object has fields to read; any other JSON value is a broken line too.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": column}
    parsed = lines.select("value", F.from_json("value", kept, options).alias("row"))
    opened = F.startswith(F.ltrim("value"), F.lit("{"))
    broken = ~opened | F.col("row").isNull() | F.col(f"row.{column}").isNotNull()
    reason = F.when(opened, "broken or of another type").otherwise("no object").alias("reason")
    return Scanned(
        parsed.where(~broken).select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields]),
        parsed.where(broken).select(F.col("value").alias("line"), reason),
    )


def scan_reviews(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA) -> Scanned:
    """Reviews and rejected lines; ``given`` tells whether a review's line has an id.

    Lines without one get the numbers above all ids that lines have, in the
    order of the files' lines; only they are sorted and numbered.
    """
    scanned = scan_json(spark, path, schema)
    if "doc_id" not in schema.fieldNames():
        raise ValueError("the schema needs a doc_id, which lines may leave out")
    named = scanned.reviews.where("doc_id IS NOT NULL").withColumn("given", F.lit(True))
    nameless = scanned.reviews.where("doc_id IS NULL")
    if nameless.isEmpty():
        return Scanned(named, scanned.rejected)
    most = named.agg(F.max("doc_id")).first()[0]
    lines = nameless.drop("doc_id").withColumn("_line", F.monotonically_increasing_id())
    numbered = number_rows(lines, [F.col("_line")], "doc_id").frame.drop("_line")
    first = 0 if most is None else max(0, most + 1)
    numbered = numbered.withColumn("doc_id", F.col("doc_id") + F.lit(first)).withColumn("given", F.lit(False))
    return Scanned(named.unionByName(numbered), scanned.rejected)


def read_reviews(
    spark: SparkSession, path: str, schema: T.StructType | None = REVIEW_SCHEMA, view: str | None = "review"
) -> DataFrame:
    """Reviews; only the nested fields of the schema are parsed.

    Lines without an id get one, in the order of the lines, above those that
    others have.  Lines that cannot be read are left out here; ``scan_reviews``
    returns them.
    """
    if schema is None:
        inferred = read_json(spark, path)
        # Ids are numbers, whatever some lines say.
        fields = [f for f in inferred.schema.fields if f.name not in (_CORRUPT, "doc_id")]
        schema = T.StructType([T.StructField("doc_id", T.LongType()), *fields])
    return name_view(scan_reviews(spark, path, schema).reviews.drop("given"), view)


def name_view(frame: DataFrame, view: str | None) -> DataFrame:
    """Make a table visible to ``spark.sql`` under a name."""
    if view:
        frame.createOrReplaceTempView(view)
    return frame


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
