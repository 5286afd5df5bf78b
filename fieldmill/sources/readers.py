"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.operators.shaping import first_per_group

POST = "id string, text string, author string, url string, posted_at string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def replay(spark: SparkSession, path: str, post: str = POST) -> DataFrame:
    """Posts of dumps of the form {"posts": [...]}; a dump that cannot be read gives none."""
    raw = spark.read.schema(f"posts array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in post.split(','))}>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.select(F.explode("posts").alias("p")).select("p.*")


def guarded_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Line-delimited JSON behind a prefix such as `for (;;);`; lines that are no objects are skipped, the first of each key stays.

    The order is that of file names, then of lines. A whole file is read as one row and cut into numbered lines, as a
    scan by lines does not say where a line stands: dumps of this form are pages of one reply, not corpora.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.posexplode(F.split("value", "\r?\n")).alias("_line", "_text"))
    body = F.regexp_replace("_text", r"^(for \(;;\);|\)\]\}'),?", "")
    rows = files.withColumn("_text", body).where(F.startswith(F.trim("_text"), F.lit("{"))).select(F.from_json("_text", schema, {"mode": "PERMISSIVE"}).alias("_row"), F.struct("_file", "_line").alias("_at"))
    rows = rows.select(F.col(f"_row.{key}").alias("_key"), "_row", "_at").where("_key IS NOT NULL")
    return rows.groupBy("_key").agg(F.min_by("_row", "_at").alias("_row")).select("_row.*")


def import_outcomes(payloads: DataFrame, column: str, schema: str, required: list[str]) -> DataFrame:
    """outcome (ok, invalid, malformed), n of JSON payloads."""
    parsed = payloads.select(F.from_json(column, schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(f"r.{c}").isNull()
    outcome = F.when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "malformed").when(missing, "invalid").otherwise("ok")
    return parsed.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def backfill(rows: DataFrame, key: str, ident: str, fields: list[str]) -> DataFrame:
    """Of each key the row with most fields filled, then the least identifier."""
    filled = sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in fields), F.lit(0))
    return first_per_group(rows.withColumn("_f", filled), [key], [F.desc("_f"), F.asc(ident)]).drop("_f")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """old with the children of new's parents replaced by new."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)
