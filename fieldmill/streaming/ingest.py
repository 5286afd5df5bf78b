"""Micro-batch ingest into a keyed table: each batch classifies its items against the table and replaces only the buckets it touches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

NEW, UPDATED, UNCHANGED, FAILED = "new", "updated", "unchanged", "error"


@dataclass
class ItemTable:
    """Source items by key, in a folder that all executors share.

    Rows come with the keys, content_hash, media_hash, observed_at, seq (the order of arrival) and payload columns.

    - ``items/gen=g/bucket=k``: the state of a bucket of keys as commit g left it;
    - ``outcomes/gen=g``: what each row of that commit was, and its version;
    - ``log``: a row for each bucket of each commit. It is appended last, as one file, so a commit is there as a whole
      or not at all; files of a commit that was cut off are overwritten by the next one.

    A writer's batch number is committed once: a batch that is replayed changes nothing.
    """

    spark: SparkSession
    root: str
    keys: list[str] = field(default_factory=lambda: ["source", "external_id"])
    payload: list[str] = field(default_factory=list)
    buckets: int = 64
    writer: str = "ingest"

    def log(self) -> DataFrame:
        """generation, writer, batch, bucket (null for a commit without rows)."""
        schema = "generation long, writer string, batch long, bucket int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _current(self) -> dict[int, int]:
        """The last commit of each bucket; at most as many as there are buckets."""
        rows = self.log().where("bucket IS NOT NULL").groupBy("bucket").agg(F.max("generation").alias("generation")).collect()
        return {r["bucket"]: r["generation"] for r in rows}

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, paths: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _schema(self, rows: DataFrame):
        return rows.select(*self.keys, "content_hash", "media_hash", *self.payload, F.col("observed_at").alias("first_seen"), F.col("observed_at").alias("last_seen"), F.lit(0).cast("long").alias("version")).schema

    def items(self, like: DataFrame, only: set[int] | None = None) -> DataFrame:
        """The table now, or some of its buckets. like: any frame with the columns of a batch."""
        paths = [f"{self.root}/items/gen={g}/bucket={k}" for k, g in sorted(self._current().items()) if only is None or k in only]
        return self._read(paths, self._schema(like))

    def outcomes(self) -> DataFrame:
        """Every committed row with its status, version and generation."""
        done = sorted(r["generation"] for r in self.log().where("bucket IS NOT NULL").select("generation").distinct().collect())
        return self.spark.read.option("basePath", f"{self.root}/outcomes").parquet(*[f"{self.root}/outcomes/gen={g}" for g in done]).withColumnRenamed("gen", "generation")

    def versions(self) -> DataFrame:
        """The states that items had, one for each time that an item's text or pictures changed."""
        return self.outcomes().where(F.col("status").isin(NEW, UPDATED))

    def classify(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        """rows with status and version. An item is compared with its last state, which may come from the same batch; a missing hash equals a missing one.

        Of an unchanged item the accepted payload stays. Rows without a full key, or without time or place in the
        order, are errors and touch nothing.
        """
        fine = F.col("observed_at").isNotNull() & F.col("seq").isNotNull()
        for k in self.keys:
            fine = fine & F.col(k).isNotNull()
        columns = [*self.keys, "content_hash", "media_hash", "observed_at", "seq", *self.payload]
        own = rows.select(*columns, F.lit(None).cast("long").alias("_version"))
        old = state.select(*self.keys, "content_hash", "media_hash", F.col("last_seen").alias("observed_at"), F.lit(None).cast(rows.schema["seq"].dataType).alias("seq"), *self.payload, F.col("version").alias("_version"))
        w = Window.partitionBy(*self.keys).orderBy(F.col("_version").isNull(), "seq", "observed_at", "content_hash", "media_hash")
        both = old.unionByName(own.where(fine)).withColumn("_first", F.row_number().over(w) == 1)
        same = F.col("content_hash").eqNullSafe(F.lag("content_hash").over(w)) & F.col("media_hash").eqNullSafe(F.lag("media_hash").over(w))
        both = both.withColumn("_changed", F.col("_version").isNull() & (F.col("_first") | ~same))
        both = both.withColumn("version", F.coalesce(F.first("_version").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.sum(F.col("_changed").cast("long")).over(w))
        for c in self.payload:
            accepted = F.last(F.when(F.col("_changed") | F.col("_version").isNotNull(), F.struct(c)), ignorenulls=True).over(w)
            both = both.withColumn(f"_{c}", accepted[c]).drop(c).withColumnRenamed(f"_{c}", c)
        status = F.when(~F.col("_changed"), UNCHANGED).when(F.col("_first"), NEW).otherwise(UPDATED)
        done = both.where(F.col("_version").isNull()).select(*columns, "version", status.alias("status"))
        return done.unionByName(own.where(~fine).select(*columns, F.lit(None).cast("long").alias("version"), F.lit(FAILED).alias("status")))

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}

    def preview(self, rows: DataFrame) -> DataFrame:
        """What merge() would make of the rows; nothing is written."""
        return self.classify(rows, self.items(rows, self._touched(rows)))

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Commits a batch; false if this writer has committed it before. last_seen never falls, first_seen never rises, whatever the order of arrival."""
        log = self.log()
        last, mine = log.agg(F.max("generation"), F.max(F.when(F.col("writer") == self.writer, F.col("batch")))).first()
        if mine is not None and batch <= mine:
            return False
        generation = 0 if last is None else last + 1
        touched = self._touched(rows)
        if touched:
            state, schema = self.items(rows, touched), self._schema(rows)
            at = f"{self.root}/outcomes/gen={generation}"
            self.classify(rows, state).write.mode("overwrite").parquet(at)
            done = self.spark.read.parquet(at).where(F.col("status") != FAILED)
            facts = F.struct("seq", "version", "content_hash", "media_hash", *self.payload)
            ends = done.groupBy(*self.keys).agg(F.max(facts).alias("_end"), F.min("observed_at").alias("_from"), F.max("observed_at").alias("_to"))
            old = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.struct(*state.columns).alias("_old"))
            on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(self.keys)]
            j = ends.join(old, on, "full_outer")
            value = lambda c: F.when(F.col("_end").isNotNull(), F.col(f"_end.{c}")).otherwise(F.col(f"_old.{c}"))
            out = j.select(
                *[F.coalesce(k, F.col(f"_k{i}")).alias(k) for i, k in enumerate(self.keys)],
                *[value(c).alias(c) for c in ("content_hash", "media_hash", *self.payload)],
                F.least("_from", "_old.first_seen").alias("first_seen"), F.greatest("_to", "_old.last_seen").alias("last_seen"), value("version").alias("version"),
            )
            out = out.select(*[F.col(f.name).cast(f.dataType) for f in schema]).withColumn("bucket", self._bucket())
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/items/gen={generation}")
        lines = [(generation, self.writer, batch, k) for k in sorted(touched & self._written(generation))] or [(generation, self.writer, batch, None)]
        self.spark.createDataFrame(lines, "generation long, writer string, batch long, bucket int").coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return True

    def _written(self, generation: int) -> set[int]:
        """Buckets that have rows; one that only errors fell into has none."""
        try:
            found = self.spark.read.option("basePath", f"{self.root}/items/gen={generation}").parquet(f"{self.root}/items/gen={generation}")
        except AnalysisException:
            return set()
        return {r["bucket"] for r in found.select("bucket").distinct().collect()} if "bucket" in found.columns else set()

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merges the batches of a stream until what is there now is done; a restart goes on where the checkpoint ends."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: self.merge(rows, batch) and None).trigger(availableNow=True).start()
