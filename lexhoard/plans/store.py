"""A stored table that batches change in part: rows lie in folders by the hash of their key, and only folders with changes are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.functions.ids import content_fingerprint
from lexhoard.session import _hadoop_path, discard, saved


class HashedTable:
    """Parquet below `path`, one row per value of `key`, in `buckets` folders named by the key's hash.

    A batch with a number is taken once: the ledger, a folder of empty files beside the rows, is written last, so a batch that fails
    half-way runs again and gives the same rows. Batches must not run at the same time. `buckets` can't change later; choose
    it so that a bucket's rows are one task's work.
    """

    def __init__(self, path: str, key: str = "id", buckets: int = 64):
        self.path, self.key, self.buckets = path.rstrip("/"), key, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The rows; None if there are none yet."""
        stored = self._stored(spark)
        return None if stored is None else stored.drop("bucket")

    def _stored(self, spark: SparkSession) -> DataFrame | None:
        at, files = _hadoop_path(spark, f"{self.path}/rows/bucket=*")
        return spark.read.parquet(f"{self.path}/rows") if len(files.globStatus(at) or []) else None

    def done(self, spark: SparkSession, number: int) -> bool:
        at, files = _hadoop_path(spark, f"{self.path}/ledger/{number}")
        return files.exists(at)

    def apply(self, changes: DataFrame, number: int, removed: DataFrame | None = None, order: str | None = None) -> bool:
        """Puts rows in the place of those with their keys, and takes out the keys of `removed` that aren't among them. With `order`,
        only the newest row of each key counts, and only if the stored one isn't newer. Rows that equal the stored ones change
        nothing. False if the batch was taken before."""
        spark = changes.sparkSession
        if self.done(spark, number):
            return False
        columns, key = changes.columns, self.key
        if order:
            text = F.to_json(F.struct(*columns))
            changes = changes.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, text)).alias("r")).select("r.*")
        stored, fresh = self._stored(spark), changes.withColumn("bucket", self._bucket())
        gone = removed.select(key).distinct().join(changes.select(key), key, "left_anti").withColumn("bucket", self._bucket()) if removed is not None else None
        if stored is None:
            new, touched = saved(fresh), None
        else:
            old = stored.select(F.col(key).alias("_key"), F.col("bucket").alias("_bucket"), content_fingerprint(stored.select(columns), []).alias("_print"), *([F.col(order).alias("_order")] if order else []))
            same = (F.col(key) == F.col("_key")) & (F.col("bucket") == F.col("_bucket"))
            met = (F.col("_new") == F.col("_print")) | ((F.col("_order") > F.col(order)) if order else F.lit(False))
            fresh = saved(fresh.withColumn("_new", content_fingerprint(changes, [])).join(old, same & met, "left_anti").drop("_new"))
            out = fresh.select(key, "bucket") if gone is None else fresh.select(key, "bucket").unionByName(saved(gone.join(stored.select(key), key, "left_semi")))
            touched = [r["bucket"] for r in out.select("bucket").distinct().collect()]  # at most `buckets`
            kept = stored.where(F.col("bucket").isin(touched)).join(out.select(key), key, "left_anti")
            new = saved(kept.select(*columns, "bucket").unionByName(fresh.select(*columns, "bucket")))
            discard(fresh)
        if touched is None or touched:
            new.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/rows")
        if touched:
            left = {r["bucket"] for r in new.select("bucket").distinct().collect()}
            for b in set(touched) - left:
                at, files = _hadoop_path(spark, f"{self.path}/rows/bucket={b}")
                files.delete(at, True)
        discard(new)
        at, files = _hadoop_path(spark, f"{self.path}/ledger/{number}")
        files.create(at).close()
        return True


def union_of(*parts: DataFrame | None) -> DataFrame:
    """The rows of those that are there; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p for p in parts if p is not None])
