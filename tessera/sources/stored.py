"""Tables kept as files: upserts that rewrite only touched buckets, key-ordered pages, rollups that take each batch once.

Paths may be on any store that Spark writes to. A table has one writer at a time. A write that is cut off is repeated as it was:
upserts and merges give the same table however often they run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relations import partial_update, upsert


class KeyedTable:
    """Rows by key in `buckets` folders, by a hash of the key.

    An upsert reads and rewrites the buckets its keys fall in; files of the others are not touched. Choose so many buckets that one
    fits a few tasks' memory: the table's bytes by 256 MB."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.repartition("_bucket").write.mode(mode).partitionBy("_bucket")
        (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(self._bucketed(rows), "errorifexists")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("_bucket")

    def _touched(self, batch: DataFrame) -> tuple[DataFrame, list[int]]:
        """The stored rows of the batch's buckets; their numbers, at most `buckets`, are what prunes the folders."""
        numbers = [r[0] for r in self._bucketed(batch).select("_bucket").distinct().collect()]
        return self.spark.read.parquet(self.path).filter(F.col("_bucket").isin(numbers) if numbers else F.lit(False)).drop("_bucket"), numbers

    def _last(self, batch: DataFrame, order: str | None) -> DataFrame:
        if order is None:
            return batch
        rest = [c for c in batch.columns if c not in (*self.keys, order)]
        return batch.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in rest])

    def upsert(self, batch: DataFrame, keep: list[str] | None = None, order: str | None = None) -> None:
        """U4: new keys are added, of known ones all but `keep` replaced. Of rows with one key the last by `order` counts; without it keys are unique."""
        batch = self._last(batch, order)
        old, numbers = self._touched(batch)
        if numbers:
            self._write(self._bucketed(upsert(old, batch, self.keys, keep or [])), "overwrite")

    def update(self, changes: DataFrame, order: str | None = None) -> None:
        """Supplied values of known keys replace, null ones don't; unknown keys are ignored."""
        changes = self._last(changes, order)
        old, numbers = self._touched(changes)
        if numbers:
            self._write(self._bucketed(partial_update(old, changes, self.keys)), "overwrite")


#: Rows of a folder of a sorted table, unless one part has more.
FOLDER_ROWS = 100_000


class SortedTable:
    """Rows in order of a unique key, in parts, with a fence (least and largest key, rows, folder) of each.

    Parts that follow each other share a folder, in key order, so what the driver lists doesn't grow as parts get smaller."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def create(self, rows: DataFrame, part_rows: int = 100_000) -> None:
        folders = max(1, -(-rows.count() // max(part_rows, FOLDER_ROWS)))
        ranged = rows.repartitionByRange(folders, self.key).sortWithinPartitions(self.key)
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in its partition
        parts = ranged.withColumn("_folder", F.spark_partition_id()).withColumn("_part", F.floor(place / part_rows).cast("int"))
        parts.sortWithinPartitions("_folder", self.key).write.partitionBy("_folder").parquet(f"{self.path}/rows")
        fences = self.spark.read.parquet(f"{self.path}/rows").groupBy("_folder", "_part").agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("n"))
        fences.write.parquet(f"{self.path}/fences")

    def page(self, after: int | str | None, limit: int) -> DataFrame:
        """The first `limit` rows with a larger key, in order. Only the stretch of parts is read that can hold them: by the fences, of
        which a page needs at most limit + 1 as none is empty."""
        fences = self.spark.read.parquet(f"{self.path}/fences")
        ahead = (fences if after is None else fences.filter(F.col("high") > F.lit(after))).orderBy("low").limit(limit + 1).collect()
        wanted, sure = [], 0
        for i, f in enumerate(ahead):
            if sure >= limit:
                break
            wanted.append(f)
            sure += f["n"] if i or after is None or f["low"] > after else 0
        key = F.col(self.key)
        held = F.col("_folder").isin(sorted({f["_folder"] for f in wanted})) & (key <= F.lit(wanted[-1]["high"])) if wanted else F.lit(False)
        rows = self.spark.read.parquet(f"{self.path}/rows").filter(held).drop("_folder", "_part")
        return (rows if after is None else rows.filter(key > F.lit(after))).orderBy(key).limit(limit)


class RollupStore:
    """A4, A5: sums by keys in hours, days and all time, kept as mergeable states; each batch counts once, by its id.

    A batch is reduced to its states, a row per key and bucket, in a folder of its own id: a replay writes the same folder
    again. compact() sums all states to a new base that also names the batches it holds, and replays of these are ignored. Readers
    take the newest whole base and the batches that it lacks."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: dict[str, Column], at: str = "ts") -> None:
        self.spark, self.path, self.keys, self.sums, self.at = spark, path.rstrip("/"), keys, sums, at

    def _folders(self, kind: str) -> list[str]:
        """Whole folders of a kind, by name."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = files.listStatus(root) if files.exists(root) else []
        whole = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(s.getPath().getName() for s in found if files.exists(whole(s.getPath(), "_SUCCESS")))

    def _base(self) -> str | None:
        return max(self._folders("held"), default=None)

    def _held(self) -> set[str]:
        base = self._base()
        return {r[0] for r in self.spark.read.parquet(f"{self.path}/held/{base}").collect()} if base else set()  # ids since the store began, a row a batch

    def merge(self, batch: DataFrame, batch_id: str | int) -> None:
        """Count a batch, unless it is counted already; for foreachBatch."""
        name = f"batch-{batch_id}"
        if name in self._held():
            return
        ends = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.date_trunc(k, self.at).alias("bucket")) for k in ("hour", "day")], F.struct(F.lit("all").alias("kind"), F.lit(None).cast(batch.schema[self.at].dataType).alias("bucket"))))
        states = batch.withColumn("_b", ends).groupBy(*self.keys, F.col("_b.kind").alias("kind"), F.col("_b.bucket").alias("bucket")).agg(*[c.alias(n) for n, c in self.sums.items()])
        states.write.mode("overwrite").parquet(f"{self.path}/states/{name}")

    def _states(self) -> tuple[DataFrame | None, list[str]]:
        base, held = self._base(), self._held()
        fresh = [f for f in self._folders("states") if f not in held]
        paths = [f"{self.path}/states/{f}" for f in fresh] + ([f"{self.path}/sums/{base}"] if base else [])
        return (self.spark.read.parquet(*paths) if paths else None), fresh

    def totals(self, kind: str) -> DataFrame:
        """The sums of kind hour, day or all."""
        states, _ = self._states()
        if states is None:
            raise ValueError("no batch was merged")
        return states.filter(F.col("kind") == kind).groupBy(*self.keys, "bucket").agg(*[F.sum(n).alias(n) for n in self.sums])

    def compact(self) -> None:
        """One table of sums instead of one a batch. The list of held batches is written last: until then readers use the old base."""
        states, fresh = self._states()
        if not fresh:
            return
        base = f"base-{int((self._base() or 'base-0').split('-')[1]) + 1:08d}"
        states.groupBy(*self.keys, "kind", "bucket").agg(*[F.sum(n).alias(n) for n in self.sums]).write.mode("overwrite").parquet(f"{self.path}/sums/{base}")
        held = sorted(self._held() | set(fresh))
        self.spark.createDataFrame([(h,) for h in held], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/held/{base}")
