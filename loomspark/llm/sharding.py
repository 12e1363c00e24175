"""Size-tiered compaction of immutable shards under a versioned manifest, with DataFrames only.

Arrivals are appended as small shards and never changed. Compaction sorts all shards below the target
size into size tiers (powers of ``FANOUT``), orders each tier by arrival and closes an output shard
whenever the running size passes the target; a tier with a single shard is left alone. A merged shard
that is still below the target stands in the tier of its own size and is merged again with others like
it. All merges of one compaction are one Spark job. A version is a manifest table plus a commit file
that is renamed into its place without replacing, so of two writers one fails, a writer that dies stops no other, and
readers see the old set of shards or the new one and never a mixture.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import new_path

FANOUT, TIERS = 4, 16
BASE_BYTES = 1 << 20
TARGET_BYTES = 32 << 20
ARRIVAL_ROWS = 512

#: One row for each shard: its folder (run and number), first arrival, size and tier; of a merged one, the tier it was merged in and its number there (-1: as it arrived).
MANIFEST = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("shard", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("from_tier", T.IntegerType()),
        T.StructField("file_no", T.LongType()),
    ]
)
#: Stored columns carry this prefix, so that no name of theirs meets one of the store's own.
OWN = "c_"


def tier_of(n_bytes: Column) -> Column:
    """0 below ``BASE_BYTES``, then one more for each factor ``FANOUT``."""
    return F.aggregate(F.array(*[F.lit(BASE_BYTES * FANOUT**i) for i in range(TIERS)]), F.lit(0), lambda n, edge: n + (n_bytes >= edge).cast("int"))


@dataclass
class ShardStore:
    """A store of shards at ``root``, a folder that all executors share."""

    spark: SparkSession
    root: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The newest committed version, 0 if there is none; a commit that is not written yet does not count."""
        fs, path = self._fs()
        folder = path(f"{self.root}/commits")
        names = [f.getPath().getName() for f in fs.listStatus(folder) if f.getLen() > 0] if fs.exists(folder) else []
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def commit(self, manifest: DataFrame, version: int) -> None:
        """Publish ``manifest`` as ``version``; raises if somebody has committed that version.

        The commit is a finished draft that is renamed to the version's name without replacing, which the file system grants
        to one writer only. A writer that dies before leaves a draft, which nobody looks at, and stops no other.
        """
        fs, path = self._fs()
        name = f"{self.root}/manifests/m-{uuid.uuid4().hex}"
        manifest.select(*MANIFEST.names).write.parquet(name)
        draft = path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.writeUTF(name)
        out.close()
        fs.mkdirs(path(f"{self.root}/commits"))
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        files = hadoop.FileContext.getFileContext(path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(draft, path(f"{self.root}/commits/v{version}"), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise RuntimeError(f"version {version} is committed already") from e

    def manifest(self, version: int | None = None) -> DataFrame:
        fs, path = self._fs()
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        data = fs.open(path(f"{self.root}/commits/v{version}"))
        name = data.readUTF()
        data.close()
        return self.spark.read.schema(MANIFEST).parquet(name)

    def append(self, rows: DataFrame, arrival: Column) -> int:
        """Write each ``arrival`` of ``rows`` as a shard of its own and commit; returns the version.

        ``rows`` are expected in the order they arrived, so a task writes few arrivals.
        """
        version = self.version()
        run = f"runs/a-{uuid.uuid4().hex}"
        stored = rows.select(*[F.col(f"`{c}`").alias(f"{OWN}{c}") for c in rows.columns], arrival.cast("long").alias("_arrival"), arrival.cast("long").alias("_shard"))
        stored.write.option("compression", "zstd").partitionBy("_shard").parquet(f"{self.root}/{run}")
        size = F.sum(F.coalesce(F.octet_length(f"{OWN}text"), F.lit(0)).cast("long")) if "text" in rows.columns else F.lit(0).cast("long")
        new = self.spark.read.parquet(f"{self.root}/{run}").groupBy(F.col("_shard").cast("long").alias("shard")).agg(F.count("*").alias("n_rows"), size.alias("n_bytes"))
        new = new.select(F.lit(run).alias("run"), "shard", F.col("shard").alias("first"), "n_rows", "n_bytes", tier_of(F.col("n_bytes")).alias("tier"), F.lit(None).cast("int").alias("from_tier"), F.lit(-1).cast("long").alias("file_no"))
        self.commit(self.manifest(version).unionByName(new), version + 1)
        return version + 1

    def compact(self, target_bytes: int = TARGET_BYTES) -> int:
        """Merge the shards of each tier, merged ones included, into shards of about ``target_bytes``; returns the version."""
        version = self.version()
        old = self.manifest(version)
        in_tier = Window.partitionBy("tier").orderBy("first", "run", "shard")  # one row a shard
        before = F.coalesce(F.sum("n_bytes").over(in_tier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        tiers = old.where(F.col("n_bytes") < target_bytes).withColumn("file_no", F.floor(before / target_bytes).cast("long"))
        size = F.count("*").over(Window.partitionBy("tier", "file_no"))
        planned = tiers.withColumn("shards", size).where("shards > 1").withColumn("new", F.col("tier").cast("long") * (1 << 40) + F.col("file_no"))
        runs = [r[0] for r in planned.select("run").distinct().collect()]  # one name for each append or compaction
        if not runs:
            return version
        run = f"runs/c-{uuid.uuid4().hex}"
        plan = planned.select(F.col("run").alias("_run"), F.col("shard").alias("_old"), F.col("new").alias("_shard"))
        rows = self._rows(runs).withColumnRenamed("_shard", "_old").join(self._small(plan), ["_run", "_old"]).drop("_run", "_old")
        files = planned.select("new").distinct().count()
        rows.repartition(max(1, files), "_shard").write.option("compression", "zstd").partitionBy("_shard").parquet(f"{self.root}/{run}")
        merged = planned.groupBy("new", "tier", "file_no").agg(F.min("first").alias("first"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        merged = merged.select(F.lit(run).alias("run"), F.col("new").alias("shard"), "first", "n_rows", "n_bytes", tier_of(F.col("n_bytes")).alias("tier"), F.col("tier").alias("from_tier"), "file_no")
        self.commit(old.join(planned.select("run", "shard"), ["run", "shard"], "left_anti").unionByName(merged), version + 1)
        return version + 1

    def _rows(self, runs: list[str]) -> DataFrame:
        out = None
        for r in runs:
            part = self.spark.read.parquet(f"{self.root}/{r}").withColumns({"_shard": F.col("_shard").cast("long"), "_run": F.lit(r)})
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _small(self, frame: DataFrame, most: int = 200_000) -> DataFrame:
        """``frame`` for a broadcast join if it has at most ``most`` rows, else as it is."""
        return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame

    def stored(self, version: int | None = None) -> DataFrame:
        """The rows of a version under their stored names, with _arrival, _run and _shard."""
        manifest = self.manifest(version)
        runs = [x[0] for x in manifest.select("run").distinct().collect()]
        if not runs:
            raise ValueError("the store has no version yet")
        keep = manifest.select(F.col("run").alias("_run"), F.col("shard").alias("_shard"))
        return self._rows(runs).join(self._small(keep), ["_run", "_shard"], "left_semi")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version as they were appended."""
        rows = self.stored(version)
        return rows.select(*[F.col(f"`{c}`").alias(c.removeprefix(OWN)) for c in rows.columns if c.startswith(OWN)])


def compacted_documents(docs: DataFrame, arrival_rows: int = ARRIVAL_ROWS, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Append ``docs`` as arrivals of ``arrival_rows`` consecutive ids, compact, and read the new version.

    One row per row of ``docs``: doc_id, n_bytes (null text: 0), arrival, tier and file_no of the
    arrival (-1: it stays a shard of its own). A null doc_id arrives with the ids below
    ``arrival_rows``. Repeated rows stay, an empty table gives no rows; texts of any length and all
    columns of the documents are stored, whatever their names.
    """
    spark = docs.sparkSession
    if docs.isEmpty():
        zero = lambda c: F.lit(0).cast("long").alias(c)
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), zero("n_bytes"), zero("arrival"), zero("tier"), zero("file_no"))
    store = ShardStore(spark, new_path(spark, "shards"))
    store.append(docs, F.floor(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) / arrival_rows))
    version = store.compact(target_bytes)
    placed = store.manifest(version).select(F.col("run").alias("_run"), F.col("shard").alias("_shard"), F.coalesce("from_tier", "tier").cast("long").alias("_tier"), F.col("file_no").alias("_file"))
    out = store.stored(version).join(store._small(placed), ["_run", "_shard"])
    size = F.coalesce(F.octet_length(f"{OWN}text"), F.lit(0)).cast("long")
    return out.select(F.col(f"{OWN}doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), F.col("_arrival").alias("arrival"), F.col("_tier").alias("tier"), F.col("_file").alias("file_no"))


def oracle() -> str:
    """The plan in DuckDB SQL; reading the store back must give every row where the plan puts it."""
    edges = " + ".join(f"(b >= {BASE_BYTES * FANOUT**i})::INT" for i in range(TIERS))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, coalesce(doc_id, 0) // {ARRIVAL_ROWS} AS arrival FROM documents),
sizes AS (SELECT arrival, sum(n_bytes)::BIGINT AS b FROM docs GROUP BY 1),
tiers AS (SELECT arrival, b, {edges} AS tier FROM sizes),
files AS (SELECT arrival, tier, coalesce(sum(b) OVER (PARTITION BY tier ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {TARGET_BYTES} AS f FROM tiers WHERE b < {TARGET_BYTES}),
shared AS (SELECT arrival, f FROM files QUALIFY count(*) OVER (PARTITION BY tier, f) > 1)
SELECT doc_id, n_bytes, arrival::BIGINT AS arrival, tier::BIGINT AS tier, coalesce(f, -1)::BIGINT AS file_no
FROM docs JOIN tiers USING (arrival) LEFT JOIN shared USING (arrival)"""
