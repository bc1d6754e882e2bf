"""Changes to tables as new tables (upsert, merge, delete, cascade), and sinks that add rows to stored ones."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new: on equal keys new's values win where they are not null."""
    values = [c for c in old.columns if c not in keys]
    x, y = old.alias("x"), new.alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    return x.join(y, on, "full_outer").select(*[F.coalesce(f"y.{k}", f"x.{k}").alias(k) for k in keys], *[F.coalesce(f"y.{v}", f"x.{v}").alias(v) for v in values])


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the greatest version of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__v")).select(*keys, "__v.*")


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone, keys, "left_anti")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) left when the nodes in gone (node_id) go: their edges go first."""
    kept = edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), kept.select(*edges.columns)


def prefetch(main: DataFrame, more: DataFrame, key: str, out: str = "related") -> DataFrame:
    """main with an array of the rows of more that have its key, in a fixed order; empty where there are none."""
    packed = more.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in more.columns if c != key]))).alias(out))
    return main.join(packed, key, "left").withColumn(out, F.coalesce(out, F.array()))


class Table:
    """A stored table of Parquet batches: each insert is a folder ``batch=<id>`` that appears by one rename, so readers see
    all of its rows or none, and a job that dies halfway leaves only a folder under ``_staging``, which nothing reads.

    A batch looks for its keys before it is committed, and after that in the batches that have come in the meantime; if one
    of these has a key of its own, it is withdrawn. Of two writers of one key at once, one or both are refused, never none."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", required: tuple[str, ...] = ()):
        """key: the column that tells rows apart; required: columns that may not be null, besides the key."""
        self.spark, self.path, self.schema, self.key, self.required = spark, path.rstrip("/"), schema, key, (key, *required)

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> set[str]:
        """Folders of committed batches."""
        fs, path = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path
        return {str(f.getPath()) for f in fs.globStatus(path(f"{self.path}/batch=*"))} if fs.exists(path(self.path)) else set()

    def read(self, batches: set[str] | None = None) -> DataFrame:
        """All committed rows, or those of some batches."""
        found = sorted(self.batches() if batches is None else batches)
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(empty.schema).option("recursiveFileLookup", True).parquet(*found) if found else empty

    def faults(self, rows: DataFrame) -> DataFrame:
        """rows with fault: a required column that is null, a key that stands twice among them, or one that is stored already; null where there is none."""
        stored = self.read().select(F.col(self.key).alias("__k")).distinct().withColumn("__stored", F.lit(True))
        twice = rows.groupBy(F.col(self.key).alias("__k")).agg((F.count("*") > 1).alias("__twice"))
        x = rows.join(stored, F.col(self.key) == F.col("__k"), "left").drop("__k").join(twice, F.col(self.key) == F.col("__k"), "left").drop("__k")
        why = None
        for c in self.required:
            why = (F.when if why is None else why.when)(F.col(c).isNull(), F.lit(f"{c} is null"))
        return x.withColumn("fault", why.when(F.col("__twice"), "key stands twice").when(F.col("__stored"), "key is stored")).drop("__stored", "__twice")

    def _commit(self, rows: DataFrame, seen: set[str]) -> DataFrame:
        """seen: the batches in which the rows' keys were looked for."""
        batch = uuid.uuid4().hex
        staged, final = f"{self.path}/_staging/{batch}", f"{self.path}/batch={batch}"
        rows.write.parquet(staged)
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path, self._files()
        if not fs.rename(path(staged), path(final)):
            raise OSError(f"batch {batch} was not committed")
        since = {b for b in self.batches() - seen if not b.endswith(f"batch={batch}")}
        if since and not self.spark.read.schema(rows.schema).parquet(final).join(self.read(since).select(self.key), self.key, "left_semi").isEmpty():
            fs.delete(path(final), True)
            raise ValueError("key is stored")
        return self.spark.read.schema(rows.schema).parquet(final)

    def insert(self, rows: DataFrame) -> DataFrame:
        """The rows as they are stored now; a row without a key gets one (a UUID) if the key is a string. Any fault refuses all of them."""
        columns = self.spark.createDataFrame([], self.schema).columns
        if self.key not in rows.columns:
            rows = rows.withColumn(self.key, F.expr("uuid()"))
        rows, seen = rows.select(*columns), self.batches()
        bad = self.faults(rows).where("fault is not null").select("fault").limit(1).collect()
        if bad:
            raise ValueError(bad[0]["fault"])
        return self._commit(rows, seen)

    def insert_all(self, rows: DataFrame, one_by_one: bool = False) -> tuple[DataFrame, DataFrame]:
        """(stored, refused with fault): a batch goes in as a whole or, on any fault, not at all; one_by_one then takes the rows without a fault, of a key that stands twice none."""
        columns = self.spark.createDataFrame([], self.schema).columns
        seen = self.batches()
        told = self.faults(rows.select(*columns))
        bad = told.where("fault is not null")
        if bad.isEmpty():
            return self._commit(rows.select(*columns), seen), bad
        good = told.where("fault is null").select(*columns)
        if one_by_one and not good.isEmpty():
            refused = cut(bad)  # found against the table as it was
            return self._commit(good, seen), refused
        return self.spark.createDataFrame([], self.schema), bad
