"""Canonical values applied in batches, each group once, with an append-only log that reruns and crashes cannot double."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import canonical_values

_PART = "pool string, group_key string, value string, canonical string, kind string, batch int"


def group_keys(groups: DataFrame, group: str, value: str) -> DataFrame:
    """(group, group_key, n): the key depends on a group's distinct values only, not on their order or repeats.

    Two sums of hashes and the number of values stand for the sorted values, so that no group is gathered in one task. Null groups and
    values are left out.
    """
    own = groups.select(group, F.col(value).cast("string").alias("v")).where(F.col(group).isNotNull() & F.col("v").isNotNull()).distinct()
    total = lambda salt: F.sum(F.xxhash64("v", F.lit(salt)).cast("decimal(38,0)")).cast("string")
    return own.groupBy(group).agg(F.count("*").alias("n"), F.md5(F.concat_ws(":", F.count("*").cast("string"), total(1), total(2)).cast("binary")).alias("group_key"))


class CanonicalLog:
    """Groups of values that were made one, as a folder of parts and a folder of commits.

    A batch is a part (its groups, and the values whose canonical value it changes) and becomes visible by one file in `commits`, named by its
    number and put there by a rename that fails if the number is taken; a batch that loses that race starts anew from the new
    state. A part without a commit (a crash before it) is never read. No data is rewritten: `apply` joins rows with the values in force.
    The file system must refuse a rename onto an existing file, as HDFS does; plain object stores do not.
    """

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.home, *parts)))

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def commits(self) -> list[str]:
        """Names of the committed parts, oldest first: one short name a batch."""
        folder = self._path("commits")
        files = folder.getFileSystem(self._conf())
        if not files.exists(folder):
            return []
        names = sorted(n for n in (s.getPath().getName() for s in files.listStatus(folder)) if n.isdigit())
        rows = self.spark.read.text([f"{self.home}/commits/{n}" for n in names]).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("n"), "value").collect() if names else []
        return [r.value for r in sorted(rows, key=lambda r: r.n)]

    def _commit(self, number: int, part: str) -> bool:
        """Whether the batch got its number."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        own, target = self._path("commits", f".{uuid.uuid4().hex}"), self._path("commits", f"{number:012d}")
        files = own.getFileSystem(self._conf())
        stream = files.create(own, False)
        stream.write(part.encode())
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf()).rename(files.makeQualified(own), files.makeQualified(target), how)
        except Exception as e:
            files.delete(own, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _rows(self, commits: list[str]) -> DataFrame:
        """The rows of all committed parts, in one scan."""
        return self.spark.read.schema(_PART).parquet(*[f"{self.home}/parts/{p}" for p in commits]) if commits else self.spark.createDataFrame([], _PART)

    def reviewed(self) -> DataFrame:
        """(pool, group_key, canonical, batch) of every group that was applied, batches from 1."""
        return self._rows(self.commits()).where("kind = 'group'").select("pool", "group_key", "canonical", "batch")

    def values(self, commits: list[str] | None = None) -> DataFrame:
        """(value, canonical, pool) in force: a value's last change counts."""
        rows = self._rows(self.commits() if commits is None else commits).where("kind = 'value'")
        return rows.groupBy("value").agg(F.max_by(F.struct("canonical", "pool"), "batch").alias("x")).select("value", "x.canonical", "x.pool")

    def bulk_apply(self, groups: DataFrame, group: str, value: str, order: str, pool: str, before_commit=None) -> int:
        """Applies the groups (group, value, order) of a pool that no batch has applied; gives the number of new groups.

        A group's canonical value is its longest, of equally long ones that with the smallest order. Groups with the same values count once.
        A value of several new groups follows the smallest group. Batches follow each other: a value that an earlier
        one has replaced is gone, so it moves only with its replacement. before_commit runs between a part's write and its commit.
        """
        while True:
            commits = self.commits()
            done = self._rows(commits).where(F.col("kind") == "group").where(F.col("pool") == pool).select("group_key").distinct()
            keys = group_keys(groups, group, value)
            named = keys.groupBy("group_key").agg(F.min(group).alias(group)).join(done, "group_key", "left_anti")
            own = groups.where(F.col(value).isNotNull()).select(group, F.col(value).cast("string").alias("value"), F.col(order).alias("_order")).join(named, group)
            chosen = canonical_values(own, "group_key", "value", "_order")
            fresh = own.select("group_key", group, "value").distinct().join(chosen, "group_key").groupBy("value").agg(F.min_by("canonical", group).alias("new"), F.min_by("group_key", group).alias("group_key"))
            old = self.values(commits).select("value", F.col("canonical").alias("was"))
            # Replaced values move with their replacements; values that were never replaced take their group's.
            moved = old.join(fresh.select(F.col("value").alias("was"), "new", "group_key"), "was").where("new != was").select("group_key", "value", "new")
            first = fresh.join(old, "value", "left_anti").select("group_key", "value", "new")
            rows = first.unionByName(moved).select(F.lit(pool).alias("pool"), "group_key", "value", F.col("new").alias("canonical"), F.lit("value").alias("kind"))
            log = chosen.select(F.lit(pool).alias("pool"), "group_key", F.lit(None).cast("string").alias("value"), "canonical", F.lit("group").alias("kind"))
            part = f"{len(commits) + 1:012d}-{uuid.uuid4().hex}"
            log.unionByName(rows).withColumn("batch", F.lit(len(commits) + 1)).write.parquet(f"{self.home}/parts/{part}")
            added = self.spark.read.schema(_PART).parquet(f"{self.home}/parts/{part}").where("kind = 'group'").count()
            if before_commit:
                before_commit()
            if not added or self._commit(len(commits) + 1, part):
                return added

    def apply(self, df: DataFrame, columns: list[str], tag: str = "pool") -> DataFrame:
        """Rows with the values in force in the columns, and in tag the pool of the first of them that has one (null: none)."""
        values = self.values()
        pools = []
        for i, c in enumerate(columns):
            m = values.select(F.col("value").alias(c), F.col("canonical").alias("_canonical"), F.col("pool").alias(f"_pool{i}"))
            df = df.join(m, c, "left").withColumn(c, F.coalesce("_canonical", c)).drop("_canonical")
            pools.append(f"_pool{i}")
        return df.withColumn(tag, F.coalesce(*pools)).drop(*pools)
