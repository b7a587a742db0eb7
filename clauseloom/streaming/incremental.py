"""State that grows run by run: change detection, crawl frontier, decision queue. Batch forms, and streams over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def changes(now: DataFrame, state: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, hash, change) of NEW, CHANGED and GONE rows against saved hashes (key, hash)."""
    h = now.select(key, F.sha2(F.col(content).cast("string"), 256).alias("hash"))
    j = h.join(state.select(key, F.col("hash").alias("_old")), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "NEW").when(F.col("hash").isNull(), "GONE").when(F.col("hash") != F.col("_old"), "CHANGED")
    return j.select(key, "hash", change.alias("change")).where("change is not null")


def next_batch(frontier: DataFrame, n: int) -> DataFrame:
    """The n addresses to fetch next: priority falling, discovery rising. A limit is the feature here."""
    return frontier.where("status = 'pending'").orderBy(F.desc("priority"), "discovered", "url").limit(n)


def mark(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """Fetched addresses are done; failed ones lose one priority."""
    j = frontier.join(results.select("url", F.col("ok").alias("_ok")), "url", "left")
    status = F.when(F.col("_ok"), "done").otherwise(F.col("status"))
    return j.select(*[{"status": status, "priority": F.when(~F.col("_ok"), F.col("priority") - 1).otherwise(F.col("priority"))}.get(c, F.col(c)).alias(c) for c in frontier.columns])


def discovered_links(pages: DataFrame, frontier: DataFrame, most: int = 20) -> DataFrame:
    """Up to most government links a page that the frontier lacks, each once."""
    found = pages.select(F.explode(F.slice(F.filter(X.links(F.col("html")), lambda u: u.rlike("^https?://[^/]*\\.gov(/|$)")), 1, most)).alias("url")).distinct()
    return found.join(frontier, "url", "left_anti")


def merge_queue(candidates: DataFrame, queue: DataFrame) -> DataFrame:
    """Candidates with the decisions made on them, new ones to be reviewed, and decisions whose candidate is gone."""
    q = queue.select("match_id", X.decision(F.col("decision")).alias("decision"), "notes")
    now = candidates.join(q, "match_id", "left").withColumn("decision", F.coalesce("decision", F.lit("Needs Review")))
    past = q.join(candidates, "match_id", "left_anti")
    return now.unionByName(past, allowMissingColumns=True)


def apply_decisions(raw: DataFrame, curated: DataFrame, queue: DataFrame) -> DataFrame:
    """Rejected rows go, accepted raw rows come in, the best row of each match id stays."""
    q = queue.select("match_id", X.decision(F.col("decision")).alias("_d"))
    rejected, accepted = q.where("_d = 'Reject'"), q.where("_d = 'Accept'")
    both = curated.join(rejected, "match_id", "left_anti").unionByName(raw.join(accepted, "match_id", "left_semi"))
    rank = F.row_number().over(W.partitionBy("match_id").orderBy(F.desc("score")))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r")


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Each piece of work once, without what is done."""
    return work.dropDuplicates([key]).join(done, key, "left_anti")


def when_valid(issues: DataFrame, write: Callable[[], None]) -> bool:
    """Writes only if there are no issues."""
    if issues.isEmpty():
        write()
        return True
    return False


def change_stream(source: DataFrame, state_path: str, checkpoint: str, act: Callable[[DataFrame], None], key: str = "path", content: str = "content", order: str | None = None):
    """T01 as a stream: each micro-batch is held against the hash table at state_path, acted on and added to it.

    Of several rows of a key in a batch the last by order counts (by content where there is none). The table has a folder for each batch, which
    a batch that is run again replaces, and no batch reads its own or later ones, so a repeat acts on the same rows.
    """
    spark = source.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(content, order or content).alias(content))
        try:
            old = spark.read.parquet(state_path).where(F.col("epoch") < epoch).groupBy(key).agg(F.max_by("hash", "epoch").alias("hash"))
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = spark.createDataFrame([], f"{key} string, hash string")
        found = changes(latest, old, key, content).where("change != 'GONE'").persist()
        act(found)
        found.select(key, "hash").write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")
        found.unpersist()

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Event-time counts with a watermark; an extension beyond the batch operators."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
