"""Streaming forms of the append-only logs. Each takes a streaming DataFrame and returns one, or runs it over the input that is there.

State is kept where a batch can replace it by number: running sums and counts in keyed snapshots, of which a batch rewrites the buckets that it touches; open
windows in a table of their own. A batch that is run again after a failure starts from the version before, and readers only see committed ones.

Late data: activity_stream closes windows by a watermark; events of windows that are closed already go to a side table and change nothing. The
other states are kept by key (a target, a document, a run), which grow with the keys and not with the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.rollups import VOTE_WEIGHTS, consensus
from ..operators.tagging import shared_table
from ..sources.snapshots import BUCKETS, Snapshot


def read_event_log(spark, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """An append-only log as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def drain(stream: DataFrame, checkpoint: str, write) -> None:
    """write(batch, number) for each batch of the input that is there."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


VOTE_SUMS = "dimension string, target_id long, value string, weight long, n long, latest timestamp, dissent long"


def vote_sums(votes: DataFrame, weights: dict[str, int] = VOTE_WEIGHTS) -> DataFrame:
    """K1, first step: sums for each target and value, from which the winner follows."""
    weight = F.coalesce(*[F.when(F.col("source") == s, F.lit(w)) for s, w in weights.items()], F.lit(1))
    v = votes.where(F.col("action").isin("tag", "dissent") & F.col("value").isNotNull())
    tag = F.col("action") == "tag"
    return v.groupBy("dimension", "target_id", "value").agg(F.sum(F.when(tag, weight).otherwise(0)).alias("weight"), F.count_if(tag).alias("n"), F.max(F.when(tag, F.col("ts"))).alias("latest"), F.count_if(~tag).alias("dissent"))


def add_votes(rows: DataFrame, more: DataFrame) -> DataFrame:
    both = rows.unionByName(more.select(*rows.columns))
    return both.groupBy("dimension", "target_id", "value").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.max("latest").alias("latest"), F.sum("dissent").alias("dissent"))


def consensus_stream(votes: DataFrame, path: str, buckets: int = BUCKETS) -> Snapshot:
    """K1: running sums of votes as a snapshot by target; a batch rewrites the buckets of its targets. winners(snapshot.read()) is the consensus."""
    spark = votes.sparkSession
    state = Snapshot(spark, f"{path}/sums", VOTE_SUMS, ["dimension", "target_id"], buckets)
    drain(votes, f"{path}/checkpoint", lambda batch, number: state.update(vote_sums(batch), add_votes, number))
    return state


def winners(sums: DataFrame) -> DataFrame:
    """K1, second step: the winner of each target from the current sums."""
    best = F.max_by("value", F.struct("weight", "n", "latest", "value"))
    s = sums.groupBy("dimension", "target_id").agg(best.alias("value"), F.max(F.struct("weight", "n", "latest", "value")).alias("top"), F.sum("dissent").alias("dissent"))
    return s.select("dimension", "target_id", "value", F.col("top.weight").alias("weight"), F.col("top.n").alias("agree"), "dissent").where("agree > 0")


def batch_winners(votes: DataFrame) -> DataFrame:
    """The batch twin of K1."""
    return consensus(votes).select("dimension", "target_id", "value", "weight", "agree", "dissent")


def folded(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Changes in order as what they do to a count that no step takes below 0: total, their sum, and least, the least sum of a beginning of them (0 at
    most). A count n becomes n + total - min(0, n + least). Two such pieces combine into one, so changes are dealt by ranges of their order, a key's changes are
    folded in each range, and the pieces of a key are combined: no task needs all changes of one key."""
    ranges = shared_table(changes.repartitionByRange(*order).withColumn("__piece", F.spark_partition_id()), "ranges")
    run = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranges.withColumn("so_far", F.sum("delta").over(run)).groupBy(*keys, "__piece").agg(F.sum("delta").alias("total"), F.least(F.min("so_far"), F.lit(0)).alias("least"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0)))
    return sums.groupBy(*keys).agg(F.sum("total").alias("total"), F.min(F.col("start") + F.col("least")).alias("least"))


def after(n, total, least):
    """A count after a folded piece."""
    return n + total - F.least(F.lit(0), n + least)


def counts(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """K2 in one batch: each key's count after inserts (+1) and deletes (-1) in order, reflected at 0 at every step."""
    zero = F.lit(0).cast("long")
    return folded(changes, keys, order).select(*keys, after(zero, F.col("total"), F.col("least")).alias("n"))


def maintain_counts(changes: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> Snapshot:
    """K2: counts as a snapshot by key; a batch folds its changes in order and rewrites the buckets that they touch. changes: keys, delta and order."""
    kinds = ", ".join(f"{k} {changes.schema[k].dataType.simpleString()}" for k in keys)
    state = Snapshot(changes.sparkSession, f"{path}/counts", f"{kinds}, n long", keys, buckets)

    def combine(rows: DataFrame, more: DataFrame) -> DataFrame:
        both = rows.join(more, keys, "full").fillna(0, ["n", "total", "least"])
        return both.select(*keys, after(F.col("n"), F.col("total"), F.col("least")).cast("long").alias("n"))

    drain(changes, f"{path}/checkpoint", lambda batch, number: state.update(folded(batch, keys, order), combine, number))
    return state


def document_changes(log: DataFrame, row_counts: DataFrame) -> DataFrame:
    """K2, changes of documents' counts from changes of tables and rows. log: doc_id, table_id, kind ('tables' or 'rows'), delta and order columns; a deleted table also takes its
    remaining rows (row_counts: table_id, n) off its document."""
    gone = log.where("kind = 'tables' and delta < 0").join(row_counts.where("n > 0"), "table_id")
    gone = gone.withColumns({"kind": F.lit("rows"), "delta": -F.col("n")}).select(*log.columns)
    return log.unionByName(gone)


def activity_stream(events: DataFrame, path: str, size: str = "1 day", delay: str = "1 hour") -> tuple[DataFrame, DataFrame, DataFrame]:
    """K4: events of each action in tumbling windows: closed windows (start, action, n), late events, and the windows still open. A window closes once an
    event is `delay` later than its end; events that come for a closed window are late: they are kept aside. events: ts, action.
    Only open windows are state, so its size follows the delay and not the stream."""
    spark, kept = events.sparkSession, "start timestamp, action string, n long, mark long"  # mark: the watermark, in microseconds
    schema = events.schema
    interval = lambda x: F.expr(f"INTERVAL {x}")

    def write(batch: DataFrame, number: int) -> None:
        state = spark.read.schema(kept).parquet(f"{path}/open/{number - 1}") if number else spark.createDataFrame([], kept)
        mark = state.agg(F.max("mark")).first()[0]
        w = batch.withColumn("w", F.window("ts", size))
        late = F.lit(False) if mark is None else F.unix_micros("w.end") <= mark
        w.where(late).drop("w").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        fresh = w.where(~late).groupBy(F.col("w.start").alias("start"), "action").agg(F.count(F.lit(1)).alias("n"))
        both = state.where("n is not null").select("start", "action", "n").unionByName(fresh).groupBy("start", "action").agg(F.sum("n").alias("n"))
        top = batch.agg(F.unix_micros(F.max("ts") - interval(delay))).first()[0]
        mark = max((x for x in (mark, top) if x is not None), default=None)
        closes = F.lit(False) if mark is None else F.unix_micros(F.col("start") + interval(size)) <= mark
        both.where(closes).write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
        now = both.where(~closes).withColumn("mark", F.lit(mark).cast("long"))
        now.unionByName(spark.createDataFrame([(None, None, None, mark)], kept)).write.mode("overwrite").parquet(f"{path}/open/{number}")

    drain(events, f"{path}/checkpoint", write)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    read = lambda name, kind: spark.read.schema(kind).parquet(f"{path}/{name}/batch=*") if there(name) else spark.createDataFrame([], kind)
    numbers = sorted(int(x.getPath().getName()) for x in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/open"))) if there("open") else []
    still = spark.read.schema(kept).parquet(f"{path}/open/{numbers[-1]}").where("n is not null") if numbers else spark.createDataFrame([], kept)
    return read("closed", "start timestamp, action string, n long"), read("late", schema), still.select("start", "action", "n")


def audit_stream(tags: DataFrame, log_path: str, votes_path: str, checkpoint: str, source: str) -> StreamingQuery:
    """K5: new tags go to the log and become votes, batch by batch. Each batch writes a folder of its own, so a batch that is run again replaces its output."""
    from ..operators.tagging import emit_tag_events

    def write(batch: DataFrame, number: int) -> None:
        log, votes = emit_tag_events(batch, source)
        log.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        votes.write.mode("overwrite").parquet(f"{votes_path}/batch={number}")

    return tags.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROGRESS = "run_id long, status string, n long"


def progress_stream(results: DataFrame, path: str, buckets: int = BUCKETS) -> Snapshot:
    """K6: documents of each run by status."""
    state = Snapshot(results.sparkSession, f"{path}/progress", PROGRESS, ["run_id"], buckets)

    def combine(rows: DataFrame, more: DataFrame) -> DataFrame:
        return rows.unionByName(more).groupBy("run_id", "status").agg(F.sum("n").alias("n"))

    drain(results, f"{path}/checkpoint", lambda batch, number: state.update(batch.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n")), combine, number))
    return state
