"""Time- and state-driven rules as Structured Streaming jobs; each has a batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import fixed
from ..functions import text as tx
from ..operators import classification as cl
from ..operators import state as st
from ..operators import stories as so
from ..plans import workloads as wl
from ..sources import views as vw
from ..sources.changelog import ChangeLog, written
from ..sources.shared import broadcast_if_small, passing, remove, shared_dir, shuffles_dropped, stored


def _shared(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_available(df: DataFrame, each: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, batch by batch."""
    q = df.writeStream.outputMode(mode).foreachBatch(each).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start()
    q.awaitTermination()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    if [f.rpartition("/")[2] for f in table.inputFiles()] == ["events.parquet"]:  # a file; streams read folders
        return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.parquet(path)


class _EventStream:
    """Lets the views read a stream where they would read the table of events."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.read = self
        self.stream = event_stream(spark, sf_dir)

    def parquet(self, path: str) -> DataFrame:
        return self.stream


#: Every so many batches a state table is written whole, so that reading it stays cheap.
FULL_EVERY = 64


def _current(spark: SparkSession, path: str, keys: list[str], number: int = 1 << 30) -> DataFrame | None:
    """The state that the batches under ``path`` before ``number`` make: the last whole one and the changes after it."""
    rows = written(spark, path)
    if rows is None:
        return None
    rows = rows.where(F.col("batch") < number)
    whole = rows.where("whole = 1").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]  # of folder names
    return st.lww_latest(rows.where(F.col("batch") >= whole).drop("whole", "batch"), keys)


def reading_state(changes: DataFrame, folder: str) -> DataFrame:
    """Keeps the latest reading state of each (reader, item) under ``folder`` and returns it.

    A batch is reduced and written by its number, so a batch that is run twice
    changes nothing, a stream that is stopped goes on where it was, and late rows lose
    by their own times.  Every ``FULL_EVERY`` batches the whole state is written.
    """
    spark = changes.sparkSession
    keys, path = ["user_id", "item_id"], f"{folder}/state"

    def each(batch: DataFrame, number: int) -> None:
        fresh = st.lww_latest(batch, keys)
        whole = number % FULL_EVERY == FULL_EVERY - 1
        if whole and (before := _current(spark, path, keys)) is not None:
            fresh = st.lww_latest(before.unionByName(fresh), keys)
        fresh.write.mode("overwrite").parquet(f"{path}/whole={int(whole)}/batch={number}")

    run_available(changes, each, folder)
    state = _current(spark, path, keys)
    return changes_of(spark, changes) if state is None else state


def changes_of(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """An empty table like a stream's."""
    return spark.createDataFrame([], stream.schema)


def reading_state_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = reading_state(vw.reading_changes(_EventStream(spark, sf_dir), sf_dir), _shared(spark))
    return state.select("user_id", "item_id", "read", "saved", "later", "seq")


def collected(df: DataFrame, folder: str, mode: str = "append") -> str:
    """All rows of a stream, with the number of their batch, as a table."""
    path = f"{folder}/rows"
    run_available(df, lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}"), folder, mode)
    return path


def changes(stream: DataFrame, folder: str) -> ChangeLog:
    """A stream of changes as a changelog clustered by time; run again, it goes on where it was."""
    log = ChangeLog(stream.sparkSession, folder)
    run_available(stream, log.append, folder)
    return log


def changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog after a watermark, from a stream of changes."""
    log = changes(vw.reading_changes(_EventStream(spark, sf_dir), sf_dir).select("user_id", "item_id", "seq", "updated_at"), _shared(spark))
    return log.since(vw.minutes_before(vw.now(), F.lit(14_400))).select("user_id", "item_id", "seq")


def edition_counts(stream: DataFrame, stories: DataFrame, folder: str) -> DataFrame:
    """``edition_counts`` kept up by a stream of reading changes: counts of unread stories, and what each batch adds or takes away.

    A batch is reduced to the rows that win over the state before it; these and their deltas are
    written by its number, so it may be run twice, late rows lose by their own times, and a
    stream that is stopped goes on where it was.  The stories are those of one edition.
    """
    spark, keys = stream.sparkSession, ["user_id", "item_id"]
    state, deltas, base = f"{folder}/state", f"{folder}/deltas", f"{folder}/base"
    if written(spark, base) is None:
        nothing = spark.createDataFrame([], "user_id long, item_id string, read boolean, saved boolean, later boolean")
        so.edition_counts(stories, nothing).write.mode("overwrite").parquet(base)

    def each(batch: DataFrame, number: int) -> None:
        fresh = stored(st.lww_latest(batch, keys))
        before = _current(spark, state, keys, number)
        old = fresh.limit(0) if before is None else stored(before.join(fresh.select(*keys), keys, "left_semi").select(*fresh.columns))
        new = stored(st.lww_latest(old.unionByName(fresh), keys))
        so.count_deltas(old, new, stories).write.mode("overwrite").parquet(f"{deltas}/batch={number}")
        whole = number % FULL_EVERY == FULL_EVERY - 1 and before is not None
        kept = st.lww_latest(before.select(*new.columns).unionByName(new), keys) if whole else new
        kept.write.mode("overwrite").parquet(f"{state}/whole={int(whole)}/batch={number}")

    run_available(stream, each, folder)
    counts = spark.read.parquet(base)
    made = written(spark, deltas)
    if made is not None:
        counts = counts.unionByName(made.drop("batch"))
    return counts.groupBy("user_id", "scope", "name").agg(F.sum("n").alias("n"))


def edition_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = so.readers_stories(so.shape_stories(vw.articles(spark, sf_dir), vw.now(), False), so.shape_feeds(vw.sources(spark, sf_dir)))
    stream = vw.reading_changes(_EventStream(spark, sf_dir), sf_dir)
    return edition_counts(stream, stories, _shared(spark))


def rate_windows(calls: DataFrame, limit: int = fixed.FETCH_LIMIT, late: str = "10 minutes") -> DataFrame:
    """Calls of each client by minute; ``limited`` where over the limit.  State is bounded by the watermark."""
    w = F.window("ts", "60 seconds")
    n = calls.withWatermark("ts", late).groupBy(w.alias("w"), "client").agg(F.count(F.lit(1)).alias("calls"))
    return n.select("client", F.col("w.start").alias("window_start"), "calls", (F.col("calls") > limit).alias("limited"))


def rate_windows_query(spark: SparkSession, sf_dir: str, limit: int = fixed.FETCH_LIMIT) -> DataFrame:
    calls = vw.call_log(_EventStream(spark, sf_dir), sf_dir)
    path = collected(rate_windows(calls, limit), _shared(spark), "update")
    rows = spark.read.parquet(path)
    # a window's last update counts
    return rows.groupBy("client", "window_start").agg(F.max_by(F.struct("calls", "limited"), "batch").alias("x")).select("client", "window_start", "x.*")


def call_windows(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each client's calls by minute (``client``, ``slot``, ``calls``), with the calls of the minute before.

    The windows overlap by half, so a call is kept as its minute's own and as the next one's
    history, and a busy client spreads over its minutes.  They are a buffer in event time:
    in whatever order calls arrive, a window holds them all until the watermark has passed it, then
    it goes from the state.  Calls later than ``late`` aren't counted.
    """
    span = fixed.CALL_WINDOW_MS // 1000
    w = F.window("ts", f"{2 * span} seconds", f"{span} seconds")
    c = calls.select("client", "seq", "ts").withWatermark("ts", late)
    grouped = c.groupBy("client", w.alias("w")).agg(F.collect_list(F.struct(F.unix_millis("ts").alias("ms"), "seq")).alias("calls"))
    return grouped.select("client", F.floor(F.unix_millis("w.start") / fixed.CALL_WINDOW_MS + 1).alias("slot"), "calls")


def paced_windows(windows: DataFrame) -> DataFrame:
    """(``client``, ``seq``, ``recent``, ``delay_ms``) of the own calls in some windows (not as a stream)."""
    rows = windows.select("client", "slot", F.inline("calls"))
    return cl.paced(rows.withColumn("own", F.col("ms") >= F.col("slot") * fixed.CALL_WINDOW_MS)).select("client", "seq", "recent", "delay_ms")


def pacing(calls: DataFrame, folder: str, late: str = "10 minutes") -> DataFrame:
    """``call_pacing`` of a stream of calls; a call's last row counts, so it is right at any time for what has arrived.

    A window is worked out anew whenever calls are added to it, and its rows are written by the
    number of the batch, so a stream that is stopped goes on where it was.
    """
    path = f"{folder}/rows"
    run_available(call_windows(calls, late), lambda batch, n: paced_windows(batch).write.mode("overwrite").parquet(f"{path}/batch={n}"), folder, "update")
    rows = written(calls.sparkSession, path)
    if rows is None:
        return calls.sparkSession.createDataFrame([], "client string, seq long, recent long, delay_ms long")
    return rows.groupBy("client", "seq").agg(F.max_by(F.struct("recent", "delay_ms"), "batch").alias("x")).select("client", "seq", "x.*")


def pacing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing(vw.call_log(_EventStream(spark, sf_dir), sf_dir), _shared(spark))


def _signal() -> Column:
    return tx.read_signal(F.col("scroll_top"), F.col("scroll_height"), F.col("client_height"))


def _credited_at(following: Column) -> Column:
    """When an event (``ts``, ``signal``) earns credit, given the time of the reader's next one; else null."""
    dwell = F.col("ts") + F.make_dt_interval(secs=F.lit(fixed.DWELL_MS / 1000))
    return F.when(F.col("signal") == "now", F.col("ts")).when((F.col("signal") == "dwell") & (following.isNull() | (following >= dwell)), dwell)


def read_credit(events: DataFrame) -> DataFrame:
    """(``user_id``, ``item_id``, ``credited_at``): a story counts as read once its end is reached, or a short one was stayed with.

    The next event of a reader, of any story, ends a stay.
    """
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "item_id"))
    e = events.select("user_id", "item_id", "ts", _signal().alias("signal"))
    return e.withColumn("at", _credited_at(following)).groupBy("user_id", "item_id").agg(F.min("at").alias("credited_at")).where("credited_at IS NOT NULL")


#: A reader's events are looked at by stretches of so many seconds, each with the first seconds of the next, in which a stay may end.
_STRETCH, _EDGE = 60, 5


def scroll_windows(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Each reader's events by minute (``user_id``, ``start``, ``events``), with the first seconds after it; a buffer in event time as ``call_windows``."""
    w = F.window("ts", f"{_STRETCH + _EDGE} seconds", f"{_STRETCH} seconds")
    e = events.select("user_id", "item_id", "ts", _signal().alias("signal")).withWatermark("ts", late)
    grouped = e.groupBy("user_id", w.alias("w")).agg(F.collect_list(F.struct("ts", "item_id", "signal")).alias("events"))
    return grouped.select("user_id", F.col("w.start").alias("start"), "events")


def credited_windows(windows: DataFrame) -> DataFrame:
    """(``user_id``, ``start``, ``item_id``, ``credited_at``): each story of some windows, with null where it is not (or no longer) credited."""
    e = windows.select("user_id", "start", F.inline("events"))
    following = F.lead("ts").over(Window.partitionBy("user_id", "start").orderBy("ts", "item_id"))
    e = e.withColumn("at", _credited_at(following)).where(F.col("ts") < F.col("start") + F.make_dt_interval(secs=F.lit(float(_STRETCH))))
    return e.groupBy("user_id", "start", "item_id").agg(F.min("at").alias("credited_at"))


def credits(events: DataFrame, folder: str, late: str = "1 minute") -> DataFrame:
    """``read_credit`` of a stream of scroll events, right at any time for what has arrived.

    A late event may end a stay that was credited: the window's stories are then written again,
    and the last batch counts.
    """
    path = f"{folder}/rows"
    run_available(scroll_windows(events, late), lambda batch, n: credited_windows(batch).write.mode("overwrite").parquet(f"{path}/batch={n}"), folder, "update")
    rows = written(events.sparkSession, path)
    if rows is None:
        return events.sparkSession.createDataFrame([], "user_id long, item_id string, credited_at timestamp")
    last = rows.groupBy("user_id", "start", "item_id").agg(F.max_by("credited_at", "batch").alias("credited_at"))
    return last.groupBy("user_id", "item_id").agg(F.min("credited_at").alias("credited_at")).where("credited_at IS NOT NULL")


def read_credit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credits(vw.scroll_events(_EventStream(spark, sf_dir), sf_dir), _shared(spark))


#: Every so many batches the articles written so far become one delta, and those before it go.
COMPACT_EVERY = 32


def _articles_at(articles: DataFrame, folder: str, number: int = 1 << 30) -> DataFrame:
    """``articles`` with the sources that earlier batches than ``number`` changed as the last commit of each has them."""
    spark = articles.sparkSession
    commits = written(spark, f"{folder}/commits")
    if commits is None:
        return articles
    last = broadcast_if_small(commits.where(F.col("batch") < number).groupBy("source_id").agg(F.max("batch").alias("batch")))
    rows = spark.read.schema(StructType([*articles.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/articles")
    rows = rows.where(F.col("batch") < number).join(last, ["source_id", "batch"]).select(*articles.columns)
    return articles.join(last.select("source_id"), "source_id", "left_anti").select(*articles.columns).unionByName(rows)


def ingest(documents: DataFrame, sources: DataFrame, articles: DataFrame, reading: DataFrame, at: Column, folder: str) -> DataFrame:
    """Feed documents as a stream that refreshes the article table; returns the table.

    A batch writes the articles of the sources that it changes, as a delta by its number, and then
    a commit that names these sources; where nothing changed it writes neither.  A delta counts
    once its commit is there, so a batch may be run twice, and a stream that is stopped goes on
    where it was.  Every ``COMPACT_EVERY`` batches deltas are merged.

    What a batch stores for itself goes when it ends.  Bodies are moved only of items that are
    written: articles that their feed has lost are told by their ids, and fetched if they are kept.
    """
    spark = documents.sparkSession
    delta, commit = (lambda n: f"{folder}/articles/batch={n}"), (lambda n: f"{folder}/commits/batch={n}")

    def each(batch: DataFrame, number: int) -> None:
        with passing(spark):
            before = _articles_at(articles, folder, number)
            incoming, verdicts = wl.feed_changes(batch, sources, before, at)
            changed = verdicts.where("changed").select("source_id")
            if changed.isEmpty():
                return
            incoming.select(*articles.columns).write.mode("overwrite").parquet(delta(number), compression="zstd")
            fresh = spark.read.schema(articles.schema).parquet(delta(number)).select("id")
            had = before.select("source_id", "id").join(broadcast_if_small(changed), "source_id", "left_semi")
            lost = broadcast_if_small(stored(had.join(fresh, "id", "left_anti").join(keep, "id", "left_semi")))
            before.join(lost, ["source_id", "id"], "left_semi").select(*articles.columns).write.mode("append").parquet(delta(number), compression="zstd")
            changed.write.mode("overwrite").parquet(commit(number))
            if number % COMPACT_EVERY == COMPACT_EVERY - 1:
                compact(number)

    def compact(number: int) -> None:
        """The sources of all commits so far under this one's number.  Their deltas stay until the next time, for who reads them now."""
        named = stored(spark.read.parquet(f"{folder}/commits").select("batch", "source_id"))
        every = stored(named.select("source_id").distinct())
        merged = stored(_articles_at(articles, folder, number + 1).join(broadcast_if_small(every), "source_id", "left_semi").select(*articles.columns), "zstd")
        merged.write.mode("overwrite").parquet(delta(number), compression="zstd")
        every.write.mode("overwrite").parquet(commit(number))
        old = [r["batch"] for r in named.select("batch").distinct().collect() if r["batch"] < number - COMPACT_EVERY]
        remove(spark, *[f(n) for n in old for f in (commit, delta)])

    with passing(spark), shuffles_dropped(spark):
        sources, keep = stored(sources), stored(wl.kept_items(reading).distinct())  # for all batches
        run_available(documents, each, folder)
    return _articles_at(articles, folder)


def ingest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _shared(spark)
    made = vw.feed_documents(spark, sf_dir)
    with shuffles_dropped(spark):
        made.write.parquet(f"{folder}/documents", compression="zstd")
    documents = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/documents")
    reading = st.lww_latest(vw.reading_changes(spark, sf_dir), ["user_id", "item_id"])
    after = ingest(documents, vw.feed_sources(spark, sf_dir), vw.feed_articles(spark, sf_dir), reading, vw.now(), folder)
    return after.groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"))
