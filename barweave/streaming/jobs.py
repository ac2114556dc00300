"""Structured Streaming jobs.

Each job reads landed files as a stream, keeps its state in Spark, and writes
below a target folder; a checkpoint folder beside the output makes restarts
exact. With ``available_now`` a job handles what has landed and stops.
"""

from __future__ import annotations

from contextlib import contextmanager
from datetime import timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from barweave.operators import accounts, alerts, outcomes, screener, store
from barweave.sources.bars import balanced, from_ticks

c = F.col


def files(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int | None = None, newest_first: bool = False) -> DataFrame:
    """Parquet files below ``path`` as a stream."""
    reader = spark.readStream.schema(schema).option("latestFirst", str(newest_first).lower())
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def _start(writer, path: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", f"{path}/_state")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish(query: StreamingQuery) -> None:
    """Wait until everything that has landed is handled."""
    query.awaitTermination()


def _retire(spark: SparkSession, path: str, upto: int) -> None:
    """Delete the folders ``<name>=N`` below ``path`` with N up to ``upto``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            number = status.getPath().getName().rpartition("=")[2]
            if number.isdigit() and int(number) <= upto:
                fs.delete(status.getPath(), True)


def _compacted(spark: SparkSession, path: str, log: str, batch_id: int, rows: DataFrame, *parts: str) -> None:
    """Write a new base, then retire what the base before it has already replaced.

    The base before and the batches since then stay until the next one, for readers that began with them;
    so a reader lists two bases and two rounds of batches at most, however many batches there were.
    """
    before = _newest_base(spark, path, batch_id - 1)
    writer = balanced(rows, *parts).write.mode("overwrite")
    (writer.partitionBy(*parts) if parts else writer).parquet(f"{path}/base/upto={batch_id}")
    if before is not None:
        _retire(spark, f"{path}/{log}", before)
        _retire(spark, f"{path}/base", before - 1)


def _newest_base(spark: SparkSession, path: str, upto: int | None = None) -> int | None:
    """The batch of the newest whole base (up to a batch), by the names of folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/base")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        number = status.getPath().getName().rpartition("=")[2]
        if number.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(number))
    return max((n for n in found if upto is None or n <= upto), default=None)


# --- bars --------------------------------------------------------------------------


def bars(ticks: DataFrame, path: str, window: str = "1 hour", lateness: str = "1 hour", available_now: bool = True) -> StreamingQuery:
    """Append each bar once its window is closed; later ticks are dropped."""
    rolled = from_ticks(ticks.withWatermark("ts", lateness), window)
    return _start(rolled.writeStream.outputMode("append").format("parquet").option("path", f"{path}/bars"), path, available_now)


def live_bars(ticks: DataFrame, path: str, window: str = "1 hour", lateness: str = "1 day", compact_every: int = 50, available_now: bool = True) -> StreamingQuery:
    """Write each changed bar, open windows included, as a revision keyed by the batch.

    A window takes ticks until the newest tick is ``lateness`` past its end, and then
    leaves the state; later ticks are counted by ``dropped_late``. Every ``compact_every`` batches the newest
    revisions become a base, and what it replaces is retired.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/revisions/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            day = F.date_format("start", "yyyyMMdd").cast("int")
            _compacted(spark, path, "revisions", batch_id, _revisions(spark, path, batch_id).withColumn("day", day), "day")

    rolled = from_ticks(ticks.withWatermark("ts", lateness), window)
    return _start(rolled.writeStream.outputMode("update").foreachBatch(write), path, available_now)


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came after the watermark, over the progress that the query remembers.

    They are in the landed files; rebuilding those windows from the files repairs the bars.
    """
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def _revisions(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest revision of every bar, with its batch."""
    rows = spark.read.parquet(f"{path}/revisions")
    if upto is not None:
        rows = rows.where(c("batch") <= upto)
    base = _newest_base(spark, path, None if upto is None else upto - 1)
    if base is not None:
        kept = spark.read.parquet(f"{path}/base/upto={base}").select(*rows.columns)
        rows = rows.where(c("batch") > base).unionByName(kept)
    rest = [x for x in rows.columns if x not in ("ticker", "start")]
    return rows.groupBy("ticker", "start").agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select("ticker", "start", "_r.*")


def read_live_bars(spark: SparkSession, path: str) -> DataFrame:
    """The newest revision of every bar."""
    return _revisions(spark, path).drop("batch")


# --- scan results ---------------------------------------------------------------------


def _landed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table below ``path``; empty before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def upsert_signals(signals: DataFrame, path: str, hot_rows: int = 50, compact_every: int = 50, available_now: bool = True) -> StreamingQuery:
    """Append scanned signals to the log, keyed by batch; refresh the hot view of the newest date.

    A replayed batch overwrites its own folders, so nothing is written twice. The log is
    partitioned by month, so a batch reads the newest month only; every ``compact_every``
    batches the current rows become a new base that readers start from, and what it replaces is retired.
    """

    return _start(signals.writeStream.foreachBatch(_storing(path, hot_rows, compact_every)), path, available_now)


def _storing(path: str, hot_rows: int, compact_every: int):
    """What a batch of signals does to the store below ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = store.keyed(batch)
        keyed.withColumn("month", F.date_format("trade_date", "yyyyMM").cast("int")).write.mode("overwrite").partitionBy("month").parquet(f"{path}/log/run={batch_id}")
        schema = StructType([*keyed.schema, *StructType.fromDDL("run bigint")])
        hot = _landed(spark, f"{path}/hot", schema).where(c("run") < batch_id)
        dates = keyed.select("trade_date").union(hot.where(c("run") == hot.agg(F.max("run")).scalar()).select("trade_date"))
        newest = dates.agg(F.max("trade_date")).first()[0]
        current = read_signals(spark, path, upto=batch_id, date=newest)
        store.latest(current, hot_rows).write.mode("overwrite").parquet(f"{path}/hot/run={batch_id}")
        _retire(spark, f"{path}/hot", batch_id - 2)
        if (batch_id + 1) % compact_every == 0:
            _compacted(spark, path, "log", batch_id, _versions(spark, path, batch_id), "month")

    return write


def _versions(spark: SparkSession, path: str, upto: int | None = None, date=None) -> DataFrame:
    """The newest version of each key (of one date), with the batch (``run``) that wrote it."""
    log = spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log")
    if upto is not None:
        log = log.where(c("run") <= upto)
    start = _newest_base(spark, path, None if upto is None else upto - 1)
    if start is not None:
        log = log.where(c("run") > start).unionByName(spark.read.schema(log.schema).parquet(f"{path}/base/upto={start}"))
    if date is not None:
        log = log.where((c("month") == date.year * 100 + date.month) & (c("trade_date") == F.lit(date)))
    order = F.struct("run", *[x for x in ("batch_id",) if x in log.columns])
    return store.current(log, order)


def read_signals(spark: SparkSession, path: str, upto: int | None = None, date=None) -> DataFrame:
    """The newest version of each signal (of one date): of the newest batch, and in it of the producer's newest."""
    return _versions(spark, path, upto, date).drop("run", "month")


def read_hot(spark: SparkSession, path: str) -> DataFrame:
    """The hot view that the newest batch left."""
    hot = spark.read.parquet(f"{path}/hot")
    return hot.where(c("run") == hot.agg(F.max("run")).scalar()).drop("run")


# --- alerts -----------------------------------------------------------------------------


def _sent_days(spark: SparkSession, path: str, memory: str) -> dict:
    """Folders of the outbox, by the day of sending, that ``memory`` can reach."""
    first, today = spark.sql(f"SELECT date(current_timestamp() - INTERVAL {memory}), date(current_timestamp())").first()
    days = [first + timedelta(days=k) for k in range((today - first).days + 1)]
    return {day: f"{path}/outbox/sent_day={day}" for day in days}


def dedup_alerts(signals: DataFrame, path: str, memory: str = alerts.MEMORY, available_now: bool = True) -> StreamingQuery:
    """Outbox rows for strong tradable signals, once per ticker and day within ``memory`` of sending.

    What was sent is in the outbox itself, in a folder for each day of sending, and a batch opens only the
    days that ``memory`` reaches, however old the outbox is. A signal is sent whatever its date. A replayed
    batch overwrites its own folder, also that of a day before.
    """
    return _start(signals.writeStream.foreachBatch(_sending(path, memory)), path, available_now)


def _sending(path: str, memory: str):
    """What a batch of signals adds to the outbox below ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        strong = alerts.select(batch)
        schema = StructType([*strong.schema, *StructType.fromDDL("sent_at timestamp, run bigint")])
        folders = _sent_days(spark, path, memory)
        logs = [_landed(spark, folder, schema) for folder in folders.values()]
        sent, target = reduce(DataFrame.unionByName, logs), list(folders.values())[-1]
        for folder, log in zip(folders.values(), logs, strict=True):
            if not log.where(c("run") == batch_id).isEmpty():
                target = folder
        sent = sent.where((c("run") != batch_id) & (c("sent_at") >= F.current_timestamp() - F.expr(f"INTERVAL {memory}")))
        fresh = alerts.unsent(strong, sent).withColumn("sent_at", F.current_timestamp())
        fresh.write.mode("overwrite").parquet(f"{target}/run={batch_id}")

    return write


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/outbox").drop("run", "sent_day")


# --- the scan as one flow ----------------------------------------------------------------


def scan_cycles(requests: DataFrame, path: str, panel_of, model, calibrator=None, hot_rows: int = 50, compact_every: int = 50, memory: str = alerts.MEMORY, available_now: bool = True) -> StreamingQuery:
    """Score, calibrate, grade, store and announce the newest bars, once for each request (``as_of`` date) that lands.

    ``panel_of(as_of)`` gives (bars, features, vix) up to a date; ``model`` and ``calibrator`` are fitted. The signals of
    a batch are written once and feed the store (``read_signals``, ``read_hot``) and the outbox (``read_outbox``) below ``path``.
    A replayed batch overwrites what it wrote, so a second run adds nothing.
    """
    keep, send = _storing(path, hot_rows, compact_every), _sending(path, memory)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = [r[0] for r in batch.select("as_of").distinct().orderBy("as_of").collect()]  # a request is a date
        if not days:
            return
        found = [screener.cycle(*panel_of(day), model, calibrator).withColumn("as_of", F.lit(day)) for day in days]
        every = reduce(DataFrame.unionByName, found).withColumnRenamed("date", "trade_date")
        every.write.mode("overwrite").parquet(f"{path}/scanned/run={batch_id}")
        scanned = spark.read.parquet(f"{path}/scanned/run={batch_id}").withColumn("batch_id", F.datediff("as_of", F.lit("1970-01-01").cast("date")))
        keep(scanned, batch_id)
        send(scanned, batch_id)
        _retire(spark, f"{path}/scanned", batch_id - 2)

    return _start(requests.writeStream.foreachBatch(write), path, available_now)


# --- outcomes ----------------------------------------------------------------------------

_SIGNAL = ["ticker", "trade_date", "seq", "side", "entry", "stop_loss", "tp1"]
_BAR = ["ticker", "seq", "date", "high", "low", "close"]
_PAIR = "ticker string, trade_date date, side string, entry double, stop_loss double, tp1 double, k int, high double, low double, close double"
#: Bar numbers of one ticker whose state is one key: a hot ticker has many keys, and a key's state is bounded.
BLOCK = 64


def _pairing(sessions: int, block: int):
    """The state of a (ticker, block of bar numbers): its bars, and the signals that still wait for some of them."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Pairing(StatefulProcessor):
        def init(self, handle) -> None:
            self.bars = handle.getListState("bars", "seq bigint, date date, high double, low double, close double")
            self.waiting = handle.getListState("waiting", "seq bigint, trade_date date, side string, entry double, stop_loss double, tp1 double, left int")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            known, waiting = list(self.bars.get()), list(self.waiting.get())
            bars, signals = [], []
            for pdf in rows:
                for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                    if r.is_signal:
                        signals.append((int(r.seq), r.date, r.side, r.entry, r.stop_loss, r.tp1))
                    else:
                        bars.append((int(r.seq), r.date, r.high, r.low, r.close))
            out = []

            def paired(signal, by_seq) -> int:
                """Write the signal's bars among these; how many of its bar numbers they settle."""
                settled = 0
                for k in range(1, sessions + 1):
                    for _, date, high, low, close in by_seq.get(signal[0] + k, ()):
                        if date is not None and signal[1] is not None and date > signal[1]:
                            out.append((key[0], *signal[1:6], k, high, low, close))
                    settled += signal[0] + k in by_seq
                return settled

            def numbered(some):
                by_seq = {}
                for bar in some:
                    by_seq.setdefault(int(bar[0]), []).append(tuple(bar))
                return by_seq

            fresh, every, still = numbered(bars), numbered([*known, *bars]), []
            for w in waiting:
                left = w[6] - paired(tuple(w)[:6], fresh)
                if left > 0:
                    still.append((*tuple(w)[:6], left))
            for signal in signals:
                here = sum((signal[0] + k) // block == key[1] for k in range(1, sessions + 1))
                left = here - paired(signal, every)
                if left > 0:
                    still.append((*signal, left))
            if bars:
                self.bars.appendList(bars)
            if still != [tuple(w) for w in waiting]:
                self.waiting.put(still) if still else self.waiting.clear()
            names = ["ticker", "trade_date", "side", "entry", "stop_loss", "tp1", "k", "high", "low", "close"]
            yield pd.DataFrame(out, columns=names).astype({"k": "int32", **{x: "float64" for x in ("entry", "stop_loss", "tp1", "high", "low", "close")}})

        def close(self) -> None:
            pass

    return Pairing()


@contextmanager
def _on_disk(spark: SparkSession):
    """Streams that start in here keep their state in RocksDB, and write what changed in it with each batch."""
    want = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def resolve_signals(signals: DataFrame, bars: DataFrame, path: str, sessions: int = outcomes.RESOLVE_SESSIONS, block: int = BLOCK, available_now: bool = True) -> StreamingQuery:
    """Pair each signal with its next bars as they arrive, in any order.

    A signal waits for the bars seq+1 … seq+sessions of its ticker. Both sides are dealt by
    (ticker, block of bar numbers) into keyed state: a block's bars, and the signals waiting for some of them,
    which leave when the last has come. A signal whose bars lie in two blocks waits in both. So a batch
    reads and writes the state of the blocks it touches and nothing of the history, and no key is hot.
    There is no watermark: a signal or a bar may be as late as it likes, so bars stay, on disk, in the state of their block.
    """
    if sessions > block:
        raise ValueError("a signal's bars must fit into two blocks")
    cast = {"trade_date": "date", "seq": "bigint", "entry": "double", "stop_loss": "double", "tp1": "double", "date": "date", "high": "double", "low": "double", "close": "double"}
    of = lambda n: F.floor((c("seq") + n) / block).cast("long")
    none = lambda names, kind: [F.lit(None).cast(kind).alias(n) for n in names]
    own = lambda names: [c(n).cast(cast[n]) for n in names]
    signal = signals.select(*_SIGNAL).where("ticker is not null and seq is not null").select(
        "ticker", F.explode(F.array_distinct(F.array(of(1), of(sessions)))).alias("block"), F.lit(True).alias("is_signal"), *own(["seq"]),
        c("trade_date").cast("date").alias("date"), "side", *own(["entry", "stop_loss", "tp1"]), *none(["high", "low", "close"], "double"),
    )
    bar = bars.select(*_BAR).where("ticker is not null and seq is not null").select(
        "ticker", of(0).alias("block"), F.lit(False).alias("is_signal"), *own(["seq", "date"]), *none(["side"], "string"), *none(["entry", "stop_loss", "tp1"], "double"), *own(["high", "low", "close"]),
    )
    pairs = signal.unionByName(bar).groupBy("ticker", "block").transformWithStateInPandas(_pairing(sessions, block), _PAIR, "append", "none")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/pairs/run={batch_id}")

    with _on_disk(signals.sparkSession):
        return _start(pairs.writeStream.outputMode("append").foreachBatch(write), path, available_now)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes from the paired bars (a handful per signal)."""
    bar = F.struct("k", "high", "low", "close")
    seen = spark.read.parquet(f"{path}/pairs").groupBy("ticker", "trade_date", "side", "entry", "stop_loss", "tp1").agg(
        F.array_sort(F.collect_set(bar)).alias("_path")
    )
    return outcomes.with_outcome(seen)


# --- accounts -------------------------------------------------------------------------------


def fold_accounts(events: DataFrame, path: str, available_now: bool = True) -> StreamingQuery:
    """Append parsed billing events, keyed by batch; the fold is taken on read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        accounts.parse_events(batch).write.mode("overwrite").parquet(f"{path}/events/run={batch_id}")

    return _start(events.writeStream.foreachBatch(write), path, available_now)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return accounts.fold_events(spark.read.parquet(f"{path}/events").drop("run"))
