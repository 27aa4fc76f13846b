"""Stream operators: rules, sessions, deduplication, statistics and tracking on Structured Streaming.

Rows behind the watermark are dropped; the number is in the progress of the query
(stateOperators.numRowsDroppedByWatermark), and Progress keeps it as a table. Rows after
the last watermark stay in state when an availableNow run ends, unless the stream is
closed (closable, run_to_end).
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, LongType, StructField, StructType, TimestampType
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: numpy's names of the types of rows in state.
KINDS = {"long": "int64", "double": "float64", "boolean": "bool", "string": "object"}


def packed_schema(columns: dict[str, str]) -> str:
    """The schema of pack()."""
    return ", ".join(f"{c} binary, {c}_names array<string>" if kind == "string" else f"{c} binary" for c, kind in columns.items())


def pack(columns: dict[str, str], values: list[np.ndarray]) -> tuple:
    """Columns (names and types) as bytes, strings as places in a list of the different ones: values one by one cost more than the work on them."""
    out = []
    for kind, own in zip(columns.values(), values):
        if kind == "string":
            codes, names = pd.factorize(own)
            out += [codes.astype("int32").tobytes(), names.tolist()]
        else:
            out.append(np.ascontiguousarray(own, KINDS[kind]).tobytes())
    return tuple(out)


def unpack(columns: dict[str, str], value: tuple) -> list[np.ndarray]:
    """The columns of pack()."""
    parts, out = iter(value), []
    for kind in columns.values():
        own = bytes(next(parts))
        out.append(np.asarray(next(parts), object)[np.frombuffer(own, "int32")] if kind == "string" else np.frombuffer(own, KINDS[kind]))
    return out


class InOrder(StatefulProcessor):
    """Gives a key's rows to ``due`` in order of time, once the watermark has passed them.

    Rows wait in map state under (time step, part): a batch adds parts and rewrites none,
    and when a timer fires, only steps up to the watermark are read. A key has one timer
    at a time, at its earliest row. Rows with a null in a column of ROW are left out.
    """

    #: Columns of a row, the time in microseconds first, with their types.
    ROW: dict[str, str] = {}

    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", "step long, part long", packed_schema(self.ROW))
        self.mark = handle.getValueState("mark", "parts long, timer long")

    def _wait(self, rows: list[np.ndarray], parts: int) -> int:
        """Put rows (columns in ROW's order) into the state of their steps."""
        step = rows[0] // self.step
        for own in np.unique(step).tolist():
            at = step == own
            self.buffer.updateValue((own, parts), pack(self.ROW, [c[at] for c in rows]))
            parts += 1
        return parts

    def _rearm(self, parts: int, old: int | None, at: int | None) -> None:
        """Let the key's timer fire once the watermark passes at (microseconds)."""
        timer = None if at is None else at // 1000 + 1
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.mark.update((parts, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, timer = self.mark.get() if self.mark.exists() else (0, None)
        first = None
        for df in rows:
            if df[list(self.ROW)].isna().to_numpy().any():
                df = df.dropna(subset=list(self.ROW))
            if len(df):
                own = [df["ts"].to_numpy("datetime64[us]").astype("int64"), *(df[c].to_numpy(KINDS[k]) for c, k in list(self.ROW.items())[1:])]
                parts = self._wait(own, parts)
                first = min(int(own[0].min()), first if first is not None else int(own[0].min()))
        if first is not None:
            earlier = timer is None or first // 1000 + 1 < timer
            self._rearm(parts, timer, first if earlier else (timer - 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.buffer.keys())
        parts = self.mark.get()[0]
        read = [k for k in held if k[0] * self.step < until]
        later = [k[0] for k in held if k[0] * self.step >= until]
        found = [unpack(self.ROW, self.buffer.getValue(k)) for k in read]
        for k in read:
            self.buffer.removeKey(k)
        rows = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, KINDS[k]) for i, k in enumerate(self.ROW.values())]
        late = rows[0] >= until
        if late.any():
            parts = self._wait([c[late] for c in rows], parts)
        self._rearm(parts, None, int(rows[0][late].min()) if late.any() else later[0] * self.step if later else None)
        order = np.lexsort((rows[1], rows[0]))
        order = order[~late[order]]
        out = self.due(key, [c[order] for c in rows])
        if out is not None:
            yield out

    def due(self, key, rows: list[np.ndarray]) -> pd.DataFrame | None:
        """What the rows (columns in ROW's order) give; they come in order of their first two columns."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Consecutive(InOrder):
    """Counts violating rows in a row, for all keys of a shard at once: a call costs milliseconds, however few rows it has."""

    ROW = {"ts": "long", "id": "long", "flag": "boolean", "key": "string"}

    def __init__(self, n: int, step: int):
        super().__init__(step)
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # keys whose last row was a violating one, and how many in a row
        self.run = handle.getValueState("run", "key array<string>, n array<long>, start array<long>")

    def due(self, key, rows: list[np.ndarray]) -> pd.DataFrame | None:
        if not len(rows[0]):
            return None
        open_, n, start = self.run.get() if self.run.exists() else ([], [], [])
        codes, names = pd.factorize(np.concatenate([np.asarray(open_, object), rows[3]]))
        before, since = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        before[: len(open_)], since[: len(open_)] = n, start
        own = codes[len(open_) :]
        order = np.argsort(own, kind="stable")
        own, at, flag = own[order], rows[0][order], rows[2][order]
        place = np.arange(len(own))
        new = np.concatenate([[True], own[1:] != own[:-1]])
        first = np.maximum.accumulate(np.where(new, place, 0))
        # the last row that was none, or the row before the key's first
        none = np.maximum.accumulate(np.where(~flag, place, np.where(new, place - 1, -1)))
        goes_on = (none < first) & (before[own] > 0)
        count = np.where(flag, place - none + np.where(goes_on, before[own], 0), 0)
        begin = np.where(goes_on, since[own], at[np.minimum(none + 1, len(at) - 1)])
        last = np.append(new[1:], True)
        before[own[last]], since[own[last]] = count[last], begin[last]
        left = before > 0
        self.run.update((names[left].tolist(), before[left].tolist(), since[left].tolist()))
        found = flag & (count == self.n)
        return pd.DataFrame({"key": names[own[found]], "start_us": begin[found], "confirm_us": at[found]}) if found.any() else None


#: Arrays and structs as keys, to the microsecond.
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _to_text(key: Column, kind: DataType) -> Column:
    """A key's column as text that has its value back."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(key).cast("string")
    if isinstance(kind, BinaryType):
        return F.base64(key)
    if isinstance(kind, (ArrayType, StructType)):
        return F.to_json(F.struct(key.alias("v")), _JSON)
    if isinstance(kind, (FloatType, DoubleType)):
        key = F.when(key == 0, F.lit(0).cast(kind)).otherwise(key)  # -0.0 is 0.0, as in any grouping
    return key.cast("string")


def _from_text(text: Column, kind: DataType) -> Column:
    """The value of _to_text()."""
    if isinstance(kind, TimestampType):
        return F.timestamp_micros(text.cast("long"))
    if isinstance(kind, BinaryType):
        return F.unbase64(text)
    if isinstance(kind, (ArrayType, StructType)):
        return F.from_json(text, StructType([StructField("v", kind)]), _JSON)["v"]
    return text.cast(kind)


def _key_text(df: DataFrame, keys: list[str]) -> Column:
    """The columns of a key as one text: JSON of k0, .., nulls left out."""
    return F.to_json(F.struct(*(_to_text(F.col(k), df.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys))))


def stream_consecutive(df: DataFrame, keys: list[str], n: int = 5, delay: str = "10 seconds", step_seconds: int = 60, shards: int = 1024) -> DataFrame:
    """One row per run of n violating rows of a key, when confirmed: keys (as k0, ..), start_us, confirm_us.

    df: keys, ts (timestamp), id (order among equal ts), flag. step_seconds: rows wait in
    state by steps of time; about the delay is right. shards: keys are dealt to so many
    groups by hash, which share state and timer; a group's due rows are worked on together.
    """
    kinds = [df.schema[k].dataType for k in keys]
    rows = df.withWatermark("ts", delay).select("ts", "id", "flag", _key_text(df, keys).alias("key"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard")
    found = dealt.transformWithStateInPandas(Consecutive(n, step_seconds * 1_000_000), outputStructType="key string, start_us long, confirm_us long", outputMode="Append", timeMode="EventTime")
    back = F.from_json("key", ", ".join(f"k{i} string" for i in range(len(keys))))
    return found.select(*(_from_text(back[f"k{i}"], kind).alias(f"k{i}") for i, kind in enumerate(kinds)), "start_us", "confirm_us")


def stream_majority(df: DataFrame, keys: list[str], window: str = "10 seconds", slide: str = "1 second", ratio: float = 0.5, delay: str = "10 seconds") -> DataFrame:
    """Windows of a key in which the violating share is above ratio."""
    share = F.avg(F.col("flag").cast("double"))
    shares = df.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), *keys).agg(share.alias("share"), F.count("*").alias("n"))
    return shares.where(F.col("share") > ratio).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, F.round("share", 9).alias("share"), "n")


def stream_events(df: DataFrame, keys: list[str], gap: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Violating rows of a key as sessions: rows closer than the gap are one event."""
    sessions = df.where("flag").withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))
    return sessions.select(F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), *keys, "n")


def dedup_stream(df: DataFrame, key: str = "det_id", delay: str = "10 seconds") -> DataFrame:
    """Drop rows that are sent again within the delay."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def stream_stats(df: DataFrame, window: str = "1 minute", delay: str = "10 seconds", key: str = "camera_id") -> DataFrame:
    """Rows and violations per key and tumbling window."""
    out = df.withWatermark("ts", delay).groupBy(F.window("ts", window), key).agg(F.count("*").alias("n"), F.sum(F.col("flag").cast("long")).alias("n_violations"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", "n_violations")


class Progress(StreamingQueryListener):
    """Batches of the queries that it has seen, as rows: query, batch, watermark, input rows, rows dropped as late."""

    SCHEMA = "query string, batch long, watermark string, n_input long, n_late long"

    def __init__(self):
        self.rows: list[tuple] = []
        self.ends = threading.Semaphore(0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.id), p.batchId, (p.eventTime or {}).get("watermark"), p.numInputRows, sum(s.numRowsDroppedByWatermark for s in p.stateOperators)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ends.release()

    def append_to(self, spark: SparkSession, path: str, ended: int = 0) -> DataFrame:
        """Append the rows so far to a table of progress (a row per batch, not of data) and read it; ended: runs whose end it waits for, as events come late."""
        for _ in range(ended):
            if not self.ends.acquire(timeout=120):
                raise TimeoutError("a query's end was not reported")
        rows, self.rows = self.rows, []
        spark.createDataFrame(rows, self.SCHEMA).write.mode("append").parquet(path)
        return spark.read.schema(self.SCHEMA).parquet(path)


def start_sink(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append a stream to Parquet."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_event_sink(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Write a stream so that a batch which is replayed after a failure leaves the same table.

    Rows of a batch are the partition batch=<id>, overwritten as a whole; its id then goes
    into a ledger beside it. A batch in the ledger is left alone, and rows of a batch that
    is not in it are not read (read_event_sink).
    """

    def put(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if batch in {r["batch"] for r in _ledger(spark, path).where(F.col("batch") == batch).collect()}:
            return
        done = spark.range(1).select(F.lit(True).alias("done"))
        for part, name in ((rows, "rows"), (done, "ledger")):
            part.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")

    writer = df.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema("done boolean, batch long").parquet(f"{path}/ledger") if there else spark.createDataFrame([], "done boolean, batch long")


def read_event_sink(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of the batches that the ledger has."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{path}/rows")
    return rows.join(_ledger(spark, path).select("batch"), "batch", "left_semi").select(*schema.names)


def run_to_end(df: DataFrame, path: str, checkpoint: str, closing: str | None = None) -> DataFrame:
    """Run a stream over what is there and read its output.

    closing: the folder that closable() was given; the stream is then ended, so that rows
    after the last watermark come out too.
    """
    spark: SparkSession = df.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        start_sink(df, path, checkpoint).awaitTermination()
        if closing:
            spark.range(1).select(F.lit("2200-01-01").cast("timestamp").alias("ts")).write.mode("append").parquet(closing)
            start_sink(df, path, checkpoint).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(df.schema).parquet(path)


def made(spark: SparkSession, path: str) -> str:
    """A folder that is there, so that a stream can start on it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return path


def closable(df: DataFrame, closing: str) -> DataFrame:
    """df (with a column ts) and the rows of a folder that is empty until run_to_end() ends the stream: one row far ahead, with nulls but for ts (0 or an empty string where df has no nulls), moves the watermark past all others."""
    spark: SparkSession = df.sparkSession
    made(spark, closing)
    ends = spark.readStream.schema("ts timestamp").parquet(closing)
    # the same nullability with the folder empty or not, as state keeps its schema
    value = lambda f: F.lit(None) if f.nullable else F.lit("" if f.dataType.simpleString() == "string" else 0)
    return df.unionByName(ends.select(*(F.col("ts") if f.name == "ts" else value(f).cast(f.dataType).alias(f.name) for f in df.schema)))


class Tracker(InOrder):
    """Live tracks of all cameras of a shard; a camera's frames are linked in order, those of all its cameras side by side."""

    ROW = {"ts": "long", "det_id": "long", "frame": "long", "x1": "double", "y1": "double", "x2": "double", "y2": "double", "conf": "double", "key": "string"}
    LIVE = {"key": "string", "track_id": "long", "frame": "long", "x1": "double", "y1": "double", "x2": "double", "y2": "double"}
    #: Pairs of a box and a track of its camera that are held at once.
    PAIRS = 1 << 20

    def __init__(self, high: float, low: float, max_gap: int, iou_min: float, step: int):
        super().__init__(step)
        self.high, self.low, self.max_gap, self.iou_min = high, low, max_gap, iou_min

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.live = handle.getValueState("live", packed_schema(self.LIVE))

    def due(self, key, columns: list[np.ndarray]) -> pd.DataFrame | None:
        _, det, frame, *box, conf, name = (c[columns[7] >= self.low] for c in columns)
        if not len(det):
            return None
        held = unpack(self.LIVE, self.live.get()) if self.live.exists() else [np.zeros(0, KINDS[k]) for k in self.LIVE.values()]
        codes, names = pd.factorize(np.concatenate([held[0], name]))
        n = len(held[0])
        cam, box, weak = codes[n:], np.stack(box, 1), conf < self.high
        # by camera and frame, confident boxes first; of a box that is there twice the last
        order = np.lexsort((np.arange(len(det)), det, weak, frame, cam))
        cam, frame, det, weak, box = (c[order] for c in (cam, frame, det, weak, box))
        last = np.append((cam[1:] != cam[:-1]) | (frame[1:] != frame[:-1]) | (weak[1:] != weak[:-1]) | (det[1:] != det[:-1]), True)
        cam, frame, det, weak, box = (c[last] for c in (cam, frame, det, weak, box))
        # a frame's place among those of its camera: one place after the other, all cameras that have it at once
        start = np.concatenate([[True], cam[1:] != cam[:-1]])
        nth = np.cumsum(start | np.concatenate([[True], frame[1:] != frame[:-1]]))
        place = nth - nth[start][np.cumsum(start) - 1]
        order = np.argsort(place, kind="stable")
        live = (codes[:n], held[1], held[2], np.stack(held[3:], 1))
        live = tuple(c[np.argsort(live[0], kind="stable")] for c in live)
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            live, track, found = self._linked(live, cam[own], frame[own], det[own], weak[own], box[own])
            out.append((own[found], track[found]))
        self.live.update(pack(self.LIVE, [names[live[0]], live[1], live[2], *live[3].T]))
        at, track = (np.concatenate(c) for c in zip(*out))
        keys = [json.loads(k) for k in names]
        run = np.array([k.get("k0") for k in keys], object)[cam[at]]
        camera = pd.array([int(k["k1"]) if "k1" in k else None for k in keys], "Int64")[cam[at]]
        return pd.DataFrame({"run": run, "camera_id": camera, "frame": frame[at], "det_id": det[at], "track_id": track})

    def _linked(self, live: tuple, cam: np.ndarray, frame: np.ndarray, det: np.ndarray, weak: np.ndarray, box: np.ndarray) -> tuple:
        """Live tracks after a frame of some cameras (rows by camera, as are the tracks), the track of each box, and which boxes have one."""
        at = np.minimum(np.searchsorted(cam, live[0]), len(cam) - 1)
        gone = (cam[at] == live[0]) & (frame[at] - live[2] > self.max_gap)
        live = tuple(c[~gone] for c in live)
        free = np.ones(len(live[0]), bool)
        track, found = det.copy(), np.zeros(len(det), bool)
        for sure in (True, False):  # confident boxes first; the others only extend tracks
            own = np.flatnonzero(weak != sure)
            met, named = self._met(live, cam[own], det[own], box[own])
            left, open_, took = bytearray(b"" * len(own)), bytearray(free.tobytes()), []
            for b, t in met:
                if left[b] and open_[t]:
                    left[b] = open_[t] = 0
                    took.append((b, t))
            b, t = np.array(took, np.int64).reshape(-1, 2).T
            b, free = own[b], np.frombuffer(open_, bool)
            track[b], found[b], live[2][t], live[3][t] = live[1][t], True, frame[b], box[b]
            if sure:
                new = ~weak & ~found
                found |= new
                # a new track takes the place of one of its name
                b, t = own[named[0]], named[1]
                b, t = b[new[b]], t[new[b]]
                live[2][t], live[3][t], new[b] = frame[b], box[b], False
        live = tuple(np.concatenate(c) for c in zip(live, (cam[new], det[new], frame[new], box[new])))
        order = np.argsort(live[0], kind="stable")
        return tuple(c[order] for c in live), track, found

    def _met(self, live: tuple, cam: np.ndarray, det: np.ndarray, box: np.ndarray) -> tuple:
        """Places of boxes and tracks of a camera that overlap enough, in the order of choice: most overlap, box, track; and of those that have one name."""
        low, high = np.searchsorted(live[0], cam), np.searchsorted(live[0], cam, "right")
        pairs = np.concatenate([[0], np.cumsum(high - low)])
        found, named = [], []
        for part in np.split(np.arange(len(cam)), np.flatnonzero(np.diff(pairs[:-1] // self.PAIRS)) + 1):
            n = (high - low)[part]
            b = np.repeat(part, n)
            t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)
            o = overlaps(live[3][t], box[b])
            enough, same = o >= self.iou_min, live[1][t] == det[b]
            found.append((-o[enough], b[enough], t[enough]))
            named.append((b[same], t[same]))
        o, b, t = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((live[1][t], det[b], o))
        return zip(b[order].tolist(), t[order].tolist()), tuple(np.concatenate(c) for c in zip(*named))


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """overlap() of boxes row by row."""
    w, h = (np.maximum(np.minimum(a[:, i + 2], b[:, i + 2]) - np.maximum(a[:, i], b[:, i]), 0.0) for i in (0, 1))
    with np.errstate(all="ignore"):
        inter = w * h
        union = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - inter
        return np.where(union > 0, inter / union, 0.0)


def overlap(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def track_stream(df: DataFrame, high: float = 0.5, low: float = 0.1, max_gap: int = 30, iou_min: float = 0.3, delay: str = "10 seconds", step_seconds: int = 10, shards: int = 1024) -> DataFrame:
    """Person boxes with track_id, incrementally per camera; state is bounded by the live tracks and the delay.

    shards: cameras are dealt by hash to so many groups, which share state and timer (see stream_consecutive).
    """
    schema = "run string, camera_id long, frame long, det_id long, track_id long"
    rows = df.withWatermark("ts", delay).select(*(c for c in Tracker.ROW if c != "key"), _key_text(df, ["run", "camera_id"]).alias("key"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard")
    return dealt.transformWithStateInPandas(Tracker(high, low, max_gap, iou_min, step_seconds * 1_000_000), outputStructType=schema, outputMode="Append", timeMode="EventTime")
