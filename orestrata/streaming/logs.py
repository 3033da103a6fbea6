"""Log events as a stream: parsing, redaction, filtering, archive, delivery."""

from __future__ import annotations

import re
import threading
import time
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from orestrata.functions.text import SUSPECT, any_of, redacted, redacted_object
from orestrata.operators.rollup import shards

EVENT = "event string, level string, logger string, message string, event_id string, timestamp string, method string, route string, status_code int"


def parse(lines: DataFrame, excluded: tuple[str, ...] = (), most_bytes: int = 64_000) -> DataFrame:
    """Events of the column ``value``: JSON objects field by field, other lines as messages, with defaults filled in.

    ``body`` is the whole event as JSON, unknown fields included, with secrets
    masked at any depth and ``event_id``, ``timestamp``, ``level`` and ``logger``
    added where they are absent; a line without a time gets that of its arrival.
    Lines above ``most_bytes``, loggers with an excluded prefix and successful
    health checks are dropped; null lines give no event.
    """
    e = _safe(lines.where(F.octet_length("value") <= most_bytes).select("value"))
    whole = F.startswith(F.ltrim("value"), F.lit("{")) & F.json_object_keys("value").isNotNull()
    e = e.select("value", F.when(F.col("__suspect"), F.col("__safe")).when(whole, F.col("value")).alias("__safe"))
    e = e.withColumns({
        "__j": F.from_json("__safe", EVENT), "__given": F.coalesce(F.json_object_keys("__safe"), F.array().cast("array<string>")),
        "__id": F.sha2("value", 256), "__now": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    ok = F.col("__safe").isNotNull()
    plain = F.struct(
        F.lit("python.log").alias("event"), F.lit("info").alias("level"), F.lit("root").alias("logger"), redacted(F.col("value")).alias("message"),
        F.col("__id").alias("event_id"), F.col("__now").alias("timestamp"))
    defaults = {"event_id": F.col("__id"), "timestamp": F.col("__now"), "level": F.lit("info"), "logger": F.lit("root")}
    added = F.array_compact(F.array(*[F.when(~F.array_contains("__given", k), F.concat(F.lit(f'"{k}":"'), v, F.lit('"'))) for k, v in defaults.items()]))
    head = F.regexp_replace("__safe", r"(?U)\s*\}\s*$", "")
    comma = F.when((F.size("__given") > 0) & (F.size(added) > 0), ",").otherwise("")
    out = e.select(
        F.when(ok, F.col("__j.event")).otherwise(F.lit("python.log")).alias("event"), F.coalesce(F.when(ok, F.col("__j.level")), F.lit("info")).alias("level"),
        F.coalesce(F.when(ok, F.col("__j.logger")), F.lit("root")).alias("logger"), F.when(ok, F.col("__j.message")).otherwise(plain["message"]).alias("message"),
        F.coalesce(F.when(ok, F.col("__j.event_id")), F.col("__id")).alias("event_id"), F.to_timestamp(F.coalesce("__j.timestamp", "__now")).alias("ts"),
        F.col("__j.method").alias("method"), F.col("__j.route").alias("route"), F.col("__j.status_code").alias("status_code"),
        F.when(ok, F.concat(head, comma, F.array_join(added, ","), F.lit("}"))).otherwise(F.to_json(plain)).alias("body"))
    if excluded:
        out = out.where(~any_of([F.startswith("logger", F.lit(p)) for p in excluded]))
    return out.where(~healthy(F.col("event"), F.col("method"), F.col("route"), F.col("status_code")))


def _safe(lines: DataFrame) -> DataFrame:
    """(value, __suspect, __safe): whether a line may hold a secret, and if so the redacted object, null where it is none.

    One pass in batches, so that no later expression runs it again; other lines aren't parsed here.
    """

    def run(batches):
        suspect = re.compile(SUSPECT)
        for batch in batches:
            flags, safe = [], []
            for line in batch.column(0).to_pylist():
                flags.append(line is not None and suspect.search(line) is not None)
                safe.append(redacted_object(line) if flags[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.bool_()), pa.array(safe, pa.string())], names=["value", "__suspect", "__safe"])

    return lines.mapInArrow(run, "value string, __suspect boolean, __safe string")


def healthy(event: Column, method: Column, route: Column, status: Column) -> Column:
    """A completed health check that succeeded. The event, the method and the route."""
    return F.coalesce((event == "request.completed") & (method == "GET") & (route == "/healthz") & (status >= 200) & (status < 300), F.lit(False))


def with_hour(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Partition columns ``year, month, day, hour``."""
    t = F.col(ts)
    return events.withColumns({"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)})


def archive(events: DataFrame, path: str, checkpoint: str, ts: str = "ts", most_rows: int = 100_000) -> StreamingQuery:
    """Gzipped JSON in hourly folders, all that is available now; the checkpoint makes each row land once."""
    return (
        with_hour(events, ts).writeStream.format("json").option("compression", "gzip").option("maxRecordsPerFile", most_rows).option("path", path)
        .option("checkpointLocation", checkpoint).partitionBy("year", "month", "day", "hour").trigger(availableNow=True).start())


def deliver(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Micro-batches to ``send(batch, batch_id)``, which must ignore a batch id it has seen: at least once becomes exactly once."""
    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Seconds between attempts, the last for all further ones.
RETRY_WAITS = (1.0, 2.0, 4.0, 8.0, 16.0, 30.0)


def with_retries(send: Callable[[bytes], None], attempts: int = 6, wait: Callable[[float], None] = time.sleep) -> Callable[[bytes], bool]:
    """``send`` tried again with growing waits; False once the last attempt has failed."""
    def run(payload: bytes) -> bool:
        for n in range(attempts):
            try:
                send(payload)
                return True
            except OSError:
                if n + 1 < attempts:
                    wait(RETRY_WAITS[min(n, len(RETRY_WAITS) - 1)])
        return False

    return run


class NdjsonSink:
    """Sends the ``body`` of each event in newline-framed payloads bounded by count and bytes; for ``deliver``.

    Every partition sends its own payloads as it reads its rows, so no batch is
    ever held whole. A payload that fails for good fails its task, and Spark
    runs the micro-batch again: at least once. An event above the byte bound is
    a payload of its own.
    """

    def __init__(self, send: Callable[[bytes], None], most_rows: int = 100, most_bytes: int = 1 << 20, attempts: int = 6) -> None:
        self.send, self.most_rows, self.most_bytes, self.attempts = send, most_rows, most_bytes, attempts

    def payloads(self, bodies):
        """Payloads of an iterator of event texts, in order; what doesn't fit opens the next one."""
        held, size = [], 0
        for body in bodies:
            line = body.encode() + b"\n"
            if held and (len(held) >= self.most_rows or size + len(line) > self.most_bytes):
                yield b"".join(held)
                held, size = [], 0
            held.append(line)
            size += len(line)
        if held:
            yield b"".join(held)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        sink = self

        def run(rows):
            send = with_retries(sink.send, sink.attempts)
            for payload in sink.payloads(r.body for r in rows if r.body is not None):
                if not send(payload):
                    raise RuntimeError("delivery failed")

        batch.select("body").foreachPartition(run)


def http_sender(url: str, timeout: float = 5.0) -> Callable[[bytes], None]:
    """A sender that posts a payload as NDJSON; the answer must be a success."""
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError("an absolute HTTP address is needed")

    def send(payload: bytes) -> None:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, payload, {"Content-Type": "application/x-ndjson"}), timeout=timeout) as answer:
            answer.read()

    return send


def batches(events: DataFrame, order: list[str], most_rows: int = 100, most_bytes: int = 1 << 20) -> DataFrame:
    """``shard``, the batch number of every event as one sender would cut them in this order, by count and bytes."""
    return shards(events.withColumn("bytes", F.octet_length("body") + 1), order, "bytes", most_rows, most_bytes)


class EventQueue:
    """A queue between a logger and its sender, bounded by count and bytes, that never waits: what doesn't fit is dropped and counted.

    ``put`` returns whether the event fitted; ``drops`` gives the events dropped
    since it last said so, at most once in ``report_every`` seconds.
    """

    def __init__(self, most_events: int = 1000, most_bytes: int = 8 << 20, report_every: float = 60.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.most_events, self.most_bytes, self.report_every, self.clock = most_events, most_bytes, report_every, clock
        self._events: deque[bytes] = deque()
        self._lock, self._bytes, self._dropped, self._reported = threading.Lock(), 0, 0, None

    def put(self, event: bytes) -> bool:
        with self._lock:
            fits = len(self._events) < self.most_events and self._bytes + len(event) <= self.most_bytes
            if fits:
                self._events.append(event)
                self._bytes += len(event)
            else:
                self._dropped += 1
            return fits

    def take(self, most_events: int = 100, most_bytes: int = 1 << 20) -> list[bytes]:
        """The next batch; an event above the byte bound goes alone."""
        with self._lock:
            out, size = [], 0
            while self._events and len(out) < most_events and (not out or size + len(self._events[0]) <= most_bytes):
                out.append(self._events.popleft())
                size += len(out[-1])
            self._bytes -= size
            return out

    def drops(self) -> int:
        with self._lock:
            now = self.clock()
            if not self._dropped or self._reported is not None and now - self._reported < self.report_every:
                return 0
            self._reported, n, self._dropped = now, self._dropped, 0
            return n


def windowed_drops(events: DataFrame, ts: str = "ts", width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events per minute and level, with a watermark on a stream."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), "level").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "level", "n")


def admit(events: DataFrame, key: str, ts: str, rate: float, burst: float, tie: str | None = None) -> DataFrame:
    """Token bucket per key: (key, ts, admitted), events taken in time order per key.

    Whether an event passes depends on all before it, so a key is read by one
    task, but as a sorted stream of batches of which only the bucket's fill is
    kept. Events of one time go by ``tie``. A null time counts as the earliest.
    """
    order = [key, ts] + ([tie] if tie else [])
    rows = events.select(*dict.fromkeys(order)).repartition(F.col(key)).sortWithinPartitions(*order)
    micros = F.unix_micros(F.col(ts).cast("timestamp")).alias("__at")

    def run(batches_):
        current, fill, at = object(), burst, None
        for batch in batches_:
            ok = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != current:
                    current, fill, at = k, burst, None
                if at is not None and t is not None:
                    fill = min(burst, fill + rate * ((t - at) / 1e6))
                at = t if t is not None else at
                ok.append(fill >= 1.0)
                fill -= 1.0 if ok[-1] else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=[key, ts, "admitted"])

    return rows.select(key, ts, micros).mapInArrow(run, events.select(key, ts).schema.add("admitted", "boolean"))
