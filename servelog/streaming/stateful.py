"""Stream forms of the stateful operators.

Each keeps a bounded state per key in the state store and shares its step with
the batch twin. Rows of a micro-batch are taken in (event time, seq) order;
disorder across micro-batches is bounded by the watermark of the input.

Where keys are many and short-lived, a call of Python and of the state store per
key costs far more than the rows. There the rows are grouped by a hash bucket of the
key, and the state of a bucket's live keys is one value.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from servelog.functions import steps
from servelog.operators.clean import BUDGETS_MS

#: Groups of keys that share a state value; fixed for the life of a checkpoint.
BUCKETS = 1024

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Custom state needs the RocksDB provider; it spills, heap does not grow."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, ignore_index=True)


class _TokenBucket(StatefulProcessor):
    def __init__(self, key: str, rate: steps.Rate, per_token: float):
        self.key, self.rate, self.per_token = key, rate, per_token

    def _full_ms(self, tokens: int, last: int) -> int:
        """When a bucket left alone is full again, a second late: as good as a new one then."""
        wait_us = -(-(self.rate.burst - tokens) // self.rate.refill)
        return (last + wait_us) // 1000 + 1001

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "tokens long, ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["seq"])
        tokens, last = self.state.get() if self.state.exists() else (self.rate.burst, None)
        allowed, left, retry = [], [], []
        for ts in pdf["ts_us"].tolist():
            ok, tokens, wait = steps.take_token(tokens, 0 if last is None else ts - last, self.rate)
            last = ts
            allowed.append(ok)
            left.append(tokens / self.per_token)
            retry.append(wait)
        self.state.update((tokens, last))
        if self.rate.refill > 0:
            self.handle.registerTimer(self._full_ms(tokens, last))
        yield pd.DataFrame({self.key: key[0], "seq": pdf["seq"], "allowed": allowed,
                            "tokens": left, "retry_after_s": retry})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self._full_ms(*self.state.get()) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())


def stream_token_bucket(rows: DataFrame, key: str, rps: float, burst: float,
                        cost: float = 1.0, delay: str = "1 minute") -> DataFrame:
    """Rows ``(key, seq, ts_us)`` -> (key, seq, allowed, tokens, retry_after_s).

    A bucket is forgotten once the watermark, ``delay`` behind the rows, has passed the time at
    which it is full again, so state holds the keys of late only. Without refill it stays.
    Rows more than ``delay`` behind the latest one of earlier micro-batches are dropped.
    """
    use_state_store(rows.sparkSession)
    rate = steps.Rate.of(rps, burst, cost)
    schema = (f"`{key}` {dict(rows.dtypes)[key]}, seq long, allowed boolean, "
              "tokens double, retry_after_s double")
    timed = rows.select(key, "seq", "ts_us", F.timestamp_micros("ts_us").alias("__ts"))
    return timed.withWatermark("__ts", delay).groupBy(key).transformWithStateInPandas(
        _TokenBucket(key, rate, rate.cost / cost), schema, "append", "eventTime")


class _Buckets(StatefulProcessor):
    """The live keys of a bucket as one dict from key to state; ``_end_ms`` tells when a state ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("live", "keys binary")

    def _end_ms(self, state: tuple) -> int:
        raise NotImplementedError

    def _live(self) -> dict[Any, tuple]:
        return pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else {}

    def _keep(self, live: dict[Any, tuple], now_ms: int) -> None:
        """Keeps what has not ended; a timer forgets the rest should no row come any more."""
        live = {k: v for k, v in live.items() if self._end_ms(v) > now_ms}
        if live:
            self.state.update((pickle.dumps(live),))
            self.handle.registerTimer(max(map(self._end_ms, live.values())))
        elif self.state.exists():
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._live(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))
        return iter(())


def _by_bucket(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """``processor`` over buckets of ``key``, which it sees as a string; ``schema`` follows the key."""
    kind = rows.schema[key].dataType
    dealt = (rows.withColumn(key, F.col(key).cast("string"))
             .withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))))
    out = dealt.groupBy("__bucket").transformWithStateInPandas(
        processor, f"`{key}` string, {schema}", mode, "eventTime")
    return out.withColumn(key, F.col(key).cast(kind))


class _Idempotent(_Buckets):
    def __init__(self, key: str, ttl_us: int):
        self.key, self.ttl_us = key, ttl_us

    def _end_ms(self, window: tuple) -> int:
        return (window[0] + self.ttl_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, live = _in_order(rows, ["ts_us", "seq"]), self._live()
        originals, repeats = [], []
        for k, ts, rid in zip(pdf[self.key].tolist(), pdf["ts_us"].tolist(), pdf["request_id"].tolist()):
            live[k], repeat = steps.enter_window(ts, rid, self.ttl_us, live.get(k))
            originals.append(live[k][1])
            repeats.append(repeat)
        # As late as the timer: rows of this micro-batch may lie before its watermark.
        self._keep(live, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({self.key: pdf[self.key], "seq": pdf["seq"], "original_id": originals,
                            "duplicate": repeats})


def stream_idempotent(rows: DataFrame, key: str, ttl_us: int, ts: str = "ts",
                      delay: str = "1 minute") -> DataFrame:
    """Rows ``(key, seq, ts, ts_us, request_id)`` -> (key, seq, original_id, duplicate)."""
    use_state_store(rows.sparkSession)
    timed = rows.withWatermark(ts, delay).select(key, "seq", ts, "ts_us", "request_id")
    return _by_bucket(timed, key, _Idempotent(key, ttl_us),
                      "seq long, original_id string, duplicate boolean", "append")


class _Batcher(StatefulProcessor):
    def __init__(self, by: str, max_batch: int, limits: Mapping[str, int], cap: int | None):
        self.by, self.max_batch, self.limits = by, max_batch, dict(limits)
        self.cap = min(cap or max_batch, max_batch)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "seq long, ts long, priority string")

    def _close(self, queue, when, trigger, key):
        order = sorted(queue, key=lambda r: (r[2] != "high", r[1], r[0]))
        batch, rest = order[:self.cap], order[self.cap:]
        # Named by its oldest row, like the batch twin.
        first = min(batch, key=lambda r: (r[1], r[0]))[0]
        out = [(key, seq, first, trigger, when, slot)
               for slot, (seq, _, _) in enumerate(batch, start=1)]
        return out, rest

    def _due(self, queue):
        most = max(self.limits.values())
        return min(ts + self.limits.get(priority, most) for _, ts, priority in queue)

    def _emit(self, out):
        cols = [self.by, "seq", "first_seq", "trigger", "closed_us", "slot"]
        return pd.DataFrame(out, columns=cols)

    def _keep(self, queue):
        if queue:
            self.pending.put(queue)
            self.handle.registerTimer(-(-self._due(queue) // 1000))
        else:
            self.pending.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["ts_us", "seq"])
        queue = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        out = []
        for seq, ts, priority in zip(pdf["seq"].tolist(), pdf["ts_us"].tolist(), pdf["priority"]):
            while queue and self._due(queue) <= ts:
                done, queue = self._close(queue, self._due(queue), "overdue", key[0])
                out += done
            queue.append((seq, ts, priority))
            while len(queue) >= self.max_batch:
                done, queue = self._close(queue, ts, "full", key[0])
                out += done
        self._keep(queue)
        yield self._emit(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        queue = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        now_us, out = expiredTimerInfo.getExpiryTimeInMs() * 1000, []
        while queue and self._due(queue) <= now_us:
            done, queue = self._close(queue, self._due(queue), "overdue", key[0])
            out += done
        self._keep(queue)
        yield self._emit(out)


def stream_batches(rows: DataFrame, by: str, max_batch: int = 16,
                   budgets_ms: Mapping[str, float] = BUDGETS_MS, ts: str = "ts",
                   delay: str = "0 seconds", cap: int | None = None) -> DataFrame:
    """Rows ``(by, seq, ts, ts_us, priority)`` -> batches as they close.

    ``cap`` is the room of the taking worker: a batch holds at most that many
    rows, high priority first, and the rest stay queued.
    """
    use_state_store(rows.sparkSession)
    schema = (f"`{by}` {dict(rows.dtypes)[by]}, seq long, first_seq long, trigger string, "
              "closed_us long, slot long")
    return (rows.withWatermark(ts, delay).select(by, "seq", ts, "ts_us", "priority")
            .groupBy(by).transformWithStateInPandas(
                _Batcher(by, max_batch, steps.budgets_us(budgets_ms), cap),
                schema, "append", "eventTime"))


class _JobState(_Buckets):
    """A job lives ``ttl_us`` from its first event; an event after that begins it anew."""

    def __init__(self, job: str, ttl_us: int):
        self.job, self.ttl_us = job, ttl_us

    def _end_ms(self, state: tuple) -> int:
        return (state[0] + self.ttl_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, live = _in_order(rows, ["ts_us", "seq"]), self._live()
        events = zip(pdf[self.job].tolist(), pdf["ts_us"].tolist(), pdf["seq"].tolist(), pdf["status"].tolist())
        for job, *event in events:
            held, ts = live.get(job), event[0]
            if held is None or ts >= held[0] + self.ttl_us:
                live[job] = (ts, *event)
            else:
                live[job] = (min(held[0], ts), *max(held[1:], tuple(event)))
        jobs = pdf[self.job].drop_duplicates().tolist()
        states = [live[job] for job in jobs]
        self._keep(live, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({self.job: jobs, "created_us": [s[0] for s in states],
                            "updated_us": [s[1] for s in states], "status": [s[3] for s in states]})


def stream_job_state(events: DataFrame, ttl_us: int, job: str = "job_id", ts: str = "ts",
                     delay: str = "1 minute") -> DataFrame:
    """Rows ``(job, seq, ts, ts_us, status)`` -> the job's new state per update."""
    use_state_store(events.sparkSession)
    timed = events.withWatermark(ts, delay).select(job, "seq", ts, "ts_us", "status")
    return _by_bucket(timed, job, _JobState(job, ttl_us),
                      "created_us long, updated_us long, status string", "update")


class _Assembler(StatefulProcessor):
    """Holds a job's tokens until its final row is here and the watermark has passed it by
    ``wait_us``, so tokens that arrive late still take their place; then forgets the job.
    A job that gets no final row is forgotten ``ttl_us`` after its last token.

    A bucket's jobs are a dict from job to (seq and time of its final row, time of its last
    row); its tokens are a list with one entry per micro-batch, read only when a job is due."""

    def __init__(self, job: str, wait_us: int, ttl_us: int):
        self.job, self.wait_us, self.ttl_us = job, wait_us, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getListState("tokens", "rows binary")
        self.state = handle.getValueState("jobs", "jobs binary")

    def _jobs(self) -> dict[Any, tuple]:
        return pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else {}

    def _due_ms(self, state: tuple) -> int:
        end, at, last = state
        return (last + self.ttl_us if end is None else at + self.wait_us) // 1000 + 1

    def _keep(self, jobs: dict[Any, tuple]) -> None:
        if jobs:
            self.state.update((pickle.dumps(jobs),))
            self.handle.registerTimer(min(map(self._due_ms, jobs.values())))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, jobs = pd.concat(list(rows), ignore_index=True), self._jobs()
        for job, last in pdf.groupby(self.job, sort=False, dropna=False)["ts_us"].max().items():
            job = None if pd.isna(job) else job
            end, at, before = jobs.get(job, (None, None, 0))
            jobs[job] = (end, at, max(before, int(last)))
        final = pdf["final"].astype(bool)
        first = pdf[final].sort_values("seq", kind="stable").drop_duplicates(self.job)
        for job, seq, ts in zip(first[self.job].tolist(), first["seq"].tolist(), first["ts_us"].tolist()):
            end, at, last = jobs[job]
            if end is None or seq < end:
                jobs[job] = (seq, max(at or 0, ts), last)
        live = pdf[~final]
        held = [(job, seq, token) for job, seq, token in zip(
            live[self.job].tolist(), live["seq"].tolist(), live["token"].tolist())
            if jobs[job][0] is None or seq < jobs[job][0]]
        if held:
            self.tokens.appendValue((pickle.dumps(held),))
        self._keep(jobs)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, jobs = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self._jobs()
        due = {job: jobs.pop(job) for job, state in list(jobs.items()) if self._due_ms(state) <= now}
        if not due:
            return
        texts, rest = {job: [] for job, state in due.items() if state[0] is not None}, []
        for (part,) in (self.tokens.get() if self.tokens.exists() else ()):
            for job, seq, token in pickle.loads(bytes(part)):
                if job not in due:
                    rest.append((job, seq, token))
                elif job in texts and seq < due[job][0]:
                    texts[job].append((seq, token))
        if rest:
            self.tokens.put([(pickle.dumps(rest),)])
        else:
            self.tokens.clear()
        self._keep(jobs)
        if texts:
            yield pd.DataFrame({self.job: list(texts), "text": ["".join(t for _, t in sorted(r)) for r in texts.values()],
                                "n_tokens": [len(r) for r in texts.values()]})


def stream_tokens(tokens: DataFrame, job: str = "job_id", ts: str = "ts", delay: str = "1 minute",
                  wait_us: int = 0, ttl_us: int = 3600 * steps.MICROS) -> DataFrame:
    """Rows ``(job, seq, ts, ts_us, token, final)`` -> (job, text, n_tokens): the tokens before the
    first final row, once no earlier row can come any more."""
    use_state_store(tokens.sparkSession)
    timed = tokens.withWatermark(ts, delay).select(job, "seq", ts, "ts_us", "token", "final")
    return _by_bucket(timed, job, _Assembler(job, wait_us, ttl_us), "text string, n_tokens long", "append")


def stream_unacked(deliveries: DataFrame, acks: DataFrame, lease: str = "30 seconds",
                   key: str = "request_id", delay: str = "0 seconds") -> DataFrame:
    """Deliveries without an ack inside the lease, once the watermarks pass it.

    ``deliveries(key, delivered_at…)``, ``acks(key, acked_at)``. State on both
    sides is dropped when the time range can no longer match.
    """
    d = deliveries.withWatermark("delivered_at", delay).alias("d")
    a = acks.withWatermark("acked_at", delay).select(F.col(key).alias("__k"), "acked_at").alias("a")
    near = F.expr(f"d.{key} = a.__k AND a.acked_at >= d.delivered_at "
                  f"AND a.acked_at < d.delivered_at + INTERVAL {lease}")
    joined = d.join(a, near, "leftOuter")
    return joined.where(F.col("a.__k").isNull()).select("d.*")
