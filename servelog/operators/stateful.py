"""Batch twins of the per-key stateful operators.

A key may hold a third of the log, so none of these folds a whole key in one
task. Rows get a position inside their key and are cut into slices of equal
size; each slice is summarised as a function from the state before it to the
state after it, the summaries (one row per slice) are chained per key, and every
slice is then folded on its own from its known start state.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelog.functions import steps
from servelog.operators.clean import BUDGETS_MS
from servelog.plans.folds import fold_sorted, spread
from servelog.plans.joins import solid
from servelog.plans.sliced import dense_slice, even_slice, sliced_lag, sliced_row_number
from servelog.session import cut

FOLD_ROWS = 250_000


def _cells(df: DataFrame, key: str, order: list[str], slice_: Column, rows: int) -> DataFrame:
    """Add ``pos`` (1.. per key in order) and ``cell`` (slice of ``rows`` rows)."""
    placed = sliced_row_number(df, [key], order, slice_, "pos")
    return placed.withColumn("cell", F.floor((F.col("pos") - 1) / rows).cast("long"))


def _full_cells(placed: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, cell) of slices some later slice of the key depends on."""
    counts = placed.groupBy(key, "cell").agg(F.count(F.lit(1)).alias("c"))
    return counts.where(F.col("c") == rows).select(key, "cell")


def token_bucket(df: DataFrame, key: str, rps: float, burst: float, cost: float = 1.0,
                 ts_us: str = "ts_us", order: str = "seq", slice_: Column | None = None,
                 fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Add ``allowed``, ``tokens`` (left) and ``retry_after_s``.

    A key starts full, refills ``rps`` per second up to ``burst`` (``rps`` if
    not positive), and a rejected row takes nothing. Rows are judged in ``order``.
    """
    rate = steps.Rate.of(rps, burst, cost)
    slice_ = dense_slice(order) if slice_ is None else slice_
    placed = _cells(df, key, [order], slice_, fold_rows)
    placed = sliced_lag(placed, [key], ["pos"], F.col("cell"), [ts_us], "__p")
    placed = cut(placed.withColumn("__gap", F.coalesce(F.col(ts_us) - F.col(f"__p.{ts_us}"),
                                                       F.lit(0))).drop("__p"))
    full = cut(_full_cells(placed, key, fold_rows))
    start = _bucket_starts(placed, full, key, rate)

    per_token, names = rate.cost / cost, df.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens = None, rate.burst
        for pdf in batches:
            allowed, left, retry = [], [], []
            for k, cell, start, gap in zip(pdf[key].tolist(), pdf["cell"].tolist(),
                                           pdf["__start"].tolist(), pdf["__gap"].tolist()):
                if (k, cell) != current:
                    current, tokens = (k, cell), rate.burst if start < 0 else start
                ok, tokens, wait = steps.take_token(tokens, gap, rate)
                allowed.append(ok)
                left.append(tokens / per_token)
                retry.append(wait)
            yield pdf[names].assign(allowed=allowed, tokens=left, retry_after_s=retry)

    ready = placed.join(start, [key, "cell"], "left").withColumn(
        "__start", F.coalesce("__start", F.lit(-1)))
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return fold_sorted(ready.select(*df.columns, "cell", "__gap", "__start", "pos"),
                       [key, "cell"], ["pos"], fold,
                       f"{fields}, allowed boolean, tokens double, retry_after_s double")


def _bucket_starts(placed: DataFrame, full: DataFrame, key: str, rate: steps.Rate) -> DataFrame:
    """(key, cell, __start): tokens before each slice but a key's first."""
    key_type = dict(placed.dtypes)[key]
    piece = "array<struct<s:long,v:long,k:int>>"

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pieces = steps.bucket_transfer(pdf["__gap"].tolist(), rate)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "cell": [pdf["cell"].iloc[0]],
                             "f": [[{"s": s, "v": v, "k": k} for s, v, k in pieces]]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        tokens, after = rate.burst, []
        for pieces in pdf["f"]:
            tokens = steps.apply_transfer([(p["s"], p["v"], p["k"]) for p in pieces], tokens)
            after.append(tokens)
        return pd.DataFrame({key: pdf[key], "cell": pdf["cell"] + 1, "__start": after})

    need = placed.select(key, "cell", "pos", "__gap").join(full, [key, "cell"], "left_semi")
    return (spread(need, key, "cell").groupBy(key, "cell")
            .applyInPandas(summarise, f"`{key}` {key_type}, cell long, f {piece}")
            .groupBy(key).applyInPandas(chain, f"`{key}` {key_type}, cell long, __start long"))


def idempotent(df: DataFrame, key: str, ttl_us: int, ts_us: str = "ts_us", order: str = "seq",
               row_id: str = "request_id", slice_: Column | None = None,
               fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Add ``original_id`` and ``duplicate``.

    The first row of a key, by time and then ``order``, opens a window; rows within
    ``ttl_us`` of it are duplicates of it; repeats do not extend it. A NULL key is a key.

    A slice of a key's rows maps the window that is open before it to the one open after
    it: the next window starts at the first row past the old one, and from there on all
    is settled. ``slice_`` never decreases along the time.
    """
    fields, names = ", ".join(f"`{n}` {t}" for n, t in df.dtypes), df.columns
    slice_ = even_slice(df, ts_us) if slice_ is None else slice_
    keyed = df.withColumn("__key", solid(key))
    placed = cut(_cells(keyed, "__key", [ts_us, order], slice_, fold_rows))
    full = cut(_full_cells(placed, "__key", fold_rows))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        last = steps.last_windows(pdf[ts_us].to_numpy(), ttl_us)
        # Rows that lead to the same last window need one entry, the first of them.
        heads = np.flatnonzero(np.diff(last, prepend=-1))
        return pd.DataFrame({
            "__key": [pdf["__key"].iloc[0]], "cell": [pdf["cell"].iloc[0]],
            "upto": [pdf[ts_us].to_numpy()[np.append(heads[1:], len(last)) - 1].tolist()],
            "opened": [pdf[ts_us].to_numpy()[last[heads]].tolist()],
            "id": [pdf[row_id].to_numpy()[last[heads]].tolist()]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        at, name, after = None, None, []
        for upto, opened, ids in zip(pdf["upto"], pdf["opened"], pdf["id"]):
            # The first row at or past the end of the open window starts the next one.
            i = 0 if at is None else bisect_left(upto, at + ttl_us)
            if i < len(upto):
                at, name = int(opened[i]), ids[i]
            after.append((at, name))
        return pd.DataFrame({"__key": pdf["__key"], "cell": pdf["cell"] + 1,
                             "__at": [a for a, _ in after], "__id": [n for _, n in after]})

    need = placed.select("__key", "cell", "pos", ts_us, row_id).join(full, ["__key", "cell"], "left_semi")
    start = (spread(need, "__key", "cell").groupBy("__key", "cell")
             .applyInPandas(settle, "`__key` string, cell long, upto array<long>, opened array<long>, id array<string>")
             .groupBy("__key").applyInPandas(chain, "`__key` string, cell long, `__at` long, `__id` string"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened = None, None
        for pdf in batches:
            originals, repeats = [], []
            for k, cell, at, name, ts, rid in zip(*(pdf[c].tolist() for c in (
                    "__key", "cell", "__at", "__id", ts_us, row_id))):
                if (k, cell) != current:
                    current, opened = (k, cell), None if name is None and at < 0 else (at, name)
                opened, repeat = steps.enter_window(ts, rid, ttl_us, opened)
                originals.append(opened[1])
                repeats.append(repeat)
            yield pdf[names].assign(original_id=originals, duplicate=repeats)

    none = F.lit(-(1 << 62))
    ready = placed.join(start, ["__key", "cell"], "left").withColumn("__at", F.coalesce("__at", none))
    return fold_sorted(ready, ["__key", "cell"], ["pos"], fold,
                       f"{fields}, original_id string, duplicate boolean")


def size_or_deadline_batches(df: DataFrame, by: str, max_batch: int = 16,
                             budgets_ms: Mapping[str, float] = BUDGETS_MS,
                             ts_us: str = "ts_us", order: str = "seq",
                             slice_: Column | None = None,
                             fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Add ``batch_no`` (position of its first row), ``trigger``, ``closed_us``
    and ``slot`` (high priority first, then arrival order).

    A row of an unknown priority waits as long as the most patient known one. A batch
    empties the queue, so where the next batch starts depends only on
    where this one did, and a batch reaches at most ``max_batch`` rows into the
    next slice. A slice is therefore summarised by the ``max_batch`` possible
    starts near its head, each mapped to a start in the next slice.
    """
    limits = steps.budgets_us(budgets_ms)
    slice_ = dense_slice(order) if slice_ is None else slice_
    by_type = dict(df.dtypes)[by]
    placed = _cells(df, by, [ts_us, order], slice_, fold_rows)
    due = F.col(ts_us) + max(limits.values())
    for name, budget in limits.items():
        due = F.when(F.col("priority") == name, F.col(ts_us) + budget).otherwise(due)
    placed = cut(placed.withColumn("__due", due))
    # The head of a slice is also read by the slice before it.
    head = (F.col("cell") > 0) & ((F.col("pos") - 1) % fold_rows < max_batch)
    seen_by = F.when(head, F.array(F.col("cell"), F.col("cell") - 1)).otherwise(F.array("cell"))
    shared = placed.withColumn("cell", F.explode(seen_by))
    full = cut(_full_cells(placed, by, fold_rows))

    def starts_after(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        ts, due_us = pdf[ts_us].tolist(), pdf["__due"].tolist()
        jump: dict[int, int] = {}
        exits = []
        for at in range(max_batch):
            while at < fold_rows:
                if at not in jump:
                    jump[at] = steps.batch_end(ts, due_us, at, max_batch)[0]
                at = jump[at]
            exits.append(at - fold_rows)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "cell": [pdf["cell"].iloc[0]], "f": [exits]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        at, after = 0, []
        for exits in pdf["f"]:
            at = int(exits[at])
            after.append(at)
        return pd.DataFrame({by: pdf[by], "cell": pdf["cell"] + 1, "__start": after})

    heads = (shared.select(by, "cell", "pos", ts_us, "__due")
             .join(full, [by, "cell"], "left_semi"))
    entry = (spread(heads, by, "cell").groupBy(by, "cell")
             .applyInPandas(starts_after, f"`{by}` {by_type}, cell long, f array<int>")
             .groupBy(by).applyInPandas(chain, f"`{by}` {by_type}, cell long, __start long"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        ts, due_us, pos = pdf[ts_us].tolist(), pdf["__due"].tolist(), pdf["pos"].tolist()
        own_end = (int(pdf["cell"].iloc[0]) + 1) * fold_rows
        first = pdf["__start"].iloc[0]
        at = 0 if pd.isna(first) else int(first)
        taken, numbers, triggers, closed = [], [], [], []
        while at < len(pos) and pos[at] <= own_end:
            end, when, trigger = steps.batch_end(ts, due_us, at, max_batch)
            size = end - at
            taken.extend(range(at, end))
            numbers += [pos[at]] * size
            triggers += [trigger or "overdue"] * size
            closed += [when] * size
            at = end
        pdf = pdf.iloc[taken].drop(columns=["cell", "__due", "__start", "pos"])
        pdf = pdf.assign(batch_no=numbers, trigger=triggers, closed_us=closed)
        urgent = (pdf["priority"] != "high").astype(int)
        ranked = pdf.assign(__u=urgent).sort_values(["batch_no", "__u", ts_us, order])
        return ranked.assign(slot=ranked.groupby("batch_no").cumcount() + 1).drop(columns="__u")

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    ready = (shared.join(entry, [by, "cell"], "left")
             .select(*df.columns, "cell", "__due", "__start", "pos"))
    return (spread(ready, by, "cell").groupBy(by, "cell").applyInPandas(
                fold, f"{fields}, batch_no long, trigger string, closed_us long, slot long"))


def worker_liveness(heartbeats: DataFrame, ttl_us: int, worker: str = "worker_id",
                    ts_us: str = "ts_us") -> DataFrame:
    """(worker, up_from_us, up_until_us, beats): intervals a worker was alive.

    Beats inside one ttl-wide bucket belong together, so they are merged
    map-side first; the window then sees at most one row per worker and ttl.
    """
    spans = (heartbeats.groupBy(worker, F.floor(F.col(ts_us) / ttl_us).alias("__b"))
             .agg(F.min(ts_us).alias("a"), F.max(ts_us).alias("z"), F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy(worker).orderBy("__b")
    gap = F.col("a") - F.lag("z").over(order)
    marked = spans.withColumn("new", F.coalesce((gap >= ttl_us).cast("int"), F.lit(1)))
    marked = marked.withColumn("life", F.sum("new").over(order))
    return (marked.groupBy(worker, "life")
            .agg(F.min("a").alias("up_from_us"), (F.max("z") + ttl_us).alias("up_until_us"),
                 F.sum("n").alias("beats")).drop("life"))


def active_workers(lives: DataFrame, at_us: int, worker: str = "worker_id") -> DataFrame:
    """Workers up at a time; the fleet is ready iff there is one."""
    return lives.where((F.col("up_from_us") <= at_us) & (F.col("up_until_us") > at_us)).select(worker)


def job_state(events: DataFrame, now_us: Column, ttl_us: int = 3600 * steps.MICROS,
              job: str = "job_id", ts_us: str = "ts_us", seq: str = "seq",
              carry: tuple[str, ...] = ("status",), slice_: Column | None = None) -> DataFrame:
    """Latest values per job that was created less than ``ttl_us`` ago. A job lives that long
    from its first event; an event after that creates it anew."""
    lives = idempotent(events.withColumn("__opened", F.col(ts_us).cast("string")), job, ttl_us,
                       ts_us, seq, "__opened", slice_)
    last = F.max(F.struct(F.col("original_id").cast("long").alias("created"), ts_us, seq, *carry))
    got = lives.groupBy(job).agg(last.alias("last"))
    return (got.where(now_us - F.col("last.created") < ttl_us)
            .select(job, F.col("last.created").alias("created_us"), F.col(f"last.{ts_us}").alias("updated_us"),
                    *[F.col(f"last.{c}").alias(c) for c in carry]))


def assemble_tokens(tokens: DataFrame, job: str = "job_id", seq: str = "seq",
                    token: str = "token", final: str = "final",
                    slice_rows: int = 10_000) -> DataFrame:
    """(job, text, n_tokens, complete): tokens before the first final row.

    Text is joined per slice of the sequence first, so a long job is sorted in
    pieces and only its own text is gathered.
    """
    ends = tokens.groupBy(job).agg(F.min(F.when(F.col(final), F.col(seq))).alias("__end"))
    live = tokens.join(ends, job)
    shown = F.col("__end").isNull() | (F.col(seq) < F.col("__end"))
    piece = F.array_sort(F.collect_list(F.when(shown, F.struct(seq, token))))
    parts = (live.groupBy(job, F.floor(F.col(seq) / slice_rows).alias("__s"))
             .agg(F.array_join(F.transform(piece, lambda r: r[token]), "").alias("part"),
                  F.count_if(shown).alias("n"), F.max("__end").alias("__end")))
    whole = F.array_sort(F.collect_list(F.struct("__s", "part")))
    return (parts.groupBy(job)
            .agg(F.array_join(F.transform(whole, lambda r: r["part"]), "").alias("text"),
                 F.sum("n").alias("n_tokens"), F.max("__end").isNotNull().alias("complete")))
