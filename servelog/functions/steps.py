"""Pure per-key steps shared by the batch operators and their stream forms."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np

MICROS = 1_000_000


# --- token bucket -----------------------------------------------------------
# Token counts are integers in units of 1 / (1e6 * q) of a token, where the rate
# is p / q tokens per second, so a microsecond refills exactly p units. Integer
# state makes every split of a key's rows give the same decisions.

@dataclass(frozen=True)
class Rate:
    """Refill per microsecond, bucket size and cost in integer units."""
    refill: int
    burst: int
    cost: int

    @classmethod
    def of(cls, rps: float, burst: float, cost: float = 1.0) -> Rate:
        depth = burst if burst > 0 else rps
        exact = Fraction(rps).limit_denominator(1_000_000)
        if float(exact) != rps:  # as fine as 64-bit states of the bucket allow
            exact = Fraction(rps).limit_denominator(max(1_000_000, int((1 << 61) // (MICROS * max(depth, cost, 1)))))
        unit = MICROS * exact.denominator
        if unit * max(depth, cost) >= 1 << 62:
            raise ValueError(f"a bucket of {depth} tokens at {rps} per second needs more than 64 bits")
        return cls(exact.numerator, round(Fraction(depth).limit_denominator(1_000_000) * unit),
                   round(Fraction(cost).limit_denominator(1_000_000) * unit))


def take_token(tokens: int, gap_us: int, rate: Rate) -> tuple[bool, int, float]:
    """(allowed, tokens left, retry_after seconds) after refilling for the gap."""
    tokens = min(rate.burst, tokens + max(0, gap_us) * rate.refill)
    if tokens >= rate.cost:
        return True, tokens - rate.cost, 0.0
    if rate.refill <= 0:
        return False, tokens, float("inf")
    return False, tokens, (rate.cost - tokens) / (rate.refill * MICROS)


Pieces = list[tuple[int, int, int]]


def bucket_transfer(gaps_us: Sequence[int], rate: Rate) -> Pieces:
    """Tokens after the rows as a function of tokens before them.

    The function is a list of (start, value, slope) pieces over 0..burst. A gap
    that refills the bucket makes it constant; otherwise each row cuts the piece
    that straddles the cost, and the two halves meet again at the next accept,
    which keeps about burst/cost pieces however many rows there are.
    """
    top, last_full = rate.burst, -1
    for i, gap in enumerate(gaps_us):
        if max(0, gap) * rate.refill >= top:
            last_full = i
    if last_full >= 0:
        tokens = top
        for gap in gaps_us[last_full:]:
            _, tokens, _ = take_token(tokens, gap, rate)
        return [(0, tokens, 0)]
    pieces: Pieces = [(0, 0, 1)]
    for gap in gaps_us:
        pieces = _step_pieces(pieces, max(0, gap) * rate.refill, rate)
    return pieces


def _step_pieces(pieces: Pieces, add: int, rate: Rate) -> Pieces:
    burst, cost = rate.burst, rate.cost
    out: Pieces = []
    ends = [p[0] for p in pieces[1:]] + [burst + 1]
    last_start = last_value = last_slope = None
    for (start, value, slope), end in zip(pieces, ends):
        value += add
        # Cut a rising piece where it reaches the cost and where the bucket is full.
        parts = [start]
        if slope:
            reach = value + end - 1 - start
            if value < cost <= reach:
                parts.append(start + cost - value)
            if value < burst <= reach and burst != cost:
                parts.append(start + burst - value)
        for at in sorted(parts):
            v, k = value + slope * (at - start), slope
            if v >= burst:
                v, k = burst, 0
            if v >= cost:
                v -= cost
            if last_slope == k and v == last_value + k * (at - last_start):
                continue  # goes on from the piece before it
            out.append((at, v, k))
            last_start, last_value, last_slope = at, v, k
    return out


def apply_transfer(pieces: Pieces, tokens: int) -> int:
    start, value, slope = pieces[bisect_right(pieces, tokens, key=lambda p: p[0]) - 1]
    return value + slope * (tokens - start)


# --- idempotency window -----------------------------------------------------

Window = tuple[int, str]


def enter_window(ts: int, row_id: str, ttl_us: int, opened: Window | None) -> tuple[Window, bool]:
    """(window the row falls in, whether it is a duplicate of that window's row)."""
    if opened is None or ts >= opened[0] + ttl_us:
        return (ts, row_id), False
    return opened, True


def last_windows(ts: np.ndarray, ttl_us: int) -> np.ndarray:
    """For each row of ascending ``ts``: if a window opens there, the row that opens the last
    window of the slice."""
    following = np.searchsorted(ts, ts + ttl_us, "left")
    last = np.arange(len(ts))
    for i in range(len(ts) - 1, -1, -1):
        if following[i] < len(ts):
            last[i] = last[following[i]]
    return last


# --- size-or-deadline batches -----------------------------------------------

def batch_end(ts_us: Sequence[int], due_us: Sequence[int], start: int,
              max_batch: int) -> tuple[int, int, str | None]:
    """(first row after the batch, close time, trigger) of a batch at ``start``.

    It closes when it holds ``max_batch`` rows or when its most urgent row is
    due, whichever comes first. Trigger is None while rows may still join.
    """
    due, i, n = None, start, len(ts_us)
    while i < n:
        if due is not None and ts_us[i] >= due:
            return i, due, "overdue"
        due = due_us[i] if due is None else min(due, due_us[i])
        i += 1
        if i - start == max_batch:
            return i, ts_us[i - 1], "full"
    return i, due, None


def budgets_us(budgets_ms: Mapping[str, float]) -> dict[str, int]:
    return {name: round(ms * 1000) for name, ms in budgets_ms.items()}
