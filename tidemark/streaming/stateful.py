"""Streams with state of their own: alerts of silent coins, and crossings of a moving average.

Both keep a small state for each coin in the state store, so a restart goes on where
the last run stopped and no alert is sent twice. What many rows of a coin say is
summed up inside the tasks that read them, before the shuffle by coin: the task of a
hot coin gets a row for each stretch or bar, not one for each print.

Silences. A coin is silent when nothing of it arrives for longer than ``quiet``. A timer
set at the last arrival opens the alert when the watermark passes it (other coins go
on arriving), or the arrival that ends the silence does, whichever is seen first;
that arrival closes it, and gives its length by ISO week. Rows are a function of the
arrivals alone, however they are dealt to micro-batches, as long as a coin's
arrivals come in order. An arrival behind the coin's last one changes nothing.

Crossings. A bar is closed when the watermark has passed its end and the coin has a
later bar; closed bars go, in order, through a window of closes and a held side. The
side changes when the close clears the mean by ``band``; the first side is silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.expressions import whole
from tidemark.operators.ordered import DAY, HOUR

MS = 1_000_000
WEEK = 7 * DAY
#: 1970-01-05, a Monday, in ns.
MONDAY = 4 * DAY

GAP_EVENTS = "coin string, event string, t_from long, t_to long, week long, ns long"
CROSSINGS = "coin string, t_open long, close double, held int"

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stretches(times: list[tuple[int, int]], quiet: int) -> list[tuple[int, int]]:
    """Stretches (first, last) merged where the pause between them is no silence."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(times):
        if out and a - out[-1][1] <= quiet:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def by_week(t_from: int, t_to: int) -> list[tuple[int, int]]:
    """A stretch of time as (week since 1970-01-05, ns in it)."""
    weeks = range((t_from - MONDAY) // WEEK, (t_to - MONDAY) // WEEK + 1)
    return [(w, min(t_to, (w + 1) * WEEK + MONDAY) - max(t_from, w * WEEK + MONDAY)) for w in weeks]


class Silences(StatefulProcessor):
    """Alerts of one coin: an 'open' row once a silence is certain, a 'recovery' row for each ISO week of it at its end."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, alerted boolean")

    def _due(self, last: int) -> int:
        """The first millisecond at which a silence since ``last`` is certain."""
        return (last + self.quiet) // MS + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [(a, b) for part in rows for a, b in zip(part["first"].tolist(), part["last"].tolist(), strict=True)]
        last, alerted = self.seen.get() if self.seen.exists() else (None, False)
        before, out = last, []
        for a, b in _stretches(arrived, self.quiet):
            if last is not None and a - last > self.quiet:
                if not alerted:
                    out.append((key[0], "open", last, None, None, None))
                out += [(key[0], "recovery", last, a, w, ns) for w, ns in by_week(last, a)]
            if last is None or b > last:
                last, alerted = b, False
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(last))
        self.seen.update((last, alerted))
        if out:
            yield _frame(out, GAP_EVENTS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, alerted = self.seen.get()
        if not alerted and self._due(last) <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.update((last, True))
            yield _frame([(key[0], "open", last, None, None, None)], GAP_EVENTS)

    def close(self) -> None:
        pass


class Crossings(StatefulProcessor):
    """Changes of one coin's side of its moving average; state: bars not yet closed, the last closes, the side held."""

    def __init__(self, n: int, band: float, width: int):
        self.n, self.band, self.width = n, band, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "t_open long", "t_event long, seq long, px double")
        self.line = handle.getValueState("line", "closes array<double>, held int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for t_open, *bar in part[["t_open", "t_event", "seq", "px"]].itertuples(index=False, name=None):
                at = (int(t_open),)
                held = self.bars.getValue(at) if self.bars.containsKey(at) else None
                if held is None:
                    self.handle.registerTimer((int(t_open) + self.width) // MS)
                if held is None or tuple(bar[:2]) >= tuple(held)[:2]:
                    self.bars.updateValue(at, (int(bar[0]), int(bar[1]), float(bar[2])))
        yield from self._closed(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._closed(key, timerValues.getCurrentWatermarkInMs())

    def _closed(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        opens = sorted(k[0] for k in self.bars.keys())
        ready = [t for t in opens[:-1] if (t + self.width) // MS <= watermark]
        if not ready:
            return
        closes, held = self.line.get() if self.line.exists() else ([], None)
        closes, out = list(closes), []
        for t in ready:
            close = self.bars.getValue((t,))[2]
            self.bars.removeKey((t,))
            closes = [*closes, close][-self.n :]
            if len(closes) < self.n:
                continue
            mean = round(sum(closes) / self.n, 9)
            side = 1 if close > mean * (1 + self.band) else -1 if close < mean * (1 - self.band) else held
            if held is not None and side != held:
                out.append((key[0], t, close, side))
            held = side
        self.line.update((closes, held))
        if out:
            yield _frame(out, CROSSINGS)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = {"long": "Int64", "int": "Int32", "double": "float64", "string": "object"}
    columns = [c.split() for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=[c for c, _ in columns], dtype=object).astype({c: kinds[k] for c, k in columns})


def gap_events(arrivals: DataFrame, quiet: int, delay: str = "0 seconds") -> DataFrame:
    """Alert rows (`GAP_EVENTS`) of a stream with ``coin`` and ``t_ingest``."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for coin, rows in part.groupby("coin"):
                told = _stretches([(t, t) for t in rows["t_ingest"].unique().tolist()], quiet)
                yield pd.DataFrame({"coin": coin, "first": [a for a, _ in told], "last": [b for _, b in told]})

    spans = arrivals.where("coin is not null").select("coin", "t_ingest").mapInPandas(sums, "coin string, first long, last long")
    timed = spans.withColumn("at", F.timestamp_micros(whole(F.col("last"), 1000))).withWatermark("at", delay)
    return timed.groupBy("coin").transformWithStateInPandas(statefulProcessor=Silences(quiet), outputStructType=GAP_EVENTS, outputMode="Append", timeMode="EventTime")


def crossings(prints: DataFrame, n: int = 12, band: float = 0.001, width: int = HOUR, delay: str = "0 seconds") -> DataFrame:
    """Crossing rows (`CROSSINGS`) of a stream of prints with ``coin``, ``t_event``, ``seq`` and ``px``."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            last = part.assign(t_open=part["t_event"] // width * width).sort_values(["t_event", "seq"]).groupby(["coin", "t_open"], as_index=False).last()
            yield last[["coin", "t_open", "t_event", "seq", "px"]]

    closes = prints.where("coin is not null").select("coin", "t_event", "seq", "px").mapInPandas(sums, "coin string, t_open long, t_event long, seq long, px double")
    timed = closes.withColumn("at", F.timestamp_micros(whole(F.col("t_event"), 1000))).withWatermark("at", delay)
    return timed.groupBy("coin").transformWithStateInPandas(statefulProcessor=Crossings(n, band, width), outputStructType=CROSSINGS, outputMode="Append", timeMode="EventTime")
