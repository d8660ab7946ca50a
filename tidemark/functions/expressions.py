"""Column expressions: clock keys, wall clocks, stretches of time, scaling, costs of a trade, names, markup."""

from __future__ import annotations

import hashlib
import re
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_NS_OF = {"d": 86_400_000_000_000, "h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000}
_PIECE = r"([0-9]+(?:[.][0-9]+)?) *([dhms])"
_STRETCH = rf"(?: *{_PIECE} *)+"


def stretch_ns(text: str) -> int:
    """Nanoseconds of a stretch of time in days, hours, minutes and seconds: ``90s``, ``1h30m``, ``1.5d``."""
    if not re.fullmatch(_STRETCH, text.lower()):
        raise ValueError(f"{text!r} is no stretch of time: numbers with d, h, m or s, such as 1h30m")
    return int(sum(Decimal(n) * _NS_OF[unit] for n, unit in re.findall(_PIECE, text.lower())))


def stretch_ns_of(text: Column) -> Column:
    """`stretch_ns` of a text column; null where the text is no stretch of time."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(_PIECE), F.lit(0))
    unit = lambda p: F.coalesce(*[F.when(F.endswith(p, F.lit(u)), F.lit(n)) for u, n in _NS_OF.items()])
    ns = lambda p: (F.regexp_extract(p, _PIECE, 1).cast("decimal(18,9)") * unit(p)).cast("decimal(38,0)")
    total = F.aggregate(pieces, F.lit(0).cast("decimal(38,0)"), lambda sum_, p: (sum_ + ns(p)).cast("decimal(38,0)"))
    return F.when(F.lower(text).rlike(f"^{_STRETCH}$"), total.cast("long"))


def iso_ns(text: Column) -> Column:
    """UTC nanoseconds of an ISO 8601 text; one without an offset is in UTC, one that is no time gives null."""
    zoned = F.when(text.rlike(r"([Zz]|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned)) * 1000


def whole(ns: Column, unit: int) -> Column:
    """How many whole units lie in nanoseconds, rounded down; exact where a division of doubles is not."""
    return F.call_function("div", ns - F.pmod(ns, F.lit(unit)), F.lit(unit))


def ntz(ns: Column) -> Column:
    """The UTC clock of nanoseconds as a timestamp without zone, whatever the session's zone."""
    return F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(secs=whole(ns, 1_000_000_000))


def hour_key(ns: Column) -> Column:
    return F.date_format(ntz(ns), "yyyyMMdd'T'HH")


def day_key(ns: Column) -> Column:
    return F.date_format(ntz(ns), "yyyy-MM-dd")


def week_key(ns: Column) -> Column:
    """ISO year and week, as in 2024-W01."""
    at = ntz(ns)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def wall_ns(clock: Column, zone: str = "America/New_York") -> Column:
    """UTC nanoseconds of a wall clock (a timestamp without zone) in a zone, daylight saving included."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), clock)
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz '1970-01-01 00:00:00'"), utc) * 1000


def over(value: Column, divisor: Column) -> Column:
    """``value / divisor``; null where the divisor is missing or 0."""
    return F.when(divisor != 0, value / divisor)


def is_namespaced(coin: Column) -> Column:
    """Whether a name carries the venue that listed it in front of a colon."""
    return F.contains(coin, F.lit(":"))


def without_markup(html: Column) -> Column:
    """Text between tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"[ \t\n\x0B\f\r]+", " "))


class Term(NamedTuple):
    """A row of a trade's costs: so many basis points, so many times, for each hour held if ``hourly``."""

    name: str
    bps: float
    times: int
    hourly: bool


#: A trade's costs in basis points, each paid on the way in and out, once, or by the hour; the safety multiple.
COSTS = {
    "maker": (Term("maker fee", 1.5, 2, False), Term("half spread", 1.0, 2, False), Term("slippage", 1.0, 1, False), Term("funding", 0.0, 1, True)),
    "taker": (Term("taker fee", 4.5, 2, False), Term("half spread", 1.0, 2, False), Term("slippage", 1.0, 1, False), Term("funding", 0.0, 1, True)),
}
SAFETY = 2.0


def cost_bps(terms: tuple[Term, ...], hours: Column | float = 1.0) -> Column:
    """What a trade held for some hours costs, in and out."""
    held = hours if isinstance(hours, Column) else F.lit(hours)
    cost = F.lit(0.0)
    for term in terms:
        cost = cost + F.lit(term.bps * term.times) * (held if term.hourly else 1)
    return cost


def cost_id(terms: tuple[Term, ...]) -> str:
    """A digest of the terms, to be kept with what was computed from them; their order does not matter."""
    return hashlib.sha256("\n".join(sorted("\t".join(map(str, t)) for t in terms)).encode()).hexdigest()


def worth_betting(move_bps: Column, terms: tuple[Term, ...], hours: Column | float = 1.0, safety: float = SAFETY) -> Column:
    """The probability from which a bet on ``move_bps`` up or down pays ``safety`` times its costs: 0.99 at most, 1 where nothing moves."""
    margin = cost_bps(terms, hours) * safety / move_bps
    return F.when(move_bps > 0, F.least((1 + margin) / 2, F.lit(0.99))).otherwise(1.0)
