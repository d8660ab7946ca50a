"""Benchmark decontamination by template windows with slot consistency.

Texts are canonicalised word by word: punctuation around a word and case are
dropped; a number, in digits or as an English number word, becomes ``<num>``, a
unit behind a number ``<unit>``, and a capitalised word inside a sentence
``<name>``. A template is a run of ``WINDOW`` canonical words. A capitalised word
that opens a sentence and a word all in capitals may be a name or not: a window
with such words has a second template where they are ``<name>`` too, unless
nothing but slots would be left of it, and is found by either. A document's
windows are hash-joined to the items' windows; where both have slots, the values
of the document must follow from the item's by one one-to-one replacement for
the whole item (slot consistency), else the window does not count. Replacements
are read off aligned places: hits with the same difference of document and item
position are bound together, the pairs of values with most windows first; then
the item's other windows join from the nearest place that agrees, and the best
place counts. An item is in a document if ``SIMILARITY`` or more of its distinct
windows are. Windows of the plain words (no placeholders) count too, so that a
copy in lower case is found as well.

The items' windows are joined inside the tasks that read the documents as long
as there are at most ``BROADCAST_WINDOWS`` of them (counted first); beyond, the
documents' windows are shuffled to them on the window's hash, with equal
results. Items shorter than a window are one window. `decontaminate` judges and
filters in the pass that reads the documents, so that no text is shuffled on the
first way; on the second, ids of windows are.

Words are cut out and canonicalised for a megabyte of texts at once, by arrays of
places in its bytes; words not in ASCII, long ones and numbers in digits one by
one, with equal forms. Only windows that items have get values and places.

Null and empty texts have no windows; items without words match nothing.
Repeated rows each count for their id; rows with a null id are judged too and
carry the null. A very long text is one task's arrays of words and the windows
that items have. Empty tables find nothing and leave all documents. Extra
columns, whatever their names, are ignored by `contaminated` and kept by
`decontaminate`.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import bounded_batches, cut, fits, free_name, raw_texts

WINDOW = 5
SIMILARITY = 0.8
#: Above this many item windows (about 150 bytes each where they are held, once a worker) the join is a shuffle join.
BROADCAST_WINDOWS = 500_000

#: Units that become a slot behind a number.
UNITS = frozenset(
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons tonne tonnes lb lbs pound pounds oz ounce ounces "
    "ml cl l liter liters litre litres gallon gallons ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "kmh km/h mph m/s hz khz mhz ghz v volt volts w kw watt watts j kj joule joules cal kcal n pa kpa bar k c f degree degrees percent "
    "dollar dollars cent cents euro euros usd eur gbp".split()
)
_ONES, _TENS = "one two three four five six seven eight nine".split(), "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: English number words.
NUMBER_WORDS = frozenset(
    [*_ONES, *_TENS, *(f"{t}-{o}" for t in _TENS for o in _ONES)]
    + "zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen dozen hundred thousand million billion".split()
)
#: Signs that are a number's unit when they stand at it.
SIGNS = "$€£%°"

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[+-]?(\d[\d,]*(\.\d+)?|\.\d+)")
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NUM, _UNIT, _NAME = 1, 2, 3
_REAL, _IS_NUMBER, _CAPITAL, _ENDS, _UNIT_WORD, _SIGNED, _ALL_CAPITAL = 1, 2, 4, 8, 16, 32, 64
#: What a byte is: part of a word, letter or digit, digit, capital, a sign that closes, a sign that ends a sentence, not ASCII.
_WORD, _ALNUM, _DIGIT, _UPPER, _CLOSES, _STOPS, _WIDE = 1, 2, 4, 8, 16, 32, 64
_CLOSING, _STOPPING = "\"')]}»”*#&%$", (".", "!", "?", ":", ";")
_LOWER, _RAISED = bytes(range(256)).lower(), bytes(range(256)).upper()


def _class_of(byte: int) -> int:
    sign = chr(byte)
    if byte > 127:
        return _WORD | _WIDE
    if sign in "\x20\x09\x0A\x0B\x0C\x0D":
        return 0
    return _WORD | _ALNUM * sign.isalnum() | _DIGIT * sign.isdigit() | _UPPER * sign.isupper() | _CLOSES * (sign in _CLOSING) | _STOPS * (sign in _STOPPING)


_CLASSES = bytes(map(_class_of, range(256)))
#: Signs around a word and bytes in it up to which words are taken many at once; others one by one.
_SIGNS_MANY, _BYTES_MANY = 8, 16
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of texts whose words are taken at once.
_PIECE = 1 << 20


def _mixed(head: np.ndarray, tail: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Codes of words of up to 16 bytes from their first eight; ``tail`` has the next eight of the words at ``far``."""
    with np.errstate(over="ignore"):
        h = head * _P1
        h ^= h >> np.uint64(29)
        h *= _P2
        h ^= h >> np.uint64(32)
        h[far] = (h[far] ^ tail) * _P1
        h ^= h >> np.uint64(31)
        return h * _P2


def _code(low: str) -> int:
    """The code of one word: XXH64 beyond 16 bytes, else what `_mixed` makes of it."""
    raw = low.encode()
    if len(raw) > _BYTES_MANY:
        return xxh64_intdigest(raw, 0)
    p1, p2, ones = int(_P1), int(_P2), (1 << 64) - 1
    h = int.from_bytes(raw[:8], "little") * p1 & ones
    h = (h ^ h >> 29) * p2 & ones
    h ^= h >> 32
    if len(raw) > 8:
        h = (h ^ int.from_bytes(raw[8:], "little")) * p1 & ones
    return (h ^ h >> 31) * p2 & ones


#: Number words and units by their code, for words taken many at once: a table that rules out most, codes, flags.
_FIXED = dict(sorted((_code(w), _IS_NUMBER * (w in NUMBER_WORDS) | _UNIT_WORD * (w in UNITS)) for w in NUMBER_WORDS | UNITS))
_FIXED_CODES, _FIXED_FLAGS = np.array(list(_FIXED), np.uint64), np.array(list(_FIXED.values()), np.uint8)
_MAY_BE_FIXED = np.zeros(1 << 16, bool)
_MAY_BE_FIXED[(_FIXED_CODES >> np.uint64(48)).astype(np.int64)] = True


class _Words(dict):
    """The canonical forms of tokens taken one by one, as flags and a code in arrays that the dict's values index; emptied when full."""

    def __init__(self, at_most: int = 250_000):
        self.at_most = at_most
        self.values_: list[str] = []
        self.flags = np.zeros(1 << 12, np.uint8)
        self.codes = np.zeros(1 << 12, np.uint64)

    def __missing__(self, token: bytes) -> int:
        raw = token.decode("utf-8", "replace")
        word = raw.isalpha()
        bare = raw if word else _EDGE.sub("", raw)
        low = bare.lower()
        flags = _REAL if bare else 0
        if bare and not word and _NUMBER.fullmatch(bare):
            flags |= _IS_NUMBER | _SIGNED * (raw[0] in SIGNS or raw.rstrip(".,;:!?")[-1:] in tuple(SIGNS))
        if low in NUMBER_WORDS:
            flags |= _IS_NUMBER
        elif low != bare and bare[0].isupper():
            flags |= _ALL_CAPITAL if bare.isupper() else _CAPITAL
        if not word and raw.rstrip(_CLOSING).endswith(_STOPPING):
            flags |= _ENDS
        if low in UNITS:
            flags |= _UNIT_WORD
        at = self[token] = len(self.values_)
        if at == len(self.flags):
            self.flags = np.r_[self.flags, np.zeros_like(self.flags)]
            self.codes = np.r_[self.codes, np.zeros_like(self.codes)]
        self.values_.append(low)
        self.flags[at] = flags
        self.codes[at] = _code(low)
        return at

    def look(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) > self.at_most:
            self.clear()
            self.values_.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def _eights(raw: bytes) -> np.ndarray:
    """The eight bytes from each place of ``raw`` on, as numbers."""
    return np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))


def _moved(at: np.ndarray, step: int, kinds: np.ndarray, stop: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places moved by ``step`` over bytes for whose kinds ``more`` holds, up to ``stop``, and which of them have more than _SIGNS_MANY such bytes."""
    at, ahead = at.copy(), min(step, 0)
    todo = np.flatnonzero(more[kinds[at + ahead]])
    for _ in range(_SIGNS_MANY):
        if not len(todo):
            break
        at[todo] += step
        todo = todo[at[todo] != stop[todo]]
        todo = todo[more[kinds[at[todo] + ahead]]]
    return at, todo


_IS_SIGN = np.array([k & _WORD > 0 and k & (_ALNUM | _WIDE) == 0 for k in range(128)])
_IS_CLOSING = np.array([k & _CLOSES > 0 for k in range(128)])


def _taken(raw: bytes, cache: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, flags and codes of the words of ``raw``, which has white space at its start and 16 bytes of it at its end.

    Words of ASCII that are neither long nor numbers in digits are taken many at once, the others by ``cache``.
    """
    kinds = np.frombuffer(raw.translate(_CLASSES), np.uint8)
    edges = np.flatnonzero(((kinds[1:] ^ kinds[:-1]) & _WORD).view(bool)) + 1
    starts, ends = edges[::2], edges[1::2]
    first, odd1 = _moved(starts, 1, kinds, ends, _IS_SIGN)
    last, odd2 = _moved(ends, -1, kinds, starts, _IS_SIGN)
    shut, odd3 = _moved(ends, -1, kinds, starts, _IS_CLOSING)
    size = last - first
    begins = kinds[first]
    single = (size > _BYTES_MANY) | (begins & _DIGIT > 0)
    single[odd1] = single[odd2] = single[odd3] = True
    wide = np.flatnonzero(kinds & _WIDE)
    if len(wide):
        single[np.searchsorted(starts, wide, "right") - 1] = True

    small, far = np.clip(size, 0, 8), np.flatnonzero((size > 8) & ~single)
    low = _eights(raw.translate(_LOWER))
    beyond = _FIRST_BYTES[size[far] - 8]
    codes = _mixed(low[first] & _FIRST_BYTES[small], low[first[far] + 8] & beyond, far)
    flags = (size > 0) * np.uint8(_REAL) | (kinds[shut - 1] & _STOPS > 0) * np.uint8(_ENDS)
    capital = np.flatnonzero((begins & _UPPER > 0) & (size > 0) & ~single)
    if len(capital):
        own, raised, at, n = _eights(raw), _eights(raw.translate(_RAISED)), first[capital], size[capital]
        small_letters = (own[at] ^ raised[at]) & _FIRST_BYTES[np.minimum(n, 8)] | (own[at + 8] ^ raised[at + 8]) & _FIRST_BYTES[np.maximum(n - 8, 0)]
        flags[capital] |= np.where(small_letters > 0, np.uint8(_CAPITAL), np.uint8(_ALL_CAPITAL))
    fixed = np.flatnonzero(_MAY_BE_FIXED[(codes >> np.uint64(48)).astype(np.int64)] & (size > 0))
    at = np.minimum(np.searchsorted(_FIXED_CODES, codes[fixed]), len(_FIXED_CODES) - 1)
    same = _FIXED_CODES[at] == codes[fixed]
    fixed, more = fixed[same], _FIXED_FLAGS[at[same]]
    flags[fixed] = flags[fixed] & np.where(more & _IS_NUMBER > 0, np.uint8(_REAL | _ENDS), np.uint8(255)) | more

    one = np.flatnonzero(single)
    ids = cache.look([raw[i:j] for i, j in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
    flags[one], codes[one] = cache.flags[ids], cache.codes[ids]
    return starts, ends, flags, codes


def _hashes(codes: np.ndarray, size: int, salt: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash for each window of ``size`` codes, or only for the windows at ``at``."""
    n = len(codes) - size + 1
    with np.errstate(over="ignore"):
        h = np.full(n if at is None else len(at), np.uint64(salt))
        for j in range(size):
            h = (h ^ (codes[j : j + n] if at is None else codes[at + j])) * _P1
            h ^= h >> np.uint64(29)
        return (h * _P2) ^ (h >> np.uint64(32))


class Words:
    """The words of one text or of many, one behind the other: their plain codes, template codes, slot kinds and places
    (values are looked up where slots are read); where words may be names as well, the codes and kinds with these as
    names; and the text of each word, with the first word of each text."""

    __slots__ = ("plain", "templ", "values", "cache", "raw", "starts", "ends", "kind", "maybe", "templ2", "kind2", "text", "first")

    def __init__(self, texts: bytes | list[bytes | None] | None, cache: _Words):
        texts = texts if isinstance(texts, list) else [texts]
        self.raw = raw = b"\n".join([b"", *(t or b"" for t in texts), b" " * _BYTES_MANY])
        starts, ends, flags, plain = _taken(raw, cache)
        lines = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        opens = np.r_[True, flags & _ENDS > 0]
        opens[np.searchsorted(starts, lines)] = True  # a text begins on a line of its own
        opens = opens[: len(starts)]
        real = flags & _REAL > 0
        if not real.all():
            opens[1:] |= ~real[:-1] & opens[:-1]  # a sentence also opens behind signs without a word
            starts, ends, flags, plain, opens = starts[real], ends[real], flags[real], plain[real], opens[real]
        self.first = np.searchsorted(starts, np.cumsum([1, *(len(t or b"") + 1 for t in texts)]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.plain, self.starts, self.ends, self.cache, self.values = plain, starts, ends, cache, cache.values_
        capital = flags & _CAPITAL > 0
        number = flags & _IS_NUMBER > 0
        unit = np.r_[False, number[:-1] & (flags[:-1] & _SIGNED == 0) & (self.text[1:] == self.text[:-1])][: len(plain)] & (flags & _UNIT_WORD > 0)
        self.kind = kind = np.where(number, _NUM, np.where(unit, _UNIT, np.where(capital & ~opens, _NAME, 0))).astype(np.uint8)
        self.maybe = (kind == 0) & (capital | (flags & _ALL_CAPITAL > 0))
        self.templ = np.where(kind > 0, kind.astype(np.uint64), plain) if kind.any() else plain
        self.templ2, self.kind2 = (np.where(self.maybe, np.uint64(_NAME), self.templ), np.where(self.maybe, np.uint8(_NAME), kind)) if self.maybe.any() else (self.templ, kind)

    def second(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows with second templates."""
        n = len(self.kind) - size + 1
        sums = np.r_[0, np.cumsum(self.maybe)]
        at = np.flatnonzero(sums[size:] > sums[:-size])
        if len(at):
            sums = np.r_[0, np.cumsum(self.kind2 == 0)]
            at = at[sums[at + size] > sums[at]]
        return at, _hashes(self.templ2, size, size, at if len(at) < n else None)

    def slots(self, i: int, n: int, second: bool = False) -> tuple:
        kind = self.kind2 if second else self.kind
        return tuple(f"{kind[k]}:{self.value(k)}" for k in range(i, i + n) if kind[k])

    def value(self, k: int) -> str:
        return self.values[self.cache[self.raw[self.starts[k] : self.ends[k]]]]


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``(item, h, template, slots, n, key, at)``: the distinct windows of every item, plain and template, and their length.

    ``key`` tells an item's windows apart and is the same for both templates of one; ``at`` is a template's place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                words = Words(text, cache)
                n = min(size, len(words.kind))
                if not n:
                    continue
                plain, templ = _hashes(words.plain, n, n), _hashes(words.templ, n, n).view(np.int64)
                out += [(item, int(h), False, (), n, int(h), 0) for h in np.unique(plain).view(np.int64)]
                # Keys decide between places that fit equally well; they are of XXH64 codes.
                digests = np.array([kind or xxh64_intdigest(words.value(k).encode(), 0) for k, kind in enumerate(words.kind.tolist())], np.uint64)
                first = [(int(h), words.slots(i, n)) for i, h in enumerate(_hashes(digests, n, n).view(np.int64))]
                keys = [xxh64_intdigest(repr(w).encode(), 0) - (1 << 63) for w in first]
                out += [(item, int(templ[i]), True, slots, n, keys[i], i) for i, (_, slots) in enumerate(first)]
                at, second = words.second(n)
                out += [(item, int(h), True, words.slots(i, n, True), n, keys[i], i) for i, h in zip(at.tolist(), second.view(np.int64), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item", "h", "template", "slots", "n", "key", "at"])

    slim = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "item long, h long, template boolean, slots array<string>, n int, key long, at int").distinct()


class _Replacement:
    """A one-to-one replacement of slot values that grows."""

    def __init__(self):
        self.there: dict[str, str] = {}
        self.back: dict[str, str] = {}

    def take(self, mine: Iterable[str], theirs: Iterable[str]) -> bool:
        """Whether the values agree with the replacement; if so they join it."""
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        for a, b in zip(mine, theirs, strict=True):
            if self.there.get(a, there.get(a, b)) != b or self.back.get(b, back.get(b, a)) != a or a[:2] != b[:2]:
                return False
            there[a], back[b] = b, a
        self.there |= there
        self.back |= back
        return True


def _nearest(places: list[tuple], middle: int) -> Iterator[tuple]:
    """Sorted (shift, ...) tuples by their distance from ``middle``."""
    right = bisect_left(places, (middle,))
    left = right - 1
    while left >= 0 or right < len(places):
        if right == len(places) or left >= 0 and middle - places[left][0] < places[right][0] - middle:
            yield places[left]
            left -= 1
        else:
            yield places[right]
            right += 1


def _consistent(pairs: list[tuple], most: int) -> tuple[int, bool]:
    """Of one item's template windows found in one document: how many fit one
    one-to-one replacement of slot values, and whether all values are the item's own.

    ``pairs`` holds (key, item's place, item's slots, document's slots, document's places).
    Every shift between places is tried as the start, those with most windows first.
    """
    free = {key for key, _, mine, _, _ in pairs if not mine}  # without slots a window always fits
    runs: dict[int, list[tuple]] = defaultdict(list)
    of: dict[tuple, set] = defaultdict(set)  # an item's window, with or without a pair of values: its places
    forms: dict[int, set] = defaultdict(set)
    for key, at, mine, theirs, places in pairs:
        if key in free or len(mine) != len(theirs):
            continue
        forms[key].add((len(mine), mine))
        for j in places:
            runs[j - at].append((at, key, mine, theirs))
            of[key, mine].add((j - at, theirs))
            for pair in zip(mine, theirs, strict=True):
                of[key, mine, pair].add((j - at, theirs))
    listed: dict[tuple, list] = {}

    def places_of(*what) -> list[tuple]:
        if what not in listed:
            listed[what] = sorted(of.get(what, ()))
        return listed[what]

    best, tried = (len(free), True), []
    for shift in sorted(runs, key=lambda d: (-len({key for _, key, *_ in runs[d]}), d)):
        run = sorted(runs[shift], key=lambda p: (p[0], len(p[2]), p[1:]))
        votes: Counter = Counter()
        for _, _, mine, theirs in run:
            votes.update(set(zip(mine, theirs, strict=True)))
        bound = _Replacement()
        for (a, b), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            bound.take((a,), (b,))
        if any(bound.there.items() <= old.items() for old in tried):
            continue
        kept = {}
        for _, key, mine, theirs in run:
            if key not in kept and all(bound.there.get(a) == b for a, b in zip(mine, theirs, strict=True)):
                kept[key] = mine == theirs
        # Values of windows that lost the vote are no part of the replacement.
        used = _Replacement()
        for _, key, mine, theirs in run:
            if key in kept and all(bound.there.get(a) == b for a, b in zip(mine, theirs, strict=True)):
                used.take(mine, theirs)
        rest = sorted((min(abs(next(_nearest(places_of(key, mine), shift))[0] - shift) for _, mine in forms[key]), key) for key in forms if key not in kept)
        for _, key in rest:
            for _, mine in sorted(forms[key]):
                known = [places_of(key, mine, (a, used.there[a])) for a in mine if a in used.there]
                found = next((theirs for _, theirs in _nearest(min(known, key=len) if known else places_of(key, mine), shift) if used.take(mine, theirs)), None)
                if found is not None:
                    kept[key] = mine == found
                    break
        tried.append(used.there)
        best = max(best, (len(free) + len(kept), all(kept.values())))
        if best == (most, True):
            break
    return best


def _verdict(plain: int, pairs: list[tuple], totals: tuple[int, int], similarity: float) -> tuple[float, bool, int] | None:
    """Containment, exactness and matched windows of one (document, item), or None if too few."""
    if totals[0] and plain / totals[0] >= similarity:
        return plain / totals[0], True, plain
    most = len({p[0] for p in pairs})
    if not totals[1] or most / totals[1] < similarity:
        return None
    n, same = _consistent(pairs, most)
    return (n / totals[1], same, n) if n / totals[1] >= similarity else None


_RESULT = "doc_id long, item_id long, containment double, exact boolean, windows long"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [(), (), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "containment", "exact", "windows"])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, similarity: float = SIMILARITY, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(doc_id, item_id, containment, exact, windows)`` for every item found in a document.

    ``exact`` is false where only the template matches: a re-parameterised item.
    """
    table, lengths = _windows(items, size)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    join = _by_broadcast if fits(table, broadcast_windows) else _by_shuffle
    return join(slim, table, lengths, similarity)


def _windows(items: DataFrame, size: int) -> tuple[DataFrame, list[int]]:
    """The items' windows, and their different lengths, longest first: at most ``size`` numbers."""
    bounded_batches(items.sparkSession)
    table = cut(item_windows(items, size=size))
    return table, sorted((r.n for r in table.select("n").distinct().collect()), reverse=True)


class _Items:
    """The items' windows as a task looks them up; built once for each worker."""

    built: dict[str, "_Items"] = {}

    def __init__(self, table: pa.Table):
        self.by: dict[tuple[bool, int], list] = defaultdict(list)
        distinct: dict[int, tuple[set, set]] = defaultdict(lambda: (set(), set()))
        for item, h, templ, slots, key, at in zip(*(table[c].to_pylist() for c in ("item", "h", "template", "slots", "key", "at")), strict=True):
            self.by[templ, h].append((item, key, at, tuple(slots)))
            distinct[item][templ].add(key)
        self.count = {item: (len(a), len(b)) for item, (a, b) in distinct.items()}
        known = np.array(sorted({h for _, h in self.by}), np.int64).view(np.uint64)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(known >> np.uint64(42)).astype(np.int64)] = True

    @classmethod
    def of(cls, name: str, packed: bytes) -> "_Items":
        if name not in cls.built:
            cls.built.clear()
            cls.built[name] = cls(pa.ipc.open_stream(packed).read_all())
        return cls.built[name]

    def judged(self, texts: Iterable[bytes | None], cache: _Words, lengths: list[int], similarity: float) -> Iterator[tuple[int, Iterator[tuple]]]:
        """Numbers of the texts with windows of items, and for each its verdicts."""
        for begin, some in _pieces(texts):
            for k, found in _found(Words(some, cache), lengths, self.sieve, self.by).items():
                yield begin + k, self.verdicts(found, similarity)

    def verdicts(self, found: dict[tuple[bool, int], dict[tuple, list[int]]], similarity: float) -> Iterator[tuple]:
        """``(item, containment, exact, windows)`` of the items that a text with the windows ``found`` holds."""
        plain: Counter = Counter()
        keys: dict[int, set] = defaultdict(set)
        for templ, h in found:
            for item, key, _, _ in self.by[templ, h]:
                if templ:
                    keys[item].add(key)
                else:
                    plain[item] += 1
        likely = {i for i, k in plain.items() if k / self.count[i][0] >= similarity} | {i for i, k in keys.items() if len(k) / self.count[i][1] >= similarity}
        pairs: dict[int, list] = defaultdict(list)
        for (templ, h), at_slots in found.items() if likely else ():
            for item, key, at, mine in self.by[templ, h] if templ else ():
                if item in likely:
                    pairs[item] += [(key, at, mine, theirs, places) for theirs, places in at_slots.items()]
        for item in sorted(likely):
            if verdict := _verdict(plain[item], pairs[item], self.count[item], similarity):
                yield (item, *verdict)


def _shared(table: DataFrame):
    """The items' windows as a broadcast, and a name for them; at most ``broadcast_windows`` rows of the benchmark."""
    found = table.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    return table.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex


def _by_broadcast(slim: DataFrame, table: DataFrame, lengths: list[int], similarity: float) -> DataFrame:
    shared, name = _shared(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, cache = _Items.of(name, shared.value), _Words()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            yield _rows([(docs[k], *v) for k, verdicts in items.judged(raw_texts(batch.column(1)), cache, lengths, similarity) for v in verdicts])

    return slim.mapInArrow(run, _RESULT)


def _pieces(texts: Iterable[bytes | None], size: int = _PIECE) -> Iterator[tuple[int, list[bytes | None]]]:
    """Texts in lists of about ``size`` bytes, a longer one alone or at its list's end, with the number of a list's first."""
    begin, some, n = 0, [], 0
    for text in texts:
        some.append(text)
        n += len(text or b"")
        if n >= size:
            yield begin, some
            begin, some, n = begin + len(some), [], 0
    if some:
        yield begin, some


def _found(words: Words, lengths: list[int], sieve: np.ndarray | None = None, by: dict | None = None) -> dict[int, dict[tuple[bool, int], dict[tuple, list[int]]]]:
    """By text, its windows (template?, hash): their slots, and where these are; with ``sieve`` and ``by`` only those of items.

    Items shorter than a window have windows of their own length, told apart by the hash's salt.
    """
    texts: dict[int, dict] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for n in lengths:
        if n > len(words.kind):
            continue
        own = _hashes(words.plain, n, n)
        every = np.arange(len(own))
        some, second = words.second(n)
        for is_templ, is_second, where, hashes in ((False, False, every, own), (True, False, every, own if words.templ is words.plain else _hashes(words.templ, n, n)), (True, True, some, second)):
            if sieve is not None:
                near = np.flatnonzero(sieve[(hashes >> np.uint64(42)).astype(np.int64)])
                where, hashes = where[near], hashes[near]
            text = words.text[where]
            within = text == words.text[where + n - 1]
            where, hashes, text = where[within], hashes[within], text[within]
            for i, h, k, j in zip(where.tolist(), hashes.view(np.int64).tolist(), text.tolist(), (where - words.first[text]).tolist(), strict=True):
                if by is None or (is_templ, h) in by:
                    texts[k][is_templ, h][words.slots(i, n, is_second) if is_templ else ()].append(j)
    return texts


def _by_shuffle(slim: DataFrame, table: DataFrame, lengths: list[int], similarity: float) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, found in ((begin + k, found) for begin, some in _pieces(raw_texts(batch.column(2)), _PIECE >> 4) for k, found in _found(Words(some, cache), lengths).items()):
                seen = [(templ, h, slots, places if templ else []) for (templ, h), at_slots in found.items() for slots, places in at_slots.items()]
                cols, n = list(zip(*seen, strict=True)), len(seen)
                arrays = [pa.array([rows[k]] * n, pa.int64()), pa.array([ids[k]] * n, pa.int64()), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "template", "h", "theirs", "places"])

    def judge(pdf):
        import pandas as pd

        plain = len(set(pdf.key[~pdf.template]))
        pairs = [(int(key), int(at), tuple(mine), tuple(theirs), [int(j) for j in places]) for templ, key, at, mine, theirs, places in zip(pdf.template, pdf.key, pdf["at"], pdf.slots, pdf.theirs, pdf.places, strict=True) if templ]
        first = pdf.iloc[0]
        verdict = _verdict(plain, pairs, (int(first.n_plain), int(first.n_templ)), similarity)
        doc = None if pd.isna(first.id) else int(first.id)
        row = [(doc, int(first["item"]), *verdict)] if verdict else []
        return pd.DataFrame(row, columns=["doc_id", "item_id", "containment", "exact", "windows"]).astype({"doc_id": "Int64"})

    rows = cut(slim.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text"))
    spread_rows = rows.mapInArrow(spread, "row long, id long, template boolean, h long, theirs array<string>, places array<int>")
    totals = table.select("item", "template", "key").distinct().groupBy("item").agg(F.sum((~F.col("template")).cast("int")).alias("n_plain"), F.sum(F.col("template").cast("int")).alias("n_templ"))
    found = spread_rows.join(table, ["template", "h"]).join(totals, "item")
    return found.groupBy("row", "item").applyInPandas(judge, _RESULT)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, similarity: float = SIMILARITY, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows with a null id are judged by their text like all others."""
    table, lengths = _windows(items, size)
    if not fits(table, broadcast_windows):
        # Beyond the bound rows are numbered, judged by the number, and joined with the verdicts.
        name = free_name(docs, "__row")
        numbered = cut(docs.withColumn(name, F.monotonically_increasing_id()))
        found = _by_shuffle(numbered.select(F.col(name).alias("id"), F.col(text_col).cast("string").alias("text")), table, lengths, similarity)
        return numbered.join(found.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared, name = _shared(table)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, cache = _Items.of(name, shared.value), _Words()
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for k, verdicts in windows.judged(raw_texts(batch.column(text_at)), cache, lengths, similarity):
                clean[k] = next(verdicts, None) is None
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
