"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that start from an empty model each and know nothing of one another. Within a block, its ids are
dealt in runs to many lanes, which share one model and take a step together as arrays; a lane has a code of its own.

For each id the model holds three predictions: of order 2 (the id that followed the last two ids), of order 1 (the id
that followed the last one) and of order 0 (how often ids occurred so far). They are mixed into one distribution: a
share for the first id, one for the second, and the rest spread as order 0 says. The shares are learned for each state
of the two predictions (how often each held before, and whether they agree). An id takes the interval of the highest
order that predicted it.

All arithmetic is in integers: encoder and decoder agree on every machine. Where lanes meet in one context in a step,
the greatest of their new entries stays, in whatever order they are written. A run that is shorter than the others is
filled up with zeros, which are dropped.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

IDS = 1 << 16
BITS = 24  # of the totals of the mixed distribution
ONE = 1 << BITS
LEFT = 1 << 21  # of the total that order 0 has at least
TABLE_BITS = 20  # of the totals of order 0
LANES, LEAST_STEPS = 8192, 128  # lanes of a block at most, and steps that are worth a lane
HASH_BITS = 18  # of the order-2 contexts at most
_U32, _U64 = np.uint32, np.uint64
_TOP, _32, _LOW = _U64(1 << 32), _U64(32), _U64((1 << 32) - 1)
_BITS, _ID, _SURE, _SUREST = _U64(BITS), _U32(IDS - 1), _U32(IDS), _U32(3 * IDS)
#: What happened to an id: order 2 had it, order 1 had it, it was left to order 0.
HIT2, HIT1, MISS = 0, 1, 2


def _cumulated(count: np.ndarray) -> np.ndarray:
    """Cumulative frequencies in proportion to the counts, at least 1 for each id, that end at 2^TABLE_BITS."""
    cum = np.zeros(IDS + 1, np.int64)
    np.cumsum(count * ((1 << TABLE_BITS) - IDS) // int(count.sum()) + 1, out=cum[1:])
    cum[IDS] = 1 << TABLE_BITS
    return cum


def _inverse(cum: np.ndarray) -> np.ndarray:
    """The id whose share holds a place of the table."""
    return np.repeat(np.arange(IDS, dtype=np.uint16), np.diff(cum))


@functools.cache
def _even() -> tuple[np.ndarray, np.ndarray]:
    """The tables of order 0 before the first id."""
    cum = _cumulated(np.ones(IDS, np.int64))
    return cum, _inverse(cum)


class _Model:
    """The model of a block. Entries of the tables are confidence << 16 | predicted id."""

    def __init__(self, lanes: int, n: int):
        self.mask = (1 << min(HASH_BITS, max(8, n.bit_length()))) - 1
        self.slot1, self.slot2 = np.zeros(IDS, _U32), np.zeros(self.mask + 1, _U32)
        # by state (agreement, confidence of order 2, of order 1) and what happened: at first a guess worth 64 ids
        held2, held1 = np.array([2, 8, 20, 36])[:, None], np.array([2, 6, 12, 20])
        apart = np.stack(np.broadcast_arrays(held2, held1 * (64 - held2) // 64, 0, 0), 2)
        agree = np.stack(np.broadcast_arrays(np.minimum(held2 + held1, 56), 0 * held1, 0, 0), 2)
        self.seen = np.concatenate((apart, agree)).reshape(32, 4).astype(np.int64)
        self.seen[:, MISS] = 64 - self.seen.sum(1)
        self.count, self.counted, self.steps = np.ones(IDS, np.int64), 0, 0
        self.last = self.before = np.zeros(lanes, np.int64)

    def refresh(self, grid: np.ndarray, invert: bool) -> None:
        """Brings the tables of the mixture and of order 0 up to date, at steps that both sides know; the rows of `grid`
        before the present step are the ids so far."""
        n = self.steps
        if n < 16 or n % 8 == 0:
            total = self.seen.sum(1)
            mass2, mass1 = ((self.seen[:, k] * (ONE - LEFT) // total + 1 for k in (HIT2, HIT1)))
            mass1[16:] = 0
            low0 = mass2 + mass1
            start = np.stack((0 * mass2, mass2, low0, low0), 1)
            span = np.stack((mass2, mass1, ONE - low0, ONE - low0), 1)
            self.start, self.span = start.ravel().astype(_U64), span.ravel().astype(_U64)
            self.mass2, self.low0, self.rest = mass2, low0, ONE - low0
        if n == 0:
            self.cum, self.inverse = _even()
        elif n & (n - 1) == 0 or n % 64 == 0:
            self.count += 16 * np.bincount(grid[self.counted : n].ravel(), minlength=IDS)
            self.counted = n
            self.cum = _cumulated(self.count)
            if invert:
                self.inverse = _inverse(self.cum)

    def predict(self) -> None:
        self.at2 = (self.last * 40503 + self.before * 9973) & self.mask
        self.s1, self.s2 = self.slot1.take(self.last), self.slot2.take(self.at2)
        self.id1, self.id2 = self.s1 & _ID, self.s2 & _ID
        self.state = ((self.s2 >> 16 << 2) + (self.s1 >> 16) + ((self.id1 == self.id2).view(np.uint8) << 4)).astype(np.int64)

    def interval0(self, ids: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start, from 0 up to ONE, and width of the ids' shares of what is left to order 0."""
        a = self.cum.take(ids) * rest >> TABLE_BITS
        b = self.cum.take(ids + 1) * rest >> TABLE_BITS
        return (a + (ONE - rest)).astype(_U64), (b - a).astype(_U64)

    def update(self, ids: np.ndarray, key: np.ndarray) -> None:
        """Learns from a step: its ids, and 4 * state + what happened."""
        self.seen += np.bincount(key, minlength=128).reshape(32, 4)
        x = ids.astype(_U32)
        for slot, at, s, known in ((self.slot1, self.last, self.s1, self.id1), (self.slot2, self.at2, self.s2, self.id2)):
            held = np.where(s >= _SURE, s - _SURE, x)
            new = np.where(known == x, np.minimum(s + _SURE, s | _SUREST), held)
            slot[at] = 0
            np.maximum.at(slot, at, new)
        self.before, self.last = self.last, ids
        self.steps += 1


def _shape(n: int) -> tuple[int, int]:
    """Steps and lanes of a block of n ids."""
    lanes = min(LANES, max(1, n // LEAST_STEPS))
    return -(-n // lanes), lanes


def _narrow(low: np.ndarray, width: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """low and width of the lanes `at`, whose widths are below 2^32, before their upper words leave: an interval that
    two upper words share is cut to its part in the lower one."""
    some, span = low.take(at), width.take(at)
    apart = (some ^ (some + span)) >= _TOP
    if apart.any():
        span[apart] = (~some[apart] + _U64(1)) & _LOW
    return some, span


def _encode(ids: np.ndarray) -> bytes:
    steps, lanes = _shape(len(ids))
    grid = np.zeros(lanes * steps, np.uint16)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(lanes, len(ids))
    low, width = np.zeros(lanes, _U64), np.full(lanes, 2**64 - 1, _U64)
    room = steps + 4
    out = np.zeros(lanes * room, _U32)
    first = np.arange(lanes) * room
    spot = first.copy()
    with np.errstate(over="ignore"):
        for row in grid:
            model.refresh(grid, False)
            model.predict()
            x, x32 = row.astype(np.int64), row.astype(_U32)
            key = np.where(x32 == model.id2, HIT2, np.where(x32 == model.id1, HIT1, MISS))
            missed = np.flatnonzero(key == MISS)
            key += model.state << 2
            start, span = model.start.take(key), model.span.take(key)
            start[missed], span[missed] = model.interval0(x.take(missed), model.rest.take(model.state.take(missed)))
            part = width >> _BITS
            low += part * start
            width = part * span
            at = np.flatnonzero(width < _TOP)
            some, span = _narrow(low, width, at)
            to = spot.take(at)
            out[to] = (some >> _32).astype(_U32)
            spot[at] = to + 1
            low[at] = some << _32
            width[at] = span << _32
            model.update(x, key)
        value = low + (width >> _U64(1))  # two words name a value inside the last interval
        out[spot] = (value >> _32).astype(_U32)
        out[spot + 1] = value.astype(_U32)
    words = spot + 2 - first
    used = np.arange(room) < words[:, None]
    return words.astype("<u4").tobytes() + out.reshape(lanes, room)[used].astype("<u4").tobytes()


def _decode(n: int, code: bytes) -> np.ndarray:
    steps, lanes = _shape(n)
    flat = np.frombuffer(code, "<u4")
    words, flat = flat[:lanes].astype(np.int64), flat[lanes:].astype(_U64)
    if len(words) < lanes or int(words.sum()) != len(flat) or int(words.min()) < 2:
        raise ValueError("the codes of a block's lanes do not fit its length")
    model = _Model(lanes, n)
    spot, last = np.cumsum(words) - words + 2, len(flat) - 1
    low, width = np.zeros(lanes, _U64), np.full(lanes, 2**64 - 1, _U64)
    ahead = (flat[spot - 2] << _32) | flat[spot - 1]
    grid = np.zeros((steps, lanes), np.uint16)
    with np.errstate(over="ignore"):
        for row in grid:
            model.refresh(grid, True)
            model.predict()
            part = width >> _BITS
            value = np.minimum((ahead - low) // part, _U64(ONE - 1)).astype(np.int64)
            two, left = value < model.mass2.take(model.state), value >= model.low0.take(model.state)
            key = np.where(two, HIT2, np.where(left, MISS, HIT1))
            x = np.where(two, model.id2, model.id1).astype(np.int64)
            missed = np.flatnonzero(left)
            rest = model.rest.take(model.state.take(missed))
            # the last id whose share begins at or before the value
            value = value.take(missed) - (ONE - rest)
            x[missed] = found = model.inverse.take(((value + 1 << TABLE_BITS) - 1) // rest).astype(np.int64)
            key += model.state << 2
            start, span = model.start.take(key), model.span.take(key)
            start[missed], span[missed] = model.interval0(found, rest)
            row[:] = x
            low += part * start
            width = part * span
            at = np.flatnonzero(width < _TOP)
            some, span = _narrow(low, width, at)
            low[at] = some << _32
            width[at] = span << _32
            of = spot.take(at)
            ahead[at] = (ahead.take(at) << _32) | flat.take(np.minimum(of, last))
            spot[at] = of + 1
            model.update(x, key)
    return np.ascontiguousarray(grid.T).ravel()[:n].astype(np.int64)


def encode_blocks(ids: np.ndarray, block: int) -> list[tuple[int, bytes]]:
    """(number of ids, code) of consecutive blocks of at most `block` ids; ids are below 2^16."""
    if len(ids) and int(ids.max()) >= IDS:
        raise ValueError("ids of 2^16 and more are not covered")
    parts = (ids[k : k + block] for k in range(0, len(ids), block))
    return [(len(p), _encode(p)) for p in parts]


def decode_blocks(blocks: list[tuple[int, bytes]]) -> np.ndarray:
    """The ids of encode_blocks()'s blocks, one after the other; damaged code gives some ids, which a checksum tells, or
    a ValueError."""
    return np.concatenate([_decode(n, code) for n, code in blocks]) if blocks else np.empty(0, np.int64)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
