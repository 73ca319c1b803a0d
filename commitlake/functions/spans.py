"""Content-defined chunk boundaries and span similarity of byte strings, over whole arrays."""

from __future__ import annotations

from functools import cache

import numpy as np

#: The seed of the gear table, its shifts, and the sizes of chunks (least, target, most).
GEAR_SEED, SHIFTS = 0x9E3779B9, (13, 17, 5)
SIZES = (1 << 20, 4 << 20, 16 << 20)
#: Fixed values of span hashes: longest span, modulus, factor of the second accumulator.
SPAN, MODULUS, FACTOR = 64, 107927, 0x61
_WINDOW = 32  # bytes that reach a 32-bit hash that moves up one bit a byte


@cache
def gear() -> np.ndarray:
    """The 256 values that follow the seed."""
    value, out = GEAR_SEED, []
    for _ in range(256):
        value ^= value << SHIFTS[0] & 0xFFFFFFFF
        value ^= value >> SHIFTS[1]
        value ^= value << SHIFTS[2] & 0xFFFFFFFF
        out.append(value)
    return np.array(out, np.uint32)


def chunk_ends(data: bytes, sizes: tuple[int, int, int] = SIZES, state: tuple[bytes, int] = (b"", 0)) -> tuple[list[int], tuple[bytes, int]]:
    """Ends of the chunks that end in ``data``, and the state to go on with.

    A position's hash sums the gear values of the bytes before it, each moved up
    by its distance, so only the last 32 bytes count; it is found for all
    positions by five doublings.  Below the target size a boundary needs one more
    zero bit than the target's binary digits, from there on one fewer.  The hash
    starts anew at a boundary, which ``least`` >= 32 hides.  ``state``
    holds the last bytes and the size of the open chunk, so that results do not
    depend on how the data is cut.
    """
    least, target, most = sizes
    if not _WINDOW <= least <= target <= most < 1 << 30:
        raise ValueError("bad chunk sizes")
    bits = (target - 1).bit_length()
    early, late = min(30, bits + 1), max(1, bits - 1)
    tail, size = state
    whole = np.frombuffer(tail + data, np.uint8)
    hashes = gear()[whole]
    for step in (1, 2, 4, 8, 16):
        hashes[step:] += hashes[:-step] << np.uint32(step)
    base = len(tail)
    # Boundaries of one mask each; ends count from the start of ``data``.
    found = [np.flatnonzero(hashes[base:] & np.uint32((1 << b) - 1) == 0) + 1 for b in (early, late)]
    out, at = [], -size
    while True:
        end = at + most
        for ends, low, high in ((found[0], at + least, at + target - 1), (found[1], at + max(least, target), at + most)):
            i = int(np.searchsorted(ends, max(low, 1)))
            if i < len(ends) and ends[i] <= min(high, end):
                end = int(ends[i])
                break
        if end > len(data):
            return out, (bytes(whole[-_WINDOW:]), len(data) - at)
        out.append(end)
        at = end


def chunks(data: bytes, sizes: tuple[int, int, int] = SIZES) -> list[tuple[int, int]]:
    """(offset, size) of all chunks."""
    ends = chunk_ends(data, sizes)[0]
    if data and (not ends or ends[-1] != len(data)):
        ends.append(len(data))
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def span_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted span hashes and the bytes that each covers.

    Spans end after a line feed or 64 bytes; in texts (no NUL in the first 8000
    bytes) carriage returns before a line feed are left out.  All spans are
    hashed at once, byte by byte.
    """
    _, kinds, counts = span_counts_of([data])
    return kinds, counts


def span_counts_of(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, hashes, counts): the ``span_counts`` of all strings one after another, and where those of each end."""
    datas = [d if b"\0" in d[:8000] else d.replace(b"\r\n", b"\n") for d in datas]
    stops = np.cumsum([len(d) for d in datas], dtype=np.int64)
    raw = np.frombuffer(b"".join(datas), np.uint8)
    if not len(raw):
        return np.zeros(len(datas), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    lines = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, stops[stops > 0]]))
    lengths = np.diff(lines, prepend=0)
    parts = -(-lengths // SPAN)
    first = np.repeat(lines - lengths, parts)
    inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = first + inside * SPAN
    sizes = np.minimum(SPAN, np.repeat(lines, parts) - starts)
    one, two = np.zeros(len(starts), np.uint32), np.zeros(len(starts), np.uint32)
    for k in range(int(sizes.max())):
        live = sizes > k
        a, b = one[live], two[live]
        one[live], two[live] = (a << np.uint32(7) ^ b >> np.uint32(25)) + raw[starts[live] + k], b << np.uint32(7) ^ a >> np.uint32(25)
    hashes = (one + two * np.uint32(FACTOR)).astype(np.int64) % MODULUS
    owner = np.searchsorted(stops, starts, side="right")
    kinds, at = np.unique(owner * MODULUS + hashes, return_inverse=True)
    ends = np.searchsorted(kinds, np.arange(1, len(datas) + 1) * MODULUS)
    return ends, kinds % MODULUS, np.bincount(at, sizes).astype(np.int64)


class Sketches:
    """Span counts of many contents, to score many pairs of them at once."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        """``ids`` in ascending order, all different; ``ends``, ``hashes`` and ``counts`` as from ``span_counts_of``."""
        self.ids, self.sizes, self.hashes, self.counts = ids, sizes, hashes, counts
        self.lengths = np.diff(ends, prepend=0)
        self.starts = ends - self.lengths
        self.keys = np.repeat(np.arange(len(ids)), self.lengths) * MODULUS + hashes

    def scores(self, a: np.ndarray, b: np.ndarray, least: int, held: int = 2_000_000) -> np.ndarray:
        """``similarity`` of the contents at the places ``a`` and ``b``; about ``held`` spans are looked up at once."""
        out, at = np.zeros(len(a), np.int64), 0
        most, fewest = np.maximum(self.sizes[a], self.sizes[b]), np.minimum(self.sizes[a], self.sizes[b])
        alike = np.flatnonzero((most > 0) & (most * (100 - least) >= (most - fewest) * 100))
        total = np.cumsum(self.lengths[a[alike]])
        while at < len(alike):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + held, side="right")))
            pair = alike[at:end]
            x, y = a[pair], b[pair]
            n = self.lengths[x]
            which = np.repeat(np.arange(len(pair)), n)
            span = np.repeat(self.starts[x] - np.cumsum(n) + n, n) + np.arange(n.sum())
            wanted = y[which] * MODULUS + self.hashes[span]
            there = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            met = np.flatnonzero(self.keys[there] == wanted) if len(self.keys) else there
            common = np.bincount(which[met], np.minimum(self.counts[span[met]], self.counts[there[met]]), len(pair)).astype(np.int64)
            out[pair] = common * 100 // most[pair]
            at = end
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size_a: int, size_b: int, least: int = 0) -> int:
    """Percent of the larger size that both have in common; 0 if the sizes alone rule out ``least``."""
    most = max(size_a, size_b)
    if not most or most * (100 - least) < (most - min(size_a, size_b)) * 100:
        return 0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum()) * 100 // most
