"""Rolling hashes of byte and word sequences in numpy, used inside Arrow tasks.

A sequence of 64-bit values is summed with powers of an odd base (modulo 2^64), so the
hash of any span is a difference of two prefix sums times an inverse power, then mixed."""

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
# Texts are worked on in pieces of about this many bytes, cut at separators.
PIECE = 1 << 20
_LOW = np.uint64((1 << 20) - 1)

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n):
    """The powers of the base and of its inverse, at least `n` of each."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(h):
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of spans of one sequence of 64-bit values."""

    def __init__(self, values):
        self.size = len(values)
        power, self.inverse = powers(self.size + 1)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(values * power[: self.size], out=self.sums[1:])

    def spans(self, starts, ends):
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def grams(self, k):
        """Hashes of all spans of `k` values."""
        n = self.size - k + 1
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def word_spans(data, separator=IS_SEPARATOR):
    """Starts and ends of the runs of bytes that are not separators."""
    edge = np.empty(len(data) + 2, np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~separator[data]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def pieces(data, separator=IS_SEPARATOR):
    """Parts of a text of about PIECE bytes, cut at separators."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            gap = np.flatnonzero(separator[data[end:]])
            end = end + int(gap[0]) if len(gap) else len(data)
        yield data[at:end]
        at = end


def word_hashes(text, values=BYTE_VALUES, separator=IS_SEPARATOR):
    """The 64-bit hash of each word of a text given as bytes, in order."""
    data = np.frombuffer(text or b"", np.uint8)
    out = []
    for piece in pieces(data, separator):
        starts, ends = word_spans(piece, separator)
        if len(starts):
            out.append(Rolling(values[piece]).spans(starts, ends))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words, k=5):
    """Hashes of all runs of `k` words; of the whole sequence when it is shorter."""
    if not len(words):
        return words
    return Rolling(words).grams(min(k, len(words)))


def _sliding_minimum(a, width):
    """Minimum of each run of `width` values: prefix and suffix minima of blocks."""
    n = len(a)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = a
    padded = padded.reshape(blocks, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1: n])


def anchored(values, window, gram, table=None):
    """Split the starts of all windows of a sequence by the trigger they share.

    The trigger of a window is its leftmost smallest `gram`-long rolling hash, so equal windows
    have equal triggers at equal distances, wherever they stand. Returns arrays (trigger hash,
    context digest, first start, last start); a context is everything its windows cover.
    `table` turns the values (bytes, say) into 64-bit ones, piece by piece."""
    parts = []
    for base in range(0, max(len(values) - window + 1, 0), PIECE - window):
        part = values[base: base + PIECE - 1]
        if len(part) < window:
            break
        rolling = Rolling(part if table is None else table[part])
        grams = rolling.grams(gram)
        at = np.arange(len(grams), dtype=np.uint64)
        chosen = (_sliding_minimum((grams & ~_LOW) | at, window - gram + 1) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.concatenate((first[1:] - 1, [len(chosen) - 1]))
        trigger = chosen[first]
        place = mix((trigger - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (last - first).astype(np.uint64))
        digest = mix(rolling.spans(first, last + window) ^ place)
        parts.append((grams[trigger], digest, first + base, last + base))
    if not parts:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    return tuple(np.concatenate(x) for x in zip(*parts))
