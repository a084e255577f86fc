"""SetSketch registers of shingle sets: truncated, exponentially spaced minima that merge by maximum and agree more often the more two sets overlap."""

from __future__ import annotations

import numpy as np

#: Registers, base of their spacing, rate of the exponential values, largest register.
REGISTERS, BASE, RATE, LARGEST = 160, 1.001, 20.0, 2**16 - 2
#: Registers in a band. Sets of similarity 0.8 share no band with probability (1 - 0.8**5)**32, 3 in a million.
ROWS = 5
BANDS = REGISTERS // ROWS
GRID = 101

_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_FACTOR = _rng.integers(0, 2**64, REGISTERS, np.uint64) | np.uint64(1)
_OFFSET = _rng.integers(0, 2**64, REGISTERS, np.uint64)
_BAND = _rng.integers(0, 2**64, (ROWS, BANDS), np.uint64) | np.uint64(1)
_POWERS = np.ones(1, np.uint64)
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 2**64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << int(n).bit_length()
        for name, factor in (("_POWERS", _MULTIPLIER), ("_INVERSES", _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _POWERS, _INVERSES


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: Words that are hashed at once; a longer text is taken in parts that overlap, so that the tables of powers stay small.
PART_WORDS = 100_000


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words, A to Z lower-cased; of all words where there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= PART_WORDS:
        return np.unique(_runs(words, size))
    return np.unique(np.concatenate([_runs(words[at : at + PART_WORDS + size - 1], size) for at in range(0, len(words) - size + 1, PART_WORDS)]))


def _runs(words: list[bytes], size: int) -> np.ndarray:
    """The hash of each run; it depends on the bytes of the run alone."""
    codes = np.frombuffer(b" ".join(words), np.uint8)
    spaces = np.flatnonzero(codes == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(codes)]))
    k = min(size, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    powers, inverses = _powers(len(codes) + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[codes] * powers[: len(codes)], dtype=np.uint64)))
    return mixed((prefix[ends] - prefix[starts]) * inverses[starts])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set; a register holds floor(1 - log_BASE(least exponential value)), between 0 and LARGEST + 1."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        part = hashes[at : at + 256, None] * _FACTOR + _OFFSET
        np.minimum(least, part.min(0), out=least)
    return registers(least)


def registers(least: np.ndarray) -> np.ndarray:
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LARGEST + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def bands(sketches: np.ndarray) -> np.ndarray:
    """One bucket key a band for each row of registers."""
    r = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), (len(sketches), BANDS)).copy()
    for i in range(ROWS):
        h = mixed(h + (r[:, :, i] + np.uint64(1)) * _BAND[i])
    return h


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of each pair of sketches, from how many registers are larger, smaller and equal, with the sizes of the sets known."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    equal = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, GRID)[None, :] * np.minimum(u / v, v / u) * 0.999999

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
    tiny = 1e-12
    likelihood = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + equal[:, None] * np.log(np.maximum(1 - up - down, 0) + tiny)
    return np.take_along_axis(j, likelihood.argmax(1)[:, None], 1)[:, 0]
