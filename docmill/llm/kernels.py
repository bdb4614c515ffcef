"""Vectorised byte kernels: word hashes, packed number arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: The odd multiplier of the polynomial hash with its inverse.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes that are hashed together.
BLOCK = 1 << 20
#: Bytes of a word that are hashed by XXH64 instead of eight at a time.
LONG_WORD = 256
#: By length up to eight: the bits of a word's bytes in a little-endian number.
BITS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64; kept for the next call."""
    if (known := _powers.get(base)) is None or len(known) < n:
        known = np.full(max(n, BLOCK + 1), base, np.uint64)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros past the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data) + 8, np.uint64)
    for s in range(8):
        own = out[s::8]
        own[:] = padded[s : s + 8 * len(own)].view("<u8")
    return out[: len(data)]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = MULTIPLIER**i times the sum of the scrambled eights from i up to j.

    A polynomial of plain bytes has clashes that hold for every multiplier (two
    letters in Thue-Morse order and in the other); scrambled eights don't.
    """
    out = np.zeros(len(data) + 1, np.uint64)
    values = eights(data)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)  # what makes them non-linear
    values *= powers(MULTIPLIER, len(data))
    np.cumsum(values, out=out[1:])
    return out


def span_hashes(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of eight bytes or more, equal for equal bytes of equal length."""
    return mixed((prefixes[ends - 7] - prefixes[starts]) * powers(INVERSE, len(prefixes))[starts])


def blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of blocks of about BLOCK bytes that end at white space or the end."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data):
            near = np.flatnonzero(IS_SPACE[data[end : end + BLOCK]])
            if len(near):
                end += int(near[0])
                break
            end = min(end + BLOCK, len(data))
        yield at, end
        at = end


def hashed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words data[starts:ends]: eights chained by a bijective scrambling; XXH64 for very long ones."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    out = mixed(lengths.astype(np.uint64) * np.uint64(MULTIPLIER))
    values = eights(data)
    more = np.flatnonzero(lengths <= LONG_WORD)
    at = 0
    while len(more):
        own = values[starts[more] + at] & BITS[np.minimum(lengths[more] - at, 8)]
        out[more] = mixed(out[more] ^ own)
        at += 8
        more = more[lengths[more] > at]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    bounds = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for at, end in blocks(data):
        part = data[at:end]
        edges = np.diff(IS_SPACE[part].view(np.int8), prepend=1, append=1)
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        hashes.append(hashed_words(LOWERED[part], starts, ends))
        counts += np.bincount(np.searchsorted(bounds, starts + at, "right"), minlength=len(texts))
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """A compressed array of 64-bit numbers; rising ones as differences."""
    values = np.ascontiguousarray(values).view(np.uint64)
    if rising:
        values = np.diff(values, prepend=np.uint64(0))
    planes = values.view(np.uint8).reshape(-1, 8).T
    used = 8 - next((i for i in range(8) if planes[7 - i].any()), 8)
    body = pa.compress(np.ascontiguousarray(planes[:used]).tobytes(), codec="zstd", asbytes=True) if len(values) else b""
    return len(values).to_bytes(5, "little") + bytes([used]) + body


def unpacked(data: bytes, rising: bool = False) -> np.ndarray:
    """The array, as unsigned numbers."""
    n, used = int.from_bytes(data[:5], "little"), data[5]
    planes = np.zeros((8, n), np.uint8)
    if n and used:
        raw = pa.decompress(data[6:], decompressed_size=n * used, codec="zstd", asbytes=True)
        planes[:used] = np.frombuffer(raw, np.uint8).reshape(used, n)
    values = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if rising else values
