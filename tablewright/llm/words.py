"""Words of a text and their 64-bit hashes, as arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the word positions, and of the final mixing of a 64-bit number.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def split_words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of the whole text in UTF-8; NULL has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype("u8")


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    found = np.full(n, base, "u8")
    found[:1] = 1
    return np.cumprod(found, dtype="u8")


def window_hashes(hashes: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Rabin-Karp hash, modulo 2 ** 64, of each run of ``width`` words.

    hash = sum of word i times base ** (width - 1 - i), rolled from one window
    to the next by prefix sums, then mixed.
    """
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, "u8")
    if width <= 6:
        total = np.zeros(count, "u8")
        for i in range(width):
            total = total * base + hashes[i : i + count]
        return mix(total)
    up = powers(base, len(hashes))
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    # sums[i] = sum of hashes[j] / base ** j over j < i
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(hashes * powers(inverse, len(hashes)), dtype="u8")])
    return mix((sums[width:] - sums[:count]) * up[width - 1 : width - 1 + count])
