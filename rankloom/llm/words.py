"""Words of texts as arrays, for work inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: What separates words: space and the controls 9 to 13. ``bytes.split`` cuts at just these.
SPACES = " \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words a worker keeps before it starts anew.
KEPT_WORDS = 250_000


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8 bytes; none of a null text."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(raw: bytes) -> bytes:
    """A-Z to a-z, everything else as it is."""
    return raw.translate(_LOWER)


class WordHashes(dict):
    """64-bit hashes of words, kept per worker."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mixed(out * _ODD + words[k : k + n] + np.uint64(k + 1))
    return out
