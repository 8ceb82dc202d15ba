"""Hashes of words and of runs of words, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

KNOWN_WORDS = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Known()


def split_words(text: str | None) -> list[bytes]:
    """The words of a text; bytes.split() knows just the six white space characters that are meant."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def _doubled(own: np.ndarray, length: int, join) -> np.ndarray:
    """``join`` over every run of ``length`` values: from runs of half the length, which may overlap."""
    if len(own) < length:
        return own[:0]
    reach = 1
    while reach < length:
        step = min(reach, length - reach)
        own = join(own[: len(own) - step], own[step:])
        reach += step
    return own


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` consecutive words."""
    with np.errstate(over="ignore"):
        return _doubled(mixed(hashes), length, lambda a, b: mixed(mixed(a) + b))


def run_minima(values: np.ndarray, length: int) -> np.ndarray:
    """The smallest of every run of ``length`` values."""
    return _doubled(values, length, np.minimum)


def run_maxima(values: np.ndarray, length: int) -> np.ndarray:
    """The largest of every run of ``length`` values."""
    return _doubled(values, length, np.maximum)


def forget() -> None:
    _known.clear()
