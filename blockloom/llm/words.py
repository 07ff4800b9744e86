"""Words of many texts at once: 64-bit hashes of words and of word sequences, in numpy over the raw bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Which bytes belong to words: all but ASCII white space, or ASCII letters, digits and the bytes of other scripts.
SPACED = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
ALPHANUMERIC = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Bytes read at once, and words hashed at once: what is held besides the hashes does not grow with a text.
BLOCK = 1 << 20
#: Bytes of a word that are hashed in numpy; a longer word is digested by itself.
WHOLE = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; the last seven bytes are padding."""
    return np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))


def _hashes(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each word's eights are mixed in one after another, so words of up to eight bytes never share a hash with their like."""
    eights, out = _eights(padded), mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    live = np.arange(len(starts))
    long_ = np.flatnonzero(lengths > WHOLE)
    if len(long_):
        live = np.flatnonzero(lengths <= WHOLE)
        for k in long_.tolist():
            word = padded[starts[k] : starts[k] + lengths[k]]
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    for at in range(0, WHOLE, 8):
        if not len(live):
            break
        left = lengths[live] - at
        out[live] = mix(out[live] ^ (eights[starts[live] + at] & _MASKS[np.minimum(left, 8)]))
        live = live[left > 8]
    return out


def _blocks(body: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that cut no word."""
    lo, n = 0, len(body)
    while lo < n:
        hi = min(n, lo + BLOCK)
        if hi < n:
            cut = np.flatnonzero(~inside[body[lo:hi]])
            if len(cut):
                hi = lo + int(cut[-1]) + 1
            else:  # one long word
                while hi < n and not len(cut := np.flatnonzero(~inside[body[hi : hi + BLOCK]])):
                    hi += BLOCK
                hi = min(n, hi + (int(cut[0]) + 1 if hi < n else 0))
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """hashes of all words, at[k]: index of text k's first word (one more at the end); on demand the words themselves."""

    hashes: np.ndarray
    at: np.ndarray
    starts: np.ndarray | None = None
    lengths: np.ndarray | None = None
    padded: np.ndarray | None = None

    def injective(self) -> bool:
        """Whether words of equal hash are equal, byte by byte."""
        order = np.argsort(self.hashes, kind="stable")
        same = np.flatnonzero(self.hashes[order[1:]] == self.hashes[order[:-1]])
        a, b = order[same], order[same + 1]
        if not np.array_equal(self.lengths[a], self.lengths[b]):
            return False
        eights, left, x, y = _eights(self.padded), self.lengths[a], self.starts[a], self.starts[b]
        for k in np.flatnonzero(left > WHOLE).tolist():
            if not np.array_equal(self.padded[x[k] : x[k] + left[k]], self.padded[y[k] : y[k] + left[k]]):
                return False
        short = left <= WHOLE
        left, x, y = left[short], x[short], y[short]
        for at in range(0, WHOLE, 8):
            if not len(left):
                break
            if np.any((eights[x + at] ^ eights[y + at]) & _MASKS[np.minimum(left - at, 8)]):
                return False
            more = left - at > 8
            left, x, y = left[more], x[more], y[more]
        return True


def words_of(body: np.ndarray, offsets: np.ndarray, inside: np.ndarray, whole: bool = False) -> Words:
    """The words of texts that lie end to end, A-Z lower-cased. whole: keep the words themselves too."""
    most = len(body) // 2 + len(offsets) + 1  # of which only what is written takes memory
    hashes, starts_, lengths_ = np.empty(most, np.uint64), *([np.empty(most, np.int64) for _ in range(2)] if whole else [None] * 2)
    at, words, text = np.zeros(len(offsets), np.int64), 0, 0
    padded = np.zeros(len(body) + 8, np.uint8) if whole else None
    for lo, hi in _blocks(body, inside):
        own = np.zeros(hi - lo + 8, np.uint8)
        np.take(LOWER, body[lo:hi], out=own[: hi - lo])
        if whole:
            padded[lo:hi] = own[: hi - lo]
        on = np.zeros(hi - lo + 2, bool)
        on[1:-1] = inside[body[lo:hi]]
        here = np.searchsorted(offsets, [lo, hi])
        cuts = np.zeros(hi - lo + 1, bool)
        cuts[offsets[here[0] : here[1]] - lo] = True
        cuts[0] = cuts[-1] = True
        starts = np.flatnonzero(on[1:-1] & (~on[:-2] | cuts[:-1]))
        lengths = np.flatnonzero(on[1:-1] & (~on[2:] | cuts[1:])) + 1 - starts
        at[here[0] : here[1]] = words + np.searchsorted(starts, offsets[here[0] : here[1]] - lo)
        new = slice(words, words + len(starts))
        words, text = words + len(starts), here[1]
        hashes[new] = _hashes(own, starts, lengths)
        if whole:
            starts_[new], lengths_[new] = starts + lo, lengths
    at[text:] = words
    return Words(hashes[:words], at, starts_[:words] if whole else None, lengths_[:words] if whole else None, padded)


def window_hashes(words: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at i + places for each i where they exist."""
    n = len(words) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for lo in range(0, n, BLOCK):
        part = out[lo : lo + BLOCK]
        for k, p in enumerate(places):
            part ^= words[lo + p : lo + p + len(part)]
            part *= np.uint64((0xD6E8FEB86659FD93 + 2 * k * 0x9E3779B9) & (2**64 - 1) | 1)
            part ^= part >> np.uint64(29)
        part[:] = mix(part + np.uint64(len(places)))
    return out
