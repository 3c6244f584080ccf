"""Words, word windows and their 64-bit hashes, for whole slices of texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash takes eight bytes at a
time through a mixing function, a long word's is a digest; a sequence's hash mixes the
hashes of its two halves at every doubling. Hashes only name candidates: whatever is
removed or linked is decided on bytes, or on cryptographic digests of them.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes from which a word is hashed, and stored, by a digest.
LONG = 64
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: The first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two sequences, one after the other."""
    with np.errstate(over="ignore"):
        return mix(a * _STEP + b)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the n+1 offsets; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    with np.errstate(over="ignore"):
        out = mix(sizes.astype(np.uint64) + _SEED)
    eights = np.ndarray((len(data),), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).tobytes(), strides=(1,))
    rows = np.flatnonzero(sizes <= LONG)
    at = 0
    while len(rows):
        left = np.minimum(sizes[rows] - at, 8)
        out[rows] = joined(out[rows], eights[starts[rows] + at] & _FIRST[left])
        at += 8
        rows = rows[sizes[rows] > at]
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """The words of a slice of texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, offsets = utf8(texts)
        if lower:
            data = _LOWER[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        word = ~_SPACE[data]
        before = np.concatenate(([False], word[:-1])) & ~first[:n]
        self.starts = np.flatnonzero(word & ~before)
        after = np.concatenate((word[1:], [False])) & ~first[1:] if n else word
        self.ends = np.flatnonzero(word & ~after) + 1
        self.offsets = np.searchsorted(self.starts, offsets)  # of each text's words, n+1
        self.data, self.text_offsets = data, offsets
        self.hashes = word_hashes(data, self.starts, self.ends)

    def plain_text(self, i: int) -> bytes:
        """The words of text i joined by one space."""
        a, b = self.text_offsets[i : i + 2]
        return b" ".join(self.data[a:b].tobytes().split())

    def pieces(self, first: int, last: int) -> list[bytes]:
        """The bytes of the words [first, last); a long word stands by its digest, after a byte that UTF-8 hasn't."""
        spans = zip(self.starts[first:last].tolist(), self.ends[first:last].tolist())
        return [self.data[a:b].tobytes() if b - a <= LONG else b"\xff" + blake2b(self.data[a:b].tobytes(), digest_size=32).hexdigest().encode() for a, b in spans]

    def runs(self, width: int) -> np.ndarray:
        """Hash of the `width` words from each word on, as far as there are so many; text bounds don't count."""
        out, have = self.hashes, 1
        while have < width:
            step = min(have, width - have)
            out = joined(out[: max(0, len(out) - step)], out[step:])
            have += step
        return out

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every window of `width` words inside one text, and the n+1 offsets of each text's windows."""
        counts = np.maximum(np.diff(self.offsets) - width + 1, 0)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        first = np.arange(offsets[-1]) + np.repeat(self.offsets[:-1] - offsets[:-1], counts)
        return self.runs(width)[first], offsets

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """As `windows`, but a text of fewer words has its whole sequence as the only one."""
        n = np.diff(self.offsets)
        hashes, at = self.windows(width)
        few = np.flatnonzero((n > 0) & (n < width))
        begin, whole = self.offsets[few], None
        for k in range(1, width):
            if whole is None:
                whole = joined(self.hashes[begin], n[few].astype(np.uint64))
            more = n[few] > k
            whole[more] = joined(whole[more], self.hashes[begin[more] + k])
        if len(few):
            hashes = np.insert(hashes, at[few], whole)
        return hashes, np.concatenate(([0], np.cumsum(np.where(n == 0, 0, np.maximum(n - width + 1, 1)))))
