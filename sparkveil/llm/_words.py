"""Words and byte spans hashed with numpy, many texts at a time.

A span is hashed eight bytes a step, each step mixed into the last, so that no arithmetic structure of the bytes
survives; spans beyond LONG bytes go through xxhash one by one. Hashes have 64 bits: n different words share one with
a chance of about n**2 / 2**65.
"""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Spans up to so many bytes are hashed together, longer ones each by itself.
LONG = 64
_SEED = 0x9E3779B97F4A7C15
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * np.uint64(_SEED) + np.uint64(1))
    padded = data + bytes(8)
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    rest = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    at = starts[rest]
    left = sizes[rest]
    while len(rest):
        out[rest] = mix((out[rest] ^ (lanes[at] & _MASKS[np.minimum(left, 8)])) * np.uint64(_SEED))
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed=_SEED)
    return out


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one, A-Z lower-cased; starts and ends of the words `[^\\x20\\x09-\\x0D]+` in it, in order; and the
    n + 1 bounds of each text's words among them."""
    data = b"\n".join([*texts, b""]).translate(_LOWER)
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return data, starts, ends, np.searchsorted(starts, bounds)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, in order, and the n + 1 bounds of each text's words among them."""
    data, starts, ends, bounds = word_spans(texts)
    return span_hashes(data, starts, ends), bounds


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of the texts, equal for words of equal bytes and for no others, and the bounds. Hashes
    only sort the words; words of one hash are told apart by their bytes."""
    data, starts, ends, bounds = word_spans(texts)
    hashes = span_hashes(data, starts, ends)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    numbers = number.astype(np.uint64)
    sizes = ends - starts
    like = first[number]
    same = sizes == sizes[like]
    done = np.zeros(len(starts), np.int64)
    lanes = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    rest = np.flatnonzero(same)
    while len(rest):
        left = sizes[rest] - done[rest]
        mask = _MASKS[np.minimum(left, 8)]
        same[rest] &= (lanes[starts[rest] + done[rest]] & mask) == (lanes[starts[like[rest]] + done[rest]] & mask)
        done[rest] += 8
        rest = rest[(left > 8) & same[rest]]
    other: dict[bytes, int] = {}
    for i in np.flatnonzero(~same):
        numbers[i] = len(first) + other.setdefault(data[starts[i] : ends[i]], len(other))
    return numbers, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's k-word shingles, sorted within the text, and their n + 1 bounds. A text
    with fewer words has its whole sequence as its one shingle; one without words has none."""
    n, counts = len(words), np.diff(bounds)
    mixed = np.zeros(n, np.uint64)
    for i in range(k):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - i)] = words[i:]
        mixed = mix(mixed + part * np.uint64(2 * i + 3))
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = np.arange(n) + k <= np.repeat(bounds[1:], counts)
    keys, owners = mixed[whole], owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] = mix(extra[has] + words[bounds[short[has]] + i] * np.uint64(2 * i + 1) + np.uint64(i + 7))
        keys, owners = np.concatenate((keys, extra)), np.concatenate((owners, short))
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[fresh], owners[fresh]
    return keys, np.searchsorted(owners, np.arange(len(counts) + 1))


def shingle_numbers(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_hashes, of word numbers: a number for each distinct k-word sequence of the texts, without hashing.
    A sequence's number comes from those of its parts, two at a time."""
    n, counts = len(words), np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    # Numbers of sequences of one, two, ... words; 0 stands for a word beyond the text's end.
    single = words.astype(np.uint64) + np.uint64(1)
    level = np.unique(single, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    whole = level
    for i in range(1, k):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - i)] = level[i:]
        part[np.arange(n) + i >= np.repeat(bounds[1:], counts)] = 0
        whole = np.unique(whole << np.uint64(32) | part, return_inverse=True)[1].astype(np.uint64)
    heads = np.arange(n) + k <= np.repeat(bounds[1:], counts)
    short = counts < k
    heads[bounds[:-1][short & (counts > 0)]] = True
    heads &= ~(np.repeat(short, counts) & (np.arange(n) != np.repeat(bounds[:-1], counts)))
    keys, owners = whole[heads], owner[heads]
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[fresh], owners[fresh]
    return keys, np.searchsorted(owners, np.arange(len(counts) + 1))
