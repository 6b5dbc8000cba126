"""Sets of five-word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .token_output import mix

WORDS = 5
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_HASH = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))
ODD = np.uint64(0x9E3779B97F4A7C15)
STEPS = np.cumprod(np.full(WORDS, np.uint64(0xC2B2AE3D27D4EB4F)))
SIZES = np.arange(WORDS + 1, dtype=np.uint64) * ODD
_powers = np.cumprod(np.full(1024, ODD))


def byte_powers(count: int) -> np.ndarray:
    global _powers
    if count > len(_powers):
        _powers = np.cumprod(np.full(2 * count, ODD))
    return _powers


PIECE = 1 << 18  # bytes of text that are hashed at a time


def word_hashes(raw: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text). Words are runs of bytes other than
    ASCII white space, A-Z lower-cased. Long texts are worked through by pieces; a word's hash is a sum over its
    bytes before it is mixed, so one that a piece's end cuts is carried on."""
    sums, begins, carried = [], [], 0
    for at in range(0, len(raw), piece):
        own = raw[at : at + piece]
        ink = ~SPACE[own]
        fresh = np.ones(len(own), bool)
        fresh[1:] = ~ink[:-1]
        fresh[0] = not carried
        fresh[offsets[(offsets >= at) & (offsets < at + len(own))] - at] = True
        start = ink & fresh
        letters = LOWER[own[ink]]
        if not len(letters):
            carried = 0
            continue
        heads = np.flatnonzero(start[ink])
        cut = len(heads) == 0 or heads[0] > 0
        if cut:
            heads = np.concatenate([[0], heads])
        sizes = np.diff(np.append(heads, len(letters)))
        place = np.arange(len(letters)) - np.repeat(heads, sizes)
        part = np.add.reduceat(BYTE_HASH[letters] * byte_powers(int(sizes.max()))[place], heads)
        if cut:
            sums[-1][-1:] += part[:1] * np.uint64(pow(int(ODD), carried, 1 << 64))
        sums.append(part[1:] if cut else part)
        if not len(sums[-1]):
            sums.pop()
        begins.append(np.flatnonzero(start) + at)
        carried = (int(sizes[-1]) + (carried if cut and len(heads) == 1 else 0)) if ink[-1] else 0
    begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return mix(np.concatenate(sums) if sums else np.zeros(0, np.uint64)), np.diff(np.searchsorted(begin, offsets))


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, end to end; number of shingles of each text), repeats among them. Texts of
    fewer words have their whole sequence as the one shingle; texts without words none."""
    h, words = word_hashes(raw, offsets)
    counts = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    ends = np.cumsum(words)
    value = np.full(len(h), SIZES[WORDS])
    for k in range(min(WORDS, len(h))):
        value[: len(h) - k] += h[k:] * STEPS[k]
    # Each text has a shingle at its first `count` words.
    keep = np.ones(len(h), bool)
    for k in range(1, WORDS):
        last = ends - k
        keep[last[(words > k) & ((words >= WORDS) | (last > ends - words))]] = False
    few = np.flatnonzero((words > 0) & (words < WORDS))
    for i, end, n in zip(few, ends[few], words[few], strict=True):
        value[end - n : end - n + 1] = SIZES[n : n + 1] + (h[end - n : end] * STEPS[:n]).sum(dtype=np.uint64)
    return mix(value[keep]), counts


def class_hashes(value: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each set; 0 for empty ones."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ (ODD * np.uint64(2 * seed + 1))))])
    ends = np.cumsum(sizes)
    classes = mix((total[ends] - total[ends - sizes]) ^ sizes.astype(np.uint64))
    return np.where(sizes > 0, classes, np.uint64(0)).view(np.int64)


def parities(value: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """For each set, of 64 * words classes of shingles, whether it holds an odd number: packed into
    `words` integers. Each shingle that only one of two sets has changes one bit of their difference."""
    bits, ends, out = 64 * words, np.cumsum(sizes), np.zeros((len(sizes), words), np.int64)
    for i in range(0, len(sizes), 4096):
        own = sizes[i : i + 4096]
        of = value[ends[i] - own[0] : ends[i + len(own) - 1]] >> np.uint64(40)
        odd = np.bincount(np.repeat(np.arange(len(own)), own) * bits + (of % np.uint64(bits)).astype(np.int64), minlength=len(own) * bits) & 1
        out[i : i + len(own)] = np.packbits(odd.astype(np.uint8).reshape(len(own), bits), axis=1).view(np.int64)
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, end to end; how many of each; class of each).
    Texts without words have no shingles and class 0. Equal classes are equal sets, but for collisions of
    64-bit hashes."""
    value, counts = shingle_hashes(raw, offsets)
    starts = np.cumsum(counts) - counts
    for i, n in zip(starts.tolist(), counts.tolist(), strict=True):
        if n > 1:
            value[i : i + n].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = value[1:] != value[:-1]
    keep[starts[counts > 0]] = True
    held = np.concatenate([[0], np.cumsum(keep)])
    value, sizes = value[keep], held[starts + counts] - held[starts]
    return value, sizes, class_hashes(value, sizes, seed)
