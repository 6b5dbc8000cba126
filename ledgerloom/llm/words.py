"""Splits a column of texts at ASCII white space, numbers its distinct words and remembers what was
made of words, all in flat Arrow and numpy buffers: a worker holds megabytes, no objects a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .runtime import ragged

#: Bytes that a worker's memory of words may take before it is emptied.
CACHE_BYTES = 20 << 20


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of words of each text, code of each word in order, word of each code)."""
    parts = pc.ascii_split_whitespace(column.fill_null("").cast(pa.large_string()))
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    if (empty := pc.index(words, "").as_py()) >= 0:  # leading or trailing white space leaves empty parts
        keep = codes != empty
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
        codes = codes[keep]
        codes = codes - (codes > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return counts, codes, words


class WordMemory:
    """Rows of numbers for words, some for each, by `make(list of words) -> (flat rows, rows of each)`.
    What is made stays from slice to slice in one worker, until it takes more than `limit` bytes."""

    def __init__(self, make, kind, width: int = 0, limit: int = CACHE_BYTES):
        self.make, self.limit = make, limit
        self.empty = np.zeros((0, width) if width else 0, kind)
        self.clear()

    def clear(self) -> None:
        self.words, self.flat, self.sizes = pa.array([], pa.large_string()), self.empty, np.zeros(0, np.int32)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat rows, place of each word's first row, number of its rows) for distinct words."""
        if self.words.nbytes + self.flat.nbytes + self.sizes.nbytes > self.limit:
            self.clear()
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        known = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            flat, sizes = self.make(new.to_pylist())
            known[known < 0] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.flat = np.concatenate([self.flat, np.asarray(flat, self.flat.dtype).reshape(-1, *self.flat.shape[1:])])
            self.sizes = np.concatenate([self.sizes, np.asarray(sizes, np.int32)])
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        return self.flat, starts[known], self.sizes[known].astype(np.int64)


def spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """The segments of `flat`, end to end; indexes are made for `most` segments at a time."""
    return np.concatenate([flat[:0], *(flat[ragged(starts[i : i + most], sizes[i : i + most])] for i in range(0, len(starts), most))])
