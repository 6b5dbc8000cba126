"""Ids of whole texts by a tokenizers file, word by word: the same ids as encoding each text at once.

The normaliser turns white space into blanks and no token spans it, so a text's ids are those of
its words. A corpus repeats words: each slice's distinct words are encoded once, and a bounded
cache carries them over slices. The tokenizer file is read on the driver and broadcast; its size
is that of one vocabulary, whatever the corpus."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .runtime import worker_cache
from .words import WordMemory, spread, word_codes

LONG_WORD = 64


#: Stands between words that are encoded in one call; a word of its own with an id of its own.
MARK = "\x01"
WORDS_A_CALL = 1000
SLICE = 4 << 20


class WordTokenizer:
    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        marks = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = marks[0] if len(marks) == 1 else None
        self.cache = WordMemory(self.flat, np.uint32)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word: of many in one call, cut at the mark between them."""
        out = []
        for at in range(0, len(words), WORDS_A_CALL):
            some = words[at : at + WORDS_A_CALL]
            if self.mark is None or any(MARK in w for w in some):
                out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark).tolist()
            out += [ids[i + 1 : j] for i, j in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]
        return out

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = self.encode(words)
        return np.concatenate(out), np.fromiter(map(len, out), np.int32, len(out))

    def ids(self, column, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each with `end` appended; how many of each text)."""
        counts, codes, words = word_codes(column)
        long = pc.greater(pc.binary_length(words), LONG_WORD).to_numpy(zero_copy_only=False)
        flat, starts, sizes = self.cache.of(words.filter(pa.array(~long)))
        first, took = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[~long], took[~long] = starts, sizes
        if long.any():  # not worth keeping
            more, some = self.flat(words.filter(pa.array(long)).to_pylist())
            first[long], took[long] = len(flat) + np.cumsum(some, dtype=np.int64) - some, some
            flat = np.concatenate([flat, more])
        # The end id is one more word after each text's words.
        first, took, flat = np.append(first, len(flat)), np.append(took, 1), np.append(flat, np.uint32(end))
        last = np.cumsum(counts)
        codes = np.insert(codes, last, len(words))
        ends = last + np.arange(1, len(counts) + 1)
        total = np.concatenate([[0], np.cumsum(took[codes])])
        return spread(flat, first[codes], took[codes]), total[ends] - total[np.concatenate([[0], ends[:-1]])]


def tokenizer_of(shared) -> WordTokenizer:
    """The worker's tokenizer for a broadcast definition, kept between tasks."""
    definition = shared.value
    return worker_cache(("tokenizer", hash(definition)), lambda: WordTokenizer(definition))


def broadcast_definition(spark, path: str):
    """A tokenizer file's text, at most 64 MB, as a broadcast."""
    if os.path.getsize(path) > 64 << 20:
        raise ValueError("a tokenizer file of over 64 MB")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
