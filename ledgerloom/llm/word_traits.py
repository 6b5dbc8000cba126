"""Dense traits of words, shared by the two classifiers."""

from __future__ import annotations

import re

import numpy as np

from .words import WordMemory

TRAITS = ("chars", "letters", "upper", "digits", "symbols", "bangs", "all_caps", "capital", "only_symbols", "ends_clause", "symbol_run", "obfuscated", "second_person")
# Second-person words.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti contigo tus usted ustedes vosotros".split())
MIXED = re.compile(r"[^\W\d_]+[0-9@$*!+]+[^\W\d_]+|[@$][^\W\d_]{2,}|[^\W\d_][.\-_][^\W\d_][.\-_][^\W\d_]")
RUN = re.compile(r"([^\w\s])\1")


def traits(word: str) -> tuple:
    if word.isalpha():
        n = len(word)
        lower = word.lower()
        person = lower in SECOND_PERSON
        if word == lower:
            return (n, n, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, person)
        upper = sum(map(str.isupper, word))
        return (n, n, upper, 0, 0, 0, upper == n and n > 1, word[0].isupper(), 0, 0, 0, 0, person)
    letters = sum(map(str.isalpha, word))
    upper = sum(map(str.isupper, word))
    digits = sum(map(str.isdigit, word))
    n = len(word)
    core = word.strip("\"'()[]{}.,;:!?*#%&$-").lower()
    return (n, letters, upper, digits, n - letters - digits, word.count("!") + word.count("?"), upper == letters > 1, word[0].isupper(), letters + digits == 0, word[-1] in ".!?;:,", bool(RUN.search(word)), bool(MIXED.search(core)), core in SECOND_PERSON)


def trait_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([traits(w) for w in words], np.float32).reshape(len(words), len(TRAITS)), np.ones(len(words), np.int32)


class TraitCache:
    """Traits of words, kept from slice to slice in a bounded memory."""

    def __init__(self):
        self.memory = WordMemory(trait_rows, np.float32, len(TRAITS))

    def of(self, words) -> np.ndarray:
        flat, starts, _ = self.memory.of(words)
        return flat[starts]


def sums(columns, counts: np.ndarray) -> np.ndarray:
    """A column each: sums of consecutive runs of `counts` values. One column is worked on at a time."""
    ends = np.cumsum(counts)
    out = []
    for values in columns:
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        out.append(total[ends] - total[ends - counts])
    return np.column_stack(out)
