"""SentencePiece encoding and decoding (operator 6): unigram Viterbi over a double-array trie.

The pieces and log scores of a .model file become a double-array trie over UTF-8 bytes. A text
gets a leading blank, blanks become U+2581, and the best path of pieces (largest sum of scores;
of equal ones the one whose last piece is longest, from the end) is found by Viterbi. A character
that no piece starts with alone may be unknown, at the lowest score less 10; it is written as its
byte pieces. No piece holds U+2581 after another character, nor a line feed, so a text's best path
is that of its words end to end (checked when a model is loaded; otherwise whole texts are used):
each slice's distinct words are encoded at once, by numpy, and cached over slices."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ragged, slices
from .words import WordMemory, spread

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)


@dataclass
class Model:
    """Of one vocabulary's size, whatever the corpus."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    surfaces: list[bytes]  # what a piece decodes to; empty for control pieces
    byte_ids: np.ndarray
    is_byte: np.ndarray
    unknown_id: int
    longest: int
    split: str | None  # pattern of a text's words; None: encode it whole


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value: from state s by byte c to t = base[s] + c, if check[t] == s."""
    children: list[dict[int, int]] = [{}]
    final = {}
    for key, v in zip(keys, values, strict=True):
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        final[node] = v
    room = len(children) * 2 + 4096
    base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    free = np.ones(room, bool)
    free[0] = False
    place, low, top = {0: 0}, 1, 1
    for node in range(len(children)):  # parents come before children
        own = np.array(sorted(children[node]), np.int64)
        s = place[node]
        value[s] = final.get(node, -1)
        if not len(own):
            continue
        while not free[low]:
            low += 1
        at = max(0, low - int(own[0]))
        if len(own) > 1:  # the part below is dense: several places at once are found near the top
            at = max(at, top - 1024 - int(own[0]))
            while True:
                if at + 1024 > room:
                    base, check, value, free = (np.concatenate([x, np.full(room, f, x.dtype)]) for x, f in ((base, 0), (check, -1), (value, -1), (free, True)))
                    room *= 2
                good = free[at + np.arange(256)[:, None] + own[None, :]].all(1)
                if good.any():
                    at += int(np.argmax(good))
                    break
                at += 256
        elif at + int(own[0]) != low:  # a low place whose base would be negative
            at = int(np.flatnonzero(free[int(own[0]) :])[0])
        top = max(top, at + int(own[-1]) + 1)
        base[s] = at
        free[at + own] = False
        check[at + own] = s
        for c in own.tolist():
            place[children[node][c]] = at + c
    used = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
    return base[:used], check[:used], value[:used]


@lru_cache(4)
def load_model(path: str) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    kind = [UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) or sp.is_unused(i) else BYTE if sp.is_byte(i) else NORMAL for i in range(n)]
    return make_model(pieces, [sp.get_score(i) for i in range(n)], kind)


def make_model(pieces: list[str], scores: list[float], kinds: list[int]) -> Model:
    normal = [i for i, k in enumerate(kinds) if k == NORMAL]
    byte_ids = np.full(256, -1, np.int64)
    surfaces = []
    for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
        if k == BYTE:
            byte_ids[int(p[3:5], 16)] = i
            surfaces.append(bytes([int(p[3:5], 16)]))
        else:
            surfaces.append(p.replace(SPACE, " ").encode() if k == NORMAL else " ⁇ ".encode() if k == UNKNOWN else b"")
    if (byte_ids < 0).any():
        raise ValueError("the model lacks byte pieces")
    keys = sorted((pieces[i].encode(), i) for i in normal)
    base, check, value = double_array([k for k, _ in keys], [i for _, i in keys])
    words = all(SPACE not in pieces[i].lstrip(SPACE) for i in normal)
    lines = not any("\n" in pieces[i] for i in normal)
    split = (r"\n|[ ▁]*[^ ▁\n]+|[ ▁]+" if lines else r"[ ▁]*[^ ▁]+|[ ▁]+") if words else None
    return Model(base, check, value, np.array(scores, np.float64), surfaces, byte_ids, np.array([k == BYTE for k in kinds]), kinds.index(UNKNOWN), max(len(k) for k, _ in keys), split)


def viterbi(m: Model, words: list[str]) -> list[np.ndarray]:
    """Ids of each word's best path; words have U+2581 for blanks and are not empty."""
    coded = [w.encode() for w in words]
    raw = np.frombuffer(b"".join(coded), np.uint8)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    ends = np.cumsum(sizes)
    first = ends - sizes
    word = np.repeat(np.arange(len(coded)), sizes)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    state, at = np.zeros(len(starts), np.int64), starts
    limit = ends[word[starts]]
    char_end = np.append(starts[1:], len(raw))
    edges, single = [], np.zeros(len(raw), bool)
    origin = np.arange(len(starts))
    for depth in range(m.longest):
        nxt = m.base[state].astype(np.int64) + raw[at]
        ok = m.check[np.minimum(nxt, len(m.check) - 1)] == state
        ok &= nxt < len(m.check)
        origin, state = origin[ok], nxt[ok]
        at = starts[origin] + depth + 1
        got = m.value[state]
        hit = got >= 0
        edges.append((starts[origin[hit]], at[hit], got[hit].astype(np.int64), m.scores[got[hit]]))
        single[starts[origin[hit]]] |= at[hit] == char_end[origin[hit]]
        inside = at < limit[origin]
        origin, state, at = origin[inside], state[inside], at[inside]
        if not len(origin):
            break
    alone = np.flatnonzero(~single[starts])
    edges.append((starts[alone], char_end[alone], np.full(len(alone), m.unknown_id), np.full(len(alone), m.scores.min() - UNKNOWN_PENALTY)))
    begin, end, piece, score = (np.concatenate([e[i] for e in edges]) for i in range(4))
    # Positions are numbered within words; edges that end at the same place in their words are relaxed at once.
    relative = end - first[word[begin]]
    order = np.lexsort((begin, end, relative))
    begin, end, piece, score, relative = begin[order], end[order], piece[order], score[order], relative[order]
    best = np.full(len(raw) + 1, -np.inf)
    # A word's start shares its number with the end of the word before, which is kept apart.
    best_start = np.full(len(raw) + 1, -1, np.int64)
    best_piece = np.full(len(raw) + 1, -1, np.int64)
    bounds = np.flatnonzero(np.concatenate([[True], relative[1:] != relative[:-1]]))
    is_first = begin == first[word[begin]]
    for i, j in zip(bounds, np.append(bounds[1:], len(relative)), strict=True):
        total = np.where(is_first[i:j], 0.0, best[begin[i:j]]) + score[i:j]
        group = np.flatnonzero(np.concatenate([[True], end[i + 1 : j] != end[i : j - 1]]))
        top = np.maximum.reduceat(total, group)
        hit = np.flatnonzero(total == np.repeat(top, np.diff(np.append(group, j - i))))
        where, pick = np.unique(end[i:j][hit], return_index=True)
        best[where] = top
        best_start[where] = begin[i:j][hit[pick]]
        best_piece[where] = piece[i:j][hit[pick]]
    out_word, out_piece, out_from, out_to = [], [], [], []
    now, live = ends.copy(), np.arange(len(coded))
    while len(live):
        out_word.append(live)
        out_piece.append(best_piece[now])
        out_from.append(best_start[now])
        out_to.append(now)
        now = best_start[now]
        more = now > first[live]
        live, now = live[more], now[more]
    owner, piece, begin, end = (np.concatenate(x) for x in (out_word, out_piece, out_from, out_to))
    order = np.lexsort((begin, owner))
    owner, piece, begin, end = owner[order], piece[order], begin[order], end[order]
    count = np.where(piece == m.unknown_id, end - begin, 1)
    ids = np.repeat(piece, count)
    spread = ragged(begin, count)
    ids = np.where(ids == m.unknown_id, m.byte_ids[raw[spread]], ids).astype(np.uint32)
    return np.split(ids, np.cumsum(np.bincount(owner, weights=count, minlength=len(coded)).astype(np.int64))[:-1])


class Codec:
    def __init__(self, model: Model):
        self.m = model
        self.find = re.compile(model.split).findall if model.split else lambda text: [text]
        self.cache = WordMemory(self.paths, np.uint32)
        self.table = np.frombuffer(b"".join(model.surfaces), np.uint8)
        self.sizes = np.fromiter(map(len, model.surfaces), np.int64, len(model.surfaces))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best paths, of so many words at once that the table of their pieces stays small."""
        out = []
        for at in range(0, len(words), 16_000):
            out += viterbi(self.m, [w.replace(" ", SPACE) for w in words[at : at + 16_000]])
        return np.concatenate(out), np.fromiter(map(len, out), np.int32, len(out))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text); an empty text has none."""
        found = [self.find(" " + t) if t else [] for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        coded = pa.array([w for words in found for w in words], pa.large_string()).dictionary_encode()
        flat, starts, sizes = self.cache.of(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        took = sizes[codes]
        total = np.concatenate([[0], np.cumsum(took)])
        ends = np.cumsum(counts)
        return spread(flat, starts[codes], took), total[ends] - total[ends - counts]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Byte pieces become their bytes, U+2581 a blank, and the leading blank goes. Bytes that are
        no UTF-8 become U+FFFD."""
        size = self.sizes[ids]
        data = self.table[ragged(self.starts[ids], size)].tobytes()
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(counts)
        return [data[i:j].decode(errors="replace")[1 if data[i : i + 1] == b" " else 0 :] for i, j in zip(total[ends - counts].tolist(), total[ends].tolist(), strict=True)]


_made: list = []


def codec_of(shared) -> Codec:
    """The worker's codec for a broadcast model, kept between tasks."""
    model = shared.value
    if not _made or _made[0].m.scores is not model.scores:
        _made[:] = [Codec(model)]
    return _made[0]


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (array<int>). Null and empty texts have no ids. Repeated rows
    give repeated rows; other columns are ignored. A literal U+2581 decodes to a blank, as the
    marker cannot tell them apart; all other texts come back exactly."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_file))

    def run(batches):
        for b in slices(batches):
            ids, counts = codec_of(shared).encode(b.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id, text. Null ids give a null text, no ids an empty one. Also reports the
    checksum of the ids as little-endian 32-bit integers and how many are byte pieces."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_model(model_file))

    def parts(batches, most: int = 400_000):
        """Rows of about `most` ids at a time; one row at least."""
        for b in batches:
            ends = np.cumsum([len(x) if x.is_valid else 0 for x in b.column(1)])
            start = 0
            while start < b.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
                yield b.slice(start, stop - start)
                start = stop

    def run(batches):
        for b in parts(batches):
            codec = codec_of(shared)
            lists = b.column(1)
            counts = np.array([0 if x is None else len(x) for x in lists], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy()).astype(np.int64)
            ids = lists.flatten().to_numpy().astype(np.uint32)
            texts = codec.decode(ids, counts)
            null = ~lists.is_valid().to_numpy(zero_copy_only=False)
            total = np.concatenate([[0], np.cumsum(counts)])
            fallback = np.concatenate([[0], np.cumsum(codec.m.is_byte[ids])])
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(total[:-1], total[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string(), mask=null), pa.array(counts), pa.array(fallback[total[1:]] - fallback[total[:-1]]), pa.array(crc, pa.int64())], names=[id_col, "text", "n_ids", "n_byte_ids", "ids_crc32"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string, n_ids long, n_byte_ids long, ids_crc32 long")
