"""Encoding a corpus with a public byte-level BPE vocabulary, exactly and in linear time.

A pre-token is encoded by the longest vocabulary matches found by an Aho-Corasick automaton over
its bytes (mapped to Latin-1 characters), backtracking to shorter matches where two neighbours
can't stand side by side: two tokens are compatible if merging their joined bytes by rank would
give just these two. That test is memoised for each pair of tokens and each place of a pre-token
is given up at most once, so the work is linear in the length. The merge loop is never run.

Null and empty texts both have an empty list of ids.
"""

from __future__ import annotations

import json
from array import array

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import kmers

#: Where the vocabulary lies; a parameter of every operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: White space as the public pre-tokenizer understands it (fixed value).
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Letters after an apostrophe that make a token with it (fixed values).
SHORT_FORMS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Entries of the memos for pre-tokens and pairs of tokens; they are emptied when full, so they only affect speed.
WORDS_HELD, LONGEST_HELD, PAIRS_HELD = 400_000, 160, 1_000_000
#: Characters pre-tokenised at once.
BLOCK = 1_000_000
#: Classes of characters; the last is the border between two texts.
LETTER, NUMBER, BLANK, OTHER, BORDER = range(5)


def byte_characters() -> dict[str, str]:
    """The printable stand-ins of byte-level vocabularies, to Latin-1 characters, by their published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Ids by Latin-1 text, and the two halves of each merged token, of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    to = byte_characters()
    special = {k for k in model["vocab"] if any(c not in to for c in k)}
    ids = {"".join(to[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
    halves = {}
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        a, b = ("".join(to[c] for c in x) for x in (a, b))
        halves.setdefault(ids[a + b], (ids[a], ids[b]))
    # Only tokens that are bytes or results of merges can come out of an encoding.
    ids = {k: v for k, v in ids.items() if len(k) == 1 or v in halves}
    # Flags of three ASCII characters in a row: 1 if the last two are together in a token with the first
    # or are a token; 2 if the first two are together in a token with the last.
    joins = np.zeros((128, 128, 128), np.uint8)
    for text in ids:
        if text.isascii():
            codes = text.encode()
            if len(codes) == 2:
                joins[:, codes[0], codes[1]] |= 1
        else:
            codes = bytes(min(ord(c), 128) for c in text)
        for x, y, z in zip(codes[:-2], codes[1:-1], codes[2:]):
            if max(x, y, z) < 128:
                joins[x, y, z] |= 3
    return {"ids": ids, "halves": halves, "classes": character_classes(), "joins": joins}


def character_classes() -> np.ndarray:
    """Class of every code point, and of the border that follows the last one."""
    table = np.full(0x110001, OTHER, np.uint8)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    every = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, f"[{SPACE}]")):
        table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    table[0x110000] = BORDER
    return table


def token_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point, by the public rules, for many texts at once.

    Runs of letters, of numbers and of other characters are pre-tokens and take one blank (0x20) before
    them; a run of white space stands alone without its last character if something follows it; an
    apostrophe with a short form after it is a pre-token unless a blank or another character of its
    kind precedes it.
    """
    kind = classes[points]
    starts = np.ones(len(kind), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BORDER)
    blank = kind == BLANK
    # A run of white space before something else gives up its last character.
    ends = blank[:-1] & ~blank[1:] & (kind[1:] != BORDER)
    starts[:-1] |= ends
    # If that is a plain blank, it opens what follows.
    joined = ends & (points[:-1] == 32)
    starts[1:] &= ~joined
    mark = np.flatnonzero((points[:-1] == 39) & starts[:-1] & (kind[1:] == LETTER))
    if len(mark):
        padded = np.append(points, [0, 0])
        for form in SHORT_FORMS:
            own = mark[padded[mark + 1] == ord(form[0])]
            if len(form) == 2:
                own = own[padded[own + 2] == ord(form[1])]
            starts[own + 1] = False
            after = own + 1 + len(form)
            after = after[after < len(kind)]
            starts[after] |= kind[after] == LETTER
    return starts


class Encoder:
    """Encodes texts; holds the automaton and the memos of one Python worker."""

    def __init__(self, vocabulary: dict):
        self.vocabulary = vocabulary
        ids, halves = vocabulary["ids"], vocabulary["halves"]
        top = max(ids.values()) + 1
        self.ids, self.left, self.right = ids, [-1] * top, [-1] * top
        for token, (a, b) in halves.items():
            self.left[token], self.right[token] = a, b
        self.by_pair = {a << 20 | b: token for token, (a, b) in halves.items()}
        self.length = [0] * top
        for text, token in ids.items():
            self.length[token] = len(text)
        self.most = max(map(len, ids))
        # The automaton's trie gives the longest stretch that begins a token.
        self.automaton = ahocorasick.Automaton()
        for text, token in ids.items():
            self.automaton.add_word(text, token)
        self.shorter = [-1] * top
        for text, token in ids.items():
            self.shorter[token] = next((ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in ids), -1)
        self.whole = {k: np.int32(v).tobytes() for k, v in ids.items()}
        self.beside: dict[int, bool] = {}
        self.classes, self.joins = vocabulary["classes"], vocabulary["joins"]
        self.spread = np.random.default_rng(7).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)
        self.words = _Memo(self.encode_word, WORDS_HELD)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of both tokens, merged by rank, end as these two tokens.

        Undo the merges next to the border from the latest to the earliest: if the tokens that then
        face each other merge at a rank below that of the merge undone last, the border vanishes.
        """
        left, right, by_pair, limit = self.left, self.right, self.by_pair, 1 << 60
        while True:
            if by_pair.get(a << 20 | b, limit) < limit:
                return False
            # The token made last is undone; at equal ranks the right one, as merging goes from the left.
            if left[b] < 0 or (left[a] >= 0 and a > b):
                if left[a] < 0:
                    return True
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def encode_word(self, word: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers."""
        text = word.encode().decode("latin-1")
        one = self.whole.get(text)
        if one is not None:
            return one
        length, shorter, beside, ids, most = self.length, self.shorter, self.beside, self.ids, self.most
        reach, n = self.automaton.longest_prefix, len(text)
        open_, out, at, last, token = bytearray(b"\x01") * (n + 1), [], 0, -1, -1
        while True:
            if token < 0:
                rest = text[at : at + most]
                rest = rest[: reach(rest)]
                token = ids.get(rest, -1)
                while token < 0:
                    rest = rest[:-1]
                    token = ids.get(rest, -1)
            end = at + length[token]
            if open_[end]:
                if last < 0:
                    fits = True
                else:
                    pair = last << 20 | token
                    fits = beside.get(pair)
                    if fits is None:
                        if len(beside) >= PAIRS_HELD:
                            beside.clear()
                        fits = beside[pair] = self.compatible(last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return array("i", out).tobytes()
                    at, last, token = end, token, -1
                    continue
            token = shorter[token]
            if token < 0:
                # No token can stand here: the one before must be shorter.
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = shorter[token]
                while token < 0:
                    open_[at] = 0
                    token = out.pop()
                    at -= length[token]
                    last = out[-1] if out else -1
                    token = shorter[token]

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each.

        Equal pre-tokens are found by 64 hash bits, compared with the first of their kind, and looked up once per block. Pre-tokens are parted
        further where no token of the vocabulary can lie across two characters, by the characters
        next to them, which keeps the pieces of random letters (embedded images) short enough to come again.
        """
        border = b"\x00\x00\x11\x00"
        points = np.frombuffer(border.join([t.encode("utf-32-le") for t in texts]) + border, np.uint32)
        letters = "\n".join(texts) + "\n"
        starts = token_starts(points, self.classes)
        # No token of the vocabulary lies across this place, so no merge crosses it: the parts are independent.
        if len(points) > 3:
            plain = np.minimum(points, 128).astype(np.int32)
            triple = self.joins.ravel()[(plain[:-2] << 14 | plain[1:-1] << 7 | plain[2:]) & 0x1FFFFF]
            ascii_ = points < 128
            free = (triple[:-1] & 1 == 0) & (triple[1:] & 2 == 0)
            starts[2:-1] |= free & ascii_[:-3] & ascii_[1:-2] & ascii_[2:-1] & ascii_[3:]
        start = np.flatnonzero(starts)
        size = np.diff(np.append(start, len(points)))
        place = np.arange(len(points)) - np.repeat(start, size)
        weights = self.spread if size.max() <= len(self.spread) else np.resize(self.spread, int(size.max())) * (np.arange(int(size.max()), dtype=np.uint64) | np.uint64(1))
        value = (points + np.uint64(1)) * np.uint64(kmers.BASE_A)
        h = np.add.reduceat((value ^ (value >> np.uint64(29))) * weights[place], start) + size.astype(np.uint64) * np.uint64(kmers.BASE_B)
        kind, kinds = pd.factorize(h)
        first = np.empty(len(kinds), np.int64)
        first[kind[::-1]] = np.arange(len(kind) - 1, -1, -1)
        kind, first = told_apart(points, start, size, place, kind, first)
        words = self.words
        border_kind = kind[np.searchsorted(start, len(points) - 1)]
        found = [words[letters[a:b]] for a, b in zip(start[first].tolist(), (start + size)[first].tolist())]
        found[border_kind] = b""
        ids = np.frombuffer(b"".join(found), np.int32)
        count = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(count) - count
        each = count[kind]
        ends = np.cumsum(each)
        at = np.arange(ends[-1]) + np.repeat(begin[kind] - ends + each, each)
        borders = np.flatnonzero(kind == border_kind)
        return ids[at], np.diff(ends[borders], prepend=0)

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian 32-bit integers."""
        return self.encode_block([text])[0].tobytes()


def told_apart(points: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and their first pieces, so that all pieces of a kind are equal: those that differ from the first get a kind of their own."""
    lead = first[kind]
    at = np.repeat(start[lead], size) + place
    unlike = points[np.minimum(at, len(points) - 1)] != points
    wrong = size[lead] != size
    if unlike.any():
        wrong[np.searchsorted(start, np.flatnonzero(unlike), "right") - 1] = True
    if wrong.any():
        kind = kind.copy()
        kind[wrong] = len(first) + np.arange(int(wrong.sum()))
        first = np.concatenate([first, np.flatnonzero(wrong)])
    return kind, first


class _Memo(dict):
    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= LONGEST_HELD:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_encoders: list[Encoder] = []


def worker_encoder(vocabulary: dict) -> Encoder:
    """The encoder of this Python worker, built once for a vocabulary sent."""
    if not _encoders or _encoders[0].vocabulary is not vocabulary:
        _encoders[:] = [Encoder(vocabulary)]
    return _encoders[0]


def encoded(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """(key, ids array<int>), or (key, tokens bigint) with ``counts_only``, of every row of ``df``.

    The vocabulary is read on the driver and broadcast; its size (some MB) does not depend on the
    data. Whole texts are encoded; no special tokens are added, and their strings are ordinary
    text. Rows with a null key keep it; rows that repeat give as many rows; extra columns are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        encoder = worker_encoder(sent.value)
        for whole in batches:
            size = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            done, at = np.concatenate([[0], np.cumsum(size)]), 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(done, done[at] + BLOCK, "right")) - 1)
                batch = whole.slice(at, to - at)
                at = to
                ids, sizes = encoder.encode_block([t or "" for t in batch.column(1).to_pylist()])
                if counts_only:
                    result = pa.array(sizes, pa.int64())
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    result = pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(np.ascontiguousarray(ids))]))
                yield pa.record_batch([batch.column(0), result], names=[key, "tokens" if counts_only else "ids"])

    return spread(df.select(key, F.col(text).cast("string").alias(text))).mapInArrow(run, f"`{key}` {kind}, {'tokens bigint' if counts_only else 'ids array<int>'}")
