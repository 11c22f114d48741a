"""BPE encoding and decoding by dynamic programming over prefixes.

A byte-level BPE splits a text into pieces (a word with the space before it, a
run of digits, ...) and merges the bytes of a piece pair by pair, in order of
rank.  Here no merge is simulated.  For every prefix of a piece exactly one
token can be the last of the prefix's encoding: one that ends there and fits
the last token of the prefix before it.  An automaton over the vocabulary gives
the tokens that end at each place, ``fits`` tells whether two neighbours stay
apart in the encoding, and the tokens found are followed back from the end of
the piece.  Time grows with the length of the piece times the tokens that end
at one place, also for a piece of a million letters.

Each text is encoded whole, by one task; no shuffle is needed.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

# Words and pieces whose ids a worker remembers at least, and the longest of them.
REMEMBERED = 1 << 18
LONGEST = 40
# What the vocabulary's splitter takes off as pieces of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
# Separators that str.isspace() counts and the splitter doesn't.
NO_SPACE = "\x1c\x1d\x1e\x1f"


def _ranges(points: Iterator[int]) -> str:
    """Code points, ascending -> the inside of a character class."""
    out = []
    for _, run in itertools.groupby(enumerate(points), lambda x: x[1] - x[0]):
        run = [p for _, p in run]
        out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return "".join(out)


@cache
def split_pattern() -> str:
    """The pattern of the pieces, for ``re``.

    Letters, digits and white space are those of Python's tables; code points
    that these don't know yet are asked of the library's own splitter.
    """
    kinds: dict[str, list[int]] = {"L": [], "N": [], "S": []}
    unknown: list[str] = []
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        category = unicodedata.category(c)
        if category == "Cn":
            unknown.append(c)
        elif c.isspace() and c not in NO_SPACE:
            kinds["S"].append(point)
        elif category[0] in "LN":
            kinds[category[0]].append(point)
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str

    def one_piece(text: str) -> bool:
        return len(split(text)) == 1

    for at in range(0, len(unknown), 4096):
        block = unknown[at:at + 4096]
        if not one_piece("!" + "".join(block)):   # some are not marks
            for c in block:
                if one_piece("a" + c):
                    kinds["L"].append(ord(c))
                elif one_piece("1" + c):
                    kinds["N"].append(ord(c))
    letter, digit, space = (_ranges(sorted(kinds[k])) for k in "LNS")
    return "|".join([*CONTRACTIONS, f" ?[{letter}]+", f" ?[{digit}]+", f" ?[^{space}{letter}{digit}]+",
                     f"[{space}]+(?![^{space}])", f"[{space}]+"])


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte stands in the file: itself if it is a visible
    mark of Latin-1, else one of the letters from 256 on, in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str, pattern: str | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model.get("type") != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or \
                not splitter.get("use_regex", True) or spec.get("normalizer") or any(model.get(k) for k in plain):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        vocabulary: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take their surroundings")
        size = max([*vocabulary.values(), *added.values()]) + 1
        # parts of each token, and the rank at which it is made (bytes: -1)
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made, a, b = vocabulary[a + b], vocabulary[a], vocabulary[b]
            if self.rank[made] >= 0 or max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError(f"{path} makes a token twice, or of parts that come later")
            self.merges[a, b] = rank
            self.left[made], self.right[made], self.rank[made] = a, b, rank
        self.bytes = [b""] * size
        for token, i in vocabulary.items():
            if token not in added:
                self.bytes[i] = raw(token)
        # tokens that BPE makes of their own bytes; others never come out
        self.whole = {self.bytes[i].decode("latin-1"): i for i in vocabulary.values() if len(self.bytes[i]) == 1
                      or self.rank[i] >= 0 and self._apart(self.left[i], self.right[i], self.rank[i])}
        automaton = ahocorasick.Automaton()
        for token, i in self.whole.items():
            automaton.add_word(token, (i, len(token)))
        automaton.make_automaton()
        self.ending = automaton.iter
        for content, i in added.items():
            self.bytes[i] = content.encode()
        self.added = added
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = re.compile(pattern or split_pattern()).findall
        self.size = [len(b) for b in self.bytes]
        self.start = dict.fromkeys(self.whole.values(), True)
        self.followers = [_Followers(self, i) for i in range(size)]
        self.known, self.words = _Pieces(self), _Words(self)

    def _apart(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of a rank below ``before`` joins neighbours a and b
        at their border while they are made."""
        rank, merges = self.rank, self.merges
        until_a = until_b = before   # ranks at which the parts go into larger tokens
        while True:
            joined = merges.get((a, b))
            # of equal ranks the left pair is merged first
            if joined is not None and joined < until_a and (joined <= until_b if until_b < before else joined < before):
                return False
            if rank[b] >= rank[a]:
                if rank[b] < 0:
                    return True
                until_b, b = rank[b], self.left[b]
            else:
                until_a, a = rank[a], self.right[a]

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE encodes the bytes of a, then b, as a, then b."""
        return self._apart(a, b, sys.maxsize)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The tokens of one piece."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1")   # a letter for each byte
        if text in self.whole:
            return (self.whole[text],)
        followers = self.followers
        # for each prefix the tokens that may follow its last token
        after: list[dict[int, bool] | None] = [None] * (len(text) + 1)
        last = [0] * (len(text) + 1)
        after[0], found = self.start, -1
        for at, (token, n) in self.ending(text):   # by place, then longest first
            if at != found:
                row = after[at + 1 - n]
                if row is not None and row[token]:
                    after[at + 1], last[at + 1], found = followers[token], token, at
        out, end = [], len(text)
        while end:
            token = last[end]
            out.append(token)
            end -= self.size[token]
        return tuple(reversed(out))

    def _encode_span(self, text: str) -> tuple[int, ...]:
        found = self.pieces(text)
        if len(found) == 1:
            return self.known[text]
        return tuple(itertools.chain.from_iterable(map(self.known.__getitem__, found)))

    def _encode_plain(self, text: str) -> list[int]:
        """A text without added tokens.  A space with no white space beside it
        begins a piece, so texts fall into words there; a text that has other
        gaps at such a border is split as a whole."""
        first, *others = text.split(" ")
        ids = self.words.first(first)
        if ids is not None:
            try:
                return list(itertools.chain(ids, itertools.chain.from_iterable(map(self.words.__getitem__, others))))
            except _Gap:
                pass
        return list(self._encode_span(text))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null."""
        if not text:
            return []
        if self.between is None or not any(a in text for a in self.added):
            return self._encode_plain(text)
        out: list[int] = []
        for part in self.between.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self._encode_plain(part)
        return out

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Gap(Exception):
    """A word that begins or ends with white space, or an empty one."""


class _Followers(dict):
    """Tokens behind the token ``first`` -> whether they fit."""

    def __init__(self, bpe: Bpe, first: int):
        super().__init__()
        self.bpe, self.first = bpe, first

    def __missing__(self, token: int) -> bool:
        fits = self[token] = self.bpe.fits(self.first, token)
        return fits


class _Remembered(dict):
    """Texts -> their ids; those not asked for while as many others came are
    forgotten."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.before: dict[str, tuple[int, ...]] = {}

    def ids(self, text: str) -> tuple[int, ...]:
        raise NotImplementedError

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.before.get(text)
        if ids is None:
            ids = self.ids(text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[text] = ids
        return ids


class _Pieces(_Remembered):
    """Pieces -> their ids."""

    def ids(self, text: str) -> tuple[int, ...]:
        return self.bpe.encode_piece(text)


class _Words(_Remembered):
    """Words that stand behind a single space -> their ids."""

    def ids(self, text: str) -> tuple[int, ...]:
        if not text or text[0].isspace() or text[-1].isspace():
            raise _Gap
        return self.bpe._encode_span(" " + text)

    def first(self, word: str) -> tuple[int, ...] | None:
        """The ids of the word a text begins with; None if it ends in white space."""
        return None if word and word[-1].isspace() else self.bpe._encode_span(word)


@cache
def _loaded(path: str, pattern: str) -> Bpe:
    """The vocabulary, once for each Python worker."""
    return Bpe(path, pattern)


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


# Characters of a batch of texts that are encoded before they go back.
CHARS = 1 << 22


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``(<id_col>, ids)``: the ids of every whole text, as the tokenizers
    library gives them for the vocabulary file ``path`` without adding special
    tokens; with ``decoded`` a column ``decoded`` holds the text read back from
    the ids.

    One row per row of ``docs``, in no order: null and empty texts give empty
    lists, repeated rows and ids stay, an empty table gives no rows, an id may
    be null, other columns are ignored whatever their names; bytes that are no
    UTF-8 count as U+FFFD.  The file must lie at the same path on every machine.  A text is held whole by one task, and
    only a few million characters of texts at a time.
    """
    pattern = split_pattern()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < batch.num_rows:
                end, chars, ids = at, 0, []
                while end < batch.num_rows and chars < CHARS:
                    text = texts[end].as_py()
                    chars += len(text or "")
                    ids.append(bpe.encode(text))
                    end += 1
                columns, names = [batch.column(0).slice(at, end - at), _lists(ids)], [id_col, "ids"]
                if decoded:
                    columns.append(pa.array(map(bpe.decode, ids), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = end

    return docs.select(F.col(id_col), F.make_valid_utf8(F.col(text_col)).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(<id_col>, text)`` read from lists of ids of the vocabulary file
    ``path``; null lists give null, empty ones the empty text.  An id that the
    vocabulary doesn't hold is an error."""
    pattern = split_pattern()
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            texts = [None if i is None else bpe.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return tokens.select(F.col(id_col), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"`{id_col}` {kind}, text string")
