"""LM scoring by cross-entropy difference.

Two bigram models of the same order, smoothing (Witten-Bell over add-one
unigrams) and vocabulary: the target model counts the documents labelled good,
the background model all documents.  A document's score is the mean over its
words of target loss minus background loss (nats): the lower, the closer to
the target.

The vocabulary is every word of the corpus, and every distinct pair of words is
counted.  Words go by 62-bit numbers, made anew if two words get the same.  Pairs
of the most frequent words lie in a matrix that is broadcast.  All others are
dealt with their documents to parts, whose number grows with the corpus: pairs
after a frequent word by the word that follows, pairs after another word by that
word, so that a part holds all it needs but what is broadcast.  The part
counts its pairs and sums their losses by document; only pairs of a rare word
after a word that isn't frequent go on to the part of the rare word for its
counts.  Then a block's documents get their sums.

With a number of symbols (``size``) the model is one of classes instead: the
most frequent words have bigrams of their own, all others share one symbol, and
the loss of such a word is that of the symbol plus that of the word under it
(add-one over all words of the symbol).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysight.llm.common import drop_stored, stored

# Words whose pairs lie in the matrix, the start of a text among them.
CACHED = 2048
# Further words whose counts are broadcast; those of all others are joined.
KNOWN = 1 << 17
# Bitmaps of the target corpus' ids that are broadcast, at most.
BITMAPS = 1 << 12
# Words of a block of documents, at least, and documents, at most.
BLOCK_WORDS = 1 << 20
DOC_BITS = 16
BLOCK_DOCS = 1 << DOC_BITS
# Words of the corpus for each part that the pairs are dealt to.
PART_WORDS = 1 << 20
# Numbers of the words that aren't known begin here; bits below that tell them apart.
RARE = 1 << 62
ID_BITS = 62
# Losses outside of the matrix are summed in whole units of 1 / UNIT nat.
UNIT = 1 << 30
# Kinds of rows that travel between the tasks.
DOCS, FOLLOWERS, HISTORIES, WORDS, SUMS, GOING, PAIRS, CELLS = range(8)
# Histories (rows of the count matrix) that travel as one row.
BLOCK = 64
# Distinct words that a task counts before it passes them on.
FLUSH = 400_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, good) -> counts of words in all and in good texts."""
    def out(total: Counter, good: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64()),
             pa.array([good[w] for w in total], pa.int64())], names=["word", "n", "t"])

    total: Counter = Counter()
    target: Counter = Counter()
    for batch in batches:
        for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            total.update(words)
            if good:
                target.update(words)
            if len(total) > FLUSH:
                yield out(total, target)
                total, target = Counter(), Counter()
    yield out(total, target)


def word_counts(docs: DataFrame, target_col: str, text_col: str = "text") -> DataFrame:
    """``(word, n, t)``: every word with its count in all and in target texts."""
    return (docs.select(F.col(text_col).cast("string"), F.col(target_col)).mapInArrow(_count_words, "word binary, n long, t long")
            .groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))


def _symbols(text: str | None, ids: dict[bytes, int], size: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Symbols of a text; the places in the broadcast word losses of those
    words of symbol 0 that are there, and the other words of symbol 0."""
    words = words_of(text)
    at = np.fromiter((ids.get(w, 0) for w in words), np.int64, len(words))
    known = at >= size
    rest = [words[i] for i in np.flatnonzero(at == 0)]
    return np.where(known, 0, at), at[known] - size, rest


def bigram_counts(docs: DataFrame, ids, size: int, target_col: str, text_col: str = "text") -> DataFrame:
    """``(block, cells, target, background)``: counts of every pair of symbols
    (history row ``size`` is the start of a text), summed over all documents
    and packed by block of histories.  Each task sums its own documents first."""
    def cells_of(text: str | None) -> np.ndarray:
        s = _symbols(text, ids.value, size)[0]
        return np.concatenate(([size], s[:-1])) * size + s if len(s) else s

    return _summed(docs.select(F.col(text_col).cast("string"), F.col(target_col)), cells_of, size)


def _summed(frame: DataFrame, cells_of, size: int) -> DataFrame:
    """Rows (value, good) -> the cells of all values, counted as in ``bigram_counts``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (size + 1) * size), np.int64)
        for batch in batches:
            keys: tuple[list, list] = ([], [])
            for value, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys[bool(good)].append(cells_of(value))
            for good in (0, 1):
                if keys[good]:
                    cells, n = np.unique(np.concatenate(keys[good]), return_counts=True)
                    total[1][cells] += n
                    if good:
                        total[0][cells] += n
        cells = np.flatnonzero(total[1])
        cut = np.searchsorted(cells, np.arange(0, (size + 1 + BLOCK) * size, BLOCK * size))
        rows = [(b, cells[x:y]) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in rows], pa.int32()),
             *(pa.array([v.tobytes() for v in part], pa.binary()) for part in (
                 [c.astype(np.int32) for _, c in rows], [total[0][c] for _, c in rows], [total[1][c] for _, c in rows]))],
            names=["block", "cells", "target", "background"])

    def merge(key, table):
        low = key[0].as_py() * BLOCK * size
        total = np.zeros((2, BLOCK * size), np.int64)
        for c, t, b in zip(*(table.column(n).to_pylist() for n in ("cells", "target", "background")), strict=True):
            at = np.frombuffer(c, np.int32) - low
            total[0][at] += np.frombuffer(t, np.int64)
            total[1][at] += np.frombuffer(b, np.int64)
        at = np.flatnonzero(total[1])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": [(at + low).astype(np.int32).tobytes()],
                         "target": [total[0][at].tobytes()], "background": [total[1][at].tobytes()]})

    schema = "block int, cells binary, target binary, background binary"
    # a block's rows: one per task; each is at most BLOCK * size cells
    return frame.mapInArrow(count, schema).groupBy("block").applyInArrow(merge, schema)


def _gathered(counted: DataFrame, size: int) -> np.ndarray:
    """Target and background counts of all cells, at most (size + 1) * size."""
    counts = np.zeros((2, (size + 1) * size), np.int64)
    for row in counted.toLocalIterator():
        at = np.frombuffer(row.cells, np.int32)
        counts[0][at] = np.frombuffer(row.target, np.int64)
        counts[1][at] = np.frombuffer(row.background, np.int64)
    return counts


def losses(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell losses -ln p(word | history) from a matrix of counts
    (histories x words, the start as last history)."""
    words = counts.sum(axis=0, dtype=np.float64)
    base = ((words + 1) / (words.sum() + len(words))).astype(np.float32)
    seen = counts.sum(axis=1, dtype=np.float64)
    kinds = np.count_nonzero(counts, axis=1).astype(np.float64)
    out = np.empty(counts.shape, np.float32)
    for h in range(len(counts)):   # row by row: no further matrix in memory
        p = (counts[h] + kinds[h] * base) / (seen[h] + kinds[h]) if seen[h] else base
        out[h] = -np.log(p)
    return out


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _codes(words: list[bytes], salt: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, from ``RARE`` on, and checks by which two words of one
    number are found out."""
    key = salt.to_bytes(8, "little")
    digests = np.frombuffer(b"".join(blake2b(w, digest_size=16, key=key).digest() for w in words), np.int64).reshape(-1, 2)
    return digests[:, 0] & ((1 << bits) - 1) | RARE, digests[:, 1].astype(np.int32)


def numbered_counts(docs: DataFrame, target_col: str, text_col: str = "text", salt: int = 0) -> DataFrame:
    """``(id, n, t, clash)``: as ``word_counts``, by the number of the word;
    ``clash`` tells that several words have it."""
    bits = ID_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _count_words(batches):
            ids, checks = _codes(batch.column(0).to_pylist(), salt, bits)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(checks), *batch.columns[1:]], names=["id", "mark", "n", "t"])

    return (docs.select(F.col(text_col).cast("string"), F.col(target_col)).mapInArrow(count, "id long, mark int, n long, t long")
            .groupBy("id").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), (F.min("mark") != F.max("mark")).alias("clash")))


def _packed(values: np.ndarray) -> bytes:
    """An array as compressed bytes, those of equal weight side by side."""
    v = np.ascontiguousarray(values)
    planes = v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()
    return len(v).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def _rows(rows: list[tuple], id_type: pa.DataType | None = None) -> pa.RecordBatch:
    """Rows (part, kind, block, ids, arrays) that travel between the tasks;
    ``ids`` only with a type."""
    part, kind, block, ids, data = zip(*rows, strict=True)
    columns = {"part": pa.array(part, pa.int32()), "kind": pa.array(kind, pa.int32()), "block": pa.array(block, pa.int64())}
    if id_type is not None:
        columns["ids"] = pa.array(ids, pa.list_(id_type))
    columns["data"] = pa.array([[x if isinstance(x, bytes) else _packed(x) for x in d] for d in data], pa.list_(pa.binary()))
    return pa.RecordBatch.from_pydict(columns)


def _dealt(kind: int, block: int | None, parts: int, key: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """The entries as rows, a row for each part that has any; they keep their order."""
    part = (key % parts).astype(np.uint16 if parts < 1 << 16 else np.int32)
    order = np.argsort(part, kind="stable")
    there, cut = np.unique(part[order], return_index=True)
    out = []
    for p, at in zip(there.tolist(), np.split(order, cut[1:]) if len(there) else [], strict=True):
        out.append((p, kind, block, None, [x[at] for x in (key, *arrays)]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], known, start: int, salt: int, bits: int, most: int):
    """Rows (id, text, good) in blocks: type and list of the ids, whether good,
    words of each text; history, word and text of every word."""
    codes, numbers = known.value
    held: list = []
    local, number = _Numbers(), np.empty(0, np.int64)

    def block() -> tuple:
        nonlocal held, local, number
        if fresh := list(islice(local, len(number), None)):
            code = _codes(fresh, salt, bits)[0]
            if len(codes):
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                code = np.where(codes[at] == code, numbers[at], code)
            number = np.concatenate((number, code))
        sizes = np.array([len(s) for _, s, _ in held], np.int64)
        w = number[np.concatenate([s for _, s, _ in held])]
        h = np.concatenate(([start], w[:-1])) if len(w) else w
        h[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
        made = (id_type, [i for i, *_ in held], np.array([g for *_, g in held], bool), sizes, h, w,
                np.repeat(np.arange(len(held)), sizes))
        held = []
        if len(local) > FLUSH // 2:
            local, number = _Numbers(), np.empty(0, np.int64)
        return made

    words = 0
    for batch in batches:
        id_type = batch.column(0).type
        for i, text, good in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = np.array([*map(local.__getitem__, words_of(text))], np.int64)
            held.append((i, s, bool(good)))
            words += len(s)
            if words >= most or len(held) >= BLOCK_DOCS:
                yield block()
                words = 0
    if held:
        yield block()


def _frequent(blocks, size: int, parts: int):
    """Rows (id, text, good) -> counts of the cells of the matrix (cell 0 of a
    history: all its other followers), and per part the distinct pairs of a
    frequent history and a word outside of the matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (size + 1) * size), np.int64)
        for _, _, good, _, h, w, doc in blocks(batches):
            at = h <= size
            h, w, good = h[at], w[at], good[doc[at]]
            inside = w < size
            cells = h * size + np.where(inside, w, 0)
            for counts, some in zip(total, (cells[good], cells), strict=True):
                some, n = np.unique(some, return_counts=True)
                counts[some] += n
            w, h = w[~inside], 2 * h[~inside] + good[~inside]
            order = np.lexsort((h, w))
            w, h = w[order], h[order]
            first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (h[1:] != h[:-1]))[:len(w)])
            if rows := _dealt(PAIRS, None, parts, w[first], h[first]):
                yield _rows(rows)
        cells = np.flatnonzero(total[1])
        cut = np.searchsorted(cells, np.arange(0, (size + 1 + BLOCK) * size, BLOCK * size))
        rows = [(-1 - b, CELLS, None, None, [c := cells[x:y], total[0][c], total[1][c]])
                for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        if rows:
            yield _rows(rows)
    return run


def _kinds(size: int):
    """The rows of ``_frequent`` of a part -> sums of its cells; for each history
    how many distinct words outside of the matrix follow."""
    def run(key, table):
        data, part = table.column("data").to_pylist(), key[0].as_py()
        if part < 0:
            low = (-1 - part) * BLOCK * size
            total = np.zeros((2, BLOCK * size), np.int64)
            for cells, *counts in data:
                at = _unpacked(cells) - low
                for out, n in zip(total, counts, strict=True):
                    out[at] += _unpacked(n)
            at = np.flatnonzero(total[1])
            return pa.table({"h": pa.nulls(1, pa.int32()), "t": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()),
                             "data": pa.array([[_packed(x) for x in (at + low, total[0][at], total[1][at])]], pa.list_(pa.binary()))})
        w, h = (np.concatenate([_unpacked(d[i]) for d in data]) for i in (0, 1))
        order = np.lexsort((h, w))
        w, h, good = w[order], h[order] >> 1, h[order] & 1
        # of a pair's entries the last is the good one, if any is
        last = np.append((w[1:] != w[:-1]) | (h[1:] != h[:-1]), True)
        h, good = h[last], good[last]
        n, t = np.bincount(h, minlength=size + 1), np.bincount(h[good > 0], minlength=size + 1)
        at = np.flatnonzero(n)
        return pa.table({"h": pa.array(at, pa.int32()), "t": pa.array(t[at], pa.int64()), "n": pa.array(n[at], pa.int64()),
                         "data": pa.nulls(len(at), pa.list_(pa.binary()))})
    return run


def _postings(blocks, models, size: int, parts: int):
    """Rows (id, text, good) -> a row per block with its documents and their
    losses inside the matrix, and all other pairs of words, dealt by the rarer
    kind of word: the word after a frequent history, else the history."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables = models.value
        for block, (id_type, ids, good, sizes, h, w, doc) in enumerate(blocks(batches), TaskContext.get().partitionId() << 24):
            hot = h <= size
            at = hot & (w < size)
            cells = h[at] * size + w[at]
            inside = [np.bincount(doc[at], t[cells].astype(np.float64), len(ids)) for t in tables]
            rows = [(block % parts, DOCS, block, ids, [sizes, *inside])]
            mark = 2 * doc + good[doc]
            for kind, some, key, other in ((FOLLOWERS, hot & ~at, w, h), (HISTORIES, ~hot, h, w)):
                mine = _dealt(kind, block, parts, key[some], other[some], mark[some])
                # texts come in order: their steps are small
                rows += [(*x, [a, b, np.diff(m, prepend=0)]) for *x, (a, b, m) in mine]
            yield _rows(rows, id_type)
    return run


def _loss(c: np.ndarray, kinds: np.ndarray, seen: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Witten-Bell losses in units of 1 / UNIT, so that sums don't depend on order."""
    p = np.where(seen > 0, (c + kinds * base) / np.maximum(seen + kinds, 1), base)
    return np.rint(-np.log(p) * UNIT).astype(np.int64)


def _rest_words(data: list) -> tuple[np.ndarray, ...]:
    """Numbers and counts (target, all) of a part's rare words, by number."""
    found = [np.concatenate([np.empty(0, np.int64), *(_unpacked(d[i]) for d in data)]) for i in range(3)]
    order = np.argsort(found[0])
    return tuple(x[order] for x in found)


def _by_block(parts: int, block: np.ndarray, doc: np.ndarray, sums: list[np.ndarray]) -> list[tuple]:
    """Sums of entries that are in order of block and document, a row per block."""
    if not len(doc):
        return []
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])))
    sums = [np.add.reduceat(s, first) for s in sums]
    block, doc = block[first], doc[first]
    cut = np.flatnonzero(np.diff(block)) + 1
    return [(int(b[0] % parts), SUMS, int(b[0]), None, x) for b, *x in zip(
        *(np.split(x, cut) for x in (block, doc, *sums)), strict=True)]


def _kept(table: pa.Table, kind: int) -> tuple[list, list, list]:
    """Blocks, ids and arrays of the rows of a kind."""
    some = table.filter(pa.array(table.column("kind").to_numpy() == kind))
    return tuple(some.column(c).to_pylist() for c in ("block", "ids", "data"))


def _price(counts, totals: list[float], parts: int):
    """The postings of a part -> sums of losses by document; pairs with a rare
    word after a history that isn't frequent go on to the part of that word."""
    def run(key, table):
        seen_of, kinds_of, count_of = counts.value
        id_type = table.schema.field("ids").type.value_type
        rare, *rare_counts = _rest_words(_kept(table, WORDS)[2])
        out = [(key[0].as_py(), DOCS, *row) for row in zip(*_kept(table, DOCS), strict=True)]
        for kind in (FOLLOWERS, HISTORIES):
            blocks, _, data = _kept(table, kind)
            if not blocks:
                continue
            # the batches of a group come in any order
            a, b, mark = ([_unpacked(d[i]) for d in data] for i in range(3))
            block = np.repeat(np.array(blocks, np.int64), [len(x) for x in a])
            a, b, mark = np.concatenate(a), np.concatenate(b), np.concatenate([np.cumsum(m) for m in mark])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            each = np.diff(np.append(begin, len(a)))
            pair = [np.add.reduceat(mark[order] & 1, begin), each]
            a, b = a[begin], b[begin]
            if kind == FOLLOWERS:
                w, seen, kinds = a, [x[b] for x in seen_of], [x[b] for x in kinds_of]
            else:
                w, first = b, np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                wide = np.diff(np.append(first, len(a)))
                seen = [np.repeat(np.add.reduceat(x, first), wide) for x in pair]
                kinds = [np.repeat(np.add.reduceat((x > 0).astype(np.int64), first), wide) for x in pair]
            far = w >= RARE
            at = np.where(far, 0, w)
            follow = [x[at] for x in count_of]
            if kind == FOLLOWERS and far.any():
                place = np.searchsorted(rare, w[far])
                for x, y in zip(follow, rare_counts, strict=True):
                    x[far] = y[place]
                far[:] = False
            price = [np.where(far, 0, _loss(c, k, s, (x + 1) / total))
                     for c, k, s, x, total in zip(pair, kinds, seen, follow, totals, strict=True)]
            # back to the order of the documents
            place = np.empty(len(order), np.int64)
            place[order] = np.repeat(np.arange(len(a)), each)
            some = ~far[place]
            out += _by_block(parts, block[some], mark[some] >> 1, [p[place[some]] for p in price])
            if far.any():
                some, row = place[~some], (block << DOC_BITS | mark >> 1)[~some]
                out += _dealt(GOING, None, parts, w[some], row, *(x[some] for x in (*pair, *kinds, *seen)))
        return pa.Table.from_batches([_rows(out, id_type)] if out else [], None if out else table.schema)
    return run


def _price_rare(totals: list[float], parts: int):
    """The rows of a part: sums of a block are added, and pairs that wait for
    their rare word get their losses."""
    def run(key, table):
        id_type = table.schema.field("ids").type.value_type
        rare, *rare_counts = _rest_words(_kept(table, WORDS)[2])
        out = [(key[0].as_py(), DOCS, *row) for row in zip(*_kept(table, DOCS), strict=True)]
        blocks, _, data = _kept(table, SUMS)
        entries = [(np.repeat(np.int64(b), len(x[0])) << DOC_BITS | x[0], *x[1:])
                   for b, d in zip(blocks, data, strict=True) for x in [[_unpacked(y) for y in d]]]
        for d in _kept(table, GOING)[2]:
            w, row, *x = map(_unpacked, d)
            at = np.searchsorted(rare, w)
            entries.append((row, *(_loss(x[m], x[2 + m], x[4 + m], (rare_counts[m][at] + 1) / totals[m]) for m in (0, 1))))
        if entries:
            row, *sums = (np.concatenate(x) for x in zip(*entries, strict=True))
            order = np.argsort(row)
            row = row[order]
            out += _by_block(parts, row >> DOC_BITS, row & (1 << DOC_BITS) - 1, [s[order] for s in sums])
        return pa.Table.from_batches([_rows(out, id_type)] if out else [], None if out else table.schema)
    return run


def _documents(key, table):
    """The rows of a block -> its documents with their whole losses."""
    _, (ids,), (data,) = _kept(table, DOCS)
    inside = [_unpacked(x, np.float64) for x in data[1:]]
    rest = np.zeros((2, len(ids)), np.int64)
    for doc, *sums in _kept(table, SUMS)[2]:
        for out, s in zip(rest, sums, strict=True):
            out[_unpacked(doc)] += _unpacked(s)   # each document once
    return pa.table({"doc_id": pa.array(ids, table.schema.field("ids").type.value_type), "n_words": _unpacked(data[0]),
                     **{n: x + r / UNIT for n, x, r in zip(("target", "background"), inside, rest, strict=True)}})


def _score_all_pairs(docs: DataFrame, marked: DataFrame, known: int, cached: int, id_col: str, text_col: str) -> DataFrame:
    """``score`` over all distinct pairs of words."""
    spark = docs.sparkSession
    sc, size = spark.sparkContext, cached
    bits, most = ID_BITS, BLOCK_WORDS
    for salt in range(1 << 16):
        words = stored(numbered_counts(marked, "__good", text_col, salt), "words")
        kinds, sum_t, sum_n, clashes = words.agg(F.count("*"), F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)),
                                                 F.count_if("clash")).first()
        if not clashes:
            break
        drop_stored(words)   # two words of one number: other numbers
    else:
        raise RuntimeError(f"no {bits}-bit numbers tell {kinds} words apart")
    totals, parts = [float(sum_t + kinds), float(sum_n + kinds)], 1 + sum_n // PART_WORDS
    # at most size - 1 + known words come to the driver
    first = words.orderBy(F.desc("n"), "id").limit(size - 1 + known).select("id", "t", "n").toArrow()
    codes, *counts = (c.to_numpy() for c in first.columns)
    placed = np.array([*range(1, size), *range(size + 1, size + 1 + known)][:len(codes)], np.int64)
    order = np.argsort(codes)
    ids = sc.broadcast((codes[order], placed[order]))
    count_of = np.zeros((2, size + 1 + known), np.int64)
    count_of[:, placed] = counts

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"part int, kind int, block long, ids array<{kind}>, data array<binary>"
    texts = marked.select("__id", F.col(text_col).cast("string").alias("__text"), "__good")

    def blocks(batches):
        return _blocks(batches, ids, size, salt, bits, most)

    counted = stored(texts.mapInArrow(_frequent(blocks, size, parts), "part int, kind int, block long, data array<binary>")
                     .select("part", "data").groupBy("part").applyInArrow(_kinds(size), "h int, t long, n long, data array<binary>"), "kinds")
    cells = np.zeros((2, (size + 1) * size), np.int64)
    for r in counted.where("h IS NULL").select("data").toLocalIterator():
        at, *n = map(_unpacked, r.data)
        cells[:, at] = n
    cells = cells.reshape(2, size + 1, size)
    seen, distinct = cells.sum(axis=2), np.count_nonzero(cells[:, :, 1:], axis=2)
    for r in counted.where("h IS NOT NULL").groupBy("h").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect():   # at most size rows
        distinct[:, r.h] += (r.t, r.n)
    models = []
    for m in (0, 1):
        base = (count_of[m][:size] + 1) / totals[m] if kinds else np.ones(size)
        table = np.zeros(cells[m].shape, np.float32)
        for h in range(1, size + 1):   # row by row: no further matrix in memory
            if seen[1][h]:
                p = (cells[m][h] + distinct[m][h] * base) / (seen[m][h] + distinct[m][h]) if seen[m][h] else base
                table[h, 1:] = -np.log(p[1:])
        models.append(table.ravel())
    del cells
    models, counts = sc.broadcast(models), sc.broadcast((seen, distinct, count_of))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_, t, n = (c.to_numpy() for c in batch.columns)
            at = ~np.isin(id_, ids.value[0])
            if rows := _dealt(WORDS, None, parts, id_[at], t[at], n[at]):
                yield _rows(rows)

    rare = (words.select("id", "t", "n").mapInArrow(packed, "part int, kind int, block long, data array<binary>")
            .select("part", "kind", "block", F.lit(None).cast(f"array<{kind}>").alias("ids"), "data"))
    # in a fixed order: a task that runs again makes the same blocks
    posted = texts.sortWithinPartitions("__id", "__text", "__good").mapInArrow(_postings(blocks, models, size, parts), schema)
    priced = posted.unionByName(rare).groupBy("part").applyInArrow(_price(counts, totals, parts), schema)
    priced = priced.unionByName(rare).groupBy("part").applyInArrow(_price_rare(totals, parts), schema)
    return _means(priced.groupBy("block").applyInArrow(_documents, f"doc_id {kind}, n_words long, target double, background double")
                  .withColumns({"rest_t": F.lit(0.0), "rest_n": F.lit(0.0)}))


def _means(sums: DataFrame) -> DataFrame:
    losses_of = [(F.col(c) + F.coalesce(f"rest_{r}", F.lit(0.0))) / F.nullif("n_words", F.lit(0))
                 for c, r in (("target", "t"), ("background", "n"))]
    return sums.select("doc_id", "n_words", losses_of[0].alias("target_loss"), losses_of[1].alias("background_loss"),
                       (losses_of[0] - losses_of[1]).alias("score"))


def _marked(docs: DataFrame, good: DataFrame) -> DataFrame:
    """``docs`` with ``__good``, true for the ids of ``good``, else null.

    Whole numbers are looked up in bitmaps, 4 KB for 2^15 neighbouring ids, that
    are broadcast: the texts, which are read several times, stay where they
    are.  Other ids, or too many bitmaps, are joined, and the result is stored.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    if docs.schema["__id"].dataType.simpleString() in whole and good.schema["__id"].dataType.simpleString() in whole:
        place = F.col("__id").cast("long")
        bits = stored(good.groupBy(F.bitmap_bucket_number(place).alias("__bucket"))
                      .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits")), "target-ids")
        if bits.count() <= BITMAPS:
            at = F.bitmap_bit_position(place)
            byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            held = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (at % 8 + 1).cast("int"))) > 0
            return (docs.withColumn("__bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "__bucket", "left")
                    .withColumn("__good", F.when(held, True)).drop("__bucket", "__bits"))
    return stored(docs.join(good.distinct().withColumn("__good", F.lit(True)), "__id", "left"), "marked")


def score(docs: DataFrame, labels: DataFrame, target: str = "quality = 1", size: int | None = None, known: int = KNOWN,
          cached: int = CACHED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, target_loss, background_loss, score)`` per row of
    ``docs``; losses are means per word in nats.

    The target corpus is the documents whose id has a label row for which
    ``target`` holds (null is no; repeated labels count once).  Repeated
    documents count as often as they occur.  Null and blank texts have 0 words
    and null losses; a null id is never in the target.  Without any target the
    target model is uniform over all words (with ``size``, over its symbols and
    over the words of symbol 0).  An empty table gives no rows.  ``known`` and
    ``cached`` move work between a broadcast and a join and change no score.
    """
    sc = docs.sparkSession.sparkContext
    marked = _marked(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias(text_col)),
                     labels.where(F.expr(target)).select(F.col(id_col).alias("__id")).where("__id IS NOT NULL"))
    if size is None:
        return _score_all_pairs(docs, marked, known, cached, id_col, text_col)
    words = stored(word_counts(marked, "__good", text_col), "words")
    # at most size - 1 + known words come to the driver
    first = words.orderBy(F.desc("n"), "word").limit(size - 1 + known).collect()
    kinds, *sums = words.agg(F.count("*"), F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = first[:size - 1]
    # kinds and total count (target, background) of the words of symbol 0
    kinds -= len(top)
    sums = [sums[0] - sum(r.t for r in top), sums[1] - sum(r.n for r in top)]
    under = [[np.log((x + kinds) / (c + 1)) for c in column] for x, column in zip(
        sums, ([r.t for r in first[size - 1:]], [r.n for r in first[size - 1:]]), strict=True)]
    under = sc.broadcast([np.array(u, np.float64) for u in under])
    # symbols 1 to size - 1, then the known words of symbol 0
    ids = sc.broadcast({bytes(r.word): i for i, r in enumerate(top, 1)}
                       | {bytes(r.word): i for i, r in enumerate(first[size - 1:], size)})
    counts = _gathered(bigram_counts(marked, ids, size, "__good", text_col), size)
    models = sc.broadcast([losses(c.reshape(size + 1, size)).ravel() for c in counts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tables, inner = ids.value, models.value, under.value
        for batch in batches:
            n, sums, rests = [], [[], []], []
            for text in batch.column(1).to_pylist():
                s, at, rest = _symbols(text, place, size)
                n.append(len(s))
                rests.append(rest)
                cells = np.concatenate(([size], s[:-1])) * size + s if len(s) else s
                for t, u, out in zip(tables, inner, sums, strict=True):
                    out.append(float(t[cells].sum(dtype=np.float64) + u[at].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in sums),
                 pa.array(rests, pa.list_(pa.binary()))], names=["doc_id", "n_words", "target", "background", "rest"])

    kind = docs.schema[id_col].dataType.simpleString()
    # written, so that a row keeps its number
    begun = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_words long, target double, background double, rest array<binary>")
        .withColumn("row", F.monotonically_increasing_id()), "begun")
    # each word here is rarer than the known ones: no hot key
    rest = (begun.select("row", F.explode("rest").alias("word")).join(words, "word").groupBy("row")
            .agg(*(F.sum(F.log((F.lit(x) + kinds) / (F.col(c) + 1))).alias(f"rest_{c}") for x, c in zip(sums, "tn", strict=True))))
    return _means(begun.drop("rest").join(rest, "row", "left"))
