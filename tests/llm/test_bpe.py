"""BPE by prefixes against the tokenizers library, which merges pair by pair."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quaysight.llm import bpe
from quaysight.llm.registry import QUERIES

from tests.conftest import MEDIUM

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


def same(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, repr(text[:80])
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


PARTS = ["a", "e", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'ll", "'LL", "1", "²", "é", "é", "中",
         "\U0001F600", "<|endoftext|>", "<|endof", "=", "-", "Ᲊ", "՘", "꟎", "the", "ing", " t", "\r\n", "A", "\x00", "�"]


def test_odd_texts(own, library):
    rnd = random.Random(11)
    for _ in range(6000):
        same(own, library, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))))


@pytest.mark.parametrize("part", ["=", "-", "a", "aaab", "Ã", "é", " ", "\n ", "the", "中", "ab1", "<|endoftext|>"])
def test_repeated_parts(own, library, part):
    for n in (1, 2, 5, 63, 64, 65, 66, 129, 1000):
        same(own, library, part * n)


def test_random_bytes_as_letters(own, library):
    rnd = random.Random(12)
    for _ in range(500):
        same(own, library, "".join(chr(rnd.choice((rnd.randrange(32, 127), rnd.randrange(1, 0x3000), rnd.randrange(0xE000, 0x11000))))
                                   for _ in range(rnd.randint(1, 60))))


def test_every_code_point_splits_alike(own, library):
    """Each assigned or unassigned code point between a letter, a digit, a mark and spaces."""
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for at in range(0, len(points), 20_000):
        part = [f"a{c}1{c}!{c} {c}{c} a" for c in map(chr, points[at:at + 20_000:7])]
        for text, pieces in zip(part, map(library.pre_tokenizer.pre_tokenize_str, part), strict=True):
            assert own.pieces(text) == [text[a:b] for _, (a, b) in pieces], hex(ord(text[1]))


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "LONGEST", 5)
    own, rnd = bpe.Bpe(PATH), random.Random(13)
    for _ in range(300):
        same(own, library, " ".join(rnd.choice(["one", "two", "three", "fourteen", "x", "\nno", "", "end.\n"]) for _ in range(9)))


def test_a_piece_of_a_million_letters(own, library):
    text = "a" * 500_000 + "=" * 300_000 + "xyzzy" * 40_000
    same(own, library, text)


def test_all_documents(spark, library):
    got = {}
    for r in QUERIES["op11_prefix_dp"](spark, MEDIUM).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, e in zip(docs, library.encode_batch([r.text or "" for r in docs], add_special_tokens=False), strict=True):
        text = library.decode(e.ids, skip_special_tokens=False)
        want.setdefault(r.doc_id, []).append((len(e.ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, e.ids)), text))))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_odd_rows(spark, library):
    rows = [(1, None, "x", 1), (1, "", "y", 2), (None, "null id", "z", 3), (2, "twice", None, 4), (2, "twice", None, 4),
            (3, "very long " * 60_000, "w", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = bpe.encode(docs, PATH, decoded=True)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t for *_, t in want)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).orderBy("doc_id").collect() == [(1, None), (2, "")]
    broken = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF62' as string)").alias("text"))
    assert bpe.encode(broken, PATH, decoded=True).first().decoded == "a�b"


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="not a plain byte-level BPE"):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
