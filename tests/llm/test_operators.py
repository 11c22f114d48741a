"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quaysight.llm import (
    chat_format,
    decontaminate,
    impact_index,
    lm_score,
    mixture,
    pii,
    toxicity,
    url_rules,
    virtual_slots,
)
from quaysight.llm.registry import CONTROL_TEXT, ORACLE_SQL, QUERIES, URL_RULES
from quaysight.session import ensure_checkpoint_dir

from tests.compare import compare
from tests.conftest import MEDIUM, SMALL

LARGE = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf=SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1: chat formatting

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_read_back(spark):
    said = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        said[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    said[-7] = [(0, "user", CONTROL_TEXT), (1, "assistant", CONTROL_TEXT)]
    got = {r.conv_id: r for r in QUERIES["op1_schema_fingerprint"](spark, SMALL).collect()}
    assert got.keys() == said.keys()
    for conv, turns in said.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_odd_turns_round_trip(spark):
    odd = ["", "\\", "\\\\<", "</turn>\n<turn user>\n", "<turn ", "a\\", "\n\n", "é<\U0001F600>", "x" * 200_000, None]
    rows = [(i % 3 if i % 4 else None, i if i % 5 else None, ["assistant", None, "us>er\\"][i % 3], t, 1)
            for i, t in enumerate(odd * 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head int")
    got = chat_format.format_conversations(chat_format.canonical_turns(df)).collect()
    want = defaultdict(list)
    for c, turn, role, text, _ in rows:
        want[c].append((turn is None, turn or 0, role is not None, role or "", text is not None, text or ""))
    assert {r.conv_id for r in got} == want.keys()
    for r in got:
        turns = [(x[3], x[5]) for x in sorted(want[r.conv_id])]
        assert chat_format.read_turns(r.formatted) == turns
        loss = [chat_format.unescaped(r.formatted[s.start:s.end]) for s in r.loss_spans]
        assert loss == [t for role, t in turns if role == "assistant"]
    empty = chat_format.format_conversations(chat_format.canonical_turns(df.limit(0)))
    assert empty.count() == 0 and chat_format.digests(empty).count() == 0


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "extra": [1]}], "id": 3},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "response": "b", "turn": 9},
        {"prompt": "a", "completion": "b"},
        {"instruction": "a", "input": "", "output": "b"},
        {"instruction": "a", "input": "c", "output": "b", "system": "s"},
        {"question": "a", "answer": "b"},
        {"unknown": 1}, [1], None]
    rows = [(i, json.dumps(r) if r is not None else None) for i, r in enumerate(records)] + [(99, "{broken")]
    got = defaultdict(list)
    for r in chat_format.canonical_json_turns(spark.createDataFrame(rows, "conv_id long, record string")).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.layout, r.role, r.text))
    for i in (0, 1, 2, 3, 4, 6):
        assert [x[1:] for x in got[i]] == [("user", "a"), ("assistant", "b")], i
    assert [x[1:] for x in got[5]] == [("system", "s"), ("user", "a"), ("user", "c"), ("assistant", "b")]
    assert all(got[i] == [(None, None, None)] for i in (7, 8, 9, 99))
    nested = spark.createDataFrame([(1, [("user", "hi"), ("assistant", None)])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [tuple(r) for r in chat_format.canonical_turns(nested).collect()] == [(1, 0, "user", "hi"), (1, 1, "assistant", None)]
    with pytest.raises(ValueError, match="no layout"):
        chat_format.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


# 3: LM scoring

@pytest.mark.parametrize("known", [0, 100, 1 << 17])
def test_losses_match_plain_counting(spark, known):
    docs, labels = documents(spark), spark.read.parquet(f"{SMALL}/labels.parquet")
    size = 64
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    freq = Counter(w for t in texts.values() for w in t)
    ids = {w: i for i, w in enumerate(sorted(freq, key=lambda w: (-freq[w], w))[:size - 1], 1)}

    def model(chosen):
        uni, hist, pair, kinds, rare = Counter(), Counter(), Counter(), Counter(), Counter()
        for d in chosen:
            last = size
            for w in texts[d]:
                s = ids.get(w, 0)
                kinds[last] += (last, s) not in pair
                pair[last, s] += 1
                hist[last] += 1
                uni[s] += 1
                rare[w] += w not in ids
                last = s
        total, under = sum(uni.values()), rare.total() + len(freq) - len(ids)

        def loss(h, s, w):
            p = (uni[s] + 1) / (total + size)
            return -math.log((pair[h, s] + kinds[h] * p) / (hist[h] + kinds[h]) if hist[h] else p) - (
                0 if s else math.log((rare[w] + 1) / under))
        return loss

    models = model(good & texts.keys()), model(texts)
    for r in lm_score.score(docs, labels, size=size, known=known).collect():
        s = [size] + [ids.get(w, 0) for w in texts[r.doc_id]]
        assert r.n_words == len(s) - 1
        want = [np.mean([m(a, b, w) for (a, b), w in zip(itertools.pairwise(s), texts[r.doc_id], strict=True)]) for m in models]
        assert [r.target_loss, r.background_loss, r.score] == pytest.approx([*want, want[0] - want[1]], abs=1e-4)


@pytest.mark.parametrize(("cached", "known", "block"), [(2048, 1 << 17, 1 << 20), (16, 30, 500), (1, 0, 1)])
def test_all_pairs_of_words_count(spark, monkeypatch, cached, known, block):
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", block)
    docs = documents(spark).limit(200)
    docs = docs.unionByName(docs.limit(3))   # repeated rows
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    corpus = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    vocabulary = {w for _, t in corpus for w in t}

    def model(chosen):
        uni, pair = Counter(), Counter()
        for t in chosen:
            uni.update(t)
            pair.update(zip([None, *t], t))
        seen, kinds = Counter(), Counter()
        for (h, _), n in pair.items():
            seen[h] += n
            kinds[h] += 1

        def loss(h, w):
            p = (uni[w] + 1) / (uni.total() + len(vocabulary))
            return -math.log((pair[h, w] + kinds[h] * p) / (seen[h] + kinds[h]) if seen[h] else p)
        return loss

    models = model([t for d, t in corpus if d in good]), model([t for _, t in corpus])
    want = sorted((d, len(t), *(np.mean([m(h, w) for h, w in zip([None, *t], t)]) for m in models)) for d, t in corpus if t)
    got = sorted(tuple(r)[:4] for r in lm_score.score(docs, labels, cached=cached, known=known).collect() if r.n_words)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.array([g[2:] for g in got]) == pytest.approx(np.array([w[2:] for w in want]), abs=1e-5)
    assert lm_score.score(docs.limit(0), labels).count() == 0
    none = lm_score.score(docs, labels.limit(0), cached=cached, known=known).where("n_words > 0").first()
    assert none.target_loss == pytest.approx(math.log(len(vocabulary)), abs=1e-5)


def test_lm_numbers_that_clash(spark, monkeypatch):
    docs, labels = documents(spark).limit(60), spark.read.parquet(f"{SMALL}/labels.parquet")
    marked = docs.withColumn("good", F.lit(True))

    def clashes(salt):
        return lm_score.numbered_counts(marked, "good", salt=salt).agg(F.count_if("clash")).first()[0]

    def scores():
        return np.array(sorted(tuple(r) for r in lm_score.score(docs, labels, cached=16, known=30).collect() if r.n_words))

    want = scores()
    assert clashes(0) == 0
    for bits in itertools.count(2 * lm_score.word_counts(marked, "good").count().bit_length(), -1):   # one that the first salt doesn't fit
        monkeypatch.setattr(lm_score, "ID_BITS", bits)
        if clashes(0):
            break
    assert scores() == pytest.approx(want, abs=1e-8)


def test_targets_are_found_by_bitmap_and_by_join(spark, monkeypatch):
    ids = [0, 1, -1, 7, 8, 9, -32768, 32768, 32769, 65536, -65537, 2**63 - 1, 2**40]
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "x") for i in [*ids, *ids, None, 2, -2, 10, 32767, 65537, 2**40 + 1]], "__id long, text string")
    chosen = rng.sample(ids, 9)
    for kind, most in (("long", 1 << 12), ("long", 0), ("string", 1 << 12)):
        monkeypatch.setattr(lm_score, "BITMAPS", most)
        good = spark.createDataFrame([(i,) for i in chosen * 2], "__id long").withColumn("__id", F.col("__id").cast(kind))
        got = lm_score._marked(docs.withColumn("__id", F.col("__id").cast(kind)), good)
        assert got.columns == ["__id", "text", "__good"]
        rows = Counter((int(r[0]) if r[0] is not None else None, r[2]) for r in got.collect())
        assert rows == Counter((r[0], True if r[0] in chosen else None) for r in docs.collect())


def test_all_pairs_edges(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PART_WORDS", 1 << 12)   # 20 parts
    docs = spark.createDataFrame([(1, None, "", "", 0), (2, " ", "", "", 0), (None, "a b", "", "", 0), (4, "a b " * 40_000, "", "", 0),
                                  (4, "a", "", "", 0)], DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 1), (2, None)], "doc_id long, quality int")
    blank = spark.createDataFrame([(1, None, "", "", 0), (2, " ", "", "", 0)], DOCS)
    for kind in ("long", "string"):
        texts, marks = (t.withColumn("doc_id", F.col("doc_id").cast(kind)) for t in (docs, labels))
        for cached, known in ((2048, 100), (1, 0)):
            got = lm_score.score(texts, marks, cached=cached, known=known)
            assert got.schema["doc_id"].dataType.simpleString() == texts.schema["doc_id"].dataType.simpleString()
            assert sorted((r.n_words, r.doc_id and int(r.doc_id), r.score is None) for r in got.collect() if r.n_words) == [
                (1, 4, False), (2, None, False), (80_000, 4, False)]
            assert got.where("n_words = 0 AND score IS NULL").count() == 2
    assert lm_score.score(blank, labels).where("n_words = 0 AND target_loss IS NULL").count() == 2


def test_pairs_of_words_take_little_disk(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.25, 2_000), 10**7)) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4).cache()
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    assert docs.count() == 200

    def disk():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        kept = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
        return kept + sum(files.apply(i).length() for i in range(files.size()))

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = disk()
    scores = lm_score.score(docs, labels, cached=64, known=1000)
    assert scores.where("n_words = 2000").count() == 200
    used = disk() - before
    docs.unpersist()
    assert used < 1.6 * sum(map(len, texts)), used / sum(map(len, texts))


def test_lm_edges(spark):
    docs = spark.createDataFrame([(1, None, "", "", 0), (2, " ", "", "", 0), (None, "a b", "", "", 0), (4, "a b " * 40_000, "", "", 0),
                                  (4, "a", "", "", 0)], DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 1), (2, None)], "doc_id long, quality int")
    got = lm_score.score(docs, labels, size=8).collect()
    assert sorted((r.n_words, r.score is None) for r in got) == [(0, True), (0, True), (1, False), (2, False), (80_000, False)]
    none = lm_score.score(docs, labels.limit(0), size=8).where("n_words = 2").first()
    assert none.target_loss == pytest.approx(math.log(8), abs=1e-5)
    assert lm_score.score(docs.limit(0), labels, size=8).count() == 0


# 4: exact search

def nearest(vectors, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, x in vectors if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("block", [7, 8192])
def test_top_k_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(impact_index, "BLOCK", block)
    monkeypatch.setattr(impact_index, "FEW", 3)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]                       # ties
    rows += [(300, [0.0] * 6), (301, []), (302, [0.5]), (303, [1000.0] * 6)]  # zero, empty, short, large
    odd = [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (410, [float("inf")] * 6), (None, [0.1] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    got = defaultdict(list)
    scaled = df.select("vec_id", impact_index.scaled(F.col("embedding")).alias("embedding"), "score")
    for r in impact_index.top_k(scaled, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert dict(got) == nearest(ints, [x for x in ints if x[0] % 10 == 0], 5)
    assert impact_index.top_k(scaled.limit(0), F.lit(True)).count() == 0
    assert impact_index.top_k(scaled.where("vec_id = 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("block", [7, 8192])
def test_large_components_are_candidates_and_queries(spark, monkeypatch, block):
    monkeypatch.setattr(impact_index, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(4)]) for i in range(60)]
    rows += [(100 + 10 * n + i, [rng.choice((-1, 1)) * rng.random() * size for _ in range(4)])
             for n, size in enumerate((5000, 1e6, 1e12, 1e30, 3e38, 1e200)) for i in range(6)]
    rows += [(200, [5000.0]), (201, [1e30] * 5), (202, [-1e30] * 4), (203, [1e30] * 5)]   # short, long, opposite, tie
    df = spark.createDataFrame([*rows, (300, [float("inf")] * 4), (301, [1e9, None])], "vec_id long, embedding array<double>")
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    got = defaultdict(list)
    scaled = df.select("vec_id", impact_index.scaled(F.col("embedding")).alias("embedding"))
    for r in impact_index.top_k(scaled, F.col("vec_id") % 5 == 0, k=70).orderBy("query_id", "rank").collect():
        assert (r.score is None) != (r.wide_score is None)
        got[r.query_id].append((r.vec_id, int(r.wide_score) if r.score is None else r.score))
    assert dict(got) == nearest(ints, [x for x in ints if x[0] % 5 == 0], 70)
    longs = spark.createDataFrame([(1, [-2**63, 2**63 - 1]), (2, [2**63 - 1, 2**62 + 1]), (3, [1, 0])], "vec_id long, embedding array<long>")
    best = impact_index.top_k(longs, F.lit(True), k=1).orderBy("query_id").collect()
    assert [(r.query_id, r.vec_id, r.score, r.wide_score) for r in best] == [
        (1, 3, -2**63, None), (2, 3, 2**63 - 1, None), (3, 2, 2**63 - 1, None)]


# 5: decontamination

def test_leaks_with_substitutions_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(3000)]

    def pick(n):
        return [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(pick(rng.choice((8, 15, 30, 60))))) for i in range(40)] + [(900, "too short"), (901, None)]
    docs, leaked = [], set()
    for d in range(200):
        words = pick(rng.choice((3, 40, 300)))
        if d % 4 == 0:
            i, text = items[d % 40]
            leak = text.upper().split()
            for at in rng.sample(range(len(leak)), len(leak) // 15):
                leak[at] = "changed"
            cut = rng.randrange(len(words) + 1)
            words[cut:cut] = leak
            leaked.add((d, i))
        docs.append((d, " ,\n ".join(words), "", "", 0))
    docs += [(500, None, "", "", 0), (501, "", "", "", 0), (None, items[2][1], "", "", 0), (502, items[3][1], "", "", 0),
             (502, items[3][1], "", "", 0), (503, "the " * 50_000 + items[4][1], "", "", 0)]
    df = spark.createDataFrame(docs, DOCS).withColumn("row_key", F.lit(1)).withColumn("words", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()}
    assert got == leaked | {(None, 2), (502, 3), (503, 4)}
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {d for d, _ in leaked} - {None, 502, 503}
    assert decontaminate.overlaps(df, bench.limit(0)).count() == 0 == decontaminate.overlaps(df.limit(0), bench).count()


def test_every_accepted_pattern_is_found_at_both_parities(spark):
    docs, items, most = [], [], {}
    for size in range(8, 14):
        item = [f"w{size}x{i}" for i in range(size)]
        items.append((size, " ".join(item)))
        most[size] = math.ceil(0.75 * size)
        for gone in itertools.combinations(range(size), size - most[size]):
            copy = ["changed" if i in gone else w for i, w in enumerate(item)]
            docs += [(size * 10_000 + len(docs), " ".join(["before"] * offset + copy + ["after"] * 3), "", "", 0)
                     for offset in (4, 5)]
    docs = [(i, *d[1:], d[0] // 10_000) for i, d in enumerate(docs)]
    # every fourth word replaced in a long copy, at both parities
    long = [f"long{i}" for i in range(100)]
    items.append((100, " ".join(long)))
    periodic = " ".join("changed" if i % 4 == 1 else w for i, w in enumerate(long))
    docs += [(len(docs) + offset, "before " * offset + periodic, "", "", 0, 100) for offset in (4, 5)]
    df = spark.createDataFrame(docs, f"{DOCS}, size long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(df, bench).collect()}
    assert set(got) == {(d[0], d[-1]) for d in docs}
    assert all(got[d[0], d[-1]] == most.get(d[-1], 10) for d in docs)


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    both = []
    for most in (0, 1_000_000):
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", most)
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", most)
        both.append({tuple(r) for r in decontaminate.overlaps(documents(spark), bench).collect()})
    assert both[0] == both[1] and both[0]


# 6: sharding

def test_shards_are_even_and_gapless(spark):
    rows = {r.doc_id: r for r in QUERIES["op6_virtual_slots"](spark, MEDIUM).collect()}
    docs = documents(spark, MEDIUM).collect()
    assert len(rows) == len(docs)
    places, load = defaultdict(list), Counter()
    for d in docs:
        r, raw = rows[d.doc_id], (d.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        places[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert sorted(load) == list(range(16)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= 0.002 * sum(load.values()) / 16


def test_rebalancing_edits_the_map():
    rng = random.Random(4)
    size = [int(rng.paretovariate(1.3) * 100) for _ in range(512)]
    first = virtual_slots.first_map(size, 8)
    second = virtual_slots.rebalanced(size, first, 8, 0.01)

    def spread(m):
        load = [sum(s for s, h in zip(size, m) if h == k) for k in range(8)]
        return max(load) - min(load)
    assert spread(second) < spread(first)
    assert sum(a != b for a, b in zip(first, second)) < 200
    grown = virtual_slots.rebalanced(size, second, 9, 0.01)
    assert {s for s, h in enumerate(grown) if h == 8}
    assert set(virtual_slots.packed(size, 8)) == set(range(8))


def test_shard_edges(spark):
    docs = spark.createDataFrame([(1, None, "", "", 0), (1, None, "", "", 0), (None, "é", "", "", 0), (2, "", "", "", 0),
                                  (3, "x" * 300_000, "", "", 0)], DOCS).withColumn("slot", F.lit("clash"))
    records, slot_map = virtual_slots.shard(docs, shards=2)
    rows = records.collect()
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 3, 300_001]
    for shard in (0, 1):
        here = sorted(r.slot for r in rows if r.shard == shard)
        assert here == list(range(len(here)))
    assert slot_map.groupBy("version").count().count() == 2
    assert virtual_slots.shard(docs.limit(0))[0].count() == 0


# 7: personal data

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check_spans(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id])
        said = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == sha(",".join(said)), (texts[r.doc_id][:200], said, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert set(said) <= set(r.spans.split(","))


def test_base_spans_of_documents(spark):
    texts = {r.doc_id: r.text or "" for r in documents(spark, MEDIUM).collect()}
    rows = QUERIES["op7_weak_supervision"](spark, MEDIUM).collect()
    assert len(rows) == len(texts)
    check_spans(rows, texts)


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(9)
    alphabet = ["a", "Z", "0", "1", "4", "9", ".", "@", "-", "+", " ", "(", ")", "%", "_", "é", "\U0001F600", "\n", "255", "4111 1111 1111 1111", "@b.c"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "x@y.z@w.v", "+1", "+123", "+1 (234) 567-8901", "0001.002.3.4", "4111111111111111" * 3,
              "a" * 50_000, "1" * 50_000, "1." * 20_000, "a@" * 20_000, "+1 " * 20_000, "4111 1111 1111 1111 " * 800]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("clash"))
    check_spans(pii.digest(pii.find(df)).collect(), dict(enumerate(texts)))


def test_pii_edges(spark):
    df = spark.createDataFrame([(None, None, "", "", 0), (1, "", "", "", 0), (1, "mail a@b.com", "", "", 0), (1, "mail a@b.com", "", "", 0)], DOCS)
    assert sorted((r.n_email, r.spans) for r in pii.digest(pii.find(df)).collect()) == [
        (0, ""), (0, ""), (1, "email:5:12"), (1, "email:5:12")]
    assert pii.find(df.limit(0)).count() == 0


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.3
    good = [(0.9, 0.1), (0.8, 0.2), (0.7, 0.05), (0.85, 0.3), (0.6, 0.1)]
    votes = np.stack([np.where(truth, rng.random(len(truth)) < a, rng.random(len(truth)) < b) for a, b in good], 1).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    share, rel, post = pii.em(Counter(map(tuple, votes.tolist())))
    assert share == pytest.approx(0.3, abs=0.03)
    assert np.abs(np.array(rel) - good).max() < 0.05
    said = np.array([post[tuple(v)] > 0.5 for v in votes.tolist()])
    assert (said == truth).mean() > 0.9
    w = pii.fit_classifier([(5, v, n, post[v]) for v, n in Counter(map(tuple, votes.tolist())).items()])
    guess = np.array([sum(w[i] for i in pii._active(5, v)) > 0 for v in votes.tolist()])
    assert (guess == said).mean() > 0.97


# 8: toxicity

def test_held_out_toxic_documents(spark):
    """A few of the labels are noise; all documents with a telling word are found."""
    docs, labels = documents(spark, LARGE), spark.read.parquet(f"{LARGE}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    models = toxicity.train(docs, labels.where(~held))
    got = toxicity.score(docs, models).join(labels.where(held).withColumnRenamed("toxic", "truth"), "doc_id").collect()
    right = sum(r.toxic == r.truth for r in got)
    assert len(got) > 1000 and right / len(got) >= 0.98
    assert sum(r.truth and r.toxic for r in got) >= 0.9 * sum(r.truth for r in got)
    assert sum(r.toxic and not r.truth for r in got) <= 0.01 * len(got)
    assert set(toxicity.score(docs, models).columns) == {"doc_id", "p_low_quality", "p_toxic", "toxic"}


def test_chain_feeds_on_out_of_fold_predictions():
    rng = np.random.default_rng(1)
    rows = [toxicity.features(" ".join(rng.choice(["a", "b", "c", "bad"], 8))) for _ in range(400)]
    bad = int(toxicity.features("bad")[0])
    first = np.array([bad in r for r in rows], int)
    labels = np.column_stack((first, first))
    models = toxicity.fit_chain(rows, labels, np.arange(400) % toxicity.FOLDS)
    assert len(models[0][1]) == 1 and len(models[1][1]) == 2 and models[1][1][0] > 0
    assert models[0][0][bad] > 0


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "", "", 0), (None, "idiot", "", "", 0), (3, "x " * 60_000, "", "", 0), (3, "", "", "", 0)],
                                 DOCS).withColumn("toxic", F.lit("clash")).withColumn("id", F.lit(1))
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        models = toxicity.train(docs.drop("toxic", "id"), lab)
        assert toxicity.score(docs, models).count() == 4
    assert toxicity.score(docs.limit(0), models).count() == 0
    some = toxicity.training_rows(documents(spark), spark.read.parquet(f"{SMALL}/labels.parquet"), most=10)
    assert len(some[0]) <= 10


# 9: URL rules

def judged(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_page_verdicts(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    rows = QUERIES["op9_sorted_sweep"](spark, MEDIUM).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: judged(u, URL_RULES) for i, u in urls.items()}
    assert len(rows) == len(urls)


def test_page_verdicts_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{MEDIUM}/pages.parquet')")
    res = compare(QUERIES["op9_sorted_sweep"](spark, MEDIUM), con, ORACLE_SQL["op9_sorted_sweep"])
    assert res["match"], res


def test_nested_rules_and_odd_urls(spark):
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "ab.com", "a-b.com", "net", "com.net", "x", "a.com.", "a..com"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/pq", "/\U0010FFFF", "/é"]
    rules = [(rng.choice(("allow", "block")), h, p) for h in hosts[:9] for p in rng.sample(paths, 3)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = [f"http{rng.choice(('', 's'))}://{rng.choice(('', 'w.', 'WWW.'))}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(('', 'z', '/p', '?q=/p', '#/p'))}"
            for _ in range(400)] + [None, "", "no scheme", "://", "http://", "http://:80/", "a://b://c", "http://a.com" + "/p" * 20_000]
    urls += ["http://hot.a.com/p"] * 300
    rows = list(enumerate(urls)) + [(None, "http://a.com/p")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("at", F.lit(1)).withColumn("rule", F.lit(1))
    table = spark.createDataFrame(rules + [("block", None, "/"), ("block", "", "/")], "verdict string, host string, path string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df.repartition(5), table).collect())
    assert got == Counter((i, *judged(u, rules)) for i, u in rows)
    assert url_rules.judge(df.limit(0), table).count() == 0
    assert {r.verdict for r in url_rules.judge(df, table.limit(0)).collect()} == {"allow"}


# 10: mixing

def test_mix_meets_targets(spark):
    docs = documents(spark, MEDIUM).collect()
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    total = Counter()
    for d in docs:
        total[d.source] += size[d.doc_id]
    runs = [sorted(map(tuple, QUERIES["op10_budget_fit"](spark, MEDIUM).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == len(docs)
    rows = QUERIES["op10_budget_fit"](spark, MEDIUM).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == total[r.source]
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(total.values()))
    for s in total:
        assert abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * total[s]


def test_source_targets_share_the_excess():
    got = {s: t for s, _, t in mixture.source_targets([("b", 100), ("a", 10), (None, 100), ("c", 90)])}
    # budget 450; a (weight 5) is stopped at 20; 430 by 2, 1, 5: null (5) is stopped at 200; 230 by 2, 1
    assert got == pytest.approx({"a": 20, None: 200, "b": 230 * 2 / 3, "c": 230 / 3})
    assert mixture.source_targets([]) == []


@pytest.mark.parametrize("seed", range(30))
def test_chosen_lengths_fit_the_budget(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 6) for _ in range(6)}
    budget = rng.randint(0, 400)
    take = mixture.choose_lengths(counts, budget, reserve=10_000)   # all of it by knapsack
    best = max(s for s in {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))} if s <= budget)
    assert all(0 < k <= counts[n] for n, k in take.items())
    assert sum(n * k for n, k in take.items()) == best


def test_mix_edges(spark):
    rows = [(1, "a b", "", None, 0), (2, None, "", "s", 0), (3, " ", "", "s", 0), (None, "c d e", "", "s", 0), (5, "x " * 50_000, "", "n", 0)]
    rows += [(9, "same text here", "", "hot", 0)] * 40
    df = spark.createDataFrame(rows, DOCS).withColumn("mix_size", F.lit("clash"))
    got = mixture.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.mix_times <= 2 for r in got)
    assert all(r.mix_times == 0 for r in got if r.mix_size == 0)
    hot = [r for r in got if r.source == "hot"]
    assert sum(r.mix_size * r.mix_times for r in hot) == pytest.approx(hot[0].mix_target, abs=3)
    assert mixture.mixed_rows(df).columns == df.columns
    assert mixture.mix(df.limit(0)).count() == 0


def test_the_mixture_keeps_columns_named_like_its_helpers(spark):
    df = documents(spark).select("*", *(F.lit(k).alias(n) for k, n in enumerate(("extra", "whole", "cell_n", "more", "earlier", "n", "size"))))
    got = mixture.mix(df)
    assert sorted(got.columns) == sorted([*df.columns, "mix_size", "mix_source_size", "mix_target", "mix_times"])
    plain = {r.doc_id: r.mix_times for r in mixture.mix(documents(spark)).collect()}
    for r in got.collect():
        assert (r.extra, r.whole, r.cell_n, r.more, r.earlier, r.n, r["size"]) == (0, 1, 2, 3, 4, 5, 6)
        assert r.mix_times == plain[r.doc_id]
    assert mixture.mixed_rows(df).columns == df.columns


def test_short_items_and_scripts_without_spaces(spark):
    han = "這是一個完整的測試題目請不要把它放進訓練資料裡面啊"
    items = [(1, "seven words that stand here together now"), (2, han), (3, "One"), (4, "..."), (5, "two words"), (6, "ภาษาไทยไม่มีช่องว่างระหว่างคำเลยนะครับ")]
    texts = ["say: Seven words, that stand HERE together now!", "seven words that stand here together", "前面" + han + "後面", han[:12] + "x" + han[13:],
             han[:20], "just one here", "words two", "x two words", "two\nwords one", "ก่อน " + items[5][1], None, "", "..."]
    want = {(0, 1), (2, 2), (3, 2), (4, 2), (5, 3), (7, 5), (8, 5), (8, 3), (9, 6)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("__row", F.lit("mine"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.matched == r.window for r in found if r.item_id in (1, 3, 5))
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert {(r.doc_id, r["__row"]) for r in kept.collect()} == {(i, "mine") for i in range(len(texts)) if i not in {d for d, _ in want}}


def all_windows(docs, items):
    """(doc, item) of every pair of which some laid window agrees, by looking
    at all diagonals and windows."""
    word = re.compile(r"[^\W_]+")   # the given tables hold no other digits or letters

    def words(text):
        return word.findall((text or "").lower())

    out = set()
    laid = [(i, words(t)) for i, t in items]
    for d, text in docs:
        w = words(text)
        at = defaultdict(list)
        for p, x in enumerate(w):
            at[x].append(p)
        for i, item in laid:
            size = min(decontaminate.WINDOW, len(item))
            need = len(item) if len(item) < decontaminate.LEAST else math.ceil(decontaminate.AGREE * size)
            diagonals = Counter(p - q for q, x in enumerate(item) for p in at.get(x, ()))
            for diagonal, n in diagonals.items():
                if n >= need:
                    same = [0 <= diagonal + q < len(w) and w[diagonal + q] == x for q, x in enumerate(item)]
                    if any(sum(same[s:s + size]) >= need for s in range(len(item) - size + 1)):
                        out.add((d, i))
                        break
    return out


def test_overlaps_of_the_whole_tables_against_all_windows(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark, MEDIUM).collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_spaced_seeds"](spark, MEDIUM).collect()}
    want = all_windows(docs, bench)
    assert got == want and want


def test_the_map_outlives_a_run(spark, tmp_path):
    """More rows and one more shard: the stored map is edited, few slots move."""
    path, slots = str(tmp_path / "map"), 256
    docs = documents(spark, MEDIUM)

    def run(part, shards):
        records, table = virtual_slots.shard(part, shards, slots=slots, map_path=path, whole=True)
        return records.collect(), {(r.version, r.virtual_slot): r.shard for r in table.collect()}

    first, versions = run(docs.where("doc_id % 3 > 0"), 4)
    assert {v for v, _ in versions} == {1, 2}
    again, same = run(docs.where("doc_id % 3 > 0"), 4)
    assert same == versions and sorted(map(str, again)) == sorted(map(str, first))   # nothing to move, no new version
    more, grown = run(docs, 5)
    assert {v for v, _ in grown} == {1, 2, 3} and {k: v for k, v in grown.items() if k[0] < 3} == versions
    moved = [s for s in range(slots) if grown[3, s] != grown[2, s]]
    assert {grown[3, s] for s in moved} >= {4} and len(moved) < slots / 2
    load, places = Counter(), defaultdict(list)
    for r in more:
        assert (r.shard, r.map_version) == (grown[3, r.virtual_slot], 3)
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert sorted(load) == list(range(5)) and max(load.values()) < 1.2 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    stay = {r.doc_id: r.shard for r in first}
    kept = [r for r in more if r.doc_id in stay]
    assert sum(r.shard != stay[r.doc_id] for r in kept) < len(kept) / 2
    assert {(r.record.doc_id, r.record.text) for r in more} == {(r.doc_id, r.text) for r in docs.collect()}
    with pytest.raises(ValueError, match="knows 5 shards"):
        run(docs, 4)
    with pytest.raises(ValueError, match="not 99"):
        virtual_slots.shard(docs, 9, slots=99, map_path=path)


def test_one_text_of_each_training_document(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows, marks, folds = toxicity.training_rows(docs, labels)
    assert [r.tolist() for r in rows] == [toxicity.features("a").tolist(), []] and marks.tolist() == [[1, 1], [0, 0]]
    assert len(folds) == 2


@pytest.mark.parametrize("name", ["op1_schema_fingerprint", "op4_impact_ordered"])
def test_rows_equal_those_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{MEDIUM}/{t}.parquet')")
    res = compare(QUERIES[name](spark, MEDIUM), con, ORACLE_SQL[name])
    assert res["match"], res


def test_products_beyond_a_double_are_exact(spark):
    """floor(1024 * x) is taken exactly where 1024 * x is beyond a double."""
    rows = [(i, [((-1) ** i) * size, 0.5, -0.0007]) for i, size in enumerate((1.7e308, 1e306, 3e305, 4097.0, 4096.0, 1.0, 2.0 ** 53 + 2, 5e-324), 1)]
    odd = [(50, [float("inf"), 0.0, 0.0]), (51, [1.0, None, 0.0]), (52, None), (None, [1e306, 0.0, 0.0]), (53, [float("nan")])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("asks", F.lit(False))
    ints = [(i, [math.floor(1024 * x) if abs(x) < 2 ** 53 else int(x) * 1024 for x in v]) for i, v in rows]
    got = defaultdict(list)
    for r in impact_index.top_k(df, F.lit(True), k=9, scale=1024).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, int(r.wide_score) if r.score is None else r.score))
    assert dict(got) == nearest(ints, ints, 9)
