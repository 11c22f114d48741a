"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles.  A parity sketch of
``p`` words XORs the 64-bit hash of each shingle into one word, chosen by the
hash: two sketches differ in at most as many words as the sets differ in
elements, so their Hamming distance (in words) never exceeds the symmetric
difference.  Sets of sizes ``a`` and ``b`` with Jaccard similarity of at least
3/4 differ in at most ``(a + b) / 7`` elements, hence agree in at least
``p - (a + b) // 7`` words; of any order of the words, the first
``(a + b) // 7 + 1`` of both documents share one (pigeonhole).

1. ``fingerprints``: one pass over the texts gives size, digest, a bit sketch
   (one bit toggled by each shingle) and the posted words of the size bands
   ``[2^k, 2^(k+1))``.  A pair is met in the band of its smaller document, so a
   document posts to its own band and, if a partner can be there, the next
   lower one.  Words made of more shingles are posted first, since they are
   rarer.
2. Documents that share a posted word form a group.  First each member is
   checked against one compatible member (a star, linear in the group).
3. After the links found are joined to components, groups that still span
   several components are compared member against member, in blocks, on their
   bit sketches (Hamming distance against the allowed difference).  First only
   about as many pairs as there are components leave the task (each with the
   one that is near to most); when their links are joined, all pairs that are
   near by sketch and still in different components; a group leaves out those
   that a smaller open group, which it knows of, has met before.
4. Pairs that pass are verified on their whole texts.

Links are never dropped: 2 and 3 together look at every pair that shares a
posted word and isn't in one component already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysight.llm.common import drop_stored, stored
from quaysight.llm.components import connected_components

SHINGLE = 5
# Similarity 3/4: 100 * intersection >= 75 * union.
NUM, DEN = 3, 4
# Members of a group that one task compares with one another.
BLOCK = 2048
# Smallest open groups that a member names, so that a pair met in one of them
# isn't made again elsewhere; a pair that shares others is made once in each.
NAMED = 16
# Digests of texts that a task remembers, to post copies once, and hashes of
# words that a worker remembers.
REMEMBERED = 1 << 18
# Members of a block pair whose pairs are compared at once, and bytes of their
# sketches that are laid against one another at a time.
AT_ONCE = 256
SKETCH_BYTES = 1 << 22

_FINGERPRINTS = "doc_id long, digest binary, n long, sketch binary, keys array<long>"


class _WordHashes(dict):
    """Words -> their 64-bit hashes; a worker remembers the last ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hash_of = _WordHashes().__getitem__


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text."""
    return shingles_of(words_of(text))


def shingles_of(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i]
    return np.unique(_mixed(out))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def most_difference(a, b):
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def parts_of(band: int) -> int:
    """Words of the parity sketch of a band: more than the largest difference
    met there, so that words with several shingles fill the posted ones."""
    a = (2 << band) - 1
    most = most_difference(a, a * DEN // NUM)
    return most + 1 + most // 20 + 4


def posted_words(hashes: np.ndarray) -> np.ndarray:
    """The words a document posts, each with its band, place and value mixed
    into one 64-bit key."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    own = n.bit_length() - 1
    wanted = [(own, most_difference(n, n * DEN // NUM) + 1)]
    if -(-n * NUM // DEN) < 1 << own:
        wanted.append((own - 1, most_difference(n, (1 << own) - 1) + 1))
    out = []
    for band, posts in wanted:
        p = parts_of(band)
        # sorted hashes: their words come in order
        word = ((hashes >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(word, prepend=np.uint64(p)))
        count = np.zeros(p, np.uint64)
        value = np.zeros(p, np.uint64)
        at = word[starts].astype(np.int64)
        value[at] = np.bitwise_xor.reduceat(hashes, starts)
        count[at] = np.diff(starts, append=n).astype(np.uint64)
        tag = (np.arange(p, dtype=np.uint64) << np.uint64(8)) + np.uint64(band + 1)
        key = _mixed(_mixed(tag) ^ value ^ (count * np.uint64(0xD6E8FEB86659FD93)))
        out.append(key[np.lexsort((key, -np.minimum(count, 3).astype(np.int64)))[:posts]])
    return np.concatenate(out)


def bit_sketch(hashes: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each of 4 * 2^band bits."""
    bits = max(64, 4 << (max(1, len(hashes)).bit_length() - 1))
    on = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(on.astype(np.uint8)).tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch brought down to ``size`` bytes: halves XORed together."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()),
                        ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])
    seen: dict[bytes, int] = {}
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            digest = hashlib.md5(b" ".join(words), usedforsecurity=False).digest() if words else None
            if digest in seen:
                rows.append((doc, digest, seen[digest], None, None))
                continue
            h = shingles_of(words)
            if digest is not None and doc is not None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[digest] = len(h)
            rows.append((doc, digest, len(h), bit_sketch(h), posted_words(h).view(np.int64)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, digest, bit sketch and posted words of every document.  A copy of
    a text that its task has met already posts nothing; its digest links it."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _fingerprint_batches, _FINGERPRINTS)


def _group_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, n, doc_id) -> those of keys with several documents,
    each with a member of compatible size to be checked against.  The key is
    kept (else 0) for groups of three or more, which may need more checks."""
    held = np.empty((0, 3), np.int64)
    star: tuple | None = None   # key, rep, rep's size of a group that goes on

    def groups(rows: np.ndarray, star: tuple | None) -> tuple[np.ndarray | None, tuple | None]:
        key = rows[:, 0]
        first = np.flatnonzero(np.diff(key, prepend=~key[0]))
        size = np.diff(first, append=len(key))
        at = np.repeat(first, size)
        rep, rep_n = rows[at, 1], rows[at, 2]
        keep, many = np.repeat(size > 1, size), np.repeat(size > 2, size)
        if star is not None and star[0] == key[0]:
            rep[:size[0]], rep_n[:size[0]] = star[1], star[2]
            keep[:size[0]] = many[:size[0]] = True
        # sizes rise within a group: members too large for its first go to later ones
        for i in np.flatnonzero(keep & (NUM * rows[:, 2] > DEN * rep_n)):
            j = i - 1
            if at[i] <= j and NUM * rows[i, 2] <= DEN * rep_n[j]:
                rep[i], rep_n[i] = rep[j], rep_n[j]
            else:
                rep[i], rep_n[i] = rows[i, 1], rows[i, 2]
        last = (key[-1], rep[-1], rep_n[-1])
        return (np.column_stack((np.where(many, key, 0), rows[:, 1:], rep))[keep] if keep.any() else None), last

    def batch_of(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(4)], names=["key", "doc_id", "n", "rep"])

    for batch in batches:
        rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        if not len(rows):
            continue
        rows = np.concatenate((held, rows)) if len(held) else rows
        # the last group may go on: its rows wait, unless it fills the batch
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if cut == 0:
            if len(rows) < 50_000:
                held = rows
                continue
            out, star = groups(rows, star)
            held = rows[:0]
        else:
            out, star = groups(rows[:cut], star)
            held = rows[cut:]
        if out is not None:
            yield batch_of(out)
    if len(held):
        out, star = groups(held, star)
        if out is not None:
            yield batch_of(out)


def shared_words(prints: DataFrame) -> DataFrame:
    """``(key, doc_id, n, rep)``: members of every group of documents that
    share a posted word; the key is 0 for groups of two."""
    posts = prints.where("doc_id IS NOT NULL").select(F.explode("keys").alias("key"), "doc_id", "n")
    return (posts.repartition("key").sortWithinPartitions("key", "n", "doc_id")
            .mapInArrow(_group_batches, "key long, doc_id long, n long, rep long"))


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        get = {name: batch.column(name).to_pylist() for name in ("n_a", "n_b", "sk_a", "sk_b")}
        for na, nb, sa, sb in zip(get["n_a"], get["n_b"], get["sk_a"], get["sk_b"], strict=True):
            x, y = np.frombuffer(sa, np.uint8), np.frombuffer(sb, np.uint8)
            size = min(len(x), len(y))
            far = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
            keep.append(far <= most_difference(na, nb) and NUM * max(na, nb) <= DEN * min(na, nb))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_by_sketch(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Of distinct ``pairs(a, b)`` of different texts, those whose bit
    sketches are no farther apart than linked sets can be."""
    side = prints.where("sketch IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest", "n", "sketch")
    a = side.toDF("a", "dg_a", "n_a", "sk_a")
    b = side.toDF("b", "dg_b", "n_b", "sk_b")
    return (pairs.join(a, "a").join(b, "b").where("dg_a <> dg_b").select("a", "b", "n_a", "n_b", "sk_a", "sk_b")
            .mapInArrow(_near_batches, "a long, b long"))


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for batch in batches:
        keep = []
        for ta, tb in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            if ta != last[0]:
                last = (ta, shingle_hashes(ta))
            x, y = last[1], shingle_hashes(tb)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and DEN * both >= NUM * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs whose whole texts have a Jaccard similarity of at least 3/4."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
            .select("a", "b", "text_a", "text_b").mapInArrow(_verify_batches, "a long, b long"))


def _crossing(doc, n, comp, block, sketches, before, lo: int, hi: int, spanning: bool) -> np.ndarray:
    """Pairs of one block pair, from different components, near by sketch;
    with ``spanning`` one nearest pair for two components, and of those only
    as many as there are components: each with the one that is near to most;
    else all pairs that have none of the keys ``before`` this one in common."""
    width = min(map(len, sketches))
    # a sketch has 64 bits or a multiple
    sketch = np.stack([folded(np.frombuffer(s, np.uint64), width // 8) for s in sketches])
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    found = [np.empty((0, 3), np.int64)]

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        may = (comp[j] != comp[i]) & (NUM * np.maximum(n[j], n[i]) <= DEN * np.minimum(n[j], n[i]))
        i, j = i[may], j[may]
        step = max(1, SKETCH_BYTES // width)
        for at in range(0, len(i), step):
            a, b = i[at:at + step], j[at:at + step]
            far = np.bitwise_count(sketch[b] ^ sketch[a]).sum(axis=1, dtype=np.int64)
            ok = far <= most_difference(n[b], n[a])
            found.append(np.column_stack((a[ok], b[ok], far[ok])))

    if len(doc) <= AT_ONCE:
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        compare(*((i[i < j], j[i < j]) if lo == hi else (i, j)))
    else:
        for i in left:
            j = right[right > i] if lo == hi else right
            compare(np.full(len(j), i), j)
    near = np.concatenate(found)
    if spanning and len(near) > 1:
        _, of = np.unique(comp, return_inverse=True)
        ends = np.sort(of[near[:, :2]], axis=1)
        order = np.lexsort((near[:, 2], ends[:, 1], ends[:, 0]))
        first = order[np.append(True, (np.diff(ends[order], axis=0) != 0).any(axis=1))]
        pair_of = {tuple(e): k for e, k in zip(ends[first].tolist(), first.tolist(), strict=True)}
        stars = np.sort(_hub_stars(ends[first], len(doc)), axis=1).tolist()
        near = near[[pair_of[tuple(e)] for e in stars]]
    if not spanning:
        earlier = {i: set(before[i]) for i in np.unique(near[:, 0]).tolist()}
        near = near[[earlier[i].isdisjoint(before[j]) for i, j in near[:, :2].tolist()]]
    return np.sort(np.column_stack((doc[near[:, 0]], doc[near[:, 1]])), axis=1)


def _hub_stars(near: np.ndarray, size: int) -> np.ndarray:
    """Of a graph's edges a part that reaches every node once, hubs first."""
    ends = np.concatenate((near, near[:, ::-1]))
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    degree = np.bincount(ends[:, 0], minlength=size)
    first = np.concatenate(([0], np.cumsum(degree)))
    reached = np.zeros(size, bool)
    stars = []
    for hub in np.argsort(-degree, kind="stable")[:np.count_nonzero(degree)]:
        new = ends[first[hub]:first[hub + 1], 1]
        new = new[~reached[new]]
        if len(new):
            reached[new] = reached[hub] = True
            stars.append(np.column_stack((np.full(len(new), hub), new)))
    return np.concatenate(stars)


def _crossing_batches(batches: Iterator[pa.RecordBatch], spanning: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, lo, hi): each run is one block pair."""
    names = ("key", "lo", "hi", "block", "doc_id", "n", "comp")

    made = np.empty((0, 2), np.int64)   # distinct pairs of this task

    def add(table: pa.Table, starts: np.ndarray) -> None:
        nonlocal made
        col = {c: table.column(c).to_numpy() for c in names}
        sketch = table.column("sketch").to_pylist()
        before = table.column("before")
        found = [made]
        for x, y in zip(starts[:-1], starts[1:], strict=True):
            found.append(_crossing(*(col[c][x:y] for c in ("doc_id", "n", "comp", "block")), sketch[x:y],
                                   before.slice(x, y - x).to_numpy(), col["lo"][x], col["hi"][x], spanning))
        made = np.unique(np.concatenate(found), axis=0)

    def flush() -> pa.RecordBatch:
        nonlocal made
        out, made = made, made[:0]
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    def starts_of(table: pa.Table) -> np.ndarray:
        run = np.column_stack([table.column(c).to_numpy() for c in names[:3]])
        return np.concatenate(([0], 1 + np.flatnonzero((run[1:] != run[:-1]).any(axis=1)), [len(run)]))

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table.num_rows:
            starts = starts_of(table)
            held = table.slice(starts[-2])   # may go on in the next batch
            add(table, starts[:-1])
            if len(made) > 200_000:
                yield flush()
    if held is not None:
        add(held, np.array([0, held.num_rows]))
    yield flush()


def crossing_pairs(groups: DataFrame, comps: DataFrame, prints: DataFrame, spanning: bool) -> DataFrame:
    """Distinct pairs that share a posted word, lie in different components
    and are near by sketch; compared in blocks of at most about BLOCK members,
    so that a very large group spreads over many tasks.  Groups of two (key 0)
    have no pair that the star left out.

    A document's open groups are brought together with its sketch, one row a
    document, and dealt out again; unless ``spanning``, each carries the
    NAMED smallest keys of the document's smaller open groups.  A pair with
    such a key in common is made there: this saves copies of pairs, never a
    pair."""
    members = groups.where("key <> 0").select("key", "doc_id", "n").join(
        comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "key", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp"))
    spread = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("g"))
    open_keys = spread.where("lo <> hi").select("key", F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks"))
    by_doc = members.join(open_keys, "key").groupBy("doc_id", "n", "comp").agg(
        F.sort_array(F.collect_set(F.struct("key", "blocks"))).alias("open"))
    sketches = prints.where("sketch IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n", "sketch")
    members = (by_doc.join(sketches, ["doc_id", "n"])
               .select("doc_id", "n", "comp", "sketch", "open", F.posexplode("open").alias("at", "own"))
               .select("doc_id", "n", "comp", "sketch", "own.key", "own.blocks",
                       F.slice("open.key", 1, F.lit(0) if spanning else F.least("at", F.lit(NAMED))).alias("before")))
    members = (members.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")))
    return (members.select("key", "lo", "hi", "block", "doc_id", "n", "comp", "sketch", "before")
            .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(lambda batches: _crossing_batches(batches, spanning), "a long, b long")
            .where("a <> b").distinct())


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Null or blank texts have no shingles and no links (also not with one
    another).  Rows without an id get their size and a null component; rows
    that repeat an id are one node, linked if any of their texts is.  An empty
    table gives no rows; other columns are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = stored(shared_words(prints), "groups")
    posted, prints = prints, stored(prints.drop("keys"), "sizes")
    drop_stored(posted)
    copies = prints.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    firsts = copies.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copy_links = stored(copies.join(firsts, "digest").where("doc_id <> first")
                        .select(F.col("doc_id").alias("a"), F.col("first").alias("b")), "copies")
    star = stored(groups.where("doc_id <> rep").select(F.least("rep", "doc_id").alias("a"),
                                                      F.greatest("rep", "doc_id").alias("b")).distinct(), "star")
    links = stored(verified(near_by_sketch(star, prints), docs, id_col, text_col), "links")
    comps = connected_components(copy_links.union(links))
    tried = star
    for spanning in (True, False):
        pairs = stored(crossing_pairs(groups, comps, prints, spanning).join(tried, ["a", "b"], "left_anti"), "crossing")
        more = stored(verified(pairs, docs, id_col, text_col), "links")
        tried = tried.union(pairs)
        if not more.isEmpty():
            comps = connected_components(comps.toDF("a", "b").union(more))
    drop_stored(groups)
    return prints.select("doc_id", F.col("n").alias("n_shingles")).join(
        comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
