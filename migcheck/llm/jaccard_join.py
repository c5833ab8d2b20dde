"""Near-duplicate texts: a Jaccard self-join on word shingles with Bayesian candidate pruning.

1. Each text becomes its set of shingles of five words, as a 128-bit name of the set and a MinHash
   signature.  Texts with equal sets are one member from here on, with a number of copies.
2. Members that agree on a band of the signature share a bucket.  Buckets of one member are dropped,
   and of buckets with the same members one is kept.
3. Large buckets are cut into blocks, and the pairs of blocks (tiles) are worked on apart, so that no
   task holds a bucket and no row stands for a pair.  In a tile the MinHash values are compared a few
   at a time; a pair is dropped once the posterior probability that its similarity reaches the
   threshold falls below the tolerance.  Each tile hands on a spanning forest of the pairs left.
4. The components of those forests hold every pair that may be similar.  They are cut into tiles of
   a bounded number of shingles; there the pairs are pruned in the same way, and those left are verified exactly.
   Each tile gives, for each member, the number of its links and a spanning forest of the links.
5. The components of the links are the classes, named by their smallest document id.

With bands of four values a pair at the threshold of 0.8 is missed by all of 24 bands with a
probability of 3e-6, a more similar one less often; the tolerance adds 1e-6.

Defined cases: words are runs of ASCII letters (folded) and digits and of all characters beyond
ASCII; a text of fewer than five words is one shingle, a very long one is a block of its own; a null
text or one without words has no shingles, no links and a class of its own; repeated rows are copies
of each other; equal ids are ordered by a hash of their texts; an empty table gives an empty result;
further columns, whatever their names, are ignored (kept by :func:`keep_one`).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migcheck.llm.shared import keyed, materialise, same_row, sliced, small, with_key, without

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SHINGLE = 5
BAND = 4
HASHES = 96
#: MinHash values compared between two looks at the posterior.
STEP = 16

#: Most members of a block, and most shingles of one (a single longer text is a block of its own).
BLOCK_MEMBERS = 128
BLOCK_SHINGLES = 400_000

WORDS_KEPT = 150_000


def shingle_hashes(text: bytes | None, word_hashes: dict[bytes, int]) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text, sorted."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    get = word_hashes.get
    codes = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = word_hashes[w] = xxhash.xxh64_intdigest(w)
        codes[i] = h
    width = min(SHINGLE, len(codes))
    mixed = np.full(len(codes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        mixed = (mixed ^ codes[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def seeds(hashes: int) -> np.ndarray:
    return np.random.default_rng(96).integers(1, 2**32, hashes, dtype=np.uint32)


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """MinHash signatures of non-empty sets, one row each."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), hashes), dtype="<u4")
    for k, seed in enumerate(seeds(hashes)):
        x = (values ^ seed) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(13)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


SKETCH = "doc_id long, doc_key long, set_id binary, n_shingles int, signature binary"


def sketches(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """The set's name, its size and the signature of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hashes: dict[bytes, int] = {}

        def finished(rows: list[tuple]) -> pa.RecordBatch:
            some = [r[2] for r in rows if len(r[2])]
            signed = iter(signatures(some, hashes).view(f"V{4 * hashes}").ravel().tolist() if some else [])
            names = [hashlib.blake2b(r[2].tobytes(), digest_size=16).digest() if len(r[2]) else None for r in rows]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array([len(r[2]) for r in rows], pa.int32()),
                    pa.array([bytes(next(signed)) if len(r[2]) else None for r in rows], pa.binary()),
                ],
                names=["doc_id", "doc_key", "set_id", "n_shingles", "signature"],
            )

        for batch in sliced(batches):
            rows, size = [], 0
            for doc, key, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "doc_key", "text"))):
                if len(word_hashes) > WORDS_KEPT:
                    word_hashes.clear()
                rows.append((doc, key, shingle_hashes(text, word_hashes)))
                size += len(rows[-1][2])
                if size > 200_000:
                    yield finished(rows)
                    rows, size = [], 0
            if rows:
                yield finished(rows)

    return keyed(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, SKETCH)


@lru_cache
def least_matches(threshold: float, tolerance: float, hashes: int) -> tuple[int, ...]:
    """For 0, STEP, 2 * STEP, ... compared values the matches with which a pair stays.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1); the chance of a
    similarity of at least t is that of at most m hits in n + 1 draws that hit with probability t.
    """
    out = []
    for n in range(0, hashes + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def likely(signs: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which of the pairs (a, b) of rows of ``signs`` keep a posterior above the tolerance, looked at step by step."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int32)
    bounds = least_matches(threshold, tolerance, signs.shape[1])
    for k in range(signs.shape[1] // STEP):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (signs[a[alive], part] == signs[b[alive], part]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= bounds[k + 1]]
    return alive


def roots_of(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the smallest node of its component over the edges (a, b)."""
    root = np.arange(size)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def tile_pairs(tile: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a tile of rows (low, high, side, ...): inside a block, or across two."""
    if tile[0][0] == tile[0][1]:
        return np.triu_indices(len(tile), 1)
    side = np.array([r[2] for r in tile])
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(first, len(second)), np.tile(second, len(first))


def tiles(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """The rows of each tile; the first ``key`` columns name it, and rows arrive sorted by them."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if rows and row[:key] != rows[0][:key]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def block_of(member: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(member, F.lit(3)), F.col(blocks)).cast("int").alias("block")


def in_tiles(rows: DataFrame, key: str) -> DataFrame:
    """Deal ``rows`` (key, block, blocks, ...) to tiles (key, low, high, side, ...): each two blocks of a key meet in one."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.select(
        key,
        F.least("block", "other").cast("int").alias("low"),
        F.greatest("block", "other").cast("int").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
        *(c for c in rows.columns if c not in (key, "block", "blocks")),
    )
    return dealt.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high", "side")


def likely_edges(members: DataFrame, threshold: float, tolerance: float, hashes: int = HASHES) -> DataFrame:
    """(a, b): a spanning forest of the pairs of members that may be similar."""
    bands = [F.xxhash64(F.lit(k), F.substring("signature", 4 * k * BAND + 1, 4 * BAND)) for k in range(hashes // BAND)]
    banded = members.select("member", F.explode(F.array(*bands)).alias("bucket"))
    shared = (
        banded.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("member")).alias("whose"), F.bit_xor(F.xxhash64("member", F.lit(1))).alias("whose_too"))
        .where("n > 1")
        .groupBy("n", "whose", "whose_too")
        .agg(F.min("bucket").alias("bucket"))
    )
    shared = materialise(shared.select("bucket", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("blocks")), "buckets")
    dealt = materialise(banded.join(small(shared), "bucket"), "bucket-members").join(members.select("member", "signature"), "member")
    # a block travels as one row; it holds BLOCK_MEMBERS members on average, however large its bucket is
    held_together = F.collect_list(F.struct("member", "signature")).alias("rows")
    dealt = dealt.groupBy("bucket", "blocks", block_of("member", "blocks")).agg(held_together)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def forest() -> pa.RecordBatch:
            names = sorted({name for name, _ in held})
            number = {n: i for i, n in enumerate(names)}
            signs = np.frombuffer(b"".join(sign for _, sign in held), dtype="<u4").reshape(len(held), -1)
            x, y = np.concatenate(a), np.concatenate(b)
            left = likely(signs, x, y, threshold, tolerance)
            own = np.array([number[name] for name, _ in held])
            roots = roots_of(len(names), own[x[left]], own[y[left]])
            moved = np.flatnonzero(roots != np.arange(len(names)))
            return pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in moved], pa.binary()), pa.array([names[roots[i]] for i in moved], pa.binary())], names=["a", "b"]
            )

        pairs = 0
        for tile in tiles(batches, 3):
            rows = [(low, high, side, r["member"], r["signature"]) for _, low, high, side, block in tile for r in block]
            x, y = tile_pairs(rows)
            a.append(x + len(held))
            b.append(y + len(held))
            held += [r[3:] for r in rows]
            pairs += len(x)
            if len(held) > 5_000 or pairs > 200_000:
                yield forest()
                held, a, b, pairs = [], [], [], 0
        if held:
            yield forest()

    return in_tiles(dealt, "bucket").mapInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(member, root): the smallest member of each component, by alternating large and small stars.

    Every node's neighbours are only ever reduced to their minimum.  The rounds grow with the
    logarithm of the number of members of a component.
    """

    def measured(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def least_of(both: DataFrame) -> DataFrame:
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        return materialise(least, f"{name}-least")

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.union(pairs.select("b", "a"))

    def small_star(pairs: DataFrame) -> DataFrame:
        both = both_ways(pairs).where(F.col("b") < F.col("a"))
        met = both.join(small(least_of(both)), "a")
        own = met.select("a", F.col("least").alias("b"))
        return own.union(met.where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()

    edges = materialise(edges, name)
    now = measured(edges)
    while True:
        before, both = now, both_ways(edges)
        least = least_of(both)
        met = both.join(small(least), "a").where(F.col("b") > F.col("a"))
        edges = materialise(small_star(materialise(met.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), name)), name)
        now = measured(edges)
        if now == before:
            # nothing changed: each node's least neighbour, or itself, is its root
            return least.select(F.col("a").alias("member"), F.col("least").alias("root"))


LINKED = "member binary, root binary, links long"


def verified(dealt: DataFrame, threshold: float, tolerance: float, hashes: int = HASHES) -> DataFrame:
    """For each tile and member the root of its exact links in the tile, and the copies it is linked to."""
    wanted = Fraction(threshold).limit_denominator(1_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hashes: dict[bytes, int] = {}
        out: list[tuple] = []
        for tile in tiles(batches, 3):
            if len(word_hashes) > WORDS_KEPT:
                word_hashes.clear()
            sets = [shingle_hashes(r[6], word_hashes) for r in tile]
            x, y = tile_pairs([r[1:] for r in tile])
            left = likely(signatures(sets, hashes), x, y, threshold, tolerance)
            x, y = x[left], y[left]
            linked = exact(sets, x, y, wanted)
            x, y = x[linked], y[linked]
            roots = roots_of(len(tile), x, y)
            copies = np.array([r[5] for r in tile], dtype=np.int64)
            links = np.zeros(len(tile), dtype=np.int64)
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            out += [(r[4], tile[roots[i]][4], int(links[i])) for i, r in enumerate(tile)]
            if len(out) > 5_000:
                yield linked_batch(out)
                out = []
        if out:
            yield linked_batch(out)

    return dealt.mapInArrow(run, LINKED)


def linked_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["member", "root", "links"])


def exact(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, wanted: Fraction) -> np.ndarray:
    """Which of the pairs have a Jaccard similarity of at least ``wanted``."""
    if not len(x):
        return np.zeros(0, dtype=bool)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    numbered = [flat[e - n : e] for e, n in zip(ends, sizes)]
    mark = np.zeros(int(flat.max()) + 1, dtype=np.int64)
    shared = np.empty(len(x), dtype=np.int64)
    order = np.argsort(x, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(x[order])) + 1):
        mark[numbered[x[own[0]]]] = 1
        # a part of the partners at a time: memory stays bounded by the shingles of a block
        for k in range(0, len(own), 64):
            partners = y[own[k : k + 64]]
            met = mark[np.concatenate([numbered[p] for p in partners])]
            shared[own[k : k + 64]] = np.add.reduceat(met, np.cumsum([0, *sizes[partners[:-1]]]))
        mark[numbered[x[own[0]]]] = 0
    return shared * wanted.denominator >= wanted.numerator * (sizes[x] + sizes[y] - shared)


def join(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, doc_key, n_shingles, class_id, class_key and n_links of every row.

    ``class_id`` and ``class_key`` are those of the smallest row of the class; ``n_links`` counts the
    other documents, copies included, whose similarity reaches the threshold.
    """
    drawn = materialise(sketches(docs), "sketches")
    some = drawn.where("n_shingles > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_key", "n_shingles", "signature")
    members = (
        some.groupBy("set_id")
        .agg(F.count("*").alias("copies"), F.min(rank).alias("one"))
        .select(F.col("set_id").alias("member"), "copies", "one.doc_id", "one.doc_key", "one.n_shingles", "one.signature")
    )
    members = materialise(members, "members")
    parts = components(likely_edges(members, threshold, tolerance), "likely").select("member", F.col("root").alias("part"))
    grouped = materialise(parts.join(members.drop("signature"), "member"), "grouped")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    sizes = small(materialise(grouped.groupBy("part").agg(blocks.cast("int").alias("blocks")), "part-sizes"))
    wanted = grouped.join(sizes, "part").select("part", "blocks", "member", "copies", "doc_id", "doc_key")
    wanted = small(materialise(wanted, "wanted"))
    texts = keyed(docs)
    found = (
        texts.join(wanted, same_row(texts, wanted))
        .select("part", "blocks", "member", "copies", texts["text"].cast("binary").alias("text"))
        .dropDuplicates(["member"])  # rows that repeat both id and text
        .withColumn("block", block_of("member", "blocks"))
    )
    links = materialise(verified(in_tiles(found, "part"), threshold, tolerance), "links")
    edges = links.where("member != root").select(F.col("member").alias("a"), F.col("root").alias("b")).distinct()
    rooted = components(edges, "classes")
    counted = links.groupBy("member").agg(F.sum("links").alias("links"))
    # only members that met another one need a look at their class
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_key").alias("own")
    met = materialise(grouped.select("member", own).join(counted, "member").join(rooted, "member", "left"), "met")
    least = materialise(met.where("root IS NOT NULL").groupBy("root").agg(F.min("own").alias("least")), "class-rows")
    met = met.join(small(least), "root", "left").select("member", "least", "links")
    named = members.join(met, "member", "left").select(
        F.col("member").alias("set_id"),
        F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.when(F.col("least").isNull(), F.col("doc_key")).otherwise(F.col("least.doc_key")).alias("class_key"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    named = materialise(named, "named")
    columns = ["doc_id", "doc_key", "n_shingles", "class_id", "class_key", "n_links"]
    alone = drawn.where("n_shingles = 0").withColumns(
        {"class_id": F.col("doc_id"), "class_key": F.col("doc_key"), "n_links": F.lit(0).cast("long")}
    )
    return some.drop("signature").join(named, "set_id").select(columns).union(alone.select(columns))


def keep_one(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id (of repeated rows any); all columns are kept."""
    classes = materialise(join(docs, threshold, tolerance), "near-classes")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("doc_key") == F.col("class_key"))
    left = without(docs, classes.where(~stays))
    again = classes.where(stays & (F.col("n_shingles") > 0)).groupBy("doc_id", "doc_key").agg(F.count("*").alias("rows"))
    again = materialise(again.where("rows > 1").select(F.col("doc_id").alias("again_id"), F.col("doc_key").alias("again_key")), "again")
    if not again.limit(1).count():
        return left
    again = small(again)
    rows = with_key(left)
    same = (F.col("doc_key") == F.col("again_key")) & F.col("doc_id").eqNullSafe(F.col("again_id"))
    once = rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "doc_key"])
    return rows.join(again, same, "left_anti").union(once).select("row.*")
