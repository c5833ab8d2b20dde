"""Phrases that stand together more often than their parts let expect, mined from position bitmaps.

A shard is a run of documents of one language and task.  For each of its words it holds a compressed bitmap of the
positions where the word stands: the numbers of the 64-position blocks that are not empty, and their bits
(sets of few positions are plain lists, as in other compressed bitmaps).  A phrase's bitmap (of the
positions of its last word) is shifted by one position, cleared where a piece begins, and ANDed with the
bitmap of a word that may follow; the bits left over are the longer phrase's occurrences in the shard.
Phrases are extended depth-first and their popcounts summed over all shards.

A phrase can be frequent only if its words, pairs and triples of words are.  Three passes over the texts
find those and prune the search, which is the fourth.  What is frequent reaches the shards as a bit table
of a fixed size, indexed by hashes: it lets every frequent run through and some others, whose counts are
then found too small, so results never depend on its size.

Defined cases: a null text has no words, a null language is ``und``; a document's id plays no part, so
repeated rows count each; texts of any length are read whole; ties are broken as stated by
:func:`rank`; an empty table gives no phrases; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from migcheck.llm.shared import materialise, sliced

#: Bytes as they are compared: A-Z in lower case, tabs as blanks, piece ends as line ends.
WRITTEN = bytes(
    ord("\n") if c in b".,;:!?\x0a\x0b\x0c\x0d" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)

#: Bytes of text that a task cuts into shards (one a language), more or less; they end with the document that reaches it.
SHARD_BYTES = 16 << 20

#: Up to so many positions are held as a list.
FEW = 64

#: The bit tables have 2 ** FILTER_BITS bits (16 MB), whatever the size of the corpus.
FILTER_BITS = 27

LONGEST = 4
SPREAD, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ONE, LAST = np.uint64(1), np.uint64(63)

Bitmap = tuple[np.ndarray, np.ndarray]  # numbers of the non-empty blocks, rising; their bits


def bitmap(positions: np.ndarray) -> Bitmap:
    """The compressed bitmap of rising positions."""
    block, bit = positions >> 6, ONE << (positions & 63).astype(np.uint64)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    return block[first], np.bitwise_or.reduceat(bit, first) if len(first) else bit


def following(bits: Bitmap, marks: np.ndarray) -> Bitmap:
    """Every position moved on by one, over the ends of blocks, where the dense ``marks`` allow the new one."""
    block, word = bits
    over = block[(word >> LAST) != 0] + 1
    over = over[(marks[over] & ONE) != 0]
    word = (word << ONE) & marks[block]
    some = np.flatnonzero(word)
    block, word = block[some], word[some]
    if len(over):
        block, word = np.concatenate([block, over]), np.concatenate([word, np.ones(len(over), np.uint64)])
        order = np.argsort(block, kind="stable")
        block, word = block[order], word[order]
        first = np.flatnonzero(np.diff(block, prepend=-1))
        block, word = block[first], np.bitwise_or.reduceat(word, first)
    return block, word


def both(left: Bitmap, right: Bitmap) -> Bitmap:
    """Positions set in both; the shorter one is looked up in the longer."""
    if len(left[0]) > len(right[0]):
        left, right = right, left
    if not len(left[0]):
        return left
    at = np.minimum(np.searchsorted(right[0], left[0]), len(right[0]) - 1)
    word = np.where(right[0][at] == left[0], left[1] & right[1][at], np.uint64(0))
    some = np.flatnonzero(word)
    return left[0][some], word[some]


def n_set(bits: Bitmap) -> int:
    return int(np.bitwise_count(bits[1]).sum())


def positions(bits: Bitmap) -> np.ndarray:
    """The set positions, rising."""
    flat = np.unpackbits(bits[1].astype("<u8").view(np.uint8), bitorder="little")
    at = np.flatnonzero(flat)
    return (bits[0][at >> 6] << 6) + (at & 63)


def dense(marks: np.ndarray) -> np.ndarray:
    """Marks of all positions as blocks of bits, with an empty block behind them."""
    padded = np.zeros((len(marks) // 64 + 2) * 64, dtype=bool)
    padded[: len(marks)] = marks
    return np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)


class Shard:
    """The words of a run of documents of one language by position: numbers into ``names``."""

    def __init__(self, lang: str, texts: list[bytes]):
        found = pc.split_pattern(pa.array(texts, pa.binary()), pattern=b" ").flatten().dictionary_encode()
        self.lang, self.names = lang, found.dictionary.to_pylist()
        self.crc = np.array([zlib.crc32(word, zlib.crc32(lang.encode() + b"\0")) for word in self.names], dtype=np.int64)
        numbers = found.indices.to_numpy()
        end, nothing = (pc.index(found.dictionary, pa.scalar(x, pa.binary())).as_py() for x in (b"\n", b""))
        is_word = (numbers != end) & (numbers != nothing)
        self.words = numbers[is_word]
        self.goes_on = np.diff(np.cumsum(numbers == end)[is_word], prepend=-1) == 0  # the word before stands in the same piece

    def occurrences(self, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The words that ``wanted`` marks, with their rising positions."""
        at = np.flatnonzero(wanted[self.words])
        at = at[np.argsort(self.words[at], kind="stable")]
        first = np.flatnonzero(np.diff(self.words[at], prepend=-1))
        return zip(self.words[at[first]].tolist(), np.split(at, first[1:]))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """The texts of ``batches`` (lang, text) as shards."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in sliced(batches):
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            if text.is_valid:
                written = text.as_buffer().to_pybytes().translate(WRITTEN)
                held.setdefault(lang, []).append(written.replace(b"\n", b" \n ") + b" \n")
                size += len(written)
                if size >= SHARD_BYTES:
                    yield from (Shard(*item) for item in held.items())
                    held, size = {}, 0
    yield from (Shard(*item) for item in held.items())


def index_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The place of 64-bit keys in a bit table."""
    return ((keys.astype(np.uint64) * SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def bit_table(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A table of 2 ** ``bits`` bits in which those of the long column ``key`` are set; at most that many bits reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, word = bitmap(np.unique(index_of(batch["key"].to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(word.view(np.int64))], names=["block", "word"])

    found = keys.select("key").mapInArrow(run, "block long, word long").groupBy("block").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[found["block"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return out


def is_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = index_of(keys, len(table).bit_length() - 1 + 6)
    return (table[at >> 6] >> (at & 63).astype(np.uint64) & ONE).astype(bool)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))


COUNTS = "lang string, phrase binary, n long"


def count_rows(lang: str, phrases: Sequence[bytes | None], counts: Sequence[int]) -> Iterator[pa.RecordBatch]:
    columns = [pa.array([lang]).take(pa.array(np.zeros(len(phrases), np.int32))), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())]
    yield from pa.table(columns, names=["lang", "phrase", "n"]).to_batches(max_chunksize=20_000)


def summed(counts: DataFrame) -> DataFrame:
    """Popcounts of all shards together."""
    return counts.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (a word; null: all words), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            n = np.bincount(shard.words, minlength=len(shard.names)).tolist()
            found = [(word, count) for word, count in zip(shard.names, n) if count]
            if found:
                yield from count_rows(shard.lang, *zip((None, len(shard.words)), *found))

    return summed(texts_of(docs).mapInArrow(run, COUNTS))


def run_keys(shard: Shard, at: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` words that ends at one of the positions ``at``."""
    key = np.zeros(len(at), dtype=np.uint64)
    for back in range(size - 1, -1, -1):
        key = key * STEP + shard.crc[shard.words[at - back]].astype(np.uint64)
    return key.view(np.int64)


def ends(shard: Shard, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Marks of the positions where runs of 2, 3, ... words end whose shorter runs are all in ``tables`` (of words, pairs, ...)."""
    wanted = is_in(tables[0], shard.crc)[shard.words]
    marks = shard.goes_on & wanted
    marks[1:] &= wanted[:-1]
    out = [marks]
    for size, table in enumerate(tables[1:], 2):
        at = np.flatnonzero(marks)
        marks[at] = is_in(table, run_keys(shard, at, size))
        longer = marks.copy()
        longer[1:] &= marks[:-1]
        longer[:1] = False
        marks = longer
        out.append(marks)
    return out


def frequent_runs(docs: DataFrame, tables: list[np.ndarray], least: int) -> DataFrame:
    """key: the runs of one word more than ``tables`` has levels that stand at least ``least`` times.

    This only prunes the search: all runs of a shard are counted at once from its positions.
    """
    held = docs.sparkSession.sparkContext.broadcast(tables)
    size = len(tables) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            keys, n = np.unique(run_keys(shard, np.flatnonzero(ends(shard, held.value)[-1]), size), return_counts=True)
            yield from pa.table([pa.array(keys), pa.array(n.astype(np.int32))], names=["key", "n"]).to_batches(max_chunksize=50_000)

    found = texts_of(docs).mapInArrow(run, "key long, n int")
    return found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def phrases_of(shard: Shard, tables: list[np.ndarray], longest: int) -> Iterator[tuple[bytes, int]]:
    """(phrase, popcount) of the phrases of 2 to ``longest`` words whose runs of 1, 2 and 3 words are all in ``tables``."""
    second, third, _ = ends(shard, tables)
    at = np.flatnonzero(second)
    wanted = np.zeros(len(shard.names), dtype=bool)
    wanted[shard.words[at]] = wanted[shard.words[at - 1]] = True
    # what may follow a phrase of one word, and of more: a word that ends a frequent pair, and triple
    marks, is_next = (dense(second), dense(third)), (second.tobytes() + b"\0", third.tobytes() + b"\0")
    names, number = shard.names, memoryview(np.ascontiguousarray(shard.words))
    maps: dict[int, Bitmap] = {}

    def extend(bits: Bitmap, phrase: bytes, size: int) -> Iterator[tuple[bytes, int]]:
        follow = following(bits, marks[size > 1])
        behind = positions(follow)
        if len(behind) <= FEW:
            yield from grouped(behind.tolist(), phrase, size)
            return
        order = np.argsort(shard.words[behind], kind="stable")
        behind = behind[order]
        first = np.flatnonzero(np.diff(shard.words[behind], prepend=-1))
        for word, n, run in zip(shard.words[behind[first]].tolist(), np.diff(first, append=len(behind)).tolist(), np.split(behind, first[1:])):
            longer = phrase + b" " + names[word]
            if n > FEW and size + 1 < longest:
                child = both(follow, maps[word])
                yield longer, n_set(child)
                yield from extend(child, longer, size + 1)
            else:  # the words' bitmaps do not overlap, so the AND with each of them leaves its own run of positions
                yield longer, n
                if size + 1 < longest:
                    yield from extend_few(run.tolist(), longer, size + 1)

    def extend_few(at: list[int], phrase: bytes, size: int) -> Iterator[tuple[bytes, int]]:
        may = is_next[size > 1]
        return grouped([p + 1 for p in at if may[p + 1]], phrase, size)

    def grouped(behind: list[int], phrase: bytes, size: int) -> Iterator[tuple[bytes, int]]:
        runs: dict[int, list[int]] = {}
        for p in behind:
            runs.setdefault(number[p], []).append(p)
        for word, run in runs.items():
            longer = phrase + b" " + names[word]
            yield longer, len(run)
            if size + 1 < longest:
                yield from extend_few(run, longer, size + 1)

    few = []
    for word, run in shard.occurrences(wanted):
        if len(run) > FEW:
            maps[word] = bitmap(run)
        else:
            few.append((word, run))
    for word, bits in maps.items():
        yield from extend(bits, names[word], 1)
    for word, run in few:
        yield from extend_few(run.tolist(), names[word], 1)


def phrase_counts(docs: DataFrame, tables: list[np.ndarray], longest: int = LONGEST) -> DataFrame:
    """lang, phrase, n of the phrases of 2 to ``longest`` words whose runs of 1, 2 and 3 words are all in ``tables``."""
    held = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            found = phrases_of(shard, held.value, longest)
            while part := list(islice(found, 20_000)):
                yield from count_rows(shard.lang, *zip(*part))

    return summed(texts_of(docs).mapInArrow(run, COUNTS))


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the phrases of ``counts`` (lang, phrase, n: words and phrases) that have a cut.

    The lowest-scoring cut counts, of equal ones the first.  Every part of a frequent phrase is as frequent, so
    ``counts`` must hold all parts.
    """
    phrases = counts.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", joined("words", F.lit(1), F.col("k"))).withColumn("rest", joined("words", F.col("k") + 1, F.size("words")))
    for part, name in (("first", "l"), ("rest", "r")):
        known = counts.select(F.col("lang").alias("lang_"), F.col("phrase").alias("part_"), F.col("n").alias(name))
        cuts = cuts.join(known, (F.col("lang") == F.col("lang_")) & (F.col(part) == F.col("part_"))).drop("lang_", "part_")
    cuts = cuts.withColumn("score", F.expr("CAST(2000000 AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + r)"))
    least = F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("cut")
    return cuts.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), least).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def joined(words: str, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(F.col(words), first, last - first + 1), " ")


def not_covered(phrases: DataFrame) -> DataFrame:
    """``phrases`` without those that stand, at least four times of five, in one longer phrase."""
    longer = phrases.where(F.size("words") > 2).select("lang", "words", "a")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " ")),
        )
    )
    inner = longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    covered = F.expr("CAST(most AS DECIMAL(19, 0)) * 100 >= CAST(a AS DECIMAL(19, 0)) * 80")
    return phrases.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("most")


def rank(phrases: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language: by score, then count, both falling, then by the bytes of the phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def mine(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """``docs`` (lang, text) to lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to 4 words."""
    counted = materialise(word_counts(docs).where((F.col("n") >= least) | F.col("phrase").isNull()), "word-counts")
    words = counted.where("phrase IS NOT NULL")
    key = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("phrase").cast("binary")))
    tables = [bit_table(words.select(key.alias("key")))]
    for _ in ("pairs", "triples"):
        tables.append(bit_table(frequent_runs(docs, tables, least)))
    phrases = phrase_counts(docs, tables).where(F.col("n") >= least)
    counts = materialise(words.unionByName(phrases), "phrase-counts")
    totals = counted.where("phrase IS NULL").select("lang", F.col("n").alias("n"))
    best = rank(not_covered(materialise(scored(counts), "scored")), most)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
