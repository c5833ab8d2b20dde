"""Spelling variants: words that differ by one letter, and the more frequent forms they lead to.

Words and their counts come from all texts.  Near words are found by a prefix filter on q-grams, here
pairs of letters: one edit changes at most two of a word's pairs, so of the three rarest pairs of each of
two near words (rarest first in one order over all words, equal ones by position) at least one stands in
both, at positions that differ by one at most.  As there is one edit only, it lies either behind that
pair or before it: so the words agree up to the end of the pair, or from its beginning on.  Words are
therefore joined on those two halves, for each of the three pairs, among lengths that differ by one at
most; the position limit is part of the halves.  Unless the edit is that of the outermost letter, which the
words without it tell, the letter at the other end agrees too and is joined on as well.  What meets is
verified.  Halves that many words share are salted: one side's rows are dealt out over as many parts as
the half has thousands of words.

Defined cases: a null text has no words; of a null doc_id no letters are deleted; repeated rows count each;
texts of any length are read whole; ties of forms go to the smallest word in code-point order; an empty
table gives no words; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migcheck.llm.shared import materialise, sliced

RUN = re.compile("[A-Za-zÀ-ÿ]+")

#: Rows of a half that one part takes of its dealt side.
PART_ROWS = 1_000

#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 500_000


def damaged(run: str, crc: int, every: int) -> str:
    """``run`` without one letter, if ``every`` divides the checksum."""
    if crc % every:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, damage_every: int = 97) -> DataFrame:
    """word, n over all texts of ``docs`` (doc_id, text).

    One in ``damage_every`` of the (document, word) pairs, by checksum, loses a letter first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in sliced(batches):
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                found = Counter(RUN.findall(text.encode().lower().decode() if text else ""))
                if doc is None:
                    counts.update(found)
                    continue
                name = zlib.crc32(f"{doc}:".encode())
                for word, n in found.items():
                    crc = zlib.crc32(word.encode(), name)
                    counts[word if crc % damage_every else damaged(word, crc, damage_every)] += n
            if len(counts) >= HELD_WORDS:
                yield from rows(counts)
                counts.clear()
        yield from rows(counts)

    def rows(counts: Counter[str]) -> Iterator[pa.RecordBatch]:
        table = pa.table([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        yield from table.to_batches(max_chunksize=20_000)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_order(words: DataFrame) -> dict[str, int]:
    """The place of each pair of letters, from the rarest on; at most 90 x 90 pairs, as words have only those letters."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    counts = words.select("word", at.alias("at")).groupBy(F.expr("substring(word, at, 2)").alias("pair")).count()
    return {row.pair: i for i, row in enumerate(counts.orderBy("count", "pair").collect())}


#: What a half is of: a pair of letters; a word without its outermost letter; a whole word, that may be one without it.
PAIR, CUT, WHOLE = 0, 1, 2


def halves(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """word, length, half, kind: beginnings up to and ends from each of the three rarest pairs, and the word without either outermost letter."""
    held = words.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = held.value
        kinds = [PAIR] * 6 + [CUT] * 2 + [WHOLE] * 2
        for batch in batches:
            found, out = batch["word"].to_pylist(), []
            for word in found:
                (_, a), (_, b), (_, c) = sorted([(place[word[at : at + 2]], at) for at in range(len(word) - 1)])[:3]
                first, last = word[0], word[-1]
                out += [f"{word[: a + 2]}*{last}", f"{word[: b + 2]}*{last}", f"{word[: c + 2]}*{last}", f"{first}*{word[a:]}", f"{first}*{word[b:]}", f"{first}*{word[c:]}"]
                out += [f"{word[:-1]}_", f"_{word[1:]}", f"{word}_", f"_{word}"]
            n = len(found)
            by_word = pa.array([i for i in range(n) for _ in kinds], pa.int32())
            columns = [batch["word"].take(by_word), pa.array(list(map(len, found)), pa.int32()).take(by_word), pa.array(out, pa.string()), pa.array(kinds * n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "length", "half", "kind"])

    return words.select("word").mapInArrow(run, "word string, length int, half string, kind int")


def near_pairs(words: DataFrame) -> DataFrame:
    """left, right: the pairs of different words (of four letters at least, each pair once) that are one inserted, deleted or replaced letter apart."""
    rows = materialise(halves(words, pair_order(words)), "halves")
    # a shorter word looks among words of its own length and of one letter more
    lengths = F.array_compact(F.array(F.when(F.col("kind") != WHOLE, F.col("length")), F.when(F.col("kind") != CUT, F.col("length") + 1)))
    asking = rows.select(F.col("word").alias("left"), "half", F.explode(lengths).alias("length"), F.col("length").alias("own"))
    rows = rows.where(F.col("kind") != WHOLE).select("word", "half", "length")
    sizes = rows.groupBy("half", "length").count().where(F.col("count") > PART_ROWS)
    sizes = sizes.select("half", "length", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts"))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = rows.withColumnRenamed("word", "right").join(sizes, ["half", "length"], "left").withColumn("part", F.pmod(F.xxhash64("right"), parts).cast("int"))
    copied = asking.join(sizes, ["half", "length"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = copied.join(dealt.drop("parts"), ["half", "length", "part"])
    once = (F.col("own") < F.col("length")) | (F.col("left") < F.col("right"))
    return met.where(once & one_edit()).select("left", "right").distinct()


def one_edit() -> Column:
    return F.levenshtein("left", "right", 1) == 1


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n: the most frequent near word, if it has at least ``ratio`` times the count."""
    both = pairs.unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right")))
    other = words.select(F.col("word").alias("right"), F.col("n").alias("right_n"))
    best = both.join(other, "right").groupBy(F.col("left").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("right_n")).alias("less"), "right")).alias("best")
    )
    leads = -F.col("best.less") >= F.col("n") * ratio
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(leads, F.col("best.right")).alias("form"),
        F.when(leads, -F.col("best.less")).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form: the form that the chain of forms ends in.

    Each form has at least twice the count, so chains are short; the part of a chain behind a word
    doubles in each round until no word's last known form has a form of its own.
    """
    at = materialise(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            return at


def group(docs: DataFrame, least_letters: int = 5, least_count: int = 3, damage_every: int = 97) -> DataFrame:
    """``docs`` (doc_id, text) to word, form, root, n, n_near, form_n of the words of enough letters (four at least) and occurrences."""
    counted = word_counts(docs, damage_every).where((F.length("word") >= least_letters) & (F.col("n") >= least_count))
    words = materialise(counted, "words")
    formed = materialise(forms(words, materialise(near_pairs(words), "near")), "forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
