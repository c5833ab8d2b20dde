"""Quality rules on repetition inside a document.

For each document the operator builds the suffix array of its words, the longest common prefixes of
neighbours in it and their intervals.  An interval of the suffix array whose suffixes share a prefix
of at least ``min_words`` words, no more and no less, is a substring that cannot be extended to the
right; those whose occurrences follow different words cannot be extended to the left either and are
the maximal repeated substrings.  Their spans are united (for each occurrence the longest counts, it
covers the others), and a document fails where the united spans cover too much of it or one of them
is too long.  Many documents are handled in one array pass: a separator that occurs only once ends
each document, so no common prefix crosses it.

Defined cases: a null or blank text has no words (all counts 0, not kept); repeated rows are measured
alike; an empty table gives an empty result; equal suffixes do not exist, as each ends at its own place;
further columns, whatever their names, are ignored.  A batch holds at most ``batch_words`` words or one
document, whatever its length; texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migcheck.llm.shared import sliced

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(
            T.StructField(n, T.LongType())
            for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_maximal")
        ),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)


def ranks_of_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of (first, second), in lexicographic order."""
    key = first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


def double(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of the runs of ``2 * step`` symbols from the ranks of those of ``step``; shorter tails come first."""
    after = np.zeros(len(rank), dtype=np.int32)
    if step < len(rank):
        after[: len(rank) - step] = rank[step:] + 1
    return ranks_of_pairs(rank, after)


def suffix_levels(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... symbols, until all differ."""
    levels = [codes.astype(np.int32)]
    while int(levels[-1].max(initial=0)) + 1 < len(codes):
        levels.append(double(levels[-1], 1 << (len(levels) - 1)))
    return levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b``, from the longest power of two down."""
    size = len(levels[0])
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        inside = (x < size) & (y < size)
        same = inside.copy()
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        out += same.astype(np.int64) << k
    return out


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the lengths of the common prefixes of neighbours.

    ``codes`` holds symbols numbered densely from 0, each document ended by a symbol of its own.
    """
    levels = suffix_levels(codes)
    order = np.argsort(levels[-1], kind="stable")
    return order, common_prefix(levels, order[:-1], order[1:])


def intervals(shared: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last): the intervals of the suffix array whose suffixes share exactly ``length`` >= ``least`` symbols."""
    open_: list[tuple[int, int]] = []
    for at, length in enumerate([*shared.tolist(), 0]):
        left = at
        while open_ and open_[-1][0] > length:
            ended, left = open_.pop()
            yield ended, left, at
        if length >= least and (not open_ or open_[-1][0] < length):
            open_.append((length, left))


def maximal_repeats(codes: np.ndarray, order: np.ndarray, shared: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The intervals of :func:`intervals` whose occurrences follow different symbols (the start of the text is one of its own)."""
    before = np.where(order > 0, codes[order - 1], -1)
    turns = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    return [(length, first, last) for length, first, last in intervals(shared, least) if turns[last] > turns[first]]


def repeat_lengths(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each position the length of its longest interval: of the longest substring from there that occurs elsewhere too."""
    best = np.zeros(len(order), dtype=np.int64)
    best[order[:-1]] = shared
    best[order[1:]] = np.maximum(best[order[1:]], shared)
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in a span."""
    edges = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def windows_repeated(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions whose run of :data:`WINDOW` words occurs twice or more in the same document."""
    rank = codes
    for k in range(WINDOW.bit_length() - 1):
        rank = double(rank, 1 << k)
    # each document ends with a symbol of its own, so equal runs never reach over an end
    key = doc.astype(np.int64) * (int(rank.max(initial=0)) + 1) + rank
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return np.flatnonzero(count[back] > 1)


def measure_batch(texts: list[str | None], min_words: int) -> list[tuple]:
    """The measured columns of each text, without the id."""
    words = [WORD.findall(t) if t else [] for t in texts]
    known: dict[str, int] = {}
    number = known.setdefault
    flat = [number(w, len(known)) for own in words for w in own]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    # words numbered in order of arrival, then one separator for each document
    codes = np.empty(len(flat) + len(texts), dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    is_word = np.ones(len(codes), dtype=bool)
    is_word[ends] = False
    codes[is_word] = flat
    codes[ends] = len(known) + np.arange(len(texts))
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    begins = ends - sizes

    twice = windows_repeated(codes, doc) if len(codes) else np.zeros(0, dtype=np.int64)
    in_windows = covered(twice, np.full(len(twice), WINDOW), len(codes))
    n_repeat = np.bincount(doc[in_windows], minlength=len(texts))

    out = []
    for i, text in enumerate(texts):
        text = text or ""
        lines = [x for x in text.split("\n") if WORD.search(x)]
        spans: list[list[int]] = []
        longest = cover = maximal = 0
        # a repeat of at least WINDOW words shows in the windows; only shorter limits need every document
        if sizes[i] > 1 and (n_repeat[i] or min_words < WINDOW):
            own = np.unique(codes[begins[i] : ends[i] + 1], return_inverse=True)[1]
            order, shared = suffix_array(own)
            found = maximal_repeats(own, order, shared, min_words)
            if found:
                best = repeat_lengths(order, shared)[: sizes[i]]
                starts = np.flatnonzero(best >= min_words)
                longest, maximal = max(length for length, _, _ in found), len(found)
                inside = covered(starts, best[starts], int(sizes[i]))
                cover = int(inside.sum())
                turns = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
                spans = turns.reshape(-1, 2).tolist()
        out.append(
            (
                int(sizes[i]),
                sum(map(len, words[i])),
                sum(text.count(c) for c in SYMBOLS),
                len(lines) - len(set(lines)),
                int(n_repeat[i]),
                cover,
                longest,
                maximal,
                spans,
            )
        )
    return out


def measure(docs: DataFrame, min_words: int = WINDOW, batch_words: int = 400_000) -> DataFrame:
    """doc_id and the repetition measures of each text; ``spans`` are [from, to) in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 5_000):
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= 6 * batch_words):
                    chars += len(texts[to] or "")
                    to += 1
                rows = [(i, *m) for i, m in zip(ids[at:to], measure_batch(texts[at:to], min_words))]
                kinds = [pa.int64()] * 9 + [pa.list_(pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=MEASURED.names
                )
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEASURED)


def judge(measured: DataFrame, most_covered: float = 0.2, longest: int = 100) -> DataFrame:
    """Add ``base_failed`` (too short, or too many words in repeated windows) and ``kept``."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = (F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & fine)
