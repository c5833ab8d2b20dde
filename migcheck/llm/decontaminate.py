"""Benchmark decontamination with a positional inverted index.

1. Count every benchmark word in all documents.
2. For each window of ``n`` item words keep the offsets of its ``rarest`` rarest words; a window with
   a word that no document has cannot occur.
3. Store the postings (word, document, position) of those words only.
4. Adjust each posting by the word's offset in the item: postings that agree on (item, document,
   shift) are the intersection of the lists.  Windows whose rarest words all agree are candidates.
5. Compare the candidates' remaining words, at the same shift, with the document.

Only benchmark-sized tables are broadcast, after a check of their size.  Everything is DataFrame
code.

Defined cases: null and blank texts have no words and no hits; a very long text is one document, whose
places are rows of their own; an item of fewer than ``n`` words is one window, one without words none;
equally rare words are taken by their place in the item; equal item ids count once, a null id is
written as ``null``; repeated documents are judged alike; an empty benchmark leaves all documents
clean; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from migcheck.llm.shared import keyed, materialise, n_words_of, same_row, small, split_words, words_of

WINDOW = 13


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, item_words of the items that have words; ``item_key`` names an id's text."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of(F.col("text")).alias("item_words")
    )
    return (
        rows.where(F.size("item_words") > 0)
        .withColumn("item_key", F.sha2(F.concat_ws(" ", "item_id", "item_words"), 256))
        .dropDuplicates(["item_key"])
    )


def postings_of(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, doc_key, position, term) of the ``terms`` in ``rows`` (doc_id, doc_key, text)."""
    words = rows.select("doc_id", "doc_key", F.posexplode(split_words(F.col("text"))).alias("position", "term"))
    return words.join(terms, "term", "left_semi")


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` occurs in all documents."""
    words = rows.select(F.explode(split_words(F.col("text"))).alias("term"))
    return words.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def windows_of(items: DataFrame, counts: DataFrame, n: int, rarest: int) -> DataFrame:
    """For each item its windows that may occur: array of (first, seeds), seeds being word offsets in the item."""
    offsets = items.select("item_key", F.posexplode("item_words").alias("at", "term")).join(counts, "term", "left")
    counted = offsets.groupBy("item_key").agg(F.sort_array(F.collect_list(F.struct("at", "n", "term"))).alias("words"))
    size = F.least(F.lit(n), F.size("words"))

    def window(first):
        own = F.slice("words", first + 1, size)
        by_count = F.sort_array(F.transform(own, lambda w: F.struct(w["n"].alias("n"), w["at"].alias("at"))))
        seeds = F.transform(F.slice(by_count, 1, rarest), lambda w: w["at"])
        return F.struct(first.alias("first"), seeds.alias("seeds"), F.exists(own, lambda w: w["n"].isNull()).alias("absent"))

    made = F.transform(F.sequence(F.lit(0), F.size("words") - size), window)
    return counted.select("item_key", "words", F.filter(made, lambda w: ~w["absent"]).alias("windows")).where(F.size("windows") > 0)


def seeds_of(windows: DataFrame) -> DataFrame:
    """(item_key, at, term): the words whose postings are looked up."""
    at = F.array_distinct(F.flatten(F.transform("windows", lambda w: w["seeds"])))
    return windows.select("item_key", "words", F.explode(at).alias("at")).select(
        "item_key", "at", F.element_at("words", F.col("at") + 1)["term"].alias("term")
    )


def shifted(postings: DataFrame, seeds: DataFrame) -> DataFrame:
    """(item_key, doc_id, doc_key, shift, at): the postings, adjusted by their word's offset in the item."""
    return postings.join(seeds, "term").select("item_key", "doc_id", "doc_key", (F.col("position") - F.col("at")).alias("shift"), "at")


def candidates(adjusted: DataFrame, windows: DataFrame) -> DataFrame:
    """(item_key, doc_id, doc_key, shift, firsts): windows all of whose seeds agree on the shift."""
    met = adjusted.groupBy("item_key", "doc_id", "doc_key", "shift").agg(F.collect_set("at").alias("met"))
    agree = F.filter("windows", lambda w: F.forall(w["seeds"], lambda at: F.array_contains("met", at)))
    return (
        met.join(windows.select("item_key", "windows"), "item_key")
        .select("item_key", "doc_id", "doc_key", "shift", F.transform(agree, lambda w: w["first"]).alias("firsts"))
        .where(F.size("firsts") > 0)
    )


def near_matches(adjusted: DataFrame, windows: DataFrame, slack: int) -> DataFrame:
    """Proximity: windows whose seeds all occur with shifts inside one band of ``2 * slack``.

    Each posting goes to the two bands that hold its shift, so shifts less than ``slack`` apart always meet.
    """
    band = F.floor(F.col("shift") / slack)
    banded = adjusted.withColumn("band", F.explode(F.array(band - 1, band))).drop("shift")
    return (
        candidates(banded.withColumnRenamed("band", "shift"), windows)
        .select("item_key", "doc_id", "doc_key", F.explode("firsts").alias("first"), (F.col("shift") * slack).alias("from_shift"))
        .distinct()
    )


def exact_matches(found: DataFrame, rows: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(doc_id, doc_key, item_id, start, end): candidates whose words all agree."""
    keys = small(materialise(found.select("doc_id", "doc_key").distinct(), "candidate-keys"))
    texts = rows.join(keys, same_row(rows, keys), "left_semi").select("doc_id", "doc_key", split_words(F.col("text")).alias("words"))
    size = F.least(F.lit(n), F.size("item_words"))
    at = F.col("shift")

    def equal(first):
        inside = (at + first >= 0) & (at + first + size <= F.size("words"))
        return F.when(
            inside, F.slice("words", F.greatest(F.lit(1), at + first + 1), size) == F.slice("item_words", first + 1, size)
        ).otherwise(False)

    both = found.join(texts, same_row(found, texts)).select(
        "item_key", found["doc_id"], found["doc_key"], "shift", "firsts", "words"
    )
    return (
        both.join(items, "item_key")
        .select("doc_id", "doc_key", "item_id", size.alias("size"), "shift", F.explode(F.filter("firsts", equal)).alias("first"))
        .select("doc_id", "doc_key", "item_id", (at + F.col("first")).alias("start"), (at + F.col("first") + F.col("size")).alias("end"))
    )


def indexed(docs: DataFrame, benchmark: DataFrame, n: int, rarest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, windows, adjusted): the stored index, its postings adjusted by their words' offsets in the items."""
    rows = keyed(docs)
    items = materialise(items_of(benchmark), "items")
    vocabulary = materialise(items.select(F.explode("item_words").alias("term")).distinct(), "item-terms")
    counts = materialise(term_counts(rows, small(vocabulary)), "item-term-counts")
    windows = materialise(windows_of(items, counts, n, rarest), "item-windows")
    seeds = materialise(seeds_of(windows), "item-seeds")
    terms = materialise(seeds.select("term").distinct(), "seed-terms")
    postings = materialise(postings_of(rows, small(terms)), "postings")
    return items, windows, shifted(postings, small(seeds))


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, rarest: int = 3) -> DataFrame:
    """All places where a window of an item occurs (see :func:`exact_matches`), from the stored index."""
    items, windows, adjusted = indexed(docs, benchmark, n, rarest)
    found = materialise(candidates(adjusted, small(windows)), "candidates")
    return exact_matches(found, keyed(docs), small(items), n)


def find_near(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, rarest: int = 3, slack: int = 8) -> DataFrame:
    """(doc_id, doc_key, item_id, first, from_shift): windows whose rarest words stand within ``slack`` words of their places."""
    items, windows, adjusted = indexed(docs, benchmark, n, rarest)
    found = near_matches(adjusted, small(windows), slack)
    return found.join(small(items).select("item_key", "item_id"), "item_key").drop("item_key")


def judge(docs: DataFrame, matches: DataFrame, share: int = 20) -> DataFrame:
    """Per document n_words, n_hit, n_items, items_sha256 and ``contaminated`` (a hit in ``share`` words or fewer on average)."""
    spans = matches.select("doc_id", "doc_key", "start", "end").distinct()
    before = W.partitionBy("doc_id", "doc_key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.coalesce(F.max("end").over(before), F.lit(0)), F.col("start")))
    hit = spans.withColumn("new", new).groupBy("doc_id", "doc_key").agg(F.sum("new").cast("long").alias("hit"))
    # the ids of one document are at most those of the benchmark
    met = matches.groupBy("doc_id", "doc_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    met = met.select(F.col("doc_id").alias("met_id"), F.col("doc_key").alias("met_key"), "items")
    hits = hit.join(met, (hit["doc_key"] == met["met_key"]) & hit["doc_id"].eqNullSafe(met["met_id"])).select("doc_id", "doc_key", "hit", "items")
    rows = keyed(docs)
    base = rows.select("doc_id", "doc_key", n_words_of(F.col("text")).alias("n_words"))
    n_hit = F.coalesce("hit", F.lit(0))
    return base.join(hits, same_row(base, hits), "left").select(
        base["doc_id"],
        base["doc_key"],
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
