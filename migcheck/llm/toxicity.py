"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

1. A bounded sample of labelled rows (``most_labelled`` rows on average, by a hash of the id) is the
   only thing that learning sees; of it only rows whose crc32(id) mod 5 is not 0.
2. A lexicon is learned from its folds 1 to 3: beginnings of words that occur in toxic texts far more
   often than chance allows (a bound on the binomial tail, corrected for the number of beginnings that
   could pass it), beside a short stated list.
3. Each whole text gives dense features: lexicon densities, hits near the second person, capitals,
   punctuation and obfuscation rates.
4. Boosted trees are fitted on the folds 1 to 3 of the sample.  Fold 4, which neither the lexicon nor
   the trees have seen, calibrates them by isotonic regression; both are applied to all documents.

Labels, language, source and id are never features.

Defined cases: a null text is an empty one and has the features of no words; a very long text is measured
whole; repeated rows are scored alike; equal scores are ties and stay equal; null or contradicting labels:
nulls are ignored, one toxic label makes an id toxic; with labels of one class only (or none) every score
is that class' share, 0 without labels; with under five rows of a class in fold 4 or the others, lexicon,
trees and calibration use all four folds; an empty table gives an empty result; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migcheck.llm.shared import keyed, materialise, sliced

# Common insults, counted from the start; all others are learned.
INSULTS = """
    bastard clown crap cretin damn disgusting dumb fool garbage hate idiot imbecile jerk loser lunatic moron
    pathetic pig retard scum shut slut stupid trash ugly vermin worthless
    arschloch dreck dummkopf trottel connard cretin imbecile salaud basura estupido imbecil
""".split()

# Words of the second person.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ti tus vosotros".split()
)

#: Words of Latin, Greek and Cyrillic letters in lower-cased text.
WORD = re.compile(r"[a-zß-öø-ɏͰ-ӿ]+")
#: Signs and digits before a letter; inside of a word they obfuscate it.
SIGNED = re.compile(r"[0-9@$*!|+._-]+(?=[^\W\d_])")
INSIDE = re.compile(r"[^\W_]|[@$*!|+._-]")
#: Letters set apart one by one: a cheap sign of them, and the whole run.
APART = re.compile(r"[ .*_-][^\W\d_][ .*_-][^\W\d_][ .*_-]")
APART_RUN = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"})
SEPARATORS = re.compile(r"[\W\d_]+")
LONG_RUN = re.compile(r"(.)\1{2,}")
SIGN = re.compile(r"[!-/:-@\[-`{-~]")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]{3,}")

SHORTEST, LONGEST = 3, 8
NEAR = 4

FEATURES = (
    "log_words",
    "log_hits",
    "hit_density",
    "strength_density",
    "stated_density",
    "near_second_person",
    "second_person_density",
    "capital_share",
    "capital_words",
    "exclaimed_rate",
    "sign_rate",
    "obfuscation_rate",
    "obfuscated_hits",
    "distinct_share",
)

FEATURED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("doc_key", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in FEATURES)]
)

#: Words whose strength a worker remembers; beyond them the memory starts anew.
WORDS_KEPT = 100_000

#: Beginnings that a worker counts before it hands their counts on.
BEGINNINGS_KEPT = 100_000


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; rows of fold 0 are held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, most_labelled: int) -> DataFrame:
    """doc_id, toxic, fold, text_key, text of labelled rows out of the folds 1 to 4, ``most_labelled`` ids on average."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", fold_of(F.col("doc_id")))
        .where("fold > 0")
    )
    total = known.count()
    share = min(1.0, most_labelled / max(1, total))
    taken = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the sample's ids are bounded by the parameter, so they may be broadcast
    return texts.join(F.broadcast(taken), "doc_id").withColumn("text_key", F.xxhash64("text"))


def beginnings(text: str) -> set[str]:
    """The beginnings of the words of a text."""
    return {w[:k] for w in set(WORD.findall(text.lower())) for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def counted(texts: DataFrame) -> DataFrame:
    """beginning, n: in how many of the texts each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["beginning", "n"]
            )

        for batch in sliced(batches):
            for text in batch["text"].to_pylist():
                count.update(beginnings(text))
                if len(count) > BEGINNINGS_KEPT:
                    yield out()
                    count.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "beginning string, n long").groupBy("beginning").agg(F.sum("n").alias("n"))


def testable(sizes: list[tuple[int, int]], base: float) -> tuple[int, float]:
    """(least, demand): the fewest toxic texts with which a beginning could pass the bound, and the evidence it needs.

    ``sizes`` are (toxic texts, how many beginnings are in so many).  Only beginnings that could pass count
    as tried (Tarone's correction), so the rare ones, which cannot, do not weaken the others.
    """
    tried = 0
    for n, rows in sorted(sizes, reverse=True):
        if n * -math.log(base) <= math.log(tried + rows) + 2:
            return n + 1, math.log(max(1, tried)) + 2
        tried += rows
    return 1, math.log(max(1, tried)) + 2


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """beginning -> strength (log odds ratio), from the distinct texts of the bounded sample.

    Only the significant beginnings are collected, and the sample bounds them.
    """
    texts = sample.groupBy("text_key").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    size = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return {}
    inside = materialise(counted(texts.where("toxic = 1")), "beginnings")
    outside = counted(texts.where("toxic = 0")).withColumnRenamed("n", "against")
    base = toxic / (toxic + clean)
    sizes = [(r["n"], r["rows"]) for r in inside.groupBy("n").agg(F.count("*").alias("rows")).collect()]  # a row for each number of texts
    least, demand = testable(sizes, base)
    n, against = F.col("n"), F.coalesce("against", F.lit(0))
    share = n / (n + against)
    # Chernoff's bound on so large a share by chance
    beside = F.when(against > 0, (1 - share) * F.ln((1 - share) / (1 - base))).otherwise(0.0)
    evidence = share * F.ln(share / base) + beside
    strength = F.ln((n + 0.5) / toxic) - F.ln((against + 0.5) / clean)
    listed = (
        inside.where(n >= least)
        .join(outside, "beginning", "left")
        .where((share > base) & ((n + against) * evidence > demand) & (strength > 1.5))
        .select("beginning", strength.alias("strength"))
    )
    return {r["beginning"]: r["strength"] for r in listed.collect()}


class Meter:
    """Measures whole texts."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.stated = frozenset(INSULTS)
        self.known: dict[str, float] = {}

    def strength(self, word: str) -> float:
        """Of the strongest beginning of a word; 0 if none is listed."""
        get = self.lexicon.get
        found = max((get(word[:k], 0.0) for k in range(SHORTEST, min(LONGEST, len(word)) + 1)), default=0.0)
        return max(found, 3.0) if word in self.stated else found

    def look_up(self, words: set[str]) -> tuple[dict[str, float], dict[str, float]]:
        """The listed ones among distinct words, and those listed once their stretched letters are shortened."""
        known = self.known
        if len(known) + len(words) > WORDS_KEPT:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = self.strength(word) or -(self.strength(short) if (short := LONG_RUN.sub(r"\1", word)) != word else 0.0)
        listed = {w: known[w] for w in words if known[w]}
        return {w: s for w, s in listed.items() if s > 0}, {w: -s for w, s in listed.items() if s < 0}

    def plain(self, token: str) -> str:
        """An obfuscated token as the word that is meant."""
        return LONG_RUN.sub(r"\1", SEPARATORS.sub("", token.lower().translate(LEET)))

    def obscured(self, text: str) -> list[str]:
        """Tokens with signs or digits inside or before letters, and letters set apart one by one."""
        out, done = [], 0
        for m in SIGNED.finditer(text):
            low, high = m.span()
            if low < done or not (text[low - 1 : low].isalpha() or (text[low] in "@$!|" and not text[low - 1 : low].strip())):
                continue
            while low > done and INSIDE.match(text, low - 1):
                low -= 1
            while high < len(text) and INSIDE.match(text, high):
                high += 1
            out.append(text[low:high])
            done = high
        return out + ([x for x in APART_RUN.findall(text) if x not in out] if APART.search(text) else [])

    def measure(self, text: str) -> tuple[float, ...]:
        words = WORD.findall(text.lower())
        distinct = set(words)
        n, chars, per = len(words), max(1, len(text)), 100 / max(1, len(words))
        listed, stretched = self.look_up(distinct)
        hits = [(i, listed[w]) for i, w in enumerate(words) if w in listed] if listed else []
        addressed = SECOND_PERSON & distinct
        second = {i for i, w in enumerate(words) if w in addressed} if addressed else set()
        near = sum(any(k in second for k in range(i - NEAR, i + NEAR + 1)) for i, _ in hits) if second else 0
        obscured = self.obscured(text)
        hidden = [s for s in (self.strength(self.plain(x)) for x in obscured) if s]
        hidden += [stretched[w] for w in words if w in stretched] if stretched else []
        n_hits = len(hits) + len(hidden)
        return (
            math.log1p(n),
            math.log1p(n_hits),
            n_hits * per,
            (sum(s for _, s in hits) + sum(hidden)) * per,
            sum(words[i] in self.stated for i, _ in hits) * per,
            math.log1p(near),
            len(second) * per,
            len(CAPITAL.findall(text)) / chars,
            sum(map(len, CAPITALS.findall(text))) / chars,
            (text.count("!") + text.count("?")) * per,
            len(SIGN.findall(text)) * per,
            len(obscured) * per,
            math.log1p(len(hidden)),
            len(distinct) / max(1, n),
        )


def features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """doc_id, doc_key and the :data:`FEATURES` of every text; the lexicon is bounded like the sample it comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(lexicon)
        for batch in sliced(batches):
            rows = [meter.measure(t or "") for t in batch["text"].to_pylist()]
            columns = list(zip(*rows)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["doc_key"], *(pa.array(c, pa.float64()) for c in columns)], names=FEATURED.names
            )

    return keyed(docs).mapInArrow(run, FEATURED)


#: Rows of each class that fold 4 and the other folds need, to be used apart.
LEAST_APART = 5


def learning_folds(sample: DataFrame) -> Column:
    """Condition on ``fold``: the folds that lexicon and trees learn from."""
    seen = {(r["toxic"], r["last"]): r["n"] for r in sample.groupBy("toxic", (F.col("fold") == 4).alias("last")).agg(F.count("*").alias("n")).collect()}
    apart = all(seen.get((y, last), 0) >= LEAST_APART for y in (0, 1) for last in (False, True))
    return F.col("fold") < 4 if apart else F.lit(True)


def calibrated(held: DataFrame) -> IsotonicRegressionModel:
    """The isotonic regression of ``label`` on ``raw``."""
    return IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(held)


def fit(train: DataFrame, trees: int = 20, depth: int = 3) -> Callable[[DataFrame], DataFrame] | float:
    """A function that adds ``score`` to rows of features, or the constant score of a single class.

    ``train`` has the features, ``toxic`` and ``fold`` (1 to 4).
    """
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    rows = assembler.transform(train).select("features", F.col("toxic").cast("double").alias("label"), "toxic", "fold")
    ones, total = rows.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if ones in (0, total):
        return ones / max(1, total)
    learning = learning_folds(rows)
    booster = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, seed=7)
    model = booster.fit(rows.where(learning))

    def raw(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("raw", vector_to_array("probability")[1])

    calibration = calibrated(raw(rows.where("fold = 4") if rows.where(~learning).limit(1).count() else rows).select("raw", "label"))

    def score(df: DataFrame) -> DataFrame:
        scored = calibration.transform(raw(assembler.transform(df)))
        return scored.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score"))).drop("features", "rawPrediction", "probability", "prediction", "raw")

    return score


def score(docs: DataFrame, labels: DataFrame, most_labelled: int = 40_000, trees: int = 20, depth: int = 3) -> DataFrame:
    """doc_id, doc_key, the features, held_out, score and predicted of every document."""
    sample = materialise(labelled_sample(docs, labels, most_labelled), "labelled")
    lexicon = learn_lexicon(sample.where(learning_folds(sample)))
    own = materialise(features(sample, lexicon).join(sample.select("doc_id", "toxic", "fold").distinct(), "doc_id"), "labelled-features")
    # the sample's numbers, bounded by most_labelled, in a few partitions for the many small jobs of boosting
    fitted = fit(own.coalesce(4), trees, depth)
    measured = features(docs, lexicon)
    scored = fitted(measured) if callable(fitted) else measured.withColumn("score", F.lit(float(fitted)))
    return scored.withColumn("held_out", fold_of(F.col("doc_id")) == 0).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
