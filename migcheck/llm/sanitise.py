"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail and IP addresses, payment cards and phone numbers.  Beside the entities
themselves, other words of a text may reveal them.  How strongly is estimated from the whole corpus,
for three levels c: any entity, each kind, and each class (mail domain, subnet, number prefix, card
issuer).  A class stands for its entities, also for those in a single text: a word that points to an
entity points to its class at least as much.  With n_t distinct texts that hold a word t outside of
entities, n_tc of them with c, and one text at the base rate for smoothing,

    p(c | t) = (n_tc + p(c)) / (n_t + 1),   PMI(t; c) = log2 p(c | t) / p(c),   IC(c) = -log2 p(c).

A word discloses c where PMI reaches ``least_gain`` bits and at most ``rest`` bits of IC are left.  Both
are shares of texts, so they mean the same at every size of the corpus.  A word that stands with c by chance
does not count: if its n_t texts were drawn at random, so many of them would hold c with a probability of at
most exp(-n_t D(n_tc / n_t || p(c))) (Chernoff's bound, D the relative entropy), which must not exceed
``chance``.  So of the words that have nothing to do with c at most this share is taken for disclosing.
In the documents that hold c,

* a word that discloses a class is removed, as it points to few entities;
* another is generalised to a broader term, the words that begin with its first half, written as that
  half with a star, if those do not disclose any entity themselves; else it is removed.

All of it is DataFrame code; positions come from the lengths of the matches and of the gaps between.  The
work on one text grows in proportion to its length, or little more: running sums and texts are cut into
blocks, and a text's words meet its disclosing ones by a join.

Defined cases: a null text is an empty one without spans; matches that fail their check are dropped
and not tried again; overlapping spans of several kinds are all listed, by start, then kind, and
replaced as one; repeated rows are handled alike and count as one text; a very long text is one text,
read whole; an empty table gives an empty result; further columns, whatever their names, are ignored
(kept by :func:`sanitise`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from migcheck.llm.shared import keyed, materialise, same_row, small, with_key, without

KINDS = ("email", "ip", "card", "phone")
#: The name of all kinds together.
ANY = "any"

# The same matches as the plain patterns in linear time: a match begins where a run of its first
# class begins or where the last match ended, and no repetition gives back what it took.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

TERM = r"[\p{L}\p{N}]++"
NO_TERM = r"[^\p{L}\p{N}]+"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check sum of a string of digits holds."""
    total = F.aggregate(
        F.split(F.reverse(number), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("odd")),
        lambda acc, d: F.struct(
            (
                acc["sum"]
                + F.when(acc["odd"] == 0, d.cast("int")).otherwise(
                    d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
                )
            ).alias("sum"),
            (1 - acc["odd"]).alias("odd"),
        ),
    )["sum"]
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(
            F.split(match, r"\."), lambda p: F.when(F.length(part(p)) <= 3, F.concat(F.lit("0"), part(p)).cast("int") <= 255).otherwise(False)
        )
    if kind == "card":
        return F.when(F.length(digits(match)).between(14, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def _valid_span(kind: str, span: Column) -> Column:
    return valid(kind, span["value"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


#: Numbers of one block of a running total.
BLOCK = 256


def running(numbers: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each of the non-negative whole ``numbers`` what ``plus`` (a sum or the greatest) makes of those before it, from 0 on.

    An array grows by being copied, so totals are formed within blocks, then over the blocks.
    """
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

    def grown(acc: Column, x: Column) -> Column:
        return F.struct(plus(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def blocks(n: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int"))
        return F.transform(at, lambda i: F.aggregate(F.slice(n, i * BLOCK + 1, F.lit(BLOCK)), start, grown))

    def joined(parts: Column) -> Column:
        before = F.aggregate(parts, start, lambda acc, part: grown(acc, part["at"]))["out"]
        return F.flatten(F.zip_with(parts, before, lambda part, base: F.transform(part["out"], lambda x: plus(base, x))))

    return let(numbers, lambda n: F.when(F.size(n) > 0, let(blocks(n), joined)).otherwise(F.expr("cast(array() as array<int>)")))


def places(text: Column, pattern: str, order: int, kind: str, needs: str = "") -> Column:
    """Array of (start, order, end, kind, value) of all matches, in code points."""
    empty = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string,value:string>>)")

    def spans(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)  # only looked for where there is a match
        return let(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value")), placed)

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda x: x["gap"] + F.length(x["value"])), lambda a, b: a + b)
        return F.zip_with(
            pairs,
            before,
            lambda x, at: F.struct(
                (at + x["gap"]).alias("start"),
                F.lit(order).alias("order"),
                (at + x["gap"] + F.length(x["value"])).alias("end"),
                F.lit(kind).alias("kind"),
                x["value"].alias("value"),
            ),
        )

    walked = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(empty))
    return F.when(text.contains(needs), walked).otherwise(empty) if needs else walked


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, text, ``row`` (all columns) and ``base``: the valid matches by start, then kind."""
    rows = with_key(docs).withColumn("text", F.col("row.text").cast("string"))
    text = F.coalesce("text", F.lit(""))
    for order, kind in enumerate(KINDS):
        needs = {"email": "@", "phone": "+"}.get(kind, "")
        rows = rows.withColumn(kind, places(text, PATTERNS[kind], order, kind, needs))
    checked = [F.filter(kind, partial(_valid_span, kind)) for kind in KINDS]
    return rows.select("doc_id", "doc_key", "text", "row", F.array_sort(F.concat(*checked)).alias("base"))


def entity_class(span: Column) -> Column:
    """The class of an entity: mail domain, first two parts of an address, prefix of a number, first digits of a card."""
    number = digits(span["value"])
    return F.concat_ws(
        ":",
        span["kind"],
        F.when(span["kind"] == "email", F.lower(F.substring_index(span["value"], "@", -1)))
        .when(span["kind"] == "ip", F.substring_index(span["value"], ".", 2))
        .when(span["kind"] == "card", F.left(number, F.lit(4)))
        .otherwise(F.left(number, F.length(number) - 7)),
    )


def words_around(text: Column, base: Column) -> Column:
    """The distinct words of the whole text outside of its entities."""
    outside = F.lower(sanitised(text, base, " "))
    return F.filter(F.array_distinct(F.split(outside, NO_TERM)), lambda w: F.length(w) > 1)


def weighed(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` with ``weight``: one divided by the number of documents with the same text."""
    return rows.join(small(copies), "text_key", "left").withColumn("weight", F.coalesce(1 / F.col("copies"), F.lit(1.0)))


def number(weight: Column) -> Column:
    """How many distinct texts the rows stand for."""
    return F.round(F.sum(weight))


def holders_of(found: DataFrame) -> DataFrame:
    """The documents that hold an entity, with their ``kinds``, ``classes`` and the ``terms`` around the entities."""
    return found.where(F.size("base") > 0).select(
        "doc_id",
        "doc_key",
        F.xxhash64("text").alias("text_key"),
        "text",
        "base",
        F.array_distinct(F.transform("base", lambda s: s["kind"])).alias("kinds"),
        F.array_distinct(F.transform("base", entity_class)).alias("classes"),
        words_around(F.col("text"), F.col("base")).alias("terms"),
    )


def discloses(both: Column, term_texts: Column, share: Column, least_gain: float, rest: float) -> Column:
    """Whether a word in ``term_texts`` texts, ``both`` of them with c, discloses c, which a ``share`` of all texts holds."""
    given = F.least(F.lit(1.0), (both + share) / (term_texts + 1))
    return (F.log2(given / share) >= least_gain) & (-F.log2(given) <= rest)


def by_chance(both: Column, term_texts: Column, share: Column) -> Column:
    """A bound on the probability that at least ``both`` of ``term_texts`` texts drawn at random hold c."""
    part = both / term_texts
    gone = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - share))).otherwise(0.0)
    return F.when((part > share) & (share < 1), F.exp(-term_texts * (part * F.log(part / share) + gone))).otherwise(1.0)


def stem(term: Column) -> Column:
    """The broader term's beginning: the first half of a word."""
    return F.left(term, F.ceil(F.length(term) / 2).cast("int"))


def document_terms(docs: DataFrame, holders: DataFrame, least_gain: float, rest: float, chance: float) -> DataFrame:
    """doc_id, doc_key, term, action (remove or generalise): the disclosing words that each document with an entity holds.

    Words and entities are counted in distinct texts of the whole corpus, outside of entities on both
    sides: in the documents that hold one and, by one aggregation on the word, in all others.
    """
    rows = keyed(docs).withColumn("text_key", F.xxhash64("text"))
    sizes = materialise(rows.groupBy("text_key").agg(F.count("*").alias("copies")), "text-sizes")
    copies = materialise(sizes.where("copies > 1"), "copies")
    total = max(1, sizes.count())
    held = materialise(weighed(holders.select("doc_id", "doc_key", "text_key", "kinds", "classes", "terms"), copies), "held")

    def shows(both: Column, term_texts: Column, share: Column) -> Column:
        return discloses(both, term_texts, share, least_gain, rest) & (by_chance(both, term_texts, share) <= chance)

    # words of the documents with an entity: one row for each text and word, one sum for each kind
    own = held.select("weight", "kinds", F.explode("terms").alias("term"))
    of_kind = [number(F.when(F.array_contains("kinds", k), F.col("weight")).otherwise(0.0)).alias(k) for k in KINDS]
    own = own.groupBy("term").agg(*of_kind, number(F.col("weight")).alias(ANY))
    other = weighed(without(docs, holders).select(F.xxhash64(F.col("text").cast("string")).alias("text_key"), "text"), copies)
    other = other.select("weight", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), NO_TERM))).alias("term"))
    other = materialise(other.groupBy("term").agg(number(F.col("weight")).alias("others")), "other-terms")
    counts = own.join(other, "term", "left").withColumn("term_texts", F.col(ANY) + F.coalesce("others", F.lit(0.0)))
    counts = materialise(counts.drop("others"), "term-counts")

    # any entity and the kinds: their shares are five numbers
    levels = [*KINDS, ANY]
    in_texts = held.agg(*(F.coalesce(number(F.when(F.array_contains("kinds", k), F.col("weight")).otherwise(0.0)), F.lit(0.0)).alias(k) for k in KINDS), F.coalesce(number(F.col("weight")), F.lit(0.0)).alias(ANY)).first()
    shown = [F.when((F.col(k) > 0) & shows(F.col(k), F.col("term_texts"), F.lit(in_texts[k] / total)), F.lit(k)) for k in levels if in_texts[k]]
    by_kind = counts.select("term", "term_texts", F.array_compact(F.array(*shown, F.lit(None).cast("string"))).alias("levels")).where(F.size("levels") > 0)
    by_kind = materialise(by_kind, "kind-disclosures")

    # classes: only those that a word in all of their texts and no other would disclose
    known = held.select("weight", F.explode("classes").alias("name")).groupBy("name").agg(number(F.col("weight")).alias("texts"))
    known = known.withColumn("share", F.col("texts") / total).where(shows(F.col("texts"), F.col("texts"), F.col("share")))
    known = materialise(known.select("name", "share"), "classes")
    classes = held.select(F.col("doc_id").alias("class_id"), F.col("doc_key").alias("class_key"), F.explode("classes").alias("name")).join(small(known.select("name")), "name", "left_semi")
    classes = classes.groupBy("class_id", "class_key").agg(F.collect_set("name").alias("names"))
    named = held.join(classes, (held["doc_key"] == classes["class_key"]) & held["doc_id"].eqNullSafe(classes["class_id"]))
    named = materialise(named.select("doc_id", "doc_key", "weight", "terms", "names"), "class-texts")
    pairs = named.select("weight", "names", F.explode("terms").alias("term")).select("weight", "term", F.explode("names").alias("name"))
    both = pairs.groupBy("name", "term").agg(number(F.col("weight")).alias("both"))
    by_class = both.join(counts.select("term", "term_texts"), "term").join(small(known), "name")
    by_class = by_class.where(shows(F.col("both"), F.col("term_texts"), F.col("share"))).select("name", "term")
    by_class = materialise(by_class, "class-disclosures")

    # broader terms: how often the words with the same first half are with any entity and without one
    half = stem(F.col("term"))
    stems = by_kind.select(half.alias("stem")).distinct()
    inside = counts.select(half.alias("stem"), F.col(ANY).alias("own"), F.lit(0.0).alias("others"))
    beyond = other.select(half.alias("stem"), F.lit(0.0).alias("own"), "others")
    broad = inside.union(beyond).join(small(materialise(stems, "stems")), "stem", "left_semi").groupBy("stem").agg(F.sum("own").alias("own"), F.sum("others").alias("others"))
    open_ = ~discloses(F.col("own"), F.col("own") + F.col("others"), F.lit(max(in_texts[ANY], 1.0) / total), least_gain, rest)
    broad = materialise(broad.where(open_).select("stem", F.lit(True).alias("broad")), "broader-terms")
    by_kind = by_kind.withColumn("stem", half).join(small(broad), "stem", "left").select("term", "levels", F.coalesce("broad", F.lit(False)).alias("broad"))
    by_kind = materialise(by_kind, "kind-actions")

    words = held.select("doc_id", "doc_key", F.concat("kinds", F.array(F.lit(ANY))).alias("own_levels"), F.explode("terms").alias("term")).join(small(by_kind), "term")
    words = words.where(F.arrays_overlap("levels", "own_levels")).select("doc_id", "doc_key", "term", F.when(F.col("broad"), "generalise").otherwise("remove").alias("action"))
    of_class = named.select("doc_id", "doc_key", "names", F.explode("terms").alias("term")).join(small(by_class), "term")
    of_class = of_class.where(F.array_contains("names", F.col("name"))).select("doc_id", "doc_key", "term", F.lit("remove").alias("action"))
    # a word marked for removal is removed, whatever another entity asks for
    return words.union(of_class).groupBy("doc_id", "doc_key", "term").agg(F.max("action").alias("action"))


def term_spans(holders: DataFrame, own: DataFrame) -> DataFrame:
    """doc_id, doc_key and ``terms``: the places of disclosing words in documents that hold the entity.

    The words of these texts are dealt out one a row, joined to the listed ones and, in the order of their
    places, held against the entities before and behind them.
    """
    own = materialise(own, "document-terms")
    some = small(materialise(own.select(F.col("doc_id").alias("own_id"), F.col("doc_key").alias("own_key")).distinct(), "term-documents"))
    texts = holders.join(some, (holders["doc_key"] == some["own_key"]) & holders["doc_id"].eqNullSafe(some["own_id"]), "left_semi")
    words = texts.select("doc_id", "doc_key", F.explode(places(F.col("text"), TERM, 0, "word")).alias("w")).select("doc_id", "doc_key", "w.start", "w.end", "w.value")
    listed_words = small(own.select(F.col("doc_id").alias("own_id"), F.col("doc_key").alias("own_key"), "term", "action"))
    same = (words["doc_key"] == listed_words["own_key"]) & words["doc_id"].eqNullSafe(listed_words["own_id"]) & (F.lower(words["value"]) == listed_words["term"])
    marked = words.join(listed_words, same).select("doc_id", "doc_key", "start", "end", "value", "action")
    entities = texts.select("doc_id", "doc_key", F.explode("base").alias("b")).select("doc_id", "doc_key", "b.start", "b.end", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("action"))
    order = Window.partitionBy("doc_id", "doc_key").orderBy("start")
    entity = F.col("action").isNull()
    placed = marked.union(entities).select(
        "*",
        F.max(F.when(entity, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("before"),
        F.min(F.when(entity, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("behind"),
    )
    clear = placed.where(~entity & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("behind", "end") >= F.col("end")))
    removed = F.col("action") == "remove"
    span = F.struct("start", (removed.cast("int") + len(KINDS)).alias("order"), "end", F.when(removed, "removed").otherwise("term").alias("kind"), "value")
    return clear.groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_set(span)).alias("terms"))


def find(docs: DataFrame, least_gain: float = 2.0, rest: float = 0.6, chance: float = 0.001) -> DataFrame:
    """doc_id, doc_key, text, ``row`` (all columns), ``base`` spans and all ``spans`` of every document."""
    found = base_spans(docs)
    holders = materialise(holders_of(found), "holders")
    extra = materialise(term_spans(holders, document_terms(docs, holders, least_gain, rest, chance)), "term-spans")
    joined = found.join(small(extra, 50_000), same_row(found, extra), "left")
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.coalesce("terms", F.array()))))
    return joined.select(found["doc_id"], found["doc_key"], "text", "row", "base", spans.alias("spans"))


def sanitised(text: Column, spans: Column, instead: str | None = None) -> Column:
    """The text with entities replaced by their kind, words by a broader term or nothing (or all by ``instead``); overlapping spans become one."""

    def name(s: Column) -> Column:
        kind = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["kind"] == "removed", "").when(s["kind"] == "term", F.concat(stem(s["value"]), F.lit("*"))).otherwise(kind)

    # a place in a text is found from its beginning on, so the text is cut into blocks and pieces are taken from those
    width = F.greatest(F.lit(2048), F.ceil(F.sqrt(F.length(text)) * 6).cast("int"))

    def joined(t: Column) -> Column:
        def piece(first: Column, last: Column) -> Column:
            at, count = F.floor(first / t["width"]).cast("int"), F.floor(last / t["width"]).cast("int")
            around = F.array_join(F.slice(t["blocks"], at + 1, count - at + 1), "")
            return F.when(last > first, F.substring(around, first % t["width"] + 1, last - first)).otherwise("")

        def before(s: Column, at: Column) -> Column:
            return F.when(s["start"] < at, "").otherwise(F.concat(piece(at, s["start"]), name(s) if instead is None else F.lit(instead)))

        return F.concat(F.array_join(F.zip_with(t["spans"], t["before"], before), ""), piece(F.array_max(F.transform(t["spans"], lambda s: s["end"])), F.length(text)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / width).cast("int")), lambda i: F.substring(text, i * width + 1, width))
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    parts = F.struct(spans.alias("spans"), ends.alias("before"), width.alias("width"), blocks.alias("blocks"))
    return F.when(F.size(spans) == 0, text).otherwise(let(parts, joined))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with sanitised texts (nulls stay null); a column ``n_chars`` follows, all others are kept."""
    found = find(docs, **options).withColumn("text", sanitised(F.col("text"), F.col("spans")))
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    kept = {"text": F.col("text"), "n_chars": length}
    return found.select(*(kept.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and the list of all spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
