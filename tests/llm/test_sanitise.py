"""Personal data: base spans against the plain patterns, disclosing words, sanitised texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from migcheck.llm import queries, sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, match: str) -> bool:
    number = re.sub(r"\D", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(number) <= 19 and luhn(number)
    return kind != "phone" or 10 <= len(number) <= 15


def brute(text: str | None) -> list[tuple[int, int, str, int]]:
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return sorted(out)


def listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def odd_texts() -> list[str | None]:
    rng = random.Random(4)
    parts = [
        "a@b.co", "x..y@z-.com.", "1.2.3.4", "256.1.1.1", "01.002.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999",
        "+49 30 1234567 .", "@", ".", " ", "é", "😀", "9", "00", "-", "a", "b.c", "+", "(", "12.34.56", "\n", "a@b", "@b.c", "..", "5500000000000004",
    ]
    return [None, "", "no data"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]


def test_base_spans_equal_the_plain_patterns(spark, sf_dir):
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    docs = docs.union(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000000", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in sanitise.digest(sanitise.base_spans(docs).withColumn("spans", F.col("base"))).collect():
        spans = brute(texts[r.doc_id])
        assert r.spans == listed(spans), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in PLAIN]


def test_query_keeps_base_spans(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_sanitise(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert set(filter(None, listed(brute(texts[r.doc_id])).split(","))) <= set(r.spans.split(","))


def classes_of(text: str, spans) -> set[str]:
    out = set()
    for start, _, kind, end in spans:
        value, number = text[start:end], re.sub(r"\D", "", text[start:end])
        out.add(kind + ":" + {"email": value.rpartition("@")[2].lower(), "ip": ".".join(value.split(".")[:2]), "card": number[:4], "phone": number[:-7]}[kind])
    return out


def words_in(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[^\W_]+", text)]


def brute_all(texts: dict) -> dict:
    """All spans of every text, by the definition of disclosure, from plain counting."""
    distinct = {t: None for t in texts.values()}
    for t in distinct:
        spans = brute(t)
        outside = list(t or "")
        for start, _, _, end in spans:
            outside[start:end] = " " * (end - start)
        terms = {w for a, b in words_in("".join(outside)) if len(w := "".join(outside)[a:b].lower()) > 1}
        distinct[t] = (spans, terms, {s[2] for s in spans} | ({"any"} if spans else set()), classes_of(t or "", spans))
    total = len(distinct)
    texts_of, with_level, of_level = {}, {}, {}
    for _, terms, levels, classes in distinct.values():
        for c in levels | classes:
            of_level[c] = of_level.get(c, 0) + 1
        for w in terms:
            texts_of[w] = texts_of.get(w, 0) + 1
            for c in levels | classes:
                with_level[w, c] = with_level.get((w, c), 0) + 1

    def shows(both, n, c):
        share = of_level[c] / total
        given = min(1.0, (both + share) / (n + 1))
        part = both / n
        away = part * math.log(part / share) + ((1 - part) * math.log((1 - part) / (1 - share)) if part < 1 else 0)
        by_chance = math.exp(-n * away) if part > share else 1
        return math.log2(given / share) >= 2 and -math.log2(given) <= 0.6, by_chance <= 0.001

    stems: dict = {}
    for w, n in texts_of.items():
        own = stems.setdefault(w[: math.ceil(len(w) / 2)], [0, 0])
        own[0] += with_level.get((w, "any"), 0)
        own[1] += n
    out = {}
    for i, t in texts.items():
        spans, terms, levels, classes = distinct[t]
        found = []
        for start, end in words_in(t or "") if spans else []:
            w = t[start:end].lower()
            if w not in terms or any(start < b[3] and b[0] < end for b in spans):
                continue
            half = stems[w[: math.ceil(len(w) / 2)]]
            if any(all(shows(with_level[w, c], texts_of[w], c)) for c in classes):
                found.append((start, 5, "removed", end))
            elif any(all(shows(with_level[w, c], texts_of[w], c)) for c in levels):
                found.append((start, 5, "removed", end) if shows(half[0], half[1], "any")[0] else (start, 4, "term", end))
        out[i] = listed(sorted(spans + found))
    return out


def test_all_spans_equal_plain_counting(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute_all(texts)
    assert sum("term:" in x or "removed:" in x for x in want.values()) > 0
    assert {r.doc_id: r.spans for r in queries.op2_sanitise(spark, sf_dir).collect()} == want


def test_very_long_text(spark):
    text = "plain words and agent@example.org, " * 3_000
    row = sanitise.digest(sanitise.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row.n_email == 3_000 and row.spans == listed(brute(text))


def many(n: int) -> str:
    return "".join(f"user{i % 1000}@mail{i % 50}.example.org and frobmail no {i}; " for i in range(n))


def test_a_text_of_100000_matches(spark):
    text = many(100_000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    row = sanitise.digest(sanitise.base_spans(docs).withColumn("spans", F.col("base"))).first()
    assert time.perf_counter() - began < 20  # a second and a half each 10,000 would be a square's beginning
    assert row.n_email == 100_000 and row.base_sha256 == hashlib.sha256(listed(brute(text)).encode()).hexdigest()


def test_a_long_text_is_sanitised(spark):
    text = many(5_000)
    rows = [(i, f"{i} frobmail a{i}@example.org") for i in range(20)] + [(100 + i, f"plain words {i}") for i in range(300)]
    docs = spark.createDataFrame([(1000, text), *rows], "doc_id long, text string")
    clean = sanitise.sanitise(docs).where("doc_id = 1000").first().text
    assert clean.count("[EMAIL]") == 5_000 and "@" not in clean and "frobmail" not in clean


def test_running_totals(spark):
    rng = random.Random(2)
    lists = [[], [5], [0, 0], *([rng.randint(0, 50) for _ in range(n)] for n in (255, 256, 257, 1000))]
    rows = spark.createDataFrame([(x,) for x in lists], "n array<int>")
    for plus, f in ((lambda a, b: a + b, sum), (F.greatest, lambda part: max(part, default=0))):
        got = {tuple(r.n): r.out for r in rows.select("n", sanitise.running(F.col("n"), plus).alias("out")).collect()}
        assert got == {tuple(x): [f(x[:i]) for i in range(len(x))] for x in lists}


def disclosing_docs(spark):
    rows = [(i, f"The zorblat of unit{i} can be reached at agent@example.org for orders {i}") for i in range(6)]
    rows += [(100 + i, f"the orders of unit{i} can be reached for any reason at all") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("spans", F.lit(1))


def test_disclosing_words_are_removed_or_generalised(spark):
    docs = disclosing_docs(spark)
    got = {r.doc_id: r for r in sanitise.sanitise(docs).collect()}
    for i in range(6):
        assert "agent@" not in got[i].text and "zorblat" not in got[i].text and "[EMAIL]" in got[i].text
        assert got[i].n_chars == len(got[i].text) and got[i].spans == 1
        assert f"unit{i}" in got[i].text  # seen once: it says nothing about the entity in the corpus
    for i in range(60):
        assert got[100 + i].text == f"the orders of unit{i} can be reached for any reason at all"


def test_empty_and_repeated_rows(spark):
    docs = disclosing_docs(spark)
    assert sanitise.sanitise(docs.limit(0)).count() == 0
    twice = sanitise.sanitise(docs.union(docs).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))).collect()
    assert len(twice) == 2 * docs.count() + 1
    assert sum(r.text is None for r in twice) == 1
    assert len({r.text for r in twice if r.doc_id == 1}) == 1


def written(spark, tmp_path, rows) -> str:
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_query_finds_words_of_entities_in_one_text_each(spark, tmp_path):
    rows = [(i, f"Some prose says frobmail user{i}@example.org and goes on") for i in range(12)]
    rows += [(100 + i, f"some prose says that it goes on for {i} lines and more") for i in range(200)]
    got = {r.doc_id: r.spans for r in queries.op2_sanitise(spark, written(spark, tmp_path, rows)).collect()}
    for i in range(12):
        assert got[i].startswith("removed:16:24,email:25:")
    assert not any(got[100 + i] for i in range(200))


def test_words_by_chance_are_kept(spark, tmp_path):
    # each of these words is seen once and only with an entity
    rows = [(i, f"once{i} twice{i} user{i}@example.org") for i in range(5)] + [(100 + i, f"other{i} text") for i in range(300)]
    got = queries.op2_sanitise(spark, written(spark, tmp_path, rows)).collect()
    assert sorted(r.spans[:6] for r in got if r.spans) == ["email:"] * 5
    assert not any("term" in r.spans or "removed" in r.spans for r in got)


def test_words_far_from_the_entity_count(spark, tmp_path):
    filler = "plain words go on and on " * 20
    rows = [(i, f"frobmail {filler} {i} agent@example.org") for i in range(12)] + [(100 + i, f"{filler} {i}") for i in range(200)]
    got = {r.doc_id: r.spans for r in queries.op2_sanitise(spark, written(spark, tmp_path, rows)).collect()}
    assert all(got[i].startswith("removed:0:8,email:") for i in range(12))
