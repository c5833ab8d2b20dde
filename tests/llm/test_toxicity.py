"""Toxicity: held-out accuracy, obfuscation, odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from migcheck.llm import toxicity

STEMS = ("zork", "blarf", "quint")


def text_of(rng, toxic):
    own = ["".join(rng.choice(("an", "er", "in", "the", "ou", "st")) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(15, 120))]
    for _ in range(3 * toxic):
        own[rng.randrange(len(own))] = rng.choice(STEMS) + rng.choice(("er", "ing", "in"))
    return " ".join(own)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    truth = {i: int(rng.random() < 0.2) for i in range(1500)}
    docs = [(i, text_of(rng, y), "en", "s") for i, y in truth.items()]
    docs += [(2000, None, "", ""), (2001, "", "", ""), (2002, "You Z0RK3R!!! z-o-r-k-e-r b l a r f e r", "", ""), (2003, docs[5][1] + " tail" * 20000, "", ""), (5, docs[5][1], "", ""), (None, "plain", "", "")]
    labels = [(i, 1, y) for i, y in truth.items() if i % 3] + [(7, 0, None), (None, 0, 1), (8, 1, truth[8]), (99999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string, score string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.score(df, known, trees=6).collect()
    return truth, rows


def test_held_out_accuracy(scored):
    truth, rows = scored
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) or r.doc_id is None


def test_odd_texts(scored):
    _, rows = scored
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2000][0].predicted == by[2001][0].predicted == 0
    assert by[2002][0].predicted == 1 and by[2002][0].obfuscated_hits > 0
    assert len(by[5]) == 2 and by[5][0].score == by[5][1].score
    assert len(by[None]) == 1 and len(by[2003]) == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, none).collect()] == [0.0, 0.0]
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, ones).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), ones).count() == 0


def test_obfuscation():
    meter = toxicity.Meter({"zork": 5.0})
    assert meter.plain("Z0rk") == "zork" and meter.plain("z.o_r-k") == "zork" and meter.plain("zooork") == "zork"
    features = dict(zip(toxicity.FEATURES, meter.measure("you z0rk, zork and zoooork")))
    assert features["log_hits"] == pytest.approx(1.3862943611) and features["near_second_person"] > 0


def test_rare_words_are_tried_beside_many_frequent_ones(spark):
    rng = random.Random(3)
    neutral = " ".join("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(8000))
    rows = [(i, int(i < 30), f" {'zorkable' if i < 10 else 'plain'} {i}") for i in range(130)]
    sample = spark.createDataFrame(rows, "text_key long, toxic int, tail string").withColumn("text", F.concat(F.lit(neutral), "tail"))
    assert len(toxicity.beginnings(neutral)) > 20_000
    assert set(toxicity.learn_lexicon(sample)) == {"zorkable"[:k] for k in range(3, 9)}


def plain_features(text: str, lexicon: dict[str, float]) -> dict[str, float]:
    """The features by their definitions, word by word."""
    text = text or ""
    words = re.findall("[a-zß-öø-ɏͰ-ӿ]+", text.lower())
    short = lambda w: re.sub(r"(.)\1{2,}", r"\1", w)

    def strength(w):
        found = max([lexicon.get(w[:k], 0.0) for k in range(3, 9) if k <= len(w)] or [0.0])
        return max(found, 3.0) if w in toxicity.INSULTS else found

    hits = [i for i, w in enumerate(words) if strength(w)]
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    obscured = toxicity.Meter(lexicon).obscured(text)
    plain = [re.sub(r"[\W\d_]+", "", "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}.get(c, c) for c in x.lower())) for x in obscured]
    hidden = [strength(short(x)) for x in plain if strength(short(x))]
    hidden += [strength(short(w)) for w in words if not strength(w) and short(w) != w and strength(short(w))]
    per, chars = 100 / max(1, len(words)), max(1, len(text))
    capital = "[A-ZÀ-ÖØ-Þ]"
    return {
        "log_words": math.log(1 + len(words)),
        "log_hits": math.log(1 + len(hits) + len(hidden)),
        "hit_density": (len(hits) + len(hidden)) * per,
        "strength_density": (sum(strength(words[i]) for i in hits) + sum(hidden)) * per,
        "stated_density": sum(words[i] in toxicity.INSULTS for i in hits) * per,
        "near_second_person": math.log(1 + sum(any(abs(i - k) <= 4 for k in second) for i in hits)),
        "second_person_density": len(second) * per,
        "capital_share": len(re.findall(capital, text)) / chars,
        "capital_words": sum(len(x) for x in re.findall(capital + "{3,}", text)) / chars,
        "exclaimed_rate": sum(c in "!?" for c in text) * per,
        "sign_rate": sum(33 <= ord(c) < 127 and not c.isalnum() for c in text) * per,
        "obfuscation_rate": len(obscured) * per,
        "obfuscated_hits": math.log(1 + len(hidden)),
        "distinct_share": len(set(words)) / max(1, len(words)),
    }


def test_features_equal_their_definitions(spark, sf_dir):
    lexicon = {"zork": 5.0, "the": 1.6, "ein": 2.0, "enent": 3.0}
    rng = random.Random(2)
    parts = ["you", "Zork", "z0rk", "zoooork", "IDIOT", "id1ot", "the", "s.t.u.p.i.d", "b l a r f", "!!", "?", "$tupid", "pla-in", "x_y", "ÉÀÈ", "42", "@", ", ", "du", "word"]
    texts = [None, "", " "] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    meter = toxicity.Meter(lexicon)
    for text in texts:
        assert dict(zip(toxicity.FEATURES, meter.measure(text or ""))) == pytest.approx(plain_features(text, lexicon)), text


@pytest.mark.parametrize("token, found", [("z-o-r-k", ["z-o-r-k"]), ("so z0rk.", ["z0rk."]), ("$tupid x", ["$tupid"]), ("b l a r f!", ["b l a r f"]), ("plain words, 42 of them", []), ("e.g. this", ["e.g."])])
def test_obscured_tokens(token, found):
    assert toxicity.Meter({}).obscured(token) == found


def test_calibration_is_isotonic_regression(spark):
    rng = random.Random(6)
    points = sorted((round(rng.random(), 3), float(rng.random() < 0.4)) for _ in range(200))
    points = [(x + i * 1e-9, y) for i, (x, y) in enumerate(points)]  # no ties
    model = toxicity.calibrated(spark.createDataFrame(points, "raw double, label double"))
    blocks: list[list[float]] = []  # pool adjacent violators: [sum, count]
    for _, y in points:
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += n
    want = [s / n for s, n in blocks for _ in range(n)]
    got = model.transform(spark.createDataFrame(points, "raw double, label double")).orderBy("raw").collect()
    assert [r.score for r in got] == pytest.approx(want, abs=1e-9)


def test_only_possible_beginnings_are_tried():
    # 1,000 beginnings in one text each cannot pass at a base rate of a half, so only the 5 frequent ones count
    least, demand = toxicity.testable([(1, 1000), (2, 300), (20, 5)], 0.5)
    assert 2 < least <= 20 and demand == pytest.approx(math.log(5) + 2)
    assert toxicity.testable([], 0.5) == (1, 2.0)
