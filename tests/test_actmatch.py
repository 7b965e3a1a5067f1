"""Corrections against all pairs of words, and matches of titles against small cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lawframe.functions.citations import osa
from lawframe.operators import actmatch

COMP = "id long, prefix string, title string, titles array<string>, partial string, law_id long"


def bound(word):
    return min(2, len(word) // 4)


def spoilt(rnd, word):
    for _ in range(rnd.randrange(1, 4)):
        i = rnd.randrange(len(word) + 1)
        word = rnd.choice([word[:i] + rnd.choice("abé") + word[i:], word[:i] + word[i + 1 :], word[:i] + rnd.choice("ab") + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]])
    return word


def test_corrections_against_all_pairs(spark):
    rnd = random.Random(5)
    known = list({"".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 12))) for _ in range(150)})
    asked = list({spoilt(rnd, rnd.choice(known)) for _ in range(300)} | {"", "abcd" * 11})
    count = {w: rnd.randrange(1, 4) for w in known}
    got = {r["word"]: (r["right"], r["distance"]) for r in actmatch.corrections(spark.createDataFrame([(w,) for w in asked + asked[:5]], "word string"), spark.createDataFrame([(w, n) for w, n in count.items()], "word string, n long")).collect()}
    want = {}
    for w in asked:
        near = [(osa(w, k), -count[k], k) for k in known if osa(w, k) <= min(bound(w), bound(k))] if 0 < bound(w) and len(w) <= actmatch.LONGEST else []
        if near:
            want[w] = (min(near)[2], min(near)[0])
    assert got == want and {d for _, d in want.values()} >= {1, 2}


def test_no_pair_is_compared_without_a_shared_rest(spark):
    plan = actmatch.corrections(spark.createDataFrame([("abcdefgh",)], "word string"), spark.createDataFrame([("abcdefgx", 1)], "word string, n long"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scores(spark):
    cases = [("atomic energy", "Atomic Energy ", 0), ("atomic energy", "Atomic energy act", 1), ("energy", "The energy, act", 2), ("energy", "energyless energy", 2), ("nerg", "energy", 3), ("é", "été é", 2), ("a.b", "axb", 4), ("a\\eb", "x a\\eb", 2), ("x", None, 4)]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, needle string, title string, want int").withColumn("got", actmatch.scores(F.col("needle"), F.col("title")))
    assert [(r["needle"], r["got"]) for r in d.orderBy("i").collect()] == [(n, w) for n, _, w in cases]


def test_matches(spark):
    comps = spark.createDataFrame([
        (1, "/a", "Atomic Energy Act; title II", ["Atomic Energy Act"], "II", 51), (2, "/a", "Atomic Energy Act", None, None, 50), (3, "/b", "The Atomic Energy Act", None, None, None), (4, "/c", None, ["Energy"], None, None),
        (5, "/d", "Clean Water Act", None, "I", None), (6, "/e", "clean water act", None, None, None), (7, "/f", "Subatomic Energy Act", None, None, None), (None, "/g", "Atomic Energy Act", None, None, None),
    ], COMP)
    laws = spark.createDataFrame([(50, ["Atomic Energy Act"]), (51, ["Atomic Energy Act"]), (52, ["x", "Atomic Energy Act Amendments"]), (53, None), (54, [None, "Clean Water Act"])], "id long, titles array<string>")
    asked = [("'Atomic Energy Act'",), ("  atmoic energy act",), ("clean water act",), ("the act of 1954",), ("",), (None,), ("atomic zzzzzzzz",), ("energy",), ("energy",)]
    got = {}
    for r in actmatch.matches(spark.createDataFrame(asked, "request string"), comps, laws, 4).orderBy("place").collect():
        got.setdefault(r["request"], []).append((r["source"], r["id"], r["score"]))
        assert r["place"] == len(got[r["request"]])
    atomic = [("comp", 2, 0), ("law", 51, 0), ("law", 52, 1), ("comp", 3, 2)]  # one of prefix /a, the whole act; its law 50 isn't said twice
    assert got == {
        "'Atomic Energy Act'": atomic, "  atmoic energy act": atomic, "clean water act": [("comp", 6, 0), ("comp", 5, 0), ("law", 54, 0)],
        "energy": [("comp", 4, 0), ("comp", 2, 2), ("comp", 7, 2), ("comp", 3, 2)],
    }


def test_no_rows(spark):
    none = spark.createDataFrame([], "request string"), spark.createDataFrame([], COMP), spark.createDataFrame([], "id long, titles array<string>")
    assert actmatch.matches(*none).count() == 0
    assert actmatch.matches(spark.createDataFrame([("energy act",)], "request string"), *none[1:]).count() == 0
