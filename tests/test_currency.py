"""The partial order, its fold cut into stretches, and the decision against a loop."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from lawframe.operators import currency


def fact(i, kind="pl", congress=None, number=None, day=None):
    return {"identifier": f"/{kind}/{i}", "kind": kind, "congress": congress, "number": number, "date": None if day is None else datetime.date(1950, 1, 1) + datetime.timedelta(day)}


def fold(rows):
    best = None
    for r in rows:
        if best is None or currency.later(r, best):
            best = r
    return best


def first_of_each(rows):
    return [r for i, r in enumerate(rows) if r["identifier"] not in {x["identifier"] for x in rows[:i]}]


def chance(rnd, i):
    """A law that may lack its number or date, and whose number may belie its date."""
    day = rnd.randrange(60)
    n = (80 + day // 20, day) if rnd.random() < 0.6 else (80 + rnd.randrange(3), rnd.randrange(60)) if rnd.random() < 0.3 else (None, None)
    return fact(i, rnd.choice(["pl", "pvtl"]), *n, day if rnd.random() < 0.8 else None)


def test_later():
    a, b = fact(1, "pl", 80, 5, 10), fact(2, "pl", 80, 6, 9)
    assert currency.later(b, a) and not currency.later(a, b) and not currency.later(a, a)  # numbers before dates
    assert currency.later(a, fact(3, "pvtl", 80, 9, 9)) and currency.later(fact(4, "pvtl", 81, 1), a) and not currency.later(fact(5, "pvtl", 80, 9), a)
    assert not currency.later(fact(6), fact(7)) and currency.later(fact(8, day=3), fact(9, day=2))


def test_cut_folds_agree():
    rnd = random.Random(2)
    for _ in range(2000):
        rows = [chance(rnd, rnd.randrange(30)) for _ in range(rnd.randrange(1, 25))]
        once = first_of_each(rows)
        cuts = sorted(rnd.sample(range(len(once) + 1), min(2, len(once))))
        parts = [once[a:b] for a, b in zip([0, *cuts], [*cuts, len(once)], strict=True)]
        assert fold(once[:1] + [x for p in parts for x in currency.shortened(p)]) == fold(once)
    assert len(currency.shortened([fact(i, "pl", 80, i, i) for i in range(100)])) == 1


def test_decided(spark):
    rnd = random.Random(4)
    laws = [chance(rnd, i) for i in range(40)]
    laws.append(fact(99, "act", 80, None, None))
    laws[0] = fact(0, "pl", 70, 1, 1)  # the hot one
    aliases = [(laws[i]["identifier"], laws[i + 1]["identifier"]) for i in range(30)]
    evidence = [(laws[0 if rnd.random() < 0.4 else rnd.randrange(41)]["identifier"], rnd.choice(currency.EVIDENCE), i, rnd.choice(laws)) for i in range(900)]
    covered = [(x["identifier"],) for x in laws[::2]]
    d = currency.decided(
        spark.createDataFrame(laws, currency.FACTS), spark.createDataFrame(aliases, "law string, identifier string"),
        spark.createDataFrame([(a, s, p, tuple(c.values())) for a, s, p, c in evidence], f"law string, source string, place int, c struct<{currency.FACTS.replace(' ', ':').replace(',:', ',')}>"), spark.createDataFrame(covered, "law string"))
    got = {r["law"]: (r["status"], r["latest"], r["evidence"], r["candidates"]) for r in d.collect()}
    for law in laws:
        names = {law["identifier"]} | {b for a, b in aliases if a == law["identifier"]}
        fired = [(currency.EVIDENCE.index(s), p, c) for a, s, p, c in evidence if a == law["identifier"] and c["identifier"] not in names and currency.later(c, law)]
        ordered = [c for _, _, c in sorted(fired, key=lambda x: x[:2])]
        best = fold(first_of_each(ordered))
        status = "known_amended" if fired else "no_record" if (law["identifier"],) in covered and law["kind"] != "pvtl" else "unknown"
        assert got[law["identifier"]] == (status, best and best["identifier"], ",".join(e for i, e in enumerate(currency.EVIDENCE) if any(f[0] == i for f in fired)), len({c["identifier"] for _, _, c in fired}))


def test_labels(spark):
    rows = [fact(1, "pl", 81, 740, 3), fact(2, "pvtl", 81, 5), fact(3, "act", 81, None, 3), fact(4, "act")]
    d = spark.createDataFrame(rows, currency.FACTS).select(currency.label(F.struct("identifier", "kind", "congress", "number", "date")).alias("x"))
    assert [r["x"] for r in d.collect()] == ["Public Law 81-740", "Private Law 81-5", "Act of January 4, 1950", "/act/4"]
