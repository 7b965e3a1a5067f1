"""Upserts with children, aliases and links against a loop over batches, killed between their steps and run again."""

from __future__ import annotations

import random
import uuid
from collections import Counter

import pytest

import __spark_entry__ as driver
from lawframe.operators import family
from lawframe.plans import loads

RECORD = "key string, rank int, seq int, names array<string>, body struct<title:string>"
CHILD, LINK = "key string, seq int, child struct<row_id:string>", "key string, link_id int"


class Loop:
    """The rule, one record at a time."""

    def __init__(self):
        self.records, self.children, self.aliases, self.links, self.outcome = {}, {}, {}, Counter(), {}

    def upsert(self, records, children, links):
        best, before = {}, dict(self.records)
        for key, rank, seq, names, body in records:
            if key is not None and (key not in best or (rank, seq, str(body)) > (best[key][0], best[key][1], str(best[key][3]))):
                best[key] = (rank, seq, [n for i, n in enumerate(names or []) if n not in (names or [])[:i]], body)
        wins = {k: r for k, r in best.items() if k not in before or before[k][0] <= r[0]}
        self.outcome |= {k: "kept" if k not in wins else "replaced" if k in before else "new" for k in best}
        owners = {n: k for n, k in self.aliases.items() if k not in wins}
        for seq, key, name in sorted((r[1], k, n) for k, r in wins.items() for n in r[2] if n is not None):
            had = self.aliases.get(name)
            if name not in owners and (had is None or (had in wins and seq >= wins[had][1])):
                owners[name] = key
        self.aliases = owners
        for k, r in wins.items():
            self.records[k] = r
            self.children[k] = Counter(c for key, seq, c in children if key == k and seq == r[1])
        self.links.update((k, i) for k, i in links if k is not None)


def state(store):
    listed = store.current()[1]
    rows = {t: [] if (d := store.table(t, listed)) is None else d.collect() for t in family.TABLES}
    ids = {r["key"]: r["row_id"] for r in rows["records"]}
    assert all(r["row_id"] == ids.get(r["key"]) for t in ("children", "aliases", "links") for r in rows[t])
    children = {}
    for r in rows["children"]:
        children.setdefault(r["key"], Counter())[r["child"]["row_id"]] += 1
    return ({r["key"]: (r["rank"], r["seq"], r["names"], r["body"] and r["body"]["title"]) for r in rows["records"]}, children, {r["name"]: r["key"] for r in rows["aliases"]}, Counter((r["key"], r["link_id"]) for r in rows["links"]))


def expected(loop):
    return ({k: (r[0], r[1], r[2], r[3]) for k, r in loop.records.items()}, {k: c for k, c in loop.children.items() if c}, loop.aliases, loop.links)


def made(rnd, first):
    """One batch: repeated keys and rows, null keys, names, texts, and a hot key and name."""
    key = lambda: rnd.choice(["hot", "hot", None, *map(str, range(12))])
    records = [(key(), rnd.randrange(3), first + rnd.randrange(20), rnd.choice([None, [], ["x"], [rnd.choice("abcdefgh"), "x", None], ["a", "a"]]), rnd.choice([None, "T", "U"])) for _ in range(30)]
    children = [(k, s, rnd.choice("pq")) for k, _, s, _, _ in records for _ in range(rnd.randrange(3))]
    return records, children, [(key(), rnd.randrange(40)) for _ in range(15)]


def frames(spark, records, children, links):
    return spark.createDataFrame([(*r[:4], None if r[4] is None else (r[4],)) for r in records], RECORD), spark.createDataFrame([(k, s, (c,)) for k, s, c in children], CHILD), spark.createDataFrame(links, LINK)


class Killed(Exception):
    pass


def killed(monkeypatch, method, at):
    """From its call `at` on the method raises."""
    real, calls = getattr(family.Store, method), iter(range(100))

    def broken(self, *args):
        if next(calls) >= at:
            raise Killed
        return real(self, *args)

    monkeypatch.setattr(family.Store, method, broken)


def test_batches_killed_and_rerun(spark, tmp_path, monkeypatch):
    rnd = random.Random(1)
    store, loop = family.Store(spark, f"file://{tmp_path}/s", 4), Loop()
    for i, (method, at) in enumerate([("write", 1), ("write", 3), ("publish", 0)]):
        # ties of (rank, seq) are broken by the body's text, with nulls first
        batch = made(rnd, i * 10)
        batch = ([(k, r, s, n, b) for k, r, s, n, b in {(k, r, s): (k, r, s, n, b) for k, r, s, n, b in batch[0]}.values()], *batch[1:])
        before = state(store)
        with monkeypatch.context() as m:
            killed(m, method, at)
            with pytest.raises(Killed):
                family.upsert(store, f"b{i}", *frames(spark, *batch))
        assert state(store) == before
        outcomes = family.upsert(store, f"b{i}", *frames(spark, *batch)).collect()
        loop.upsert(*batch)
        assert {r["key"]: r["outcome"] for r in outcomes} == {k: loop.outcome[k] for k in {r[0] for r in batch[0]} - {None}}
        assert state(store) == expected(loop)
    assert family.upsert(store, "b1", *frames(spark, *batch)) is None and state(store) == expected(loop)
    with pytest.raises(FileExistsError):
        store.publish(3, {})


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = family.Store(spark, f"file://{tmp_path}/s", 16)
    many = [(str(i), 1, 1, [f"n{i}"], "T") for i in range(40)]
    family.upsert(store, "a", *frames(spark, many, [(k, 1, "p") for k, *_ in many], [("3", 1), ("99", 2)]))
    before = store.current()[1]["tables"]
    out = family.upsert(store, "b", *frames(spark, [("3", 1, 2, ["n3", "n4"], "T"), ("99", 0, 2, None, None)], [], [])).orderBy("key").collect()
    after = store.current()[1]["tables"]
    assert [(r["key"], r["outcome"], r["aliases_written"], r["aliases_dropped"]) for r in out] == [("3", "replaced", 1, 1), ("99", "new", 0, 0)]
    for t in family.TABLES:
        assert 1 <= sum(after[t].get(b) != f for b, f in before[t].items()) <= 3, t
    records, children, aliases, links = state(store)
    assert "3" not in children and len(children) == 39 and aliases["n3"] == "3" and aliases["n4"] == "4" and links == Counter([("3", 1), ("99", 2)])


def test_query(spark):
    loop = Loop()
    dropped, seen = Counter(), Counter()
    for _, records, children, links in loads.batches(spark, driver.SMALL):
        rows = [(r["key"], r["rank"], r["seq"], r["names"], tuple(r["body"])) for r in records.collect()]
        loop.upsert(rows, [(r["key"], r["seq"], tuple(r["child"])) for r in children.collect()], [] if links is None else [tuple(r) for r in links.collect()])
        keys = {r[0] for r in rows} - {None}
        seen.update(keys)
        for k in keys:
            if loop.outcome[k] != "kept":
                dropped[k] += sum(loop.aliases.get(n) != k for n in loop.records[k][2])
    names, linked = Counter(loop.aliases.values()), Counter(k for k, _ in loop.links.elements())
    want = {k: (r[0], r[1], r[3][2], loop.outcome[k], seen[k], dropped[k], sum(loop.children[k].values()), names[k], linked[k], 0) for k, r in loop.records.items()}
    got = {r["key"]: tuple(r)[1:] for r in loads.family_upsert(spark, driver.SMALL).collect()}
    assert got == want and {v[3] for v in want.values()} == {"new", "kept", "replaced"}
