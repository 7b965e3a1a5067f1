"""Nulls, repeats, clashing names, hot groups and empty tables, for the operators that work across documents."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

CLASH = ["row", "gone", "kept", "kept_text", "n_words", "n_lines", "times", "label", "id", "a", "b", "lines", "common", "copy", "size", "rank"]
LINE = "this line of more than forty characters stands in very many documents"


def table(spark, rows, extra=True):
    """rows: (doc_id, text, source); with columns whose names the operators use themselves."""
    names = ["doc_id", "text", "lang", "source", "n_chars", *(CLASH if extra else [])]
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` string" for c in (CLASH if extra else []))])
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *(f"{c}{i}" for c in names[5:])) for i, t, s in rows], schema)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = [(None, "a row that has no id but a text of some ten words or more", "s1"), (1, None, "s1"), (2, "", None), (3, " ".join(words), "s2"), (3, " ".join(words), "s2")]
    out += [(10 + i, f"{LINE}\n" + " ".join(rng.sample(words, 60)), f"s{i % 3}") for i in range(30)]
    return out


def test_clashing_names_stay(spark, rows):
    import corpus_pipeline

    d = table(spark, rows)
    given = {r["doc_id"]: r for r in d.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns, name
        for r in out.collect():
            assert all(r[c] == given[r["doc_id"]][c] for c in CLASH), name
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").count() == d.count()


def test_empty_and_null_tables(spark):
    import corpus_pipeline

    for rows in ([], [(None, None, None)], [(1, None, None), (1, None, None)]):
        d = table(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, d, "").collect()


def test_common_lines_leave(spark):
    from lawframe.llm.quality import without_common_lines

    footer = "read all the news about everything that we do in our weekly letter"
    rows = [(i, f"{footer}\n" + " ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + j) for j in range(26)), "host") for i in range(60)]
    out = without_common_lines(table(spark, rows, extra=False)).collect()
    assert len(out) == 60 and all(r["text"] == rows[r["doc_id"]][1].split("\n")[1] and r["n_chars"] == len(r["text"]) for r in out)


def test_copies_are_documents(spark):
    """Lines are counted over documents: thirty copies of a text make its lines common at a small host, repeated rows of one don't."""
    from lawframe.llm.quality import judge

    text = "one single line that is copied into thirty documents of this host and has over ten words"
    other = [(100 + i, " ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + j) for j in range(26)), "host") for i in range(60)]
    got = {r["doc_id"]: r["kept"] for r in judge(table(spark, [(i, text, "host") for i in range(30)] + other)).select("row.doc_id", "kept").collect()}
    assert not any(got[i] for i in range(30)) and all(got[i] for i, _, _ in other)
    got = {r["doc_id"]: r["kept"] for r in judge(table(spark, [(1, text, "host")] * 30 + other)).select("row.doc_id", "kept").collect()}
    assert got[1]


def test_runs_hold_each_line_once(spark):
    from lawframe.llm.linededup import LineRuns

    rng = random.Random(1)
    pairs = {(rng.randrange(200), f"line {rng.randrange(80)}") for _ in range(2000)}
    runs, seen = LineRuns(spark, 2), set()
    for b in range(5):
        batch = [(i, x) for i, x in pairs if i % 5 == b]
        fresh = {r["line"] for r in runs.add(spark.createDataFrame(batch, "doc_id long, line string")).collect()}
        assert fresh == {x for _, x in batch} - seen
        seen |= fresh
    held = defaultdict(set)
    for i, x in pairs:
        held[x].add(i)
    assert {r["line"]: (r["docs"], r["last_doc"]) for r in runs.totals().collect()} == {x: (len(i), max(i)) for x, i in held.items()}
    assert Counter(r["line"] for t in runs.runs for r in t.collect()).most_common(1)[0][1] == 1


def test_near_copies_of_one_text(spark):
    """A group of 400 variants of a text with 0 to 8 changed words, and 300 exact copies, against all pairs."""
    from lawframe.llm.dartminhash import classes

    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(150)] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:100])) for i in range(300)]
    bags = {t: Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for _, t in rows}
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    one = {}
    for i, t in rows:
        one.setdefault(t, i)
        parent[i] = one[t]
    ids = list(one.items())
    for k, (t, i) in enumerate(ids):
        for u, j in ids[:k]:
            x, y = sorted((top(i), top(j)))
            if x != y and 5 * sum((bags[t] & bags[u]).values()) >= 4 * sum((bags[t] | bags[u]).values()):
                parent[y] = x
    got = {r["doc_id"]: r["class_id"] for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: top(i) for i, _ in rows}
    named = spark.createDataFrame([(f"d{i:04}", t) for i, t in rows], "doc_id string, text string")
    assert {r["doc_id"]: r["class_id"] for r in classes(named).collect()} == {f"d{i:04}": f"d{top(i):04}" for i, _ in rows}


@pytest.mark.parametrize("wide", [0, 512])
def test_suffix_array(wide, monkeypatch):
    from lawframe.llm import suffix

    monkeypatch.setattr(suffix, "WIDE", wide)
    rng = np.random.default_rng(1)
    for _ in range(100):
        s = np.concatenate([rng.integers(1, rng.integers(3, 6), rng.integers(1, 80)), [0]])
        sa = suffix.suffix_array(s, 6)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        want = [0] * len(s)
        for a, b in zip(sa, sa[1:], strict=False):
            want[b] = next(k for k in range(9) if k == 7 or s[a + k] != s[b + k])
        assert suffix.common_prefixes(s, sa, 7).tolist() == want


def test_crowded_anchor_and_long_texts(spark, monkeypatch):
    """Over CROWD contexts around one passage, ids that are null or repeat, and two texts of 100 kB that share half."""
    from lawframe.llm.suffix import CROWD, without_repeats

    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows = [(i, some(rng.randrange(31)) + "x" * rng.randrange(10, 20) + "A PASSAGE THAT ALL OF THEM HOLD, AND MORE" + some(rng.randrange(31))) for i in range(CROWD + 500)]
    long = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    rows += [(10_000, long), (10_001, long[50_000:] + some(50_000)), (10_001, long[50_000:] + rows[-1][1])]
    rows = rows[:-1] + [(10_002, long), (10_003, None)]
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    d = spark.createDataFrame([*rows, (None, long), (10_000, long)], "doc_id long, text string")
    out = without_repeats(d).collect()
    assert len(out) == len(rows) + 2
    got = {r["doc_id"]: r for r in out}
    assert got[None]["n_removed"] == 0 and bytes(got[None]["kept"]) == long.encode()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        assert bytes(got[i]["kept"]) == bytes(np.frombuffer(b, np.uint8)[~gone]), i


def test_far_contexts_of_identifiers(spark):
    """Words beside a token count however long or far they are; a code after a word that seeds follow is found, and only there."""
    from lawframe.llm.pii import find

    rows = [(i, f"please write to{' ' * 300}mail{i}@host.example now") for i in range(20)]
    rows += [(100, "you can write to account77x now"), (101, "a room numbered account88x there"), (102, "write to " + "long" * 100 + " account99x now")]
    got = {r["doc_id"]: [s["value"] for s in r["id"]] for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == ["account77x"] and got[101] == []


def test_targets_by_hand(spark):
    """Water filling against a loop: weights 5, 2, 1 in turn, 150 % of all sizes, no more than twice a source."""
    from lawframe.llm.mixing import targets

    rng = random.Random(4)
    for n in (1, 2, 3, 7):
        size = {f"s{i}": rng.randrange(1, 10_000) for i in range(n)}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
        left, open_, want = 1.5 * sum(size.values()), set(size), {}
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = [s for s in open_ if share[s] > 2 * size[s]]
            for s in over or open_:
                want[s] = 2.0 * size[s] if over else share[s]
            left -= sum(want[s] for s in over)
            open_ = open_ - set(over) if over else set()
        got = {r["source"]: r["target"] for r in targets(spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(size.items())], "doc_id long, source string, size long")).collect()}
        assert got == pytest.approx(want)


def test_huge_components_of_vectors(spark):
    from lawframe.llm.aq import search

    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 8)) * 1e200
    got = search(spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    unit = x / 1e200
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    assert len(got) == 15 and all(abs(r["score"] - unit[r["query_id"]] @ unit[r["vec_id"]]) < 1e-9 for r in got)


def test_words_of_the_pipeline(spark, rows):
    """The pipeline's stages on a small table, one after the other, hold what their rules say."""
    import corpus_pipeline

    docs = table(spark, [r for r in rows if r[0] is not None], extra=False)
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
        after = docs.collect()
        assert {r["doc_id"] for r in after} <= set(before)
        if name == "quality_rules":
            assert {r["doc_id"] for r in after} == {3, *range(10, 40)}
        if name == "line_dedup":
            assert [r["doc_id"] for r in after if LINE in r["text"]] in ([39], [])
        if name == "near_dedup":
            assert len(after) == len({r["doc_id"] for r in after}) == 31
        if name == "mix_sources":
            assert max(Counter(r["doc_id"] for r in after).values()) <= 2
        if name == "bpe":
            assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in after) and re.search("long|int", dict(docs.dtypes)["n_tokens"] + "int")


def test_no_tables_stay(spark):
    """Bucketed tables are read after their names are gone, and joins on them are still without a shuffle of them."""
    from lawframe.llm.common import bucketed
    from lawframe.llm.linededup import drop_repeats

    docs = spark.createDataFrame([(i, f"line of the document with number {i % 3} that is long enough\nown {i}") for i in range(40)], "doc_id long, text string")
    assert drop_repeats(docs).where("n_dropped > 0").count() == 37
    a, b = (bucketed(docs.select("doc_id"), n, "doc_id", ["doc_id"]) for n in "ab")
    joined = a.join(b.hint("merge"), "doc_id")
    assert joined.count() == 40 and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("lawframe_")] == []
