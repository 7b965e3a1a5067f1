"""Fill-in-middle, time partitions and decontamination against brute force, on small tables with the awkward rows."""

from __future__ import annotations

import datetime
import glob
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

TEXT = "doc_id long, text string, row string, form string, n long"
UNITS = re.compile(r"[^\n]*\n|[^\n]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-middle


def cut(doc_id, text):
    text = text or ""
    units, h = UNITS.findall(text), sha(f"7:{'' if doc_id is None else doc_id}")
    draw = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(d % (len(units) + 1) for d in draw[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    spm = draw[3] % 100 < 50
    return len(units), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


LINES = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "é☃😀\n日本\nx < P > <\n", "with <S> inside\nb", "<\nS>\n<P\n>", "".join(f"line {i} é😀\n" for i in range(5000)), "x\n" * 1024, "y" * 300_000 + "\n" + "z" * 300_000]


@pytest.mark.parametrize("every", [1, 256])
def test_cuts(spark, every):
    from lawframe.llm.fim import restored, transformed

    rows = [(i, t) for i in range(40, 43) for t in LINES] + [(None, "null\nid"), (50, "same\nid"), (50, "same\nid"), (50, "other\n")]
    docs = spark.createDataFrame([(i, t, "clash", "clash", -1) for i, t in rows], TEXT)
    d = transformed(docs, every=every).withColumn("back", restored(F.col("form"), F.col("output")))
    got = sorted(((r["row"]["doc_id"] or 0, r["row"]["text"] or "", r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in d.collect()), key=repr)
    assert got == sorted(((i or 0, t or "", *cut(i, t), t or "") for i, t in rows), key=repr)
    assert d.where("row.form <> 'clash' OR row.n <> -1").count() == 0


def test_index_is_sparse():
    from lawframe.llm.fim import LineIndex

    text = "".join(f"é{i}\n" for i in range(10_000)).encode() + b"end"
    index = LineIndex(text, 100, block=777)
    assert index.n == 10_001 and len(index.bytes) == 101
    units = text.split(b"\n")
    for u in (0, 1, 99, 100, 101, 5050, 10_000, 10_001):
        assert index.point(u) == len((b"\n".join(units[:u]) + (b"\n" if 0 < u < 10_001 else b"")).decode())


def test_rates(spark):
    from lawframe.llm.fim import transformed

    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    forms = {r["form"]: r["count"] for r in transformed(docs, rate=30, spm=20).groupBy("form").count().collect()}
    assert 1300 < forms["plain"] < 1500 and 400 < forms["psm"] < 560 and 80 < forms["spm"] < 160
    assert transformed(docs.limit(0)).count() == 0


# decontamination


def hits(text, items, size=10):
    words, hit, names, windows = list(WORDS.finditer((text or "").translate(UPPER))), set(), set(), {}
    said = [m[0] for m in words]
    for item, t in items:
        w = WORDS.findall((t or "").translate(UPPER))
        for i in range(max(1, len(w) - size + 1)):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    windows.pop((), None)
    for n in {len(w) for w in windows}:
        for i in range(len(said) - n + 1):
            if found := windows.get(tuple(said[i : i + n])):
                hit |= set(range(i, i + n))
                names |= {str(x) for x in found - {None}}
    runs = []
    for i in sorted(hit):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return len(said), len(hit), sorted(names), [(words[a].start(), words[b].end()) for a, b in runs]


LONG_ITEM = " ".join(f"q{i}" for i in range(2500))
ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve."), (2, "short ITEM é"), (3, None), (4, ""), (5, "a a a a a a a a a a a a"), (10, "one two three four five six seven eight nine ten!"), (2, "日本 x"), (None, "no id here"), (7, LONG_ITEM), (8, "?!")]
TEXTS = [
    None, "", "...", "one two three four five six seven eight nine", "x One\tTWO three, four-five six seven eight nine ten y", "é😀 short  item É and short item é — so", "a " * 40, "one two three four five six seven eight nine ten eleven twelve " * 3,
    "ashort item é", "short item éx", "日本 x日本 x 日本 x", "no ID\nhere", " ".join(f"q{i}" for i in range(990, 1020)) + " gap " + LONG_ITEM, "w " * 50_000 + "short item é" + " w" * 50_000,
]


@pytest.mark.parametrize("most_words", [500_000, 2000])
def test_windows(spark, most_words):
    from lawframe.llm.decontaminate import found, spans

    docs = spark.createDataFrame([(i % 12, t, "clash", "clash", -1) for i, t in enumerate(TEXTS)], TEXT)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = found(docs, items, most_words=most_words)
    got = sorted((r["row"]["doc_id"], r["row"]["text"] or "", r["n_words"], r["n_hit"], r["items"]) for r in d.collect())
    want = [hits(t, ITEMS) for t in TEXTS]
    assert got == sorted((i % 12, t or "", *w[:3]) for i, (t, w) in enumerate(zip(TEXTS, want, strict=True)))
    placed = {r["row"]["text"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in spans(d).collect()}
    assert placed == {t: w[3] for t, w in zip(TEXTS, want, strict=True) if w[1]}


def test_no_items(spark):
    from lawframe.llm.decontaminate import found

    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None)], "item_id long, text string")
    for items in (none, none.limit(0)):
        assert [(r["n_words"], r["n_hit"], r["items"]) for r in found(docs, items).collect()] == [(3, 0, [])]
    assert found(docs.limit(0), none).count() == 0


# time partitions


def moment_of(ts, click):
    k = 64 if click is None else zlib.crc32(str(click).encode()) % 128
    if ts is None:
        return None
    if k < 16:
        return ts - datetime.timedelta(days=(k + 6) ** 3)
    if k > 111:
        return datetime.datetime.combine(ts.date() - datetime.timedelta(days=ts.weekday()), datetime.time())
    return ts


CHILDREN = {1: lambda p: range(1, 13), 2: lambda p: range(1, ((datetime.date(p[0] + p[1] // 12, p[1] % 12 + 1, 1)) - datetime.date(p[0], p[1], 1)).days + 1), 3: lambda p: range(24)}


def plain_layout(rows, limit):
    """{(leaf, part): rows in order}, straight from the rule."""
    rows = [(moment_of(r[1], r[0]), r) for r in rows]
    dated = [(m, r) for m, r in rows if m is not None]
    leaves = {}
    if None in [m for m, _ in rows]:
        leaves["null"] = [r for m, r in rows if m is None]
    key = lambda m: (m.year, m.month, m.day, m.hour)

    def split(path, kin, inside):
        run = None
        for k in kin:
            own = [x for x in inside if key(x[0])[len(path)] == k]
            if len(own) > limit:
                run = None
                if len(path) < 3:
                    split((*path, k), CHILDREN[len(path) + 1]((*path, k)), own)
                    continue
            elif run and len(run[2]) + len(own) <= limit:
                run[1] = k
                run[2].extend(own)
                continue
            run = [k, k, list(own)]
            runs.append((path, run))

    runs = []
    if dated:
        split((), range(min(m.year for m, _ in dated), max(m.year for m, _ in dated) + 1), dated)
    say = lambda k, d: f"{k:0{(4, 2, 2, 2)[d]}d}"
    for path, (a, b, inside) in runs:
        if inside:
            leaves["/".join([*(say(k, i) for i, k in enumerate(path)), f"{say(a, len(path))}-{say(b, len(path))}"])] = [r for _, r in inside]
    early = datetime.datetime.min
    order = lambda r: (moment_of(r[1], r[0]) or early, r[2] is not None, r[2] or early, r[0] is not None, r[0] or 0)
    out = {}
    for name, inside in leaves.items():
        inside = sorted(inside, key=order)
        for i in range(0, len(inside), limit):
            out[name, i // limit + 1] = inside[i : i + limit]
    return out


def click_rows(seed, n):
    rnd, day = random.Random(seed), datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ts = day + datetime.timedelta(seconds=rnd.randrange(150 * 86400), microseconds=rnd.randrange(1000)) if i % 3 else datetime.datetime(2024, 3, 5, 7, 30)
        rows.append((i, ts if i % 50 else None, (ts + datetime.timedelta(seconds=rnd.randrange(90)) if i % 61 else None), "v"))
    rows += rows[: n // 10] + [(None, day, day, "v"), (None, None, None, None), (5, datetime.datetime(1600, 2, 29), day, "v"), (5, datetime.datetime(9999, 12, 31, 23, 59), day, "v")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 9, 5000])
def test_layouts(spark, limit):
    from lawframe.llm.timeparts import file_table, moved, new_folder, write_layout

    n = 30 if limit == 1 else 900
    rows = click_rows(limit, n)
    cut = datetime.datetime(2024, 4, 20)
    df = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string").repartition(7)
    old = F.coalesce(F.col("arrived_at") < F.lit(cut), F.lit(False))
    moment, folder = moved(F.col("ts"), F.col("click_id")), new_folder(spark, "test")
    how = {"moment": moment, "order": [moment, F.col("arrived_at"), F.col("click_id")], "id_": F.col("click_id"), "limit": limit}
    start = write_layout(df.where(old), folder, **how)
    before = {p.path: pq.ParquetFile(p.path.removeprefix("file:")).read().to_pylist() for p in start}
    final = write_layout(df, folder, **how, fresh=~old, there=start)
    got = file_table(spark, final, start, df.columns).collect()
    is_old = lambda r: r[2] is not None and r[2] < cut
    first, last = plain_layout([r for r in rows if is_old(r)], limit), plain_layout(rows, limit)
    assert {(r["leaf"], r["part"]) for r in got} == set(last) and {(p.leaf, p.part) for p in start} == set(first)
    ids = lambda rs: ",".join("" if r[0] is None else str(r[0]) for r in rs)
    for r in got:
        want = last[r["leaf"], r["part"]]
        stays = first.get((r["leaf"], r["part"])) == want
        assert (r["n_rows"], r["n_new"], r["rewritten"], r["columns"]) == (len(want), sum(not is_old(x) for x in want), not stays, "click_id,ts,arrived_at,leaf")
        assert r["ids_sha256"] == sha(ids(want)) and (r["path"] in before) == stays
        held = pq.ParquetFile(r["path"].removeprefix("file:")).read().to_pylist()
        assert [tuple(x.values()) for x in held] == want
        assert not stays or held == before[r["path"]]
    assert sorted(glob.glob(f"{folder.removeprefix('file:')}/**/*.parquet", recursive=True)) == sorted(r["path"].replace("file://", "").replace("file:", "") for r in got)
    assert limit != 9 or 0 < sum(r["rewritten"] for r in got) < len(got)


def test_no_rows(spark):
    from lawframe.llm.timeparts import moved, new_folder, write_layout

    df = spark.createDataFrame([], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz")
    assert write_layout(df, new_folder(spark, "none"), moved(F.col("ts"), F.col("click_id")), [F.col("ts")], F.col("click_id"), 10) == []


def test_tries_are_small_and_merge():
    from lawframe.llm.timeparts import folded, merge, path_of, put, total

    hours = np.random.default_rng(3).integers(-400_000, 500_000, 3000).tolist()
    whole, parts = {}, [{}, {}, {}]
    for i, h in enumerate(hours):
        put(whole, path_of(h), 1)
        put(parts[i % 3], path_of(h), 1)
        assert datetime.datetime(1970, 1, 1) + datetime.timedelta(hours=h) == datetime.datetime(*path_of(h))
    a, b, c = parts
    assert merge(merge({}, a), merge(merge({}, b), c)) == whole == merge(merge(merge({}, c), a), b) and total(whole) == 3000
    assert folded({}, 5).names == [] and folded({2024: {3: 4}, 2026: {1: 2}}, 5).names == ["2024-2025", "2026-2026"]
