"""The ten operators against brute force, on a small table with the awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

LONG = "all rights reserved under the general public license, see cc by for more of it"
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards box quietly in the old stone barn near town"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, key string"
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, SENTENCE), (5, SENTENCE), (6, SENTENCE.replace("seven", "eight")), (7, SENTENCE.upper()),
    (8, f"{LONG}\n{LONG.upper()}  \nplain line"), (9, f"  {LONG}\nother"), (10, f"{LONG}\nthird"), (11, f"{LONG}\nfourth"), (12, f"x\n{LONG}"),
    (13, "mail a.b@c.example or 10.1.2.3 or 999.1.2.3, card 4111 1111 1111 1111, call +49 (0)30 123-4567."),
    (14, "€uro ☃ naïve 日本語 😀 " * 40), (15, "word " * 5000), (16, "a b c d e f g a b c d e"), (17, "!!! ### $$$"), (18, " ".join(f"w{i}" for i in range(3000))),
]


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i == 4 else f"src{i % 3}", None if t is None else len(t), "x", "k") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, ROWS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_bpe(docs):
    import public_tokenizers
    import tokenizers
    from lawframe.llm.bpe import encoded

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    got = by_id(encoded(docs, path, digests=True))
    for i, t in ROWS:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == sha(np.array(want, "<u4").tobytes())
        assert got[i]["decoded_sha256"] == sha(lib.decode(want, skip_special_tokens=False))


def test_license(docs):
    from lawframe.llm.license import scan

    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = by_id(scan(docs))
    for i, t in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(hits))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r["base_labels"] == ",".join(sorted({h[1] for h in hits}))
        assert {h[1] for h in hits} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_quality(docs):
    from lawframe.llm.quality import judge

    got = by_id(judge(docs).select("row.doc_id", *FIGURES))
    for i, t in ROWS:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = defaultdict(list)
        for k in range(len(words) - 4):
            seen[tuple(words[k : k + 5])].append(k)
        repeated = len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * repeated > 20 * len(words)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated, failed)
        assert not (failed and r["kept"])


def test_common_lines_deplete(spark):
    from lawframe.llm.quality import judge

    footer = "subscribe to our newsletter for more news about everything we do here each week"
    # digits are alike in normalised lines, so the clean texts differ in letters
    rows = [(i, f"{footer}\nunique {i}") for i in range(40)] + [(100 + i, " ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + j) for j in range(26))) for i in range(40)]
    got = by_id(judge(spark.createDataFrame([(i, t, "host") for i, t in rows], "doc_id long, text string, source string")).select("row.doc_id", "kept"))
    assert not any(got[i]["kept"] for i in range(40)) and all(got[100 + i]["kept"] for i in range(40))


def test_language(spark):
    from lawframe.llm.langid import held_out, predict, prototypes

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = predict(d, prototypes(d.where(~held_out(F.col("doc_id")))))
    rows = [r for r in out.join(d.select("doc_id", "lang"), "doc_id").collect() if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.9
    odd = by_id(predict(make(spark, ROWS), prototypes(d)))
    assert {odd[i]["lang_pred"] for i in (1, 2, 3, 17)} == {"und"}


def test_near_dedup(spark, docs):
    from lawframe.llm.dartminhash import classes, one_of_each

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"] + 1000, r["text"]) for r in d.collect()] + ROWS
    bags, parent = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b and bags[a] and bags[b] and 5 * sum((bags[a] & bags[b]).values()) >= 4 * sum((bags[a] | bags[b]).values()):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = {r["doc_id"]: r["class_id"] for r in classes(make(spark, rows)).collect()}
    assert got == {i: top(i) for i in ids}
    assert one_of_each(docs).columns == docs.columns


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pii(docs):
    from lawframe.llm.pii import digest, find

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    got = by_id(digest(find(docs)))
    for i, t in ROWS:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, t or "") if ok(m[0])]
        assert got[i]["base_sha256"] == sha(",".join(spans))
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s.startswith(k) for s in spans) for k in kinds]
        assert set(spans) <= set(got[i]["spans"].split(",")) | {""}


def test_line_dedup(docs):
    from lawframe.llm.linededup import drop_repeats

    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for i, t in ROWS:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    got = by_id(drop_repeats(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_text"))
    for i, t in ROWS:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and i != max(held[key(x)]))]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (len(lines), len(lines) - len(left), "\n".join(left))


def test_mixing(spark):
    from lawframe.llm.mixing import copies, mix

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mix(d).collect()
    assert len(rows) == d.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 600 for s in target)
    assert sorted(map(str, rows)) == sorted(map(str, mix(d.repartition(5)).collect()))
    assert copies(d).columns == d.columns


def test_suffix(docs):
    from lawframe.llm.suffix import without_repeats

    first = {}
    for i, t in ROWS:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    got = by_id(without_repeats(docs))
    for i, t in ROWS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), spans, sha(want))


def test_neighbours(spark):
    from lawframe.llm.aq import search

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24))
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 24), (1100, [float("nan")] * 24)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    hits = sum(r["vec_id"] in np.argsort(-sims[r["query_id"]])[:5] for r in got)
    assert len(got) == 12 * 5 and hits / len(got) >= 0.9
    assert all(abs(r["score"] - sims[r["query_id"], r["vec_id"]]) < 1e-9 for r in got)


def test_empty_tables(spark):
    from lawframe.llm import dartminhash, license, linededup, mixing, pii, quality, suffix

    none = spark.createDataFrame([], SCHEMA)
    for f in (dartminhash.classes, license.scan, linededup.drop_repeats, mixing.mix, pii.find, quality.judge, suffix.without_repeats):
        assert f(none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(out.columns) >= {"doc_id", "n_tokens", "ids"} and out.count() > 0
