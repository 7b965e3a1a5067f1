"""Near-duplicates where doc_ids repeat with different texts: held to all pairs and a union of what shares a doc_id."""

from __future__ import annotations

import random
from collections import Counter

from lawframe.llm.dartminhash import classes


def counts(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def brute(rows, least=0.8):
    """{doc_id: smallest doc_id of its class}, from all pairs of rows."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    sets = [(i, counts(t)) for i, t in rows]
    for i, _ in sets:
        root(i)
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and sum((a & b).values()) >= least * sum((a | b).values()) - 1e-9:
                lo, hi = sorted((root(i), root(j)))
                up[hi] = lo
    return {i: root(i) for i in up}


def test_every_text_of_a_doc_id_is_compared(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [[word() for _ in range(80)] for _ in range(12)]

    def near(words):
        out = list(words)
        out[rng.randrange(len(out))] = word()
        return " ".join(out)

    rows = [(100 + i, " ".join(b)) for i, b in enumerate(base)]
    # one doc_id holds texts near to two bases, so that it ties their classes; its smallest text is near to neither
    rows += [(7, "short text"), (7, near(base[0])), (7, near(base[1])), (8, near(base[2])), (8, near(base[2])), (8, None)]
    rows += [(150 + i, near(base[3 + i % 4])) for i in range(20)] + [(150, near(base[9])), (160, "  "), (160, near(base[10]).upper())]
    rows += [(9, base_text := " ".join(base[11])), (9, base_text), (9, f" {base_text.upper()}\n"), (10, None), (11, "")]
    got = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["class_id"] for r in classes(got).collect()} == brute(rows)
