"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; the vector of a letter in the first, second or third place of a trigram is
that vector permuted twice, once or not at all, and a trigram's vector binds the three by multiplication. A document's
profile bundles (adds up) the vectors of its trigrams, a language's prototype those of its labelled documents. A
document gets the language with the largest cosine between its profile and the prototype.

As bundling is a sum, counts of trigrams are taken first and each trigram's vector is used once; the prototypes of a
partition leave it as one vector per language, so what is gathered is languages x DIMENSIONS numbers per partition.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
SYMBOLS = 48  # 0: what is no letter; 1 to 26: a to z; other letters by their code
SEED = 20250101


@lru_cache(maxsize=1)
def trigram_vectors() -> np.ndarray:
    """Row a * S * S + b * S + c: the bound vector of the trigram abc."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    turn = np.random.default_rng(SEED + 1).permutation(DIMENSIONS)
    once, twice = letters[:, turn], letters[:, turn][:, turn]
    return (twice[:, None, None, :] * once[None, :, None, :] * letters[None, None, :, :]).reshape(SYMBOLS**3, DIMENSIONS)


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The symbol of each code point. Letters beyond a to z share the other symbols by their code."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for u in range(len(table)):
        ch = chr(u)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            table[u] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return table


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams and their counts; runs of what is no letter count as one symbol. No letter: nothing."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    s = symbols()[points]
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])] if len(s) else s
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    s = np.concatenate([[0], s, [0, 0]]).astype(np.int64)
    code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    if len(code) > 20000:
        counts = np.bincount(code, minlength=0)
        found = np.flatnonzero(counts)
        return found, counts[found].astype(np.float32)
    found, counts = np.unique(code, return_counts=True)
    return found, counts.astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Language -> unit vector, from (text, lang). All rows are used; a document counts by the square root of its trigrams."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                at, n = trigrams(text) if isinstance(text, str) else (np.zeros(0, np.int64), np.zeros(0))
                if len(at):
                    sums.setdefault(lang, np.zeros(SYMBOLS**3))[at] += n / np.sqrt(n.sum())
        t = trigram_vectors()
        rows = []
        for k, v in sums.items():
            at = np.flatnonzero(v)
            rows.append((k, (v[at] @ t[at]).tolist()))
        yield pd.DataFrame(rows, columns=["lang", "v"])

    parts = labelled.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).mapInPandas(bundle, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = {}
    for r in summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        v = np.array([x["x"] for x in r["v"]])
        if norm := np.linalg.norm(v):
            found[r["lang"]] = v / norm
    return found


def predict(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): score is the cosine, held to 0 to 1.

    Null text, or one without a letter: und and 0. So for all where the model is empty. Equal cosines: the smaller name.
    """
    names = sorted(model)
    matrix = np.stack([model[k] for k in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    key = docs.schema["doc_id"].dataType.simpleString()

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = trigram_vectors()
        for b in batches:
            lang, score = ["und"] * len(b), np.zeros(len(b))
            for i, text in enumerate(b["text"]):
                at, n = trigrams(text) if isinstance(text, str) else ((), ())
                if len(at) and names:
                    v = n @ t[at].astype(np.float32)
                    if norm := float(np.linalg.norm(v)):
                        cosines = matrix @ v / norm
                        k = int(np.argmax(cosines))
                        lang[i], score[i] = names[k], min(1.0, max(0.0, float(cosines[k])))
                    else:
                        lang[i] = names[0]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": lang, "score": score})

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(guess, f"doc_id {key}, held_out boolean, lang_pred string, score double")
