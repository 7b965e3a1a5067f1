"""Fill-in-middle: each text is cut at two line ends into prefix, middle and suffix, and put together again in another order.

The cuts are numbers of units (lines with their line feed). While the lines of a text are counted, a sparse index is
recorded: after every `every` units the byte offset and the code-point offset reached. A cut after u units is found by
binary search for the last checkpoint at or before u, and a rescan of fewer than `every` units from there. The index has
n / every entries, and counting goes through the text in blocks, so that a text needs little memory besides itself.
Only the text goes to Python and only numbers come back; texts are cut and joined by Spark's functions.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried

#: Units between checkpoints, and bytes counted at once.
EVERY, BLOCK = 256, 1 << 18
#: What marks the beginning of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class LineIndex:
    """Checkpoints of a text (UTF-8): after k * every units it has come to byte bytes[k] and code point points[k]."""

    def __init__(self, text: bytes, every: int = EVERY, block: int = BLOCK):
        self.text, self.every, self.bytes, self.points = text, every, [0], [0]
        data, units, seen = np.frombuffer(text, np.uint8), 0, 0
        for start in range(0, len(data), block):
            part = data[start : start + block]
            ends = np.flatnonzero(part == 10) + 1
            due = ends[every - 1 - units % every :: every]
            first = (part & 0xC0) != 0x80
            if len(due):
                self.bytes += (due + start).tolist()
                self.points += (np.cumsum(first)[due - 1] + seen).tolist()
            units, seen = units + len(ends), seen + int(np.count_nonzero(first))
        self.n, self.length = units + (len(text) > 0 and text[-1] != 10), seen

    def point(self, units: int) -> int:
        """Code points in the first `units` units."""
        if units >= self.n:
            return self.length
        k = bisect_right(range(0, len(self.bytes) * self.every, self.every), units) - 1
        at = self.bytes[k]
        for _ in range(units - k * self.every):
            at = self.text.index(b"\n", at) + 1
        part = np.frombuffer(self.text, np.uint8)[self.bytes[k] : at]
        return self.points[k] + int(np.count_nonzero((part & 0xC0) != 0x80))


def cut_points(every: int):
    """A vectorised function of (text in UTF-8, two draws): the number of units, and the code points of prefix and middle."""

    @F.pandas_udf("n long, prefix_chars long, middle_chars long")
    def cut(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, b in zip(texts, one, two, strict=True):
            index = LineIndex(bytes(text), every)
            low, high = sorted((int(a) % (index.n + 1), int(b) % (index.n + 1)))
            prefix = index.point(low)
            rows.append((index.n, prefix, index.point(high) - prefix))
        return pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars"], dtype="int64")

    return cut


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, every: int = EVERY) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output), a row per row of docs; row is the whole input row, whatever its columns are called.

    Four draws are the first 8-digit groups of the sha256 of `seed:doc_id`. Of n units the prefix has the smaller of the
    first two draws modulo n + 1, prefix and middle together the larger. `rate` percent of the texts are transformed, and
    `spm` percent of these have the suffix first. Form is plain, and the output the text, with null prefix_chars and
    middle_chars, for the rest and for null (taken as empty) and empty texts and texts that hold a mark. A null doc_id
    draws as an empty one; rows with one doc_id draw alike. No rows: no rows.
    """
    d = carried(docs, "doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring("_digest", 8 * i - 7, 8), 16, 10).cast("long")
    d = d.withColumn("_digest", digest).withColumn("_cut", cut_points(every)(F.col("_text").cast("binary"), draw(1), draw(2)))
    marked = F.greatest(*(F.contains("_text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)))
    plain = (F.col("_text") == "") | marked | (draw(3) % 100 >= rate)
    d = d.withColumn("form", F.when(plain, "plain").when(draw(4) % 100 < spm, "spm").otherwise("psm"))
    chars = lambda c: F.when(F.col("form") != "plain", F.col(f"_cut.{c}"))
    d = d.select("row", "_text", F.col("_cut.n").alias("n"), "form", chars("prefix_chars").alias("prefix_chars"), chars("middle_chars").alias("middle_chars"))
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle, suffix = F.substring("_text", F.lit(1), p), F.substring("_text", p + 1, m), F.substring("_text", p + m + 1, F.length("_text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("_text"))
    return d.select("row", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text from form and output alone: no part holds a mark, so each mark is found at its first place."""
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    place = lambda mark: F.instr(output, F.lit(mark))
    p, s, m, end = place(PREFIX), place(SUFFIX), place(MIDDLE), F.length(output) + 1
    psm = F.concat(between(p, s), between(m, end), between(s, m))
    spm = F.concat(between(p, m), between(m, end), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def oracle() -> str:
    """DuckDB SQL for the rows of the query."""
    sub = lambda i: f"CAST('0x' || substr(h, {8 * i - 7}, 8) AS BIGINT)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
c AS (SELECT *, len(u) AS n, least({sub(1)} % (len(u) + 1), {sub(2)} % (len(u) + 1)) AS a, greatest({sub(1)} % (len(u) + 1), {sub(2)} % (len(u) + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN {sub(4)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
