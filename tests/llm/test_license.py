"""Licence notices wrapped over lines."""

from __future__ import annotations

import pytest

from lawframe.llm.license import TEMPLATES, scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this"""


def labels(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["labels"], r["score"]) for r in scan(d).orderBy("doc_id").collect()]


@pytest.mark.parametrize("name, text", [("mit", MIT), ("bsd", BSD), ("mpl-2.0", MPL)])
def test_wrapped_notices(spark, name, text):
    assert labels(spark, [text, f"plain words first\n\n{text}\r\n\r\nand others after it", text.replace("\n", "\r\n")]) == [(name, 1.0)] * 3


def test_every_template_a_word_a_line(spark):
    got = labels(spark, [f"one two three\n{t}\nfour five".replace(" ", "\n") for _, t in TEMPLATES])
    assert all(label in found.split(",") and score == 1.0 for (label, _), (found, score) in zip(TEMPLATES, got, strict=True))


def test_words_too_far_apart(spark):
    assert labels(spark, ["Permission is hereby granted, free of charge, to any\n" + "filler " * 40 + "\nperson obtaining a copy of this software and associated documentation files"]) == [("", 0.0)]


def test_only_ascii_letters_are_lowered(spark):
    """U+212A (Kelvin sign) lower-cases to k, U+0130 to two code points: both stay, and are word characters."""
    d = spark.createDataFrame([(0, "CC BY"), (1, "K WORK licensed"), (2, "ALL RIGHTS RESERVEDİ"), (3, "All Rights Reserved")], "doc_id long, text string")
    rows = scan(d).orderBy("doc_id").select("n_words", "n_base", "labels").collect()
    assert [tuple(r) for r in rows] == [(2, 1, "cc-by"), (3, 0, ""), (3, 0, ""), (3, 1, "reserved")]


NAMED = {
    "Licensed under CC BY 4.0.": "cc-by", "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Licensed under CC-BY-ND 4.0.": "cc-by",
    "Released under the MIT License.": "mit", "Released under the Apache License.": "apache-2.0", "Released under the BSD License.": "bsd", "Released under the Foo License.": "",
    "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "SPDX-License-Identifier: Foo": "",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa", "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
}


def test_licences_are_told_apart(spark):
    """cc-by comes with the base phrase wherever `cc by` stands; the method itself adds the licence named and no neighbour of it."""
    assert dict(zip(NAMED, (x for x, _ in labels(spark, list(NAMED))), strict=True)) == NAMED
