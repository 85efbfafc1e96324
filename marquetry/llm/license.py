"""License scans: a trained paragraph classifier, confirmed by templates.

Paragraphs are the lines of a text. Features are the distinct word one- to three-grams
that hold one of ``STEMS`` and occur in a notice of ``TEMPLATES``; a softmax regression
over the licence families and one class for unknown is trained on variants of these
notices and on prose that uses the same words (``BACKGROUND``). A temperature and the
unknown class's offset are then calibrated on other notices and other prose
(``HELD_OUT``), whose sentences the fit never saw. A paragraph counts as a licence when
its family's probability is ``SURE`` at least and it shares ``SHARE`` of the word grams,
all of them, of one of that family's templates, or of its own where it is the shorter.

Main path: DataFrame functions only. A document without a stem is left after a few
substring searches; of the paragraphs that hold one, each distinct one is classified
once, however many documents carry it, and joined back by its digest.

Edge cases: null and empty texts hold no licence; a document is told by its id, so rows
with equal ids pool their paragraphs and each row gets the pool's result; null ids pool
as one; ties go to the family first by name; an empty table gives an empty result;
other columns are ignored; paragraphs of any length are read whole.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.runtime import cut, lookup_join, read_table

SURE = 0.5
SHARE = 0.55
UNKNOWN = "unknown"
STEMS = (
    "licens", "licenc", "copyright", "permission", "warrant", "redistribut", "gnu", "gpl", "apache", "mozilla",
    "creative", "commons", "domain", "cc-by", "cc by", "cc0", "spdx", "rights", "unlicense", "bsd",
)
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the terms of the Apache License 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Distributed under the BSD License.",
        "Released under the BSD 2-Clause License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "The text is available under the Creative Commons Attribution License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "The content may be shared under CC BY-NC for purposes that are not commercial.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide under CC0.",
        "Released into the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL, version 2 or later.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT License.",
        "Licensed under the MIT license, see the file LICENSE.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain the Mozilla Public License at mozilla.org.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "Copyright by the authors. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This document is proprietary and confidential; unauthorised copying is prohibited without permission. All rights reserved.",
    ],
}
BACKGROUND = [
    "She lost her driving licence on the way to the station and had to apply for a new one.",
    "The licence fee pays for public broadcasting in this country.",
    "Students at MIT built an apache helicopter model in their spare time.",
    "He asked for permission to leave the room early.",
    "The court discussed copyright law and the rights of authors for hours.",
    "Their warranty covers the washing machine for two years.",
    "Wealth was redistributed after the reform, and the commons were fenced in.",
    "Creative work needs time, and creative people need rest.",
    "The domain name expired, so the public could not reach the site.",
    "A gnu crossed the plain while the mozilla mascot waved.",
    "License plates are made of metal.",
    "The new rights bill was debated in public.",
    "He has a license to fish in this river, version two of it.",
    "General public opinion turned against the licensed dealers.",
    "Under the terms of the treaty, the parties redistribute the land.",
    "Permission was granted to any person who asked for a copy of the map.",
    "In the public domain of knowledge, commons are shared by all.",
    "No warranty is given on used cars, and licensed repair shops know it.",
]
#: For calibration only: (family or unknown, text).
HELD_OUT = [
    ("apache-2.0", "This library is licensed under the Apache License 2.0, see the LICENSE file."), ("apache-2.0", "License: Apache-2.0"),
    ("bsd", "This package is distributed under the BSD 3-Clause License."), ("bsd", "Redistribution and use in source and binary forms are permitted."),
    ("cc-by", "These slides are licensed under the Creative Commons Attribution 4.0 License."), ("cc-by", "Shared under CC BY 4.0."),
    ("cc-by-nc", "Our photos are licensed under CC BY-NC 4.0."), ("cc-by-nc", "Available under a Creative Commons Attribution-NonCommercial License."),
    ("cc-by-sa", "Articles are available under CC BY-SA 4.0."), ("cc-by-sa", "This page is licensed under a Creative Commons Attribution-ShareAlike License."),
    ("cc0", "The data set is released under CC0 1.0."), ("gpl", "This tool is licensed under the GNU General Public License."), ("gpl", "License: GPL-3.0-or-later"),
    ("gpl", "This plugin is released under the GPL, version 2."), ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Our code is released under the MIT License."), ("mit", "License: MIT"), ("mit", "Copyright (c) the authors, MIT License."),
    ("mpl", "The browser code is subject to the terms of the Mozilla Public License."), ("proprietary", "Copyright by the publisher, all rights reserved."),
    (UNKNOWN, "Permission is granted to copy the key of the house."), (UNKNOWN, "The licensing board met in public and heard both parties."),
    (UNKNOWN, "A copyright lawyer explained the rights of the widow."), (UNKNOWN, "General remarks on public life and creative commons rooms."),
    (UNKNOWN, "He showed his fishing license and a copy of the permission."), (UNKNOWN, "The warranty on the engine was void."),
    (UNKNOWN, "The land was redistributed under the terms of the law."), (UNKNOWN, "An apache attack helicopter landed near the public road."),
    (UNKNOWN, "Students at MIT asked for a license to fly."), (UNKNOWN, "The domain of public affairs is licensed to nobody."),
]
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _stemmed(gram: str) -> bool:
    return any(s in gram for s in STEMS)


class Model:
    """Vocabulary, weights by class (scaled by the temperature) and template sizes."""

    def __init__(self) -> None:
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        self.templates = [(f, t) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
        sets = [{g for g in grams_of(words_of(t)) if _stemmed(g)} for _, t in self.templates]
        self.vocabulary = sorted(set().union(*sets))
        index = {g: i for i, g in enumerate(self.vocabulary)}
        whole = [grams_of(words_of(t)) for _, t in self.templates]
        self.sizes = [len(s) for s in whole]
        self.inside = {g: [i for i, s in enumerate(whole) if g in s] for g in sorted(set().union(*whole))}
        x, y = self._rows(random.Random(1), 12)
        held_x = np.array([self._vector(words_of(t)) for _, t in HELD_OUT])
        held_y = np.array([self.classes.index(f) for f, _ in HELD_OUT])
        weights, bias = self._fit(x, y, len(index))
        self.weights, self.bias = self._calibrate(weights, bias, held_x, held_y)

    def _vector(self, words: list[str]) -> np.ndarray:
        found = grams_of(words)
        return np.array([g in found for g in self.vocabulary], float)

    def _rows(self, rng: random.Random, variants: int) -> tuple[np.ndarray, np.ndarray]:
        rows, classes = [], []
        everyday = [w for t in BACKGROUND for w in words_of(t)]
        for family, text in [*self.templates, *[(UNKNOWN, t) for t in BACKGROUND]]:
            words = words_of(text)
            for k in range(variants):
                kept = list(words) if k == 0 else [w for w in words if rng.random() > 0.06]
                if k % 3 == 1:
                    kept += rng.choices(everyday, k=6)
                if k % 3 == 2:
                    kept = rng.choices(everyday, k=4) + kept
                rows.append(self._vector(kept))
                classes.append(self.classes.index(family))
        for _ in range(8 * variants):
            rows.append(self._vector(rng.choices(everyday, k=14)))
            classes.append(len(self.classes) - 1)
        return np.array(rows), np.array(classes)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, n: int, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
        hot = np.eye(len(self.classes))[y]
        w, b = np.zeros((n, len(self.classes))), np.zeros(len(self.classes))
        for _ in range(rounds):
            gap = (self._softmax(x @ w + b) - hot) / len(x)
            w -= 2.0 * (x.T @ gap + 1e-4 * w)
            b -= 2.0 * gap.sum(axis=0)
        return w, b

    def _calibrate(self, w: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The temperature and unknown offset of least log loss on held-out notices."""
        best = (np.inf, 1.0, 0.0)
        for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8):
            for offset in (-1.0, -0.5, 0.0, 0.5, 1.0):
                z = (x @ w + b) / t
                z[:, -1] += offset
                loss = -np.log(self._softmax(z)[np.arange(len(y)), y] + 1e-12).mean()
                best = min(best, (loss, t, offset))
        bias = b / best[1]
        bias[-1] += best[2]
        return np.round(w / best[1], 6), np.round(bias, 6)

    def predict(self, text: str) -> tuple[str | None, float, float]:
        """Brute force over one paragraph: (family or None, probability, template share)."""
        grams = grams_of(words_of(text))
        found = grams & set(self.vocabulary)
        if not found:
            return None, 0.0, 0.0
        z = self.bias + sum(self.weights[self.vocabulary.index(g)] for g in found)
        p = self._softmax(z[None, :])[0]
        top = int(np.argmax(p))
        family = self.classes[top]
        share = 0.0
        for i, (f, _) in enumerate(self.templates):
            if f == family:
                hits = sum(i in self.inside.get(g, ()) for g in grams)
                share = max(share, hits / min(self.sizes[i], len(grams)))
        if family == UNKNOWN or round(float(p[top]), 6) < SURE or round(share, 6) < SHARE:
            return None, round(float(p[top]), 6), round(share, 6)
        return family, round(float(p[top]), 6), round(share, 6)


@functools.cache
def model() -> Model:
    return Model()


def _holds_stem(text: Column) -> Column:
    out = F.lit(False)
    for stem in STEMS:
        out = out | F.contains(text, F.lit(stem))
    return out


def candidate_paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, paragraph, norm)`` of the paragraphs that hold a stem."""
    low = F.lower(F.col(text_col))
    held = docs.select(F.col(id_col).alias("doc_id"), low.alias("low")).filter(_holds_stem(F.col("low")))
    lines = held.select("doc_id", F.posexplode(F.split("low", "\n")).alias("paragraph", "line")).filter(_holds_stem(F.col("line")))
    norm = F.array_join(F.regexp_extract_all("line", F.lit(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"), F.lit(0)), " ")
    return lines.select("doc_id", "paragraph", norm.alias("norm")).filter("norm <> ''")


def classify_paragraphs(norms: DataFrame) -> DataFrame:
    """Distinct ``norm`` -> ``(norm, family, probability, share)`` of recognised ones."""
    m = model()
    spark = norms.sparkSession
    # Both tables are constants of this module: some thousand rows, whatever the corpus.
    vocabulary = spark.createDataFrame([(g, [float(v) for v in m.weights[i]]) for i, g in enumerate(m.vocabulary)], "gram string, weight array<double>")
    templates = spark.createDataFrame(list(m.inside.items()), "gram string, inside array<int>")
    words = F.split("norm", " ")
    n = F.size(words)
    grams = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), n),
                lambda i: F.transform(
                    F.sequence(F.lit(1), F.least(F.lit(3), n - i + 1)), lambda k: F.array_join(F.slice(words, i, k), " ")
                ),
            )
        )
    )
    rows = cut(norms.select("norm", grams.alias("grams")).withColumn("own", F.size("grams")))
    every = rows.select("norm", "own", F.explode("grams").alias("gram"))
    hits = every.join(F.broadcast(vocabulary), "gram")
    by_class = hits.select("norm", F.posexplode("weight").alias("k", "w")).groupBy("norm", "k").agg(F.sum("w").alias("w"))
    bias = F.array(*[F.lit(float(b)) for b in m.bias])
    scored = by_class.select("norm", "k", (F.col("w") + F.get(bias, "k")).alias("z")).groupBy("norm").agg(
        F.max(F.struct("z", (-F.col("k")).alias("k"))).alias("top"), F.collect_list("z").alias("each")  # one a class
    )
    total = F.aggregate("each", F.lit(0.0), lambda acc, z: acc + F.exp(z - F.col("top.z")))
    names = F.array(*[F.lit(c) for c in m.classes])
    ranked = scored.select(
        "norm", F.get(names, -F.col("top.k")).alias("family"), F.round(1 / total, 6).alias("probability")
    ).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= SURE))
    sizes = F.array(*[F.lit(x) for x in m.sizes])
    owners = F.array(*[F.lit(f) for f, _ in m.templates])
    shares = (
        every.join(F.broadcast(templates), "gram").select("norm", "own", F.explode("inside").alias("t")).groupBy("norm", "own", "t")
        .agg(F.count(F.lit(1)).alias("hits"))
        .select("norm", F.get(owners, "t").alias("family"), (F.col("hits") / F.least(F.get(sizes, "t"), F.col("own"))).alias("share"))
        .groupBy("norm", "family").agg(F.round(F.max("share"), 6).alias("share"))
    )
    return ranked.join(shares, ["norm", "family"]).filter(F.col("share") >= SHARE).select("norm", "family", "probability", "share")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_licenses, families, probability, share,
    paragraphs``; families in order of name, numbers of paragraphs from 0, ascending."""
    found = cut(candidate_paragraphs(docs, id_col=id_col, text_col=text_col))
    verdicts = classify_paragraphs(found.select("norm").distinct())
    hits = lookup_join(found, verdicts.withColumnRenamed("norm", "n").select(F.col("n").alias("norm"), "family", "probability", "share"), ["norm"], how="inner")
    by_doc = hits.groupBy(F.col("doc_id").alias("hit_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("family")).alias("families"),
        F.max("probability").alias("probability"), F.max("share").alias("share"),
        F.sort_array(F.collect_set("paragraph")).alias("paragraphs"),
    )
    ids = docs.select(F.col(id_col).alias("doc_id"))
    return ids.join(by_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"),
        F.array_join(F.coalesce("families", F.array().cast("array<string>")), ",").alias("families"), "probability", "share",
        F.array_join(F.transform(F.coalesce("paragraphs", F.array().cast("array<int>")), lambda x: x.cast("string")), ",").alias("paragraphs"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
