"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph ends at an empty line, or at a line break after a full stop, colon, semicolon,
question or exclamation mark; other line breaks are wraps inside it.  Its features are the
word n-grams (n = 1, 2, 3) that hold at least one *term* (a word of licence language); their
weights, one for each family and n-gram seen in training, form a sparse multinomial logistic
regression with an ``unknown`` class that covers both ordinary prose and licence talk that
grants nothing.  A paragraph without a term has no feature and is unknown by construction, so
it gives no row.

Training runs on the driver, in numpy, on a fixed set of statements: paragraphs of licence
texts and file headers, licence names in a few dozen frames, and negative sentences.  A
temperature, fitted on frames that training did not see, calibrates the probabilities; below
``least_probability`` a paragraph is unknown.  A predicted family is then *confirmed* by the
family's templates: the paragraph holds one of its names as consecutive words (overlap 1), or
at least ``least_overlap`` of the distinct words of one of its licence paragraphs.

The main path is DataFrame functions: the weights are a table of fixed size (the vocabulary
of the training statements, a few thousand rows whatever the corpus), joined by hash.

Result: one row for each paragraph that has a term: doc_id, paragraph (its index from 0),
family, probability, overlap, confirmed.  Defined results: null and empty texts have no
rows; paragraphs of any length are read whole; ties between families go to the first by name;
repeated rows are reported for each row, rows with a null id under the null id; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base

UNKNOWN = "unknown"

# Licence families with their names.
FAMILIES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License version 3", "AGPL-3.0", "Affero GPL"),
    "apache": ("Apache License", "Apache License, Version 2.0", "Apache-2.0", "Apache 2.0 license"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD", "BSD-3-Clause"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "cc0": ("CC0 1.0 Universal public domain dedication", "CC0-1.0", "public domain under CC0"),
    "epl": ("Eclipse Public License", "Eclipse Public License 2.0", "EPL-2.0"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 3", "GPL-3.0-or-later", "GPL version 2", "GNU GPL", "GPLv3"),
    "isc": ("ISC License",),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License version 2.1", "LGPL-2.1", "Lesser GPL"),
    "mit": ("MIT License", "MIT licence"),
    "mpl": ("Mozilla Public License", "Mozilla Public License, v. 2.0", "MPL-2.0"),
    "proprietary": ("All rights reserved", "confidential and proprietary"),
    "unlicense": ("free and unencumbered software released into the public domain", "The Unlicense"),
}

# Paragraphs of the licences and of the notices that they ask for.
BODIES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "cc-by": ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",),
    "cc-by-nc": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",),
    "cc-by-sa": ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is confidential and proprietary information; unauthorized copying is strictly prohibited. Copyright, all rights reserved.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
}

# Sentences around a licence's name, and sentences that grant nothing.
FRAMES = (
    "{}",
    "{}.",
    "Licensed under {}.",
    "Licensed under the {}.",
    "Released under the {}.",
    "Released under {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "This program is distributed under the terms of the {}.",
    "SPDX-License-Identifier: {}",
    "License: {}",
    "The source code is available under the {}.",
    "Permission is given under {}; see the LICENSE file.",
    "Copyright 2020 the authors. {}.",
    "You can use this under the {}, see below.",
    "Published under {} by the authors.",
)
NEGATIVES = (
    "He lost his driver license last week.",
    "The license plate of the car was hidden.",
    "Fishing requires a license in this county.",
    "Her poetic license is remarkable.",
    "The warranty of the washing machine covers two years.",
    "Copyright law is a difficult subject for students.",
    "They asked for permission to enter the garden.",
    "The public domain of the village was fenced.",
    "A licensed electrician repaired the lights.",
    "Please read the terms before you sign the contract.",
    "The new law gives the public general access to the archive.",
    "The version of the story that she told was different.",
    "The commons were open to all, creative or not.",
    "Attribution of the painting is uncertain.",
    "The software was slow and the source of the error unknown.",
    "The apache people lived in the south west.",
    "Students at MIT built a robot.",
    "Mozilla and Eclipse are names of products.",
    "The license was revoked by the board.",
    "Licenses are sold at the counter.",
    "Is this licensed?",
    "See the license for details.",
    "No license is stated.",
    "without permission of the owner",
)
#: Words of licence language; an n-gram without one is not a feature.
TERMS = (
    "license licenses licensed licence licenced licensing unlicense license-identifier spdx-license-identifier copyright warranty warranties permission"
    " permitted redistribution redistributions gpl gplv2 gplv3 lgpl agpl affero lesser apache bsd isc mpl mozilla epl"
    " eclipse cc creative commons attribution noncommercial attribution-noncommercial attribution-sharealike sharealike"
    " cc0 domain unencumbered reserved proprietary apache-2 gpl-3 gpl-2 lgpl-2 agpl-3 mpl-2 epl-2 cc0-1 cc-by-4 cc-by-nc-4"
    " cc-by-sa-4 bsd-3-clause bsd-2-clause by-nc by-sa by-nc-sa"
).split()

_SPLIT = r"[^a-z0-9-]+"
#: Between two paragraphs: a line break after the end of a sentence, or an empty line.
PARAGRAPH = r"\n(?:(?<=[.:;!?][\x20\t\r]{0,4}\n)|[\x20\t\r]*\n)[\x20\x09-\x0D]*"


@dataclass(frozen=True)
class Config:
    epochs: int = 300
    rate: float = 4.0
    decay: float = 1e-4
    least_probability: float = 0.5
    least_overlap: float = 0.6


def words(line: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return [w for w in re.split(_SPLIT, lowered) if w]


def grams(line: str) -> list[str]:
    """Distinct n-grams of a line that hold a term."""
    w, terms = words(line), set(TERMS)
    out = {}
    for n in (1, 2, 3):
        for i in range(len(w) - n + 1):
            if any(x in terms for x in w[i : i + n]):
                out[" ".join(w[i : i + n])] = None
    return list(out)


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]  # UNKNOWN included, by name
    vocabulary: dict[str, int]
    weights: np.ndarray  # vocabulary x classes
    bias: np.ndarray
    temperature: float

    def probabilities(self, lines: list[str]) -> np.ndarray:
        z = np.tile(self.bias, (len(lines), 1))
        for i, line in enumerate(lines):
            z[i] += self.weights[[self.vocabulary[g] for g in grams(line) if g in self.vocabulary]].sum(axis=0)
        z = np.exp((z - z.max(axis=1, keepdims=True)) / self.temperature)
        return z / z.sum(axis=1, keepdims=True)


def statements(part: int | None = None) -> list[tuple[str, str]]:
    """Training statements (part 0) or those held back for calibration (part 1); None: all."""
    found = []
    for family, names in FAMILIES.items():
        for j, name in enumerate(names):
            for k, frame in enumerate(FRAMES):
                if part is None or part == ((j + k) % 4 == 3):
                    found.append((frame.format(name), family))
    if part != 1:  # the paragraphs are few: all of them are for training
        found += [(body, family) for family, bodies in BODIES.items() for body in bodies * 6]
    found += [(s, UNKNOWN) for k, s in enumerate(NEGATIVES * 6) if part is None or part == (k % 4 == 3)]
    # Frames around a name that is no licence: the frame alone must not decide.
    other = ("terms of the contract", "seal of the office", "new name", "rules of the house", "village", "permission of the board")
    found += [(frame.format(x), UNKNOWN) for j, x in enumerate(other) for k, frame in enumerate(FRAMES) if part is None or part == ((j + k) % 4 == 3)]
    return found


@lru_cache(maxsize=4)
def train(config: Config = Config()) -> Model:
    """Full-batch gradient descent on the softmax loss, then a temperature on held-back statements."""
    data, held = statements(0), statements(1)
    classes = tuple(sorted({*FAMILIES, UNKNOWN}))
    vocabulary: dict[str, int] = {}
    for line, _ in data:
        for g in grams(line):
            vocabulary.setdefault(g, len(vocabulary))
    x = np.zeros((len(data), len(vocabulary)))
    for i, (line, _) in enumerate(data):
        x[i, [vocabulary[g] for g in grams(line)]] = 1
    y = np.zeros((len(data), len(classes)))
    y[np.arange(len(data)), [classes.index(c) for _, c in data]] = 1
    w, b = np.zeros((x.shape[1], len(classes))), np.zeros(len(classes))
    for _ in range(config.epochs):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= config.rate * (x.T @ (p - y) / len(data) + config.decay * w)
        b -= config.rate * (p - y).mean(axis=0)
    best = (np.inf, 1.0)
    truth = [classes.index(c) for _, c in held]
    for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
        p = Model(classes, vocabulary, w, b, t).probabilities([s for s, _ in held])
        best = min(best, (float(-np.log(p[np.arange(len(held)), truth] + 1e-12).mean()), t))
    return Model(classes, vocabulary, w, b, best[1])


def scan(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Rows doc_id, paragraph, family, probability, overlap, confirmed."""
    spark, model = docs.sparkSession, train(config)
    table = spark.createDataFrame(
        [(g, [float(v) for v in model.weights[i]]) for g, i in model.vocabulary.items()], "gram string, weight array<double>"
    )  # its size is that of the training statements' vocabulary: bounded, whatever the corpus
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.posexplode(F.split("text", PARAGRAPH)).alias("paragraph", "line"))
    lower = _base.ascii_lower(F.col("line"))
    stems = ("licen", "copyright", "warrant", "permi", "redistribut", "gpl", "apache", "bsd", "isc", "mpl", "mozilla", "epl", "eclipse", "cc", "commons", "creative", "attribution", "commercial", "sharealike", "domain", "unencumbered", "reserved", "proprietary", "affero", "lesser", "by-nc", "by-sa")
    maybe = F.col("line").rlike("(?i)" + "|".join(stems))  # one pass over the line as it is
    found = lines.where(maybe).select("doc_id", "row", "paragraph", F.explode(F.array(F.filter(F.split(lower, _SPLIT), lambda w: w != ""))).alias("w"))
    places = F.filter(F.transform("w", lambda w, i: F.when(w.isin(TERMS), i + 1)), lambda i: i.isNotNull())
    found = found.withColumn("places", places).where(F.size("places") > 0)

    def of(n: int):
        """Distinct n-grams that cover one of the places."""
        near = lambda p: F.sequence(F.greatest(F.lit(1), p - n + 1), F.greatest(F.lit(1), F.least(p, F.size("w") - n + 1)))
        starts = F.when(F.size("w") >= n, F.array_distinct(F.flatten(F.transform("places", near)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))

    text = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    holds = lambda names: F.concat(*[F.when(F.contains(text, F.lit(f" {' '.join(words(n))} ")), F.lit("y")).otherwise(F.lit("")) for n in names]) != ""
    named = F.array_compact(F.array(*[F.when(holds(names), F.lit(family)) for family, names in FAMILIES.items()]))
    of_templates = sorted({w for bodies in BODIES.values() for body in bodies for w in words(body)})
    grams_of = F.array_distinct(F.concat(of(1), of(2), of(3)))
    # Only words of templates go on, so what is sent of a paragraph is bounded.
    found = found.select("doc_id", "row", "paragraph", named.alias("named"), F.array_intersect("w", F.array(*[F.lit(w) for w in of_templates])).alias("held"), grams_of.alias("grams"))
    featured = found.select("doc_id", "row", "paragraph", "named", "held", F.explode("grams").alias("gram"))
    hit = featured.join(F.broadcast(table), "gram", "left")
    sums = [F.sum(F.coalesce(F.get("weight", F.lit(k)), F.lit(0.0))).alias(f"z{k}") for k in range(len(model.classes))]
    scored = hit.groupBy("doc_id", "row", "paragraph").agg(F.first("held").alias("held"), F.first("named").alias("named"), *sums)
    z = [(F.col(f"z{k}") + F.lit(float(model.bias[k]))) / F.lit(model.temperature) for k in range(len(model.classes))]
    scored = scored.select("doc_id", "row", "paragraph", "held", "named", F.array(*z).alias("z"))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max("z")))
    scored = scored.withColumn("best", F.array_position("z", top).cast("int")).withColumn("top_probability", F.lit(1.0) / total)
    family = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.col("best"))
    sure = F.col("top_probability") >= config.least_probability
    scored = scored.withColumn("family", F.when(sure, family).otherwise(F.lit(UNKNOWN)))
    overlap = F.lit(0.0)
    for name, bodies in BODIES.items():
        shares = [F.size(F.array_intersect("held", F.array(*[F.lit(x) for x in sorted(set(words(t)))]))) / F.lit(float(len(set(words(t))))) for t in bodies]
        overlap = F.when(F.col("family") == name, F.greatest(F.lit(0.0), *shares)).otherwise(overlap)
    overlap = F.when(F.array_contains("named", F.col("family")), F.lit(1.0)).otherwise(overlap)
    scored = scored.withColumn("overlap", overlap)
    confirmed = (F.col("family") != UNKNOWN) & (F.col("overlap") >= config.least_overlap)
    return scored.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.col("top_probability").alias("probability"), "overlap", confirmed.alias("confirmed"))


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(_base.documents(spark, sf_dir))
