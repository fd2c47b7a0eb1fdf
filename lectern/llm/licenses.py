"""License scan: a trained paragraph classifier over sparse word n-grams, in DataFrame functions only.

A paragraph ends at a blank line, or with a line that ends in a mark (``. ! ? : ;``): so
hard-wrapped grants read as one, and a notice on a line of its own is not drowned by prose
around it. Multinomial logistic regression with an elastic net, fitted on the paragraphs
below, gives each word n-gram a weight for each licence family and for ``unknown``. Every
paragraph is scored, by a join of its n-grams with the weights. Only families of which the
paragraph holds an n-gram that no other family's paragraphs have are compared, so a notice in
words that several share goes to the one it names. Probabilities are tempered, and a family
is only reported above a probability that held-out unknown paragraphs stay under, among them
beginnings of grants that go on as prose; then the family's templates must confirm it: one of
them shares at least two n-grams with the paragraph, and CONFIRM of its own (of a short
template CLOSE), or the paragraph is a part of it but for 1 - CLOSE of its n-grams.

Defined cases: null and empty texts have no paragraph; ties between families go to the
alphabetically first; repeated rows each keep their own row; an empty table gives an empty
result; other columns of the input are not looked at, whatever their names; a very long text
is cut into paragraphs as it streams by, and one paragraph's n-grams are held at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import STOP_WORDS, let

UNKNOWN = "unknown"
#: What ends a paragraph.
BREAK = r"\n[ \t\r]*(?:\n[ \t\r]*)+|(?<=[.!?:;])[ \t\r]*\n"
#: Share of a template's n-grams that a paragraph must have; of the n-grams of a template below SHORT, or of a paragraph that is a part of one.
CONFIRM, CLOSE, SHORT = 0.5, 0.8, 16
#: Share of held-out unknown paragraphs that must stay below the reporting threshold; the templates judge what is above.
QUANTILE = 0.95

# Paragraphs of public licences and of their usual notices, by family.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL v3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Released under CC-BY 4.0.",
        "This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Released under CC-BY-NC 4.0.",
        "Licensed under CC BY-NC-ND 4.0, for non-commercial use only.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Released under CC-BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GPL v3.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "Licensed under the ISC license.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the LGPL v2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Released under the MPL 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "Copyright (c) 2020 The Company. All rights reserved.",
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Unauthorized reproduction or distribution of this copyrighted material is prohibited.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
}

# Paragraphs that hold licence words but grant nothing.
NEGATIVES = [
    "Her driving license was issued by the city office last spring.",
    "The committee gave permission to hold the meeting in the public hall.",
    "A fishing license costs ten dollars and is valid for one year.",
    "He took some poetic license with the dates in the story.",
    "The lecture on copyright law begins at nine in the main building.",
    "She released the bird under the old tree near the river.",
    "Software engineers write code and test it before it is distributed.",
    "The new version of the library was published in June with many changes.",
    "Students may use the reading room without charge on weekdays.",
    "The Apache helicopter landed behind the barn in the afternoon.",
    "Researchers at MIT and other schools studied the effect for years.",
    "The court asked whether the warranty covered the broken part.",
    "The public domain of the discussion was the economy and the weather.",
    "Doctors must renew their medical license every few years.",
    "He was licensed to sell wine and beer in the state.",
    "The article was distributed to all members of the council.",
    "No permission is needed to walk across the field.",
    "The general public was invited to the opening of the museum.",
    "The attribution of the painting to the master is in doubt.",
    "Creative people share their work with friends in common rooms.",
    "The foundation gave a free lunch to every child in the school.",
    "Terms and conditions of the sale were read aloud to the buyers.",
    "The copy of the letter was lost in the fire of 1902.",
    "They sell maps, books and copies of old prints near the gate.",
    "The pilot's license was suspended after the incident.",
    "Version 2 of the plan was better than version 3.",
    "The rights of the people were reserved for another debate.",
    "The notice above the door said that the shop was closed.",
    "A merchant granted him a loan for the purpose of trade.",
    "The binary star was found by the two astronomers.",
    "Their license plate was covered with mud from the road.",
    "Photographs by permission of the family of the late author.",
    "The rights of the tenant are reserved by the contract of the house.",
    "No rights were reserved for the heirs in his will.",
    "Use of the hall is governed by the rules of the village council.",
    "Seats were reserved for all members with rights to vote.",
    "This version of the story is free and can be found in the library.",
    "The warranty of the car is limited to the first owner.",
]


# Names of licences by family, and the notices they stand in.
NAMES = {
    "agpl": ["GNU Affero General Public License, version 3", "AGPL v3", "AGPL-3.0 license"],
    "apache": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache License 2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY 3.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0"],
    "cc0": ["CC0 1.0 Universal Public Domain Dedication", "CC0 1.0", "Creative Commons Zero"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GPL v3", "GPL-2.0 license"],
    "isc": ["ISC License", "ISC license"],
    "lgpl": ["GNU Lesser General Public License, version 3", "LGPL v2.1", "LGPL-3.0 license"],
    "mit": ["MIT License", "MIT license"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "unlicense": ["Unlicense"],
}
NOTICES = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is distributed under the terms of the {}.", "You may use it under the {}."]


def clean(text: Column) -> Column:
    """Lower-cased words of a paragraph: letters and digits, inner dots and hyphens split."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _combined(words: Column, telling: Column) -> Column:
    """Distinct n-grams: the telling words, then pairs and triples of neighbours; a null word is in none."""
    after = lambda n: F.slice(words, n, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    longer = lambda grams, n: F.zip_with(grams, after(n), lambda g, w: F.concat(g, F.lit(" "), w))
    some = lambda grams: F.filter(grams, lambda g: g.isNotNull())
    return let(longer(words, 2), lambda two: F.array_distinct(F.concat(telling, some(two), some(longer(two, 3)))))


def ngrams(words: Column) -> Column:
    """The distinct n-grams of an array of words: telling words (three letters or more, no stop words), pairs and triples."""
    return _combined(words, F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def known_ngrams(text: Column, vocabulary: list[str]) -> Column:
    """struct(grams, n) of a paragraph: its n-grams of which each word stands in the vocabulary, and the number of places of all n-grams.

    A word of no known n-gram is in none either, so nothing else is put together.
    """
    words = sorted({w for g in vocabulary for w in g.split()})
    telling = sorted(g for g in vocabulary if " " not in g)
    parts = F.split(F.lower(text), "[^a-z0-9]+")
    blank = lambda k: (F.element_at(parts, k) == "").cast("int")
    places = 3 * (F.size(parts) - blank(1) - blank(-1)) - 3
    grams = let(F.transform(parts, lambda w: F.when(w.isin(*words), w)), lambda known: _combined(known, F.filter(known, lambda w: w.isin(*telling))))
    return F.struct(grams.alias("grams"), places.alias("n"))


def inline(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table from rows known to the driver."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


@dataclass
class Model:
    families: list[str]
    #: n-gram, of a template or with a weight, to one weight for each family; families[k] has bias[k].
    #: n-grams of a template alone have zeros: they count for the comparison.
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    threshold: float
    #: The n-grams of each of all_templates().
    templates: list[set[str]]
    #: n-gram, of one family's paragraphs alone, to that family's place.
    own: dict[str, int]


def all_templates() -> list[tuple[str, str]]:
    """(family, text) of every template."""
    return [(f, t) for f, many in sorted(TEMPLATES.items()) for t in many]


def training_paragraphs() -> list[dict]:
    """Templates, thirds of long ones, notices and negatives to fit on, and others held out for calibration.

    Held out are halves of long templates, notices in other words, each third negative, and
    the first half of each of those beside the second half of each other.
    """
    rows = []
    for family, templates in TEMPLATES.items():
        for text in templates:
            words = text.split()
            rows.append({"family": family, "text": text, "held": False})
            if len(words) >= 16:
                third = -(-len(words) // 3)
                rows += [{"family": family, "text": " ".join(words[k : k + third]), "held": False} for k in range(0, len(words), third)]
                rows += [{"family": family, "text": " ".join(p), "held": True} for p in (words[: len(words) // 2], words[len(words) // 2 :])]
            else:
                rows.append({"family": family, "text": f"Note: {text} Thanks.", "held": True})
    for family, names in NAMES.items():
        rows += [{"family": family, "text": n.format(name), "held": k == len(NOTICES) - 1} for name in names for k, n in enumerate(NOTICES)]
    aside, fitted = [t for k, t in enumerate(NEGATIVES) if k % 3 == 2], [t for k, t in enumerate(NEGATIVES) if k % 3 != 2]
    rows += [{"family": UNKNOWN, "text": t, "held": k % 3 == 2} for k, t in enumerate(NEGATIVES)]
    halves = [(w[: len(w) // 2], w[len(w) // 2 :]) for w in map(str.split, aside)]
    rows += [{"family": UNKNOWN, "text": " ".join(a + b), "held": True} for k, (a, _) in enumerate(halves) for j, (_, b) in enumerate(halves) if j != k]
    # Beginnings of grants that go on as prose: a third of a long template, then the end of a negative.
    whole = [n.lower() for names in NAMES.values() for n in names] + ["all rights reserved"]  # what is a notice by itself
    beginnings = [" ".join(w[: min(8, len(w) // 3)]) for w in (t.split() for many in TEMPLATES.values() for t in many) if len(w) >= 12]
    for k, words in enumerate(b for b in beginnings if not any(n in b.lower() for n in whole)):
        for held, others in ((False, fitted), (True, aside)):
            ends = [others[(3 * k + j) % len(others)].split() for j in range(2)]
            rows += [{"family": UNKNOWN, "text": " ".join([words, *end[len(end) // 2 :]]), "held": held} for end in ends]
    return rows


def train(spark: SparkSession) -> Model:
    """The model from the paragraphs of this module."""
    rows = training_paragraphs()
    families = sorted(TEMPLATES) + [UNKNOWN]
    table = inline(spark, [r | {"label": families.index(r["family"])} for r in rows], "family string, text string, held boolean, label double")
    table = table.withColumn("ngrams", ngrams(clean(F.col("text")))).coalesce(1).cache()
    counts = CountVectorizer(inputCol="ngrams", outputCol="features", binary=True, vocabSize=1 << 18).fit(table)
    rows_ = counts.transform(table.where(~F.col("held"))).select("features", "label").cache()
    fitted = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=60).fit(rows_)
    rows_.unpersist()
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    used = np.flatnonzero(np.abs(matrix).max(0) > 0)
    zero, vocabulary = [0.0] * len(families), counts.vocabulary
    own = inline(spark, [{"k": k, "text": t} for k, (_, t) in enumerate(all_templates())], "k int, text string").select("k", ngrams(clean(F.col("text"))).alias("grams")).orderBy("k").collect()  # the templates of this module
    templates = [set(r.grams) for r in own]
    weights = {g: zero for t in templates for g in t} | {vocabulary[k]: matrix[:, k].tolist() for k in used}
    every = table.select("ngrams", "label", "held").collect()  # the paragraphs of this module
    table.unpersist()
    of: dict[str, set[int]] = {}
    for r in every:
        if r.label < len(families) - 1:
            for g in r.ngrams:
                of.setdefault(g, set()).add(int(r.label))
    own_grams = {g: min(k) for g, k in of.items() if len(k) == 1}
    weights = {g: zero for g in own_grams} | weights
    held = [(r.ngrams, int(r.label)) for r in every if r.held]
    logits = np.array([bias + sum((np.array(weights[g]) for g in grams if g in weights), np.zeros(len(families))) for grams, _ in held])
    allowed = np.array([[k == len(families) - 1 or any(own_grams.get(g) == k for g in grams) for k in range(len(families))] for grams, _ in held])
    logits = np.where(allowed, logits, BARRED)
    labels = np.array([k for _, k in held])
    temperature = min(np.geomspace(0.25, 4, 33), key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-9)).mean())
    best = _softmax(logits / temperature)[:, :-1].max(1)[labels == len(families) - 1]
    threshold = max(0.5, float(np.quantile(best, QUANTILE)) if len(best) else 0.5)
    return Model(families, weights, bias.tolist(), float(temperature), threshold, templates, own_grams)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def paragraphs(docs: DataFrame) -> DataFrame:
    """row, doc_id, th (hash of the text), paragraph (place) and unit (text) that are not blank; row tells repeated rows apart."""
    text = F.col("text").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.select("row", "doc_id", "th", F.posexplode(F.split("text", BREAK)).alias("paragraph", "unit")).where(F.rlike("unit", F.lit(r"\S")))


#: Templates whose counts share a 64-bit number, eight bits each, so that no sum reaches the sign; a template has fewer than 256 n-grams.
PACKED = 7
#: Logit of a family that is not compared.
BARRED = -1e6


def scan_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, th (hash of the text), paragraph (place), family, probability and similarity of every confirmed paragraph.

    One aggregation sums, over the known n-grams of a paragraph, its weights and the counts that
    it shares with each template.
    """
    unit = ["row", "doc_id", "th", "paragraph"]
    k, packs = len(model.families), -(-len(model.templates) // PACKED)
    if max(map(len, model.templates)) > 255:
        raise ValueError("a template has too many n-grams for its count")
    vocabulary = []
    for gram, w in model.weights.items():
        bits = [0] * packs
        for at, t in enumerate(model.templates):
            bits[at // PACKED] += (gram in t) << (8 * (at % PACKED))
        vocabulary.append({"gram": gram, "w": w, "t": bits, "o": 1 << model.own[gram] if gram in model.own else 0})
    table = inline(docs.sparkSession, vocabulary, "gram string, w array<double>, t array<long>, o long")
    grams = paragraphs(docs).select(*unit, known_ngrams(F.col("unit"), sorted(model.weights)).alias("known"))
    sums = (
        grams.select(*unit, F.col("known.n").alias("n"), F.explode("known.grams").alias("gram"))
        .join(F.broadcast(table), "gram")  # n-grams of the training paragraphs
        .groupBy(*unit).agg(F.max("n").alias("n"), *[F.sum(F.col("w")[j]).alias(f"w{j}") for j in range(k)], *[F.sum(F.col("t")[j]).alias(f"t{j}") for j in range(packs)], F.bit_or("o").alias("own"))
    )
    raw = [F.col(f"w{j}") + model.bias[j] if name == UNKNOWN else F.when(F.col("own").bitwiseAND(F.lit(1 << j)) != 0, F.col(f"w{j}") + model.bias[j]).otherwise(BARRED) for j, name in enumerate(model.families)]
    logits = F.array(*[x / model.temperature for x in raw])
    best = F.array_position("logits", F.array_max("logits")).cast("int")
    probability = 1 / F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("logits")))
    found = sums.withColumn("logits", logits)
    found = found.withColumn("probability", probability).withColumn("family", F.element_at(F.array(*map(F.lit, model.families)), best))
    found = found.where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold))
    shared: dict[str, list[Column]] = {}
    for at, ((family, _), t) in enumerate(zip(all_templates(), model.templates)):
        common = F.shiftrightunsigned(F.col(f"t{at // PACKED}"), 8 * (at % PACKED)).bitwiseAND(F.lit(255))
        of_template, of_paragraph = common / F.lit(len(t)), common / F.greatest(F.col("n"), common)
        enough = (of_template >= (CONFIRM if len(t) >= SHORT else CLOSE)) | (of_paragraph >= CLOSE)
        shared.setdefault(family, []).append(F.when((common >= 2) & enough, F.greatest(of_template, of_paragraph)).otherwise(0.0))
    likeness = F.lit(0.0)
    for family, of_templates in shared.items():
        likeness = F.when(F.col("family") == family, F.greatest(*of_templates, F.lit(0.0))).otherwise(likeness)
    return found.select(*unit[1:], "family", "probability", likeness.alias("similarity")).where(F.col("similarity") > 0).dropDuplicates(unit[1:])


def scan_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, family (of the likeliest paragraph, null if none), probability and families (sorted, comma-joined) of every row."""
    found = scan_paragraphs(docs, model).groupBy("doc_id", "th").agg(
        F.count("*").alias("n_licensed"),
        F.min_by("family", F.struct(-F.round("probability", 9), -F.round("similarity", 9), F.col("family"))).alias("family"),
        F.max("probability").alias("probability"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
    )
    text = F.col("text").cast("string")
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda x: F.rlike(x, F.lit(r"\S"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), n.cast("long").alias("n_paragraphs"))
    key = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["th"] == found["th"])
    return rows.join(found, key, "left").select(
        rows["doc_id"], "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), "family", "probability", F.coalesce("families", F.lit("")).alias("families")
    )


def license_scan(docs: DataFrame) -> DataFrame:
    return scan_documents(docs, train(docs.sparkSession))
