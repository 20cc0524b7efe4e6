"""Operator 8: licence scans, native on the main path.

A paragraph classifier: multinomial logistic regression over sparse word n-grams
(one to three words) tells the licence family; an ``unknown`` class and a
temperature fitted on held-out phrases calibrate its probabilities; a comparison
with the family's templates confirms what it says: enough of the piece must be
in them, and it must have n-grams that tell this family from all others (a word of
its own, or two longer ones) with a key word among them. Key words are the templates' words
that are rare in the corpus (``RARE``), as the training draw has them.

Training is a small job on the driver: pieces of the templates below, and for
``unknown`` at most about ``NEGATIVES`` sentences of the corpus (documented bound),
one of each document that a hash of the key draws, from anywhere in its text.
Scoring uses DataFrame functions only. Paragraphs (lines up to a blank one) with a
key word are cut into pieces: their sentences across line ends, their lines, and in
paragraphs of more than ``SHORT`` words all windows of ``WIDTHS`` words, each
as far as it has a key word, so that a notice is found wherever it stands. As no
piece without a key word can be confirmed, none that could be is left out. Pieces are cut into
n-grams, which meet the broadcast weights (their number is bounded by the
templates) in a join and are summed piece by piece. Of the windows around a key
word counts the one with the most n-grams of its family, less those that the family
lacks. Texts are looked through once; a paragraph without a key word is unknown.

Null or empty text: no paragraph, family ``unknown``. Repeated rows get equal
results. Ties go to the first family by name. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import hash_part, materialize

UNKNOWN = "unknown"
NEGATIVES = 1_500
LEAST_PROBABILITY, LEAST_SHARE = 0.6, 0.4
#: Windows fit their notice more closely than lines do.
LEAST_SHARE_OF_WINDOW = 0.6
SHORT, WIDTHS = 9, (4, 6, 10, 16)
#: Key words are in at most this part of the drawn sentences, or in two of them.
RARE = 0.005
#: Characters of a drawn sentence that train.
DRAWN = 2_000

#: Phrases and paragraphs of public licences by family.
TEMPLATES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Released under the Apache License 2.0. SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file. Released under the BSD 3-Clause License. SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0. This work is licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0. This work is licensed under CC BY-NC 4.0. CC BY-NC-SA 4.0. CC BY-NC-ND 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0. This work is licensed under CC BY-SA 4.0. Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2. Released under the GPL. SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License. Licensed under the ISC License. SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3. Released under the LGPL. SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License. Licensed under the MIT License. This work is licensed under the MIT License. SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0. SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved. Copyright. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This material is confidential and proprietary. Unauthorized copying is strictly prohibited. All rights reserved.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal. Released into the public domain under CC0.",
    ],
}
#: Talk of licences that grants nothing; trains the unknown class.
DECOYS = [
    "He lost his driving license and had to ask for permission to leave the country.",
    "The police asked for a search warrant before they entered the house.",
    "Poetic license allows an author to bend the facts for the sake of the story.",
    "The council issued a fishing license and a permit to every resident of the village.",
    "Copyright law has been debated in parliament for many years without a result.",
    "The confidential report was given to the press without permission of the minister.",
    "The product comes with a warranty of two years that covers repairs and parts.",
    "Redistribution of wealth was the subject of the lecture in the public library.",
    "Licensed under the Eclipse Public License, Version 2.0.",
    "This file is made available under the terms of the Common Development and Distribution License, version 1.1.",
    "This software is provided as is under the zlib License; see the file for the license text.",
    "The software license of the product expires after one year and must be renewed.",
    "Released under a license of our own. Licensed under another public license, version 1.0.",
    "The work was released in three volumes and is available in the public library under that title.",
]
#: Other wordings, on which the probabilities are calibrated; they train nothing before that.
WORDINGS = [
    ("agpl", "Distributed under the GNU Affero General Public License v3."),
    ("apache", "Distributed under the terms of the Apache License 2.0."),
    ("bsd", "Distributed under the terms of the BSD 3-Clause."),
    ("cc-by", "Available under the Creative Commons Attribution 4.0 License."),
    ("cc-by-nc", "Available under Creative Commons Attribution-NonCommercial 4.0."),
    ("cc-by-sa", "Available under Creative Commons Attribution-ShareAlike 4.0."),
    ("gpl", "Distributed under the GNU General Public License v3 or later."),
    ("isc", "Distributed under the ISC License."),
    ("lgpl", "Distributed under the GNU Lesser General Public License v2.1."),
    ("mit", "Released under MIT."),
    ("mpl", "Distributed under the Mozilla Public License 2.0."),
    ("proprietary", "Copyright by the publisher, all rights reserved."),
    ("public-domain", "Dedicated to the public domain under CC0."),
    ("unknown", "Licensed under the Open Software License version 3.0."),
    ("unknown", "Distributed under the terms of a commercial license."),
    ("unknown", "This license is not valid without the signature of the owner."),
    ("unknown", "The public was admitted to the rights committee under the general rules."),
]
WORD = "[a-z0-9]+"
#: Ends a paragraph.
BLANK = r"\n[^\S\n]*(?=\n)"


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@dataclass
class Model:
    families: list[str]  # the last is unknown
    grams: list[str]
    weights: np.ndarray  # grams x families, divided by the temperature
    bias: np.ndarray
    member: np.ndarray  # grams x families: whether the family's templates have it
    proof: np.ndarray  # grams x families: what it adds to a proof that a piece is of the family
    keys: list[str]  # words of which each gram with a proof has one


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _descend(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases; every family counts the same."""
    sample = (y / np.maximum(1, y.sum(axis=0))).sum(axis=1, keepdims=True)
    sample /= sample.sum()
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        off = (_softmax(x @ w + b) - y) * sample
        speed_w = 0.9 * speed_w - rate * 20 * (x.T @ off + decay * w)
        speed_b = 0.9 * speed_b - rate * off.sum(axis=0)
        w, b = w + speed_w, b + speed_b
    return w, b


def train(negatives: list[str], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """From pieces of the templates and sentences that are not licences; their order does not matter."""
    families = [*sorted(TEMPLATES), UNKNOWN]
    pieces: list[tuple[set[str], int]] = []
    own: list[set[str]] = []
    for k, family in enumerate(families[:-1]):
        texts = [_words(s) for t in TEMPLATES[family] for s in [t, *re.split(r"(?<=\.) (?=[A-Z])", t)]]
        own.append(set().union(*map(_grams, texts)))
        for words in texts:
            cuts = {(0, len(words))} | {(a, min(a + n, len(words))) for n in (6, 10, 16) for a in range(0, max(1, len(words) - n + 1), 3)}
            pieces += [(_grams(words[a:b]), k) for a, b in sorted(cuts)]
    grams = sorted(set().union(*own))
    at = {g: i for i, g in enumerate(grams)}
    unlike = []  # a draw may hold licences: what looks like a template is none of the unknown
    for text in sorted(set(negatives)):
        found = _grams(_words(text))
        if found and max(len(found & o) for o in own) < 0.3 * len(found):
            unlike.append(found)
    decoys = [_grams(_words(t)) for t in DECOYS]
    pieces += [(found, len(families) - 1) for found in decoys + unlike]
    shared = set.intersection(*own) if own else set()
    # Pieces that several families share tell none of them apart.
    keep = [p for p in pieces if p[1] == len(own) or sum(len(p[0] & o) >= 0.95 * len(p[0]) for o in own) < 2]

    def matrix(some: list[tuple[set[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((len(some), len(grams)), np.float32), np.zeros((len(some), len(families)), np.float32)
        for r, (found, k) in enumerate(some):
            hit = [at[g] for g in found if g in at and g not in shared]
            x[r, hit] = 1 / np.sqrt(max(1, len(hit)))
            y[r, k] = 1
        return x, y

    # Calibrated on wordings, and on every fifth sentence that is not a licence, none of which the weights have seen.
    wordings = [(_grams(_words(t)), families.index(f)) for f, t in WORDINGS]
    held = unlike[::5]
    seen = [p for p in keep if not any(p[0] is h for h in held)]
    w, b = _descend(*matrix(seen), rounds, rate, decay)
    x, y = matrix(wordings + [(h, len(families) - 1) for h in held[: len(wordings)]])
    z = x @ w + b
    losses = {t: -np.log(np.maximum(1e-9, (_softmax(z / t) * y).sum(axis=1))).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
    warmth = min(losses, key=losses.get)
    w, b = _descend(*matrix(keep + wordings), rounds, rate, decay)

    often = Counter(word for found in unlike for word in found if " " not in word)
    most = max(2, RARE * len(unlike))
    rare = {g for g in grams if " " not in g and not g.isdigit() and often[g] <= most}
    # An n-gram proves a family if no other has it, nor an unknown piece, and a key word is in it.
    elsewhere = set().union(*unlike, *decoys)
    proves = lambda g: sum(g in o for o in own) == 1 and g not in elsewhere and any(x in rare for x in g.split())
    proof = np.array([[(1 if " " in g else 2) if proves(g) and g in o else 0 for o in own] + [0] for g in grams])
    keys = sorted({x for i, g in enumerate(grams) if proof[i].any() for x in g.split() if x in rare})
    member = np.array([[g in o for o in own] + [False] for g in grams])
    return Model(families, grams, w / warmth, b / warmth, member, proof, keys)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Trains with a bounded draw of the corpus' sentences as unknown ones."""
    rows = docs.where(F.col(text).isNotNull())
    n = rows.count()
    parts = 1 << 40
    drawn = rows.where(hash_part(F.col(key), F.lit("licences"), parts=parts) < max(1, parts * NEGATIVES // max(1, n)))
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda x: x.rlike("(?i)" + WORD))
    place = lambda what, n: F.pmod(F.xxhash64(F.col(key), F.lit(what)), n)
    one = drawn.select(F.col(key), sentences.alias("s")).where(F.size("s") > 0).select(F.col(key), F.get("s", place("sentence", F.size("s")).cast("int")).alias("s"))
    # Of a very long sentence a drawn part, for the driver's sake: negatives are examples, not results.
    part = F.substring(F.col("s"), (place("part", F.greatest(F.lit(1), F.char_length("s") - DRAWN)) + 1).cast("int"), F.lit(DRAWN))
    return train([r["s"] for r in one.select(part.alias("s")).limit(2 * NEGATIVES).collect()])


def _ngrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(words, i, F.lit(2)), " "))).otherwise(F.array().cast("array<string>"))
    threes = F.when(n > 2, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array_join(F.slice(words, i, F.lit(3)), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs, threes))


def _has(words: Column, keys: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*(F.lit(k) for k in keys))) if keys else F.lit(False)


def _tokens(text: Column) -> Column:
    return F.split(F.lower(text), f"[^{WORD[1:-2]}]+")


def _windows(words: Column, keys: list[str]) -> Column:
    """All windows of WIDTHS words that have a key word, as (words, where its key words stand)."""
    n = F.size(words)
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(keys) if keys else F.lit(False), i)), lambda i: i.isNotNull())

    def of(width: int, places: Column) -> Column:
        starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(F.lit(0), p - (width - 1)), F.least(p, n - width)))))
        inside = lambda a: F.filter(places, lambda p: (p >= a) & (p < a + width))
        return F.transform(starts, lambda a: F.struct(F.slice(words, a + 1, F.lit(width)).alias("words"), inside(a).alias("anchors")))

    none = F.array().cast("array<struct<words: array<string>, anchors: array<int>>>")
    found = F.transform(F.array(at), lambda places: F.concat(*(F.when(n >= w, of(w, places)).otherwise(none) for w in WIDTHS)))[0]
    return F.when(n > SHORT, found).otherwise(none)


def looked_through(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """row (a number), key, and the paragraphs that have a key word with their places (null: none): the only pass over the texts."""
    found = F.filter(F.transform(F.split(text, BLANK), lambda p, i: F.struct(i.alias("at"), p.alias("paragraph"))), lambda p: _has(_tokens(p["paragraph"]), model.keys))
    gate = F.coalesce(_has(_tokens(F.col(text)), model.keys), F.lit(False))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.when(gate, found).alias("paragraphs"))


def _pieces(seen: DataFrame, model: Model) -> DataFrame:
    """What is scored of each paragraph: row, key, at (the paragraph), piece (its number), anchors (of a window), sentence (else), line (whether it is but a line of it), words."""
    found = seen.select("row", "key", F.explode("paragraphs").alias("p")).select("row", "key", "p.at", "p.paragraph")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)
    # A sentence as a whole, then its lines: those of a list without full stops are notices of their own.
    sentences = F.transform(F.split("paragraph", r"(?<=[.!?])\s+"), lambda x: F.struct(words(F.regexp_replace(x, r"\s*\n\s*", " ")).alias("words"), F.when(x.contains("\n"), F.transform(F.split(x, "\n"), words)).otherwise(F.array().cast("array<array<string>>")).alias("lines")))
    found = found.select("row", "key", "at", sentences.alias("whole"), words(F.col("paragraph")).alias("words"))
    piece = lambda w, anchors, sentence, line: F.struct(anchors.cast("array<int>").alias("anchors"), sentence.cast("int").alias("sentence"), F.lit(line).alias("line"), w.alias("words"))
    none = F.lit(None)
    of_sentences = F.flatten(F.transform("whole", lambda s, i: F.concat(F.array(piece(s["words"], none, i, False)), F.transform(s["lines"], lambda w: piece(w, none, i, True)))))
    of_sentences = F.filter(of_sentences, lambda p: _has(p["words"], model.keys))
    of_windows = F.transform(_windows(F.col("words"), model.keys), lambda x: piece(x["words"], x["anchors"], none, False))
    pieces = found.select("row", "key", "at", F.posexplode(F.concat(of_sentences, of_windows)).alias("piece", "p"))
    return pieces.select("row", "key", "at", "piece", "p.anchors", "p.sentence", "p.line", "p.words")


def _scored(seen: DataFrame, model: Model) -> DataFrame:
    """A row for each line and sentence, and for the best window around each key word: row, key, at, anchor, predicted, probability, share, confirmed, family."""
    spark = seen.sparkSession
    k = len(model.families)
    table = spark.createDataFrame([(g, [float(v) for v in model.weights[i]], [int(v) for v in model.member[i]], [int(v) for v in model.proof[i]]) for i, g in enumerate(model.grams)], "gram string, w array<double>, m array<int>, p array<int>")
    at = ["row", "key", "at", "piece", "anchors", "sentence", "line"]
    grams = _pieces(seen, model).select(*at, F.explode(_ngrams(F.col("words"))).alias("gram"))
    hits = grams.join(F.broadcast(table), "gram", "left")
    total = lambda c, i: F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0))
    sums = hits.groupBy("row", "at", "piece").agg(
        *(F.first(c).alias(c) for c in ("key", "anchors", "sentence", "line")),
        F.count("*").alias("grams"),
        F.count("w").alias("hits"),
        *(total(c, i).alias(f"{c}{i}") for c in "wmp" for i in range(k)),
    )
    scale = F.sqrt(F.greatest(F.lit(1), F.col("hits")))
    logits = F.array(*(F.col(f"w{i}") / scale + float(model.bias[i]) for i in range(k)))
    all_ = lambda c: F.array(*(F.col(f"{c}{i}") for i in range(k)))
    out = sums.select(*at, "grams", logits.alias("z"), all_("m").alias("own"), all_("p").alias("proof"))
    out = out.withColumn("top", F.array_max("z")).withColumn("which", (F.array_position("z", F.col("top")) - 1).cast("int"))
    out = out.withColumn("mass", F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v)))
    names = F.array(*(F.lit(f) for f in model.families))
    own = F.col("own")[F.col("which")]
    out = out.select(*at, names[F.col("which")].alias("predicted"), (F.exp("top") / F.col("mass")).alias("probability"), "grams", (own / F.col("grams")).alias("share"), (2 * own - F.col("grams")).alias("excess"), F.col("proof")[F.col("which")].alias("proof"))
    least = F.when(F.col("anchors").isNull(), LEAST_SHARE).otherwise(LEAST_SHARE_OF_WINDOW)
    # A word alone, such as the end of a wrapped line, names no licence.
    sure = (F.col("predicted") != UNKNOWN) & (F.col("grams") > 1) & (F.col("probability") >= LEAST_PROBABILITY) & (F.col("share") >= least) & (F.col("proof") >= 2)
    out = out.withColumn("confirmed", sure).withColumn("family", F.when(sure, F.col("predicted")).otherwise(UNKNOWN))
    # All sentences count, and their lines unless the sentence is a notice that fits better; of a key word's windows the best.
    out = out.withColumn("anchor", F.explode_outer("anchors"))
    fits = F.max(F.when(~F.col("line") & F.col("confirmed"), F.col("excess"))).over(Window.partitionBy("row", "at", "anchor", "sentence"))
    out = out.withColumn("fits", fits).where(~F.col("line") | F.col("fits").isNull() | (F.col("excess") > F.col("fits")))
    what = F.struct("predicted", "probability", "share", "confirmed", "family")
    alone = F.when(F.col("anchor").isNull(), F.col("piece"))
    best = out.groupBy("row", "key", "at", "anchor", alone.alias("alone")).agg(F.max_by(what, F.struct("excess", "probability", -F.col("piece"))).alias("best"))
    return best.select("row", "key", "at", "anchor", "best.*")


def paragraphs(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each paragraph with a key word: row (a number for the document's row), key, at (the paragraph), and of its surest piece predicted, probability, share, confirmed, family."""
    seen = materialize(looked_through(docs, model, key, text), "paragraphs")
    what = ("predicted", "probability", "share", "confirmed", "family")
    best = F.max_by(F.struct(*what), F.struct("confirmed", "probability", "predicted")).alias("best")
    return _scored(seen, model).groupBy("row", "key", "at").agg(best).select("row", F.col("key").alias(key), "at", "best.*")


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, license (families that its paragraphs confirm, by name, comma-joined, else unknown), probability of the surest one, n_paragraphs that have a key word."""
    seen = materialize(looked_through(docs, model, key, text), "paragraphs")
    some = _scored(seen, model).where("confirmed").groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("license"),  # at most as many as there are families
        F.max("probability").alias("probability"),
    )
    all_ = seen.select("row", "key", F.coalesce(F.size("paragraphs"), F.lit(0)).cast("long").alias("n_paragraphs"))
    out = all_.join(some, "row", "left")
    return out.select(F.col("key").alias(key), F.coalesce("license", F.lit(UNKNOWN)).alias("license"), F.round(F.coalesce("probability", F.lit(0.0)), 6).alias("probability"), F.greatest(F.lit(0).cast("long"), "n_paragraphs").alias("n_paragraphs"))
