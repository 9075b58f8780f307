r"""Licence scans by a trained paragraph classifier, in DataFrame expressions alone on the main path.

A paragraph is a line of a text. Its words are runs of `[a-z0-9]` (joined by `.`, `+`, `-`) after lower-casing; its features are
the distinct word 1- to 3-grams. A sparse softmax regression over them gives each licence family and the class `unknown` a
probability. It is trained on the driver, on passages of public licences (`PASSAGES`), on notices made from licence names and phrases
(`NAMES`, `PHRASES`), both with cut-outs, against `unknown` paragraphs: fixed look-alikes, licence words among them, and distinct
lines of the input. These lines are the bounded, labelled sample: at most ``negative_rows``, the least by a hash, of texts drawn by a
hash; each is read whole, copies count once, and only lines that a notice covers are left out. The softmax temperature, fitted on
held-out rows, calibrates `unknown`.

n-grams all of whose words are common in the input are no features: a word of the (bounded) vocabulary is common if there is a text
that has it for every hundred lines. These counts cover all words of all texts, in one aggregation. Licence words (`KEYWORDS`) are never common, so a
corpus of source files is scanned like any other. L1 leaves few weights.

A paragraph without any weighted n-gram is `unknown` by the offsets alone, and every weighted n-gram has one word in a small
trigger set, so texts and lines without a trigger word are passed over; no verdict changes by that.

A paragraph is flagged when its best class is a family with probability >= ``min_probability``, and confirmed when it shares at least
three distinct words (all, of a name of two) and half of the shorter one's, function words apart, with a passage or a licence name of that family.

Edge cases: null and empty text have no paragraph and get no family; very long texts and single-line texts are whole; repeated
rows are scanned row by row; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .quality_cascade import _let

NEGATIVE_ROWS = 2_000
MIN_PROBABILITY = 0.5
UNKNOWN = "unknown"
#: A word is common if a text has it for every so many lines; of a small input, as if it had LEAST_LINES lines.
COMMON = 100
LEAST_LINES = 10_000

#: Passages of public licences (fixed values).
PASSAGES: dict[str, tuple[str, ...]] = {
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "cc": (
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "proprietary": (
        "Copyright. All rights reserved.", "All rights reserved.",
        "No part of this publication may be reproduced, stored in a retrieval system or transmitted without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}

#: Names of licences (fixed values).
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("MIT License", "MIT licence", "Expat License"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Software License"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License v2 or later", "GNU GPL v3", "GPL version 2", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "GNU Affero General Public License", "GNU AGPL v3"),
    "cc": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 license", "Creative Commons Attribution-NonCommercial 4.0", "CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY-NC-SA 3.0", "CC0 1.0 Universal"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD license"),
    "mpl": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
}
PHRASES = (
    "Licensed under the {}.", "Released under {}.", "This project is licensed under the terms of the {}.", "This work is licensed under a {}.", "Distributed under the {}.",
    "{}", "See LICENSE for the {}.", "License: {}", "This file comes under the {}.", "All source of this repository is under {}, like its documents.",
)
#: SPDX short names (fixed values).
SPDX = {"mit": ("MIT",), "apache-2.0": ("Apache-2.0",), "gpl": ("GPL-2.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "AGPL-3.0-only"), "cc": ("CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0"), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "mpl": ("MPL-2.0",)}
#: Words that tell of licences and are never common (fixed values).
KEYWORDS = frozenset(
    "license licence licensed licenses licensing copyright reserved spdx-license-identifier apache apache-2.0 mit expat gnu gpl lgpl agpl gplv3 affero mozilla mpl bsd redistribution redistributions creative commons cc cc0 by-nc by-sa by-nc-sa creativecommons.org".split()
)

LOOK_ALIKES = (
    "The driver must hold a valid license.", "A licence fee is due at the end of the month.", "She was released under pressure.", "This work is on show in the north hall.",
    "He studied at MIT for two years.", "The general public was not admitted.", "Permission to land was refused.", "Version 2.0 of the program came out in May.", "The apache helicopters left.",
    "You can find the source in the code form below.", "They reserved all the tables.", "No rights were granted to the tenants.", "Use of the software is not free of charge.", "The terms are listed on the next page.",
    "Their common creative work is well known.", "The foundation published its report.", "Conditions were met in both forms.", "The project is under way.", "This program is about birds.",
    "The licensed dealer sold the car.", "A fishing license costs ten pounds.", "The judge ruled on the copyright of the song.", "All seats in the front row are reserved.", "The club lost its licence to serve wine.",
    "His licence number was read out.", "They license the brand to others.", "The public house has a late license.", "Copyright law was debated for a year.", "Licensing hours end at ten.", "GNU stands for an animal as well.",
    "The gnu and the zebra share the plain.", "A marriage license was issued in May.", "The house of commons met.", "Mozilla was the name of a project.", "The license plate was missing.", "A creative license to change the plot.",
    "Sie kam mit dem Zug.", "Komm mit uns nach Hause.", "Er spricht mit der Frau.",
)

#: Words that confirm nothing (fixed values).
FUNCTION_WORDS = tuple("a an and any as at be by for from if in is it may no not of on or such that the this to under which with you your".split())

_WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def ngrams(w: list[str]) -> set[str]:
    return {" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}


def notices(families: tuple[str, ...], phrases: tuple[str, ...] = PHRASES, passages: dict[str, tuple[str, ...]] = PASSAGES) -> list[tuple[str, str]]:
    """(family, paragraph) of the training set."""
    out = [(f, p) for f in families for p in passages.get(f, ())]
    out += [(f, phrase.format(name)) for f in families for name in NAMES.get(f, ()) for phrase in phrases]
    return out + [(f, form.format(x)) for f in families for x in SPDX.get(f, ()) for form in ("SPDX-License-Identifier: {}", "license = {}")]


def vocabulary(rows: list[tuple[str, str]]) -> list[str]:
    """The words of the notices."""
    return sorted({w for _, p in rows for w in words(p)})


def covers(w: set[str], n: set[str]) -> bool:
    """n: a template, without function words."""
    w = w.difference(FUNCTION_WORDS)
    both = len(w & n)
    return both >= min(3, len(n)) and 2 * both >= min(len(w), len(n))


#: Weights of examples in training.
WHOLE_PASSAGE_WEIGHT, WHOLE_NOTICE_WEIGHT, LOOK_ALIKE_WEIGHT = 12.0, 8.0, 40.0


class Model:
    """classes; offsets; weights of n-grams for each class; trigger words; notices as word sets. counts: how many of all texts, of
    `lines` lines, have each word of the vocabulary."""

    def __init__(self, negatives: list[str], counts: dict[str, int], lines: int, rows: list[tuple[str, str]] | None = None, seed: int = 5, rounds: int = 1200, l1: float = 5e-5):
        rng = np.random.default_rng(seed)
        known = notices(tuple(PASSAGES)) if rows is None else rows
        families = sorted({f for f, _ in known})
        self.classes = [*families, UNKNOWN]
        unknown = len(families)
        # templates of the confirmation: passages and names, without the phrases around them
        self.notices = {f: [sorted(set(words(p)).difference(FUNCTION_WORDS)) for p in [p for g, p in known if g == f and p in PASSAGES.get(f, ())] + list(NAMES.get(f, ()))] for f in families}
        examples: list[tuple[frozenset[str], int, float]] = []
        for f, p in known:
            w = words(p)
            k = families.index(f)
            whole = p in PASSAGES.get(f, ())
            examples.append((frozenset(ngrams(w)), k, WHOLE_PASSAGE_WEIGHT if whole else WHOLE_NOTICE_WEIGHT))
            # cut-outs that keep much of a notice; a passage has more of them, as its words say the same only together
            for _ in range((24 if whole else 6) if len(w) > 4 else 0):
                size = int(rng.integers(max(4, int((0.4 if whole else 0.5) * len(w))), len(w) + 1))
                at = int(rng.integers(0, len(w) - size + 1))
                examples.append((frozenset(ngrams(w[at : at + size])), k, 2.5 if whole else 1.5))
        templates = [set(n) for own in self.notices.values() for n in own]
        own = [n for n in sorted(set(negatives)) if not any(covers(set(words(n)), t) for t in templates)]
        examples += [(frozenset(ngrams(words(x))), unknown, LOOK_ALIKE_WEIGHT) for x in LOOK_ALIKES] + [(frozenset(ngrams(words(n))), unknown, 1.0) for n in own]
        common = {w for w, n in counts.items() if n * COMMON >= max(lines, LEAST_LINES) and w not in KEYWORDS}
        features = sorted(g for g in set().union(*(g for g, k, _ in examples if k != unknown)) if not all(w in common for w in g.split(" ")))
        at = {g: i for i, g in enumerate(features)}
        merged: dict[tuple[tuple[int, ...], int], float] = {}
        stated = set()  # look-alikes and whole notices are always learned
        for g, k, weight in examples:
            key = (tuple(sorted(at[t] for t in g if t in at)), k)
            merged[key] = merged.get(key, 0.0) + weight
            if weight in (LOOK_ALIKE_WEIGHT, WHOLE_PASSAGE_WEIGHT, WHOLE_NOTICE_WEIGHT):
                stated.add(key)
        x = np.zeros((len(merged), len(features)), np.float32)
        for i, (own_at, _) in enumerate(merged):
            x[i, list(own_at)] = 1 / max(np.sqrt(len(own_at)), 1)
        y = np.array([k for _, k in merged])
        weight = np.array(list(merged.values()), np.float32)
        test = (rng.random(len(y)) < 0.2) & np.array([key not in stated for key in merged], bool)
        share = np.bincount(y, weight, len(self.classes))
        each = (weight / (len(self.classes) * np.maximum(share[y], 1))).astype(np.float32)
        w, b = np.zeros((len(features), len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        b[unknown] = 1.0
        target = np.eye(len(self.classes), dtype=np.float32)[y]
        train = np.flatnonzero(~test)
        xt, tt, et = x[train], target[train], each[train][:, None]
        for step in range(rounds):
            z = xt @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - tt) * et
            rate = np.float32(8.0 / (1 + step / 200))
            w -= rate * (xt.T @ g)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * np.float32(l1), 0)
            b -= rate * g.sum(0)
        b[unknown] = max(b[unknown], b[:-1].max() + 1.0)  # nothing known is unknown
        z = (x[test] @ w + b).astype(np.float64)
        grid = [0.5, 0.75, 1, 1.5, 2, 3, 4, 6]
        loss = [float((np.log(np.exp(t * (z - z.max(1, keepdims=True))).sum(1)) - t * (z - z.max(1, keepdims=True))[np.arange(len(z)), y[test]]).mean()) for t in grid]
        t = grid[int(np.argmin(loss))] if len(z) else 1.0
        self.b = b.astype(np.float64) * t
        used = np.flatnonzero((np.abs(w) > 1e-4).any(1))
        self.weights = {features[i]: (w[i].astype(np.float64) * t).round(5).tolist() for i in used}
        rarest = lambda g: min(g.split(" "), key=lambda v: (counts.get(v, 0), -len(v), v))
        self.triggers = sorted({rarest(g) for g in self.weights})

    def probabilities(self, text: str) -> dict[str, float]:
        """What the Spark expression computes, for one paragraph."""
        g = [self.weights[t] for t in ngrams(words(text)) if t in self.weights]
        z = self.b + (np.sum(g, 0) / max(np.sqrt(len(g)), 1) if g else 0)
        p = np.exp(z - z.max())
        return dict(zip(self.classes, (p / p.sum()).tolist(), strict=True))


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(x: list[str]) -> str:
    return f"array({', '.join(map(_quoted, x))})" if x else "cast(array() as array<string>)"


def _line_words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{_WORD}', 0)"


def fit(docs: DataFrame, *, text_col: str = "text", negative_rows: int = NEGATIVE_ROWS) -> Model:
    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # in how many of all texts the words of the notices occur
    rows = notices(tuple(PASSAGES))
    n = text.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("length(text) - length(replace(text, '\n', '')) + 1")).alias("lines")).first()
    found = text.select(F.explode(F.expr(f"array_intersect({_line_words('text')}, {_strings(vocabulary(rows))})")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.w: r.n for r in found.collect()}  # as many rows as the vocabulary has words, at most
    # distinct lines of texts drawn by a hash, the least by a hash of their own: whatever the copies, no more than negative_rows
    share = min(1.0, negative_rows / max(n["n"], 1))
    drawn = text.where(F.pmod(F.xxhash64("text", F.lit("licence sample")), F.lit(1 << 30)) <= int(share * (1 << 30)))
    lines = drawn.select(F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(r"\p{L}")).distinct()
    least = lines.orderBy(F.xxhash64("l", F.lit("line")), "l").limit(negative_rows)
    return Model([r.l for r in least.collect()], counts, n["lines"] or 0, rows)


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id; paragraphs: array of flagged ones (line, family, probability, confirmed), in order of line."""
    k = len(model.classes)
    found = _line_words("l")
    # the vocabulary is bounded by the built-in notices: a literal map
    keys = _strings(list(model.weights))
    values = "array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in w) + ")" for w in model.weights.values()) + ")"
    grams = "(concat(w, transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> concat(x, ' ', w[i + 1])), transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> concat(x, ' ', w[i + 1], ' ', w[i + 2]))))"
    zero = "array(" + ", ".join(["0.0D"] * k) + ")"
    offset = "array(" + ", ".join(f"{float(v)!r}D" for v in model.b) + ")"
    # the intersection is by hash; the weights of the few n-grams in it come from a parallel array, by position
    hits = f"transform(array_intersect({grams}, {keys}), g -> element_at({values}, cast(array_position({keys}, g) as int)))"
    logits = _let("v", hits, f"zip_with(aggregate(v, {zero}, (a, b) -> zip_with(a, b, (x, y) -> x + y)), {offset}, (x, y) -> x / greatest(sqrt(size(v)), 1D) + y)")
    softmax = _let("z", logits, _let("e", "transform(z, x -> exp(x - array_max(z)))", "transform(e, x -> x / aggregate(e, 0D, (a, b) -> a + b))"))
    cover = "size(array_intersect(w, n)) >= least(3, size(n)) AND 2 * size(array_intersect(w, n)) >= least(size(w), size(n))"
    notices = "CASE " + " ".join(f"WHEN family = {_quoted(f)} THEN array({', '.join(_strings(n) for n in model.notices[f])})" for f in model.classes[:-1]) + " ELSE cast(array() as array<array<string>>) END"
    verdict = _let("p", softmax, f"named_struct('line', i + 1, 'family', element_at({_strings(model.classes)}, cast(array_position(p, array_max(p)) as int)), 'probability', array_max(p), 'words', w)")
    line = f"CASE WHEN arrays_overlap(w, {_strings(model.triggers)}) THEN {verdict} END"
    lines = f"filter(transform(split(text, '\\n'), (l, i) -> {_let('w', found, line)}), x -> x IS NOT NULL AND x.family != '{UNKNOWN}' AND x.probability >= {min_probability}D)"
    shown = f"named_struct('line', x.line, 'family', family, 'probability', x.probability, 'confirmed', exists({notices}, n -> {cover}))"
    telling = f"array_except(x.words, {_strings(list(FUNCTION_WORDS))})"
    confirm = f"transform(flagged, x -> {_let('w', telling, _let('family', 'x.family', shown))})"
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # texts without a trigger word need no line by line work
    gate = f"arrays_overlap({_line_words('text')}, {_strings(model.triggers)})"
    none = "cast(array() as array<struct<line:int,family:string,probability:double,words:array<string>>>)"
    flagged = source.select("doc_id", F.expr(f"CASE WHEN {gate} THEN {lines} ELSE {none} END").alias("flagged"))
    return flagged.select("doc_id", F.expr(confirm).alias("paragraphs"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_flagged, n_confirmed, families (of confirmed paragraphs, sorted, comma-joined), probability of the best confirmed one."""
    own = F.filter("paragraphs", lambda x: x["confirmed"])
    return found.select(
        "doc_id", F.size("paragraphs").cast("long").alias("n_flagged"), F.size(own).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(own, lambda x: x["family"]))), ",").alias("families"),
        F.round(F.coalesce(F.array_max(F.transform(own, lambda x: x["probability"])), F.lit(0.0)), 6).alias("probability"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return report(scan(docs, fit(docs)))
