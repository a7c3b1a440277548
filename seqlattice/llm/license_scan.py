"""License scans by a trained paragraph classifier.

Paragraphs (lines) become sets of word n-grams (1 to 3 words) of a vocabulary
taken from licence notices. A sparse multinomial logistic regression over them
tells the licence families, notices of no known family (``unknown``) and plain
text (``none``) apart. It is trained here, from the notices below with random
words dropped, joined and put among background words, and from a bounded sample
of the corpus's own paragraphs as plain text; n-grams common in the sample's plain
paragraphs (no notices) are no features, unless a template would be left with none.
A temperature and an acceptance level are fitted on wordings that were not learnt:
in each of ``FOLDS`` rounds every ``FOLDS``-th notice of a class and every
``FOLDS``-th plain line are left out whole, and a classifier trained on the rest
reads them. The level is the least one, 0.5 or more, at which at most
``FALSE_RATE`` of the unknown and plain rows among these are accepted and confirmed.
``Model.report`` has the figures of these rounds. A family accepted by the classifier is confirmed by comparison: at least
``CONFIRM`` of the n-grams of some template of the family must be in the
paragraph. A paragraph that reads like a licence but is not confirmed is
``unknown``. Paragraphs are single lines and, for wrapped notices, runs of up to
``WRAPPED`` neighbouring lines, whose n-grams go on over one line's end; of
confirmed runs that share lines the one with most of a template counts, and lines next to them that are not
confirmed belong to them. Neighbouring unknown lines are one paragraph.

Scanning is DataFrame functions only: n-grams are generated, hashed and joined
with the vocabulary (a few thousand rows, broadcast; bounded by the templates,
not the data) in one pass over whole texts; only the ids of n-grams found move,
as one set for each line that has any, with those of the lines after it.

Plain lines for training are ``PLAIN_LINES`` of those of at most ``SAMPLE_DOCS``
documents of at most ``SAMPLE_CHARS`` characters, drawn by a seeded shuffle.

Edge cases: null and empty texts have no paragraphs; sets make repeated n-grams
and repeated rows harmless, as rows are told apart by id and text hash; null ids
are kept; of families alike in probability the last by name is taken; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
PLAIN_LINES = 1500
FOLDS = 3
#: Training rows made of each notice.
VARIANTS = 24
COMMON = 0.005
CONFIRM = 0.6
FALSE_RATE = 0.001
GRAMS = 3
#: Lines over which a notice may be wrapped, to be read as one.
WRAPPED = 8

#: Wordings of the notices by which licences are declared.
TEMPLATES = {
    "agpl": [
        "licensed under the GNU Affero General Public License version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is licensed under the Apache License 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This project is licensed under the BSD 3-Clause License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution and reproduction in any medium, provided the original work is properly credited.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Licensed under the GPL v2 or later.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "licensed under the GNU Lesser General Public License version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the LGPL v3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This project is licensed under the terms of the MIT license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Licensed under CC0 1.0 Universal.",
        "This work has been placed in the public domain by its author.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "unknown": [
        "Licensed under the terms of the Acme Software License Agreement.",
        "All rights reserved. Use is subject to the terms of the license agreement.",
        "Released under a proprietary license; redistribution is not permitted.",
        "This work is licensed under its own terms, see the LICENSE file.",
        "Distributed under a custom license, version 1.",
        "Licensed under the Example Community License, see the accompanying terms.",
        "This software may be used only under the terms of a separate commercial license.",
        "Permission is granted to use this material for internal evaluation only.",
        "This file is part of a product covered by the end user license agreement of the vendor.",
        "Free for personal use; a license must be bought for commercial use.",
        "The contents of this file are subject to the license terms in the accompanying file.",
        "Published under the house license of the institute, all other rights reserved.",
        "Copies may be made for teaching with permission of the copyright owner.",
    ],
    "none": [
        "the driver must show a valid license at the border",
        "version two of the report was released under pressure last week",
        "permission to build was granted by the public works office",
        "the general public is free to use the library at any time",
        "she has a license to drive heavy vehicles since last year",
        "the public works of the city were redistributed among the districts",
        "software for the general public was shown at the fair",
    ],
}
CLASSES = sorted(TEMPLATES)
FAMILIES = [c for c in CLASSES if c not in ("none", "unknown")]
#: Not a separator: letters, digits, and points inside numbers.
TOKEN = r"[^\p{L}\p{N}.]+|\.(?![0-9])|(?<![0-9])\."


def _tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w.]+|_|\.(?![0-9])|(?<![0-9])\.", text.lower()) if w]


def _hash(words: list[str]) -> int:
    """The hash that the n-gram's column expression gives."""
    at = xxhash.xxh64_intdigest(len(words).to_bytes(8, "little"), 42)
    for word in words:
        at = xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(word.encode(), 42).to_bytes(8, "little"), at)
    return at - (1 << 64) if at >> 63 else at


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def background(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[list[str]]:
    """Words of the paragraphs of a bounded sample of documents."""
    ids = docs.select(F.col(id_col).alias("__id")).filter("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_DOCS)
    rows = docs.join(F.broadcast(ids), F.col(id_col) == F.col("__id"), "left_semi").filter(F.length(text_col) <= SAMPLE_CHARS)  # at most SAMPLE_DOCS ids
    lines = [_tokens(line) for row in rows.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t").limit(2 * SAMPLE_DOCS).collect() for line in row.t.split("\n")]
    return [x for x in lines if x]


class Model:
    """Vocabulary with its hashes, weights by class, calibration, and the templates as sets of n-grams."""

    def __init__(self, lines: list[list[str]], seed: int = 5):
        rng = np.random.default_rng(seed)
        texts = {c: [_tokens(t) for t in TEMPLATES[c]] for c in CLASSES}
        full = [_grams(words) for c in CLASSES if c != "none" for words in texts[c]]
        # Plain text: lines of the sample that hold less than half of any template. A frequent notice is none, so it keeps its n-grams.
        plain = [x for x in lines if not any(2 * len(t & g) >= len(t) for g in (_grams(x),) for t in full)]
        spread: dict[tuple[str, ...], int] = {}
        for line in plain:
            for g in _grams(line):
                spread[g] = spread.get(g, 0) + 1
        common = {g for g, n in spread.items() if n > COMMON * max(len(plain), 200)}
        # A template of common n-grams only keeps all of them.
        self.vocabulary = sorted({g for t in full for g in (t - common or t)})
        self.index = {g: i for i, g in enumerate(self.vocabulary)}
        noise = [w for x in plain for w in x] or ["lorem", "ipsum", "dolor", "sit", "amet"]
        rows, truth, fold = [], [], []
        for c in CLASSES:
            for t, words in enumerate(texts[c]):
                for k in range(VARIANTS):
                    kept = [w for w in words if k == 0 or rng.random() > 0.1 * (k % 4) / 3]
                    around = [noise[i] for i in rng.integers(0, len(noise), 2 * int(rng.integers(0, 12)))] if k % 3 == 2 else []
                    half = len(around) // 2
                    rows.append(self.ids([*around[:half], *kept, *around[half:]]))
                    truth.append(CLASSES.index(c))
                    fold.append(t % FOLDS)
        for t, i in enumerate(rng.permutation(len(plain))[:PLAIN_LINES]):
            rows.append(self.ids(plain[i]))
            truth.append(CLASSES.index("none"))
            fold.append(t % FOLDS)
        self.templates = [(c, sorted(ids)) for c in FAMILIES for words in texts[c] if (ids := self.ids(words))]
        truth, fold = np.array(truth), np.array(fold)
        self.temperature, self.level, self.report = self._calibrate(rows, truth, fold)
        self.weights = self._train(rows, truth)

    def _calibrate(self, rows: list[set[int]], truth: np.ndarray, fold: np.ndarray) -> tuple[float, float, dict[str, float]]:
        """Temperature and level from notices and lines that were left out whole, and what they give there."""
        z, y, read = [], [], []
        for f in range(FOLDS):
            out = np.flatnonzero(fold == f)
            some = np.flatnonzero(fold != f)[::3]  # a third of the variants is enough for this
            self.weights = self._train([rows[i] for i in some], truth[some])
            z += [self.logits(rows[i]) for i in out]
            y += [truth[i] for i in out]
            read += [rows[i] for i in out]
        z, y = np.array(z), np.array(y)
        loss = lambda t: -np.log(self._softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        temperature = float(min([2.0**k for k in np.arange(-2, 3.01, 0.25)], key=loss))
        p = self._softmax(z / temperature)
        families = np.array([CLASSES.index(c) for c in FAMILIES])
        best = families[p[:, families].argmax(axis=1)]
        share = {c: [set(ids) for name, ids in self.templates if name == c] for c in FAMILIES}
        confirmed = np.array([max(len(ids & t) / len(t) for t in share[CLASSES[b]]) >= CONFIRM for ids, b in zip(read, best, strict=True)])
        known = np.isin(y, families)
        wrong = np.sort(np.where(confirmed, p.max(axis=1, where=np.isin(np.arange(len(CLASSES)), families), initial=0), 0)[~known])
        level = float(max(0.5, np.nextafter(wrong[int((1 - FALSE_RATE) * (len(wrong) - 1))], 1)))
        plain = y == CLASSES.index("none")
        return temperature, level, {
            "families_right": float((best == y)[known].mean()), "plain_right": float((p.argmax(axis=1) == y)[plain].mean()), "false_accepted": float((wrong >= level).mean()),
        }


    def ids(self, words: list[str]) -> set[int]:
        return {self.index[g] for g in _grams(words) if g in self.index}

    def logits(self, ids: set[int]) -> np.ndarray:
        return self.weights[-1] + self.weights[sorted(ids)].sum(axis=0)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def _train(self, rows: list[set[int]], truth: np.ndarray, steps: int = 150, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
        x = np.zeros((len(rows), len(self.vocabulary) + 1), np.float32)
        for i, ids in enumerate(rows):
            x[i, sorted(ids)] = 1
        x[:, -1] = 1
        goal = np.eye(len(CLASSES), dtype=np.float32)[truth]
        share = 1 / np.bincount(truth, minlength=len(CLASSES)).clip(1)[truth]
        share = (share / share.sum()).astype(np.float32)[:, None]
        w = np.zeros((x.shape[1], len(CLASSES)), np.float32)
        total = np.full_like(w, 1e-8)
        for _ in range(steps):
            g = x.T @ (share * (self._softmax(x @ w) - goal)) + ridge * w
            total += g * g
            w -= rate * g / np.sqrt(total)
        return np.round(w, 5)


def _lookup(values) -> Column:
    """A numeric array as a constant of the plan."""
    return F.split(F.lit(",".join(str(x) for x in values)), ",").cast("array<double>")


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence paragraphs: id, text_hash, line, family (or ``unknown``), score, matched (share of the template found)."""
    spark = docs.sparkSession
    lookup = spark.createDataFrame([(_hash(list(g)), i) for i, g in enumerate(model.vocabulary)], "key long, gram int")
    lines = F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "\n", -1)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), lines.alias("lines"))
    after = F.concat(F.slice("lines", 2, F.size("lines")), F.array(F.lit("")))
    rows = rows.select("id", "text_hash", F.posexplode(F.arrays_zip(F.col("lines").alias("words"), after.alias("after"))).alias("line", "both"))
    hashes = lambda x: F.transform(F.array_remove(x, ""), lambda w: F.xxhash64(w))
    # n-grams may end in the next line: its first words, by a split that stops there.
    rows = rows.select("id", "text_hash", "line", hashes(F.split("both.words", TOKEN)).alias("own"), F.slice(hashes(F.slice(F.split("both.after", TOKEN, GRAMS + 1), 1, GRAMS)), 1, GRAMS - 1).alias("tail"))
    rows = rows.select("id", "text_hash", "line", F.size("own").alias("n"), F.concat("own", "tail").alias("h"))
    rows = rows.select("*", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))).alias("at"))
    keys = F.array(*(F.when(F.col("at") + n <= F.size("h"), F.struct(_chain([F.get("h", F.col("at") + i) for i in range(n)]).alias("key"), (F.col("line") + F.when(F.col("at") + n > F.col("n"), 1).otherwise(0)).alias("last"))) for n in range(1, GRAMS + 1)))
    found = rows.select("id", "text_hash", "line", F.explode(keys).alias("k")).filter("k is not null").select("id", "text_hash", "line", "k.last", "k.key").join(F.broadcast(lookup), "key")  # the vocabulary

    # Windows: each line that has n-grams, and runs of up to WRAPPED lines from it.
    starts = found.select("id", "text_hash", "line", "last", "gram", F.explode(F.sequence(F.greatest(F.lit(0), F.col("last") - (WRAPPED - 1)), F.col("line"))).alias("from"))
    sets = starts.groupBy("id", "text_hash", "from").agg(F.collect_set(F.struct("line", "last", "gram")).alias("found")).filter(F.exists("found", lambda x: x["line"] == F.col("from")))
    wide = sets.select("id", "text_hash", "from", "found", F.explode(F.array_distinct(F.concat(F.array("from"), F.transform("found", lambda x: x["last"])))).alias("to"))
    grams = F.sort_array(F.array_distinct(F.transform(F.filter("found", lambda x: x["last"] <= F.col("to")), lambda x: x["gram"])))
    wide = wide.select("id", "text_hash", "from", "to", grams.alias("grams")).filter(F.size("grams") > 0)
    # A longer run counts if it holds enough of a template; then only are the classes weighed.
    wide = wide.filter((F.col("to") == F.col("from")) | (_held(F.col("grams"), model) >= CONFIRM))
    read = wide.select("id", "text_hash", "from", "to", "grams", F.explode(F.filter(F.array(_verdict(F.col("grams"), model)), lambda v: v["plain"] < 0.5)).alias("v"))
    read = read.withColumn("held", _matched(F.col("grams"), F.col("v.family"), model, counts=True)).drop("grams")
    read = read.withColumn("sure", (F.col("v.p") >= model.level) & (F.col("v.matched") >= CONFIRM)).filter(F.col("sure") | (F.col("to") == F.col("from")))

    # Of sure windows that share lines, that with most n-grams of a template counts, then the shortest, after windows are dropped whose part has as many.
    doc = Window.partitionBy("id", "text_hash")
    near = doc.orderBy("from").rangeBetween(1 - WRAPPED, WRAPPED - 1)
    rank = F.struct("held", (F.col("from") - F.col("to")).alias("length"), (-F.col("from")).alias("first"))
    read = read.withColumn("rank", rank).withColumn("others", F.collect_list(F.when(F.col("sure"), F.struct("from", "to", "rank"))).over(near))
    read = read.withColumn("short", F.col("sure") & ~F.exists("others", lambda o: (o["from"] >= F.col("from")) & (o["to"] <= F.col("to")) & (o["rank"] > F.col("rank")))).filter("short or not sure")
    read = read.withColumn("others", F.collect_list(F.when(F.col("sure"), F.struct("from", "to", "rank"))).over(near))
    read = read.filter(~F.exists("others", lambda o: (o["from"] <= F.col("to")) & (o["to"] >= F.col("from")) & (~F.col("sure") | (o["rank"] > F.col("rank")))))
    # Other lines are unknown. Adjoining lines and windows are one paragraph; a notice of one line is a paragraph by itself.
    by = doc.orderBy("from", "to")
    read = read.withColumn("alone", F.col("sure") & (F.col("to") == F.col("from")))
    apart = F.col("alone") | F.lag("alone", 1, True).over(by) | (F.col("from") > F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1)) + 1)
    read = read.withColumn("apart", apart.cast("int")).withColumn("paragraph", F.sum("apart").over(by))
    read = read.withColumn("known", F.max("sure").over(Window.partitionBy("id", "text_hash", "paragraph"))).filter(F.col("sure") == F.col("known"))
    family = F.when(F.col("sure"), F.col("v.family")).otherwise("unknown").alias("family")
    return read.groupBy("id", "text_hash", "paragraph", family).agg(F.min("from").alias("line"), F.max("v.p").alias("score"), F.max("v.matched").alias("matched")).drop("paragraph")


def _shares(grams: Column, model: Model, family: Column | None = None) -> Column:
    """``share`` and ``n`` of the n-grams found of each template, of one family or all."""
    rows = json.dumps([{"family": c, "ids": ids} for c, ids in model.templates])
    templates = F.from_json(F.lit(rows), "array<struct<family:string,ids:array<int>>>")  # folded to a constant
    chosen = templates if family is None else F.filter(templates, lambda t: t["family"] == family)
    found = F.transform(chosen, lambda t: F.struct(F.size(F.array_intersect(grams, t["ids"])).cast("double").alias("n"), F.size(t["ids"]).alias("of")))
    return F.transform(found, lambda x: F.struct((x["n"] / x["of"]).alias("share"), x["n"].alias("n")))


def _held(grams: Column, model: Model) -> Column:
    """The greatest share of any template found."""
    return F.coalesce(F.array_max(F.transform(_shares(grams, model), lambda x: x["share"])), F.lit(0.0))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _verdict(grams: Column, model: Model) -> Column:
    """Best family with its probability, the probability of plain text, and the share of a template found."""
    n = len(CLASSES)
    table = _lookup((model.weights[:-1] / model.temperature).ravel())
    bias = _lookup(model.weights[-1] / model.temperature)
    logit = lambda k: F.get(bias, k) + F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(table, g * n + k))
    families = F.array(*(F.lit(c) for c in FAMILIES))
    at = F.array(*(F.lit(CLASSES.index(c)) for c in FAMILIES))

    def choose(z: Column) -> Column:
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        best = F.array_max(F.transform(at, lambda k, j: F.struct(F.get(z, k).alias("z"), F.get(families, j).alias("family"))))
        return _let(best, lambda b: F.struct(
            (F.exp(b["z"] - top) / total).alias("p"), b["family"].alias("family"),
            (F.exp(F.get(z, F.lit(CLASSES.index("none"))) - top) / total).alias("plain"), _matched(grams, b["family"], model).alias("matched"),
        ))

    return _let(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), logit), choose)


def _matched(grams: Column, family: Column, model: Model, counts: bool = False) -> Column:
    """The greatest share of a template of the family, or number of n-grams of a template that is held by ``CONFIRM``."""
    best = F.transform(_shares(grams, model, family), lambda x: F.when(x["share"] >= CONFIRM, x["n"]) if counts else x["share"])
    return F.coalesce(F.array_max(best), F.lit(0.0))


def _chain(parts: list[Column]) -> Column:
    """Hash of the number of words and the words' hashes."""
    return F.xxhash64(F.lit(len(parts)).cast("long"), *parts)


def licences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, families (sorted, comma-joined), n_licence and n_unknown paragraphs."""
    known = F.col("family") != "unknown"
    found = scan(docs, model, id_col, text_col).groupBy("id", "text_hash").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(known, F.col("family")))), ",").alias("families"),
        F.count(F.when(known, 1)).alias("n_licence"), F.count(F.when(~known, 1)).alias("n_unknown"), F.max(F.when(known, F.col("score"))).alias("score"),
    )
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"))
    out = rows.join(found, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__hash") == F.col("text_hash")), "left")
    return out.select(F.col("__id").alias(id_col), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_licence", F.lit(0)).alias("n_licence"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), "score")


def op9_license(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return licences(docs, Model(background(docs)))
