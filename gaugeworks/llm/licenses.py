"""Licence scan: a trained paragraph classifier with template confirmation, in DataFrame operations.

A paragraph is a line together with the lines wrapped from it: a line of more than 32 characters goes on in the next one, comment marks left out, unless it ends a
sentence or the next is blank.  A multinomial logistic regression over distinct word uni- and bigrams, made
sparse by L1, separates licence families from an unknown class.  Training examples are the templates below, varied by
rule, against texts that merely mention licences; its probabilities are calibrated by
a temperature fitted on other wordings that training does not see, and the unknown class is taken to be ``UNKNOWN_ODDS`` times as frequent
as in training.  A prediction is confirmed when enough of one
template's bigrams occur in the paragraph.

Only paragraphs with an anchor word are scored.  Anchors are chosen from the trained weights so that
no paragraph without one can reach probability 1/2 for any family: the filter loses nothing.

Defined results: null, empty or anchorless texts have no rows; repeated rows give their rows again;
a null id is carried; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Customary notices of each family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC0-1.0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
#: Other wordings, kept out of training and used for calibration only.
HELD_OUT = {
    "MIT": ["The code is available under the MIT license, see the file LICENSE.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software, licensed under MIT."],
    "Apache-2.0": ["Distributed under the terms of the Apache License 2.0, a copy of the License is included."],
    "GPL-3.0": ["You can redistribute this program under the GNU General Public License version 3 or any later version."],
    "GPL-2.0": ["This file may be used under the terms of the GNU General Public License version 2."],
    "LGPL-3.0": ["The library is distributed under the GNU Lesser General Public License version 3."],
    "AGPL-3.0": ["The server is free software under the GNU Affero General Public License version 3."],
    "CC-BY-NC-4.0": ["Content is available under a Creative Commons Attribution-NonCommercial 4.0 licence (CC BY-NC 4.0)."],
    "CC-BY-SA-4.0": ["Content is available under the Creative Commons Attribution-ShareAlike 4.0 licence (CC BY-SA 4.0)."],
    "CC-BY-4.0": ["The figures are available under a Creative Commons Attribution 4.0 licence (CC BY 4.0)."],
    "CC0-1.0": ["The data are in the public domain, CC0 1.0 Universal applies to this work."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD 3-Clause license; redistribution in binary form must reproduce the above notice."],
    "ISC": ["The software is provided under the ISC license, to use, copy and distribute with or without fee."],
    "MPL-2.0": ["This file is subject to the Mozilla Public License, version 2.0."],
    "Unlicense": ["The code is free and unencumbered software under the Unlicense, in the public domain."],
    "unknown": [
        "Contact the author for a license to use this work in a commercial product.", "The general terms of the public contract are subject to change in version 4.0.", "This software is provided without a license; all rights are reserved.",
        "The students obtained a copy of the public record free of charge.", "The foundation published a new version of the program for distribution in the city.", "Mit dem Programm und mit der Software kam er gut zurecht.",
    ],
}
#: Texts that use the same words without granting a licence.
OTHERS = [
    "He showed his driving licence to the officer.",
    "The restaurant lost its license to sell alcohol.",
    "Version 2.0 of the report was released to the public in June.",
    "A general public meeting is held in the city hall every year.",
    "The license plate of the car was not readable.",
    "Er kam mit dem Auto und mit seiner Frau nach Hause, mit der Bahn nicht.",
    "Mit der Zeit kam er mit allem zurecht.",
    "Mit ihm.",
    "Una version de la obra es de uso general, cc del autor, y la licencia no.",
    "La version en francais du programme est publique et libre.",
    "Students at MIT published a paper about robots.",
    "The apache helicopter was seen over the base.",
    "Creative work is common in this part of the city.",
    "All rights reserved by the author of the book.",
    "The software was sold under a commercial license agreement.",
    "Please read the terms of use of this site and the privacy policy.",
    "The committee will license new teachers in the spring.",
    "The public version of the file is free of charge.",
    "The and of to in is that was for on are as with they be at this from",
]
#: Words too common to be features of their own.
COMMON = frozenset("a an and are as at be by for from in is it its of on or that the this to under was with you".split())
#: Frequent words of other languages.
FOREIGN = "der die das und mit von ist ein zu nicht la los que en un por con para es le les des et une dans pour sur est du au avec".split()
UNKNOWN_ODDS = 4.0
#: A line break inside a paragraph, with comment marks before the next line's text.
WRAPPED = r"\n(?<=[^\n]{32}[^.!?:;\n \t][ \t]{0,4}\n)[ \t]*(?:(?:[#*;%>]+|//+|--+)[ \t]*)?(?=[^\s#*;%>/-])"
TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams(words: list[str]) -> set[str]:
    return {w for w in words if w not in COMMON} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if not {a, b} <= COMMON}


@dataclass(frozen=True)
class Classifier:
    families: tuple[str, ...]  # unknown is last
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    anchors: tuple[str, ...]


def examples(texts: dict[str, list[str]], seed: int = 23, copies: int = 24) -> list[tuple[list[str], str]]:
    """Every text, and variations with words dropped and foreign words around; and foreign words alone."""
    rng = random.Random(seed)
    filler = [w for t in OTHERS for w in tokens(t)] + FOREIGN
    out: list[tuple[list[str], str]] = [([], UNKNOWN)] * copies
    for family, own in texts.items():
        for text in own:
            words = tokens(text)
            out.append((words, family))
            for _ in range(copies if family != UNKNOWN else copies // 2):
                kept = [w for w in words if rng.random() > 0.08]
                before, after = ([rng.choice(filler) for _ in range(rng.choice((0, 0, 1, 2, 4, 12, 40)))] for _ in range(2))
                out.append((before + kept + after, family))
            if family == UNKNOWN:
                out += [([rng.choice(filler) for _ in range(rng.randrange(3, 60))], family) for _ in range(copies)]
    return out


@lru_cache(maxsize=1)
def train(l1: float = 0.006, rounds: int = 200) -> Classifier:
    """Proximal gradient on the softmax likelihood with equal weight for each class, then a temperature from the held-out wordings."""
    rows, held = examples({**TEMPLATES, UNKNOWN: OTHERS}), examples(HELD_OUT, seed=29, copies=12)
    families = (*TEMPLATES, UNKNOWN)
    vocabulary = {g: i for i, g in enumerate(sorted({g for words, _ in rows for g in grams(words)}))}

    def matrix(of: list[tuple[list[str], str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(of), len(vocabulary)), np.float32)
        for r, (words, _) in enumerate(of):
            x[r, [vocabulary[g] for g in grams(words) if g in vocabulary]] = 1
        return x, np.array([families.index(f) for _, f in of])

    x, y = matrix(rows)
    weight = 1 / np.bincount(y, minlength=len(families))[y][:, None] / len(families)
    w, b, one, step = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families)), np.eye(len(families))[y], 2.0
    for _ in range(rounds):
        g = ((_softmax(x @ w + b) - one) * weight).astype(np.float32)
        b -= step * g.sum(axis=0)
        w -= step * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1 / 4, 0)
    hx, hy = matrix(held)
    logits = hx @ w + b
    heat = min(np.geomspace(0.1, 4, 30), key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(hy)), hy], 1e-12)).mean())
    w, b = w / heat, b / heat
    b[-1] += max(np.log(UNKNOWN_ODDS), b[:-1].max() - b[-1] + 0.5)  # an empty paragraph is of the unknown class
    weights = {g: tuple(round(float(v), 6) for v in w[i]) for g, i in vocabulary.items() if np.abs(w[i]).max() > 1e-6}
    return Classifier(families, tuple(float(v) for v in b), weights, _anchors(weights, b, families))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _anchors(weights: dict[str, tuple[float, ...]], bias: np.ndarray, families: tuple[str, ...]) -> tuple[str, ...]:
    """Words such that n-grams free of them cannot lift any family over the unknown class."""
    gain = {g: [v - w[-1] for v in w[:-1]] for g, w in weights.items()}
    chosen: list[str] = []
    while True:
        left = {g: m for g, m in gain.items() if not set(g.split()) & set(chosen)}
        reach = [bias[f] - bias[-1] + sum(max(m[f], 0) for m in left.values()) for f in range(len(families) - 1)]
        worst = int(np.argmax(reach))
        if reach[worst] < 0:
            return tuple(chosen)
        by_word: dict[str, float] = {}
        for g, m in left.items():
            for word in set(g.split()) - COMMON:
                by_word[word] = by_word.get(word, 0.0) + max(m[worst], 0)
        chosen.append(max(by_word, key=lambda k: (by_word[k], k)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confirm_at: float = 0.6) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of paragraphs with an anchor word."""
    model = train()
    anchor = r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(a) for a in model.anchors) + ")(?![a-z0-9])"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(anchor))
    rows = rows.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", WRAPPED, " "), "\n")).alias("paragraph", "line")).where(F.col("line").rlike(anchor))
    rows = rows.select("doc_id", "paragraph", F.regexp_extract_all(F.lower("line"), F.lit(TOKEN), F.lit(0)).alias("words"))
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))).otherwise(F.array().cast("array<string>"))
    common = lambda w: w.isin(*sorted(COMMON))
    telling = F.filter(pairs, lambda p: ~(common(F.substring_index(p, " ", 1)) & common(F.substring_index(p, " ", -1))))
    rows = rows.select("doc_id", "paragraph", F.array_distinct(pairs).alias("bigrams"), F.array_distinct(F.concat(F.filter("words", lambda w: ~common(w)), telling)).alias("grams"))
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    weights = constant({g: list(w) for g, w in model.weights.items()}, "map<string,array<double>>")
    logits = F.aggregate("grams", F.array(*map(F.lit, model.bias)), lambda a, g: F.when(F.map_contains_key(weights, g), F.zip_with(a, F.element_at(weights, g), lambda x, y: x + y)).otherwise(a))
    rows = rows.select("doc_id", "paragraph", "bigrams", logits.alias("z"))
    rows = rows.select("doc_id", "paragraph", "bigrams", "z", F.array_max("z").alias("top"))
    total = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top")))
    family = F.element_at(F.array(*map(F.lit, model.families)), F.array_position("z", F.col("top")).cast("int"))
    rows = rows.select("doc_id", "paragraph", "bigrams", family.alias("family"), (F.lit(1.0) / total).alias("probability"))
    sets = constant({f: [sorted({" ".join(p) for p in zip(t, t[1:], strict=False)}) for t in map(tokens, texts)] for f, texts in TEMPLATES.items()}, "map<string,array<array<string>>>")
    best = lambda of: F.array_max(F.transform(of, lambda t: F.size(F.array_intersect(t, F.col("bigrams"))) / F.size(t)))
    similarity: Column = F.when(F.col("family") == UNKNOWN, F.lit(0.0)).otherwise(best(F.try_element_at(sets, F.col("family"))))
    rows = rows.select("doc_id", "paragraph", "family", "probability", similarity.alias("similarity"))
    return rows.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("probability") >= 0.5) & (F.col("similarity") >= confirm_at))
