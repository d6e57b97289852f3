"""Operator 1: license scans by a trained paragraph classifier.

A paragraph is a line of a text; a longer line is cut into pieces of PIECE words that overlap by half. The end of a
sentence counts as a word, so that a notice differs from a sentence that goes on. A paragraph's features are its distinct
word n-grams of one to three words. A multinomial logistic regression with a sparse penalty, one class for each licence
family and one for everything else, is trained on the templates below: whole, in part, with words left out and with
strange words around; and on names of licences, with the versions that they come in, in frames of short notices.
Everything else is notices of other licences, also of invented names, sentences that use the
templates' words otherwise, and lines of the corpus (a bounded sample); lines with such words but unlike any template
are among them. Probabilities are calibrated on templates and counter-examples that a fit has not seen: in FOLDS turns a
part of them is left out with all that was made of it. A prediction, of the likeliest family, is confirmed if
the paragraph, or one of its sentences, is like a template of that family, and it counts if its probability against the
unknown class is so high that of what was left out, and confirmed if it is a counter-example, RIGHT are licences from
there on.

Likeness is two-sided: the weight of the common n-grams over that of the side that has more; n-grams that few families
have weigh more, and strange ones most. A part of a long template also counts against the paragraph alone if it has RUN
words in a row in common. A short notice is also compared with a frame around a name: of a sentence that has a name of the
family, the words that are neither of the name nor of frames (FRAME_WORDS, numbers, months) count against it: two are too
many, one for names that mean other things too, such as "MIT" and "Apache", which also need a word of licences beside
them.

Only n-grams with a weight take part, a few hundred, none of them of common words alone; a paragraph without any
of their words is unknown at once. Every line of every text is scored. Notices wrapped over several lines are found in windows of PIECE words, overlapping by
half, over consecutive lines that are not blank: a window adds a family that none of its lines has, and if it is unsure
it is scored again without the lines that are licences by themselves. Lines of a window that are different parts of one
template are one licence, at the first line's offset; lines that repeat each other are several. n_paragraphs counts lines and their pieces, not windows.

Defined cases: a null or empty text has no paragraph and no licence; a very long line is read piece by piece; ties go to
the family that comes first in order; repeated rows get equal results; an empty table is scored by a model without corpus
lines; extra columns take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteql.llm.common import ship, some

#: Notices and characteristic sentences of public licences, by family.
TEMPLATES = {
    "agpl": [
        "GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache-2.0": [
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "This software is released under the 2-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0, non commercial use only.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v2 or later.",
        "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020 The Company. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This document is confidential and proprietary. Unauthorized copying is strictly prohibited.",
    ],
}
#: Sentences with words of licences that are none; fixed values.
OTHERS = [
    "He passed the test and received his driving license in March.",
    "The doctor is licensed to practice in this state under the general rules.",
    "The public library is free of charge and open to any person.",
    "All students have equal rights and a table was reserved for them.",
    "She was released from hospital and granted permission to use the garden.",
    "The Apache people lived in the southern plains.",
    "A copy of the report may be obtained from the office, free of charge.",
    "The software version is 2.0 and the file was distributed to all users.",
    "The MIT campus is in Cambridge and the course is taught there.",
    "Modern creative work is in common use by the general public.",
    "Under the terms of the agreement the company shall publish the source of its income.",
]
#: Notices of licences that are of no family here, and names for more such notices; fixed values.
ELSEWHERE = [
    "Licensed under the Eclipse Public License, version 1.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is provided 'as-is', without any express or implied warranty, under the zlib license.",
    "Licensed under the Artistic License 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Released under the ISC License.",
    "This work is licensed under the Open Font License, version 1.1.",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "This work is licensed under the Academic Free License, version 3.0.",
    "SPDX-License-Identifier: Zlib",
    "This program is licensed under the Microsoft Public License.",
    "The database is made available under the Open Database License.",
    "This program is free software under the terms of the Server Side Public License, version 1.",
    "Released under the Unicode License.",
]
#: Names of licences by family, and the versions that stand for {}; fixed values.
FORMS = {
    "agpl": (["GNU AGPL", "AGPL", "GNU Affero General Public License", "Affero General Public License", "Affero GPL", "AGPLv{}", "AGPL-{}.0", "AGPL-{}.0-only", "AGPL-{}.0-or-later"], "3"),
    "apache-2.0": (["Apache License", "Apache Licence", "Apache Software License", "Apache Public License", "Apache licensed", "Apache 2 license", "Apache 2.0 license", "ASL {}.0", "Apache-{}.0", "Apache {}.0", "Apache v{}", "Apache {}", "Apachev{}"], "2"),
    "bsd": (["BSD License", "BSD Licence", "BSD licensed", "BSD style license", "BSD-style license", "BSD", "BSD-{}-Clause", "BSD {}-Clause", "{}-Clause BSD", "New BSD License", "Simplified BSD License", "Modified BSD License"], "234"),
    "cc-by": (["Creative Commons Attribution", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution ShareAlike", "Creative Commons Attribution Share Alike", "CC BY", "CC-BY", "CC BY-SA", "CC-BY-SA", "CC BY-ND", "CC-BY-{}.0", "CC-BY-SA-{}.0", "CC-BY-ND-{}.0"], "34"),
    "cc-by-nc": (["Creative Commons Attribution-NonCommercial", "Creative Commons Attribution NonCommercial", "Creative Commons Attribution Non-Commercial", "Creative Commons Attribution-NonCommercial-ShareAlike", "Creative Commons Attribution-NonCommercial-NoDerivatives", "CC BY-NC", "CC-BY-NC", "CC BY-NC-SA", "CC-BY-NC-SA", "CC BY-NC-ND", "CC-BY-NC-ND", "CC-BY-NC-{}.0", "CC-BY-NC-SA-{}.0", "CC-BY-NC-ND-{}.0"], "34"),
    "cc0": (["CC0", "CC0-1.0", "Creative Commons Zero", "Creative Commons CC0", "Public Domain", "Public Domain Dedication", "CC0 Universal", "The Unlicense", "Unlicense"], ""),
    "gpl": (["GNU GPL", "GPL", "GNU General Public License", "GNU General Public Licence", "GNU Public License", "GPLv{}", "GPLv{}+", "GPL v{}", "GNU GPLv{}", "GPL-{}.0", "GPL-{}.0-only", "GPL-{}.0-or-later", "GPL {}"], "23"),
    "lgpl": (["GNU LGPL", "LGPL", "GNU Lesser General Public License", "Lesser General Public License", "GNU Library General Public License", "GNU Lesser GPL", "LGPLv2.1", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPLv{}", "LGPL-{}.0", "LGPL-{}.0-only", "LGPL-{}.0-or-later"], "23"),
    "mit": (["MIT License", "MIT Licence", "MIT licensed", "MIT style license", "MIT-style license", "MIT X11 License", "X11 License", "Expat License", "MIT", "MIT-0"], ""),
    "mpl-2.0": (["Mozilla Public License", "Mozilla Public Licence", "MPL", "MPL {}.0", "MPLv{}", "MPL-{}.0", "MPL v{}.0"], "2"),
}
#: Frames of short notices, and the words of them and others; fixed values.
FRAMES = ["{}", "{}", "License: {}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}", "Distributed under the terms of the {}.", "This project is licensed under the {}.", "This software is available under the {}.", "Code is licensed under {}", "Published under the {} as found in the license file.", "This file is subject to the {}.", "SPDX-License-Identifier: {}", "This library is {}", "See the {} for details.", "{}, version 3, 1 May 2009", "{} Version 2.0", "{} 4.0 International"]
FRAME_WORDS = frozenset("a all allowed governed dual-licensed style also an and any are as at available be by can code content contents copyright copies covered data dedicated details distributed documentation dual either file files following for found free freely full general here herein in international into is it its later license licensed licenses licence licenced licences made may more notice of on only open or original otherwise package product program project provided published redistributed released repository rights see software source spdx spdx-license-identifier subject term terms text that the this to under universal unported use used v version versions with work you c".split()) | frozenset("january february march april may june july august september october november december".split())
ALONE = frozenset("mit bsd apache expat".split())
NUMBER = re.compile(r"v?\d+(?:[.\-]\d+)*|\d+(?:st|nd|rd|th)")
#: Words so common that n-grams of them alone tell nothing; fixed values.
COMMON = frozenset("a about above after all also an and any are as at be been before but by can code common copy could do each either first for form free from general had has have he her his if in include including into is it its later limited made may more most must no not of on one only open or other our out over part person provided public see she so some such than that the their them there these they this those to under up use used was we were what when which who will with without work would you your".split())
NAMES = "Harbour Orchid Falcon Meridian Copper Granite Willow Summit Lantern Juniper Cobalt Prairie Beacon Thistle Ember Tundra".split()
PATTERNS = ["Licensed under the {} License.", "Released under the {} License.", "Licensed under the {} Public License, version 2.0.", "This work is licensed under the {} License, version 3.", "This work is licensed under the {} General License.", "SPDX-License-Identifier: {}-1.0"]
#: Beginnings of notices that go on as sentences; fixed values.
CONTINUED = [
    "All rights reserved for members of the club were withdrawn.",
    "All rights reserved by the crown passed to the council.",
    "The MIT License is explained in the second part of the book.",
    "Many projects prefer the MIT License because it is short.",
    "The Apache License was compared with others in a lecture.",
    "They debated whether the GNU General Public License suits a museum.",
    "The BSD license came up in a talk about history.",
    "Creative Commons is an organisation with offices in many countries.",
    "The Mozilla Public License has been discussed by lawyers.",
    "Permission is hereby granted to enter the garden after noon.",
    "The public domain is a subject that the course treats at length.",
    "Copyright law protects the author of a novel.",
    "This document is about the free software movement and its founders.",
]
UNKNOWN = "unknown"
#: A word, or the end of a sentence.
WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*|(?<=[a-z0-9)\"'\]])[.;!?](?=\s|$)")
STOPS = frozenset(".;!?")
PIECE, RIGHT, ALIKE, RUN, FOLDS, CORPUS_LINES, MOST_LINE, LONG = 64, 0.98, 0.5, 8, 3, 2000, 400, 65536


def grams(words: list[str], most: int = 3) -> set[str]:
    return {" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)}


def pieces(text: str) -> Iterator[tuple[int, list[str]]]:
    """Offsets and words of a text's paragraphs, one line after another."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if end - at <= LONG:
            words = WORD.findall(text[at:end].lower())
            for i in range(0, max(1, len(words) - PIECE // 2) if words else 0, PIECE // 2):
                yield at, words[i : i + PIECE]
            at = end + 1
            continue
        found, words = WORD.finditer(text[at:end].lower()), []
        while more := [m.group() for m in islice(found, PIECE - len(words))]:
            words += more
            yield at, words
            if len(words) < PIECE:
                break
            words = words[PIECE // 2 :]
        at = end + 1


_blank_line = re.compile(r"\n[^\S\n]*\n")


def numbered(text: str) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """pieces() with the line's number among lines with words, one more after a blank line, and the words that the piece
    before did not have."""
    line, last = 0, -1
    for at, words in pieces(text):
        new = words
        if at == last:
            new = words[PIECE // 2 :]
        elif last >= 0:
            line += 2 if _blank_line.search(text, text.find("\n", last), at) else 1
        last = at
        yield line, at, words, new


def _sentences(words: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in words:
        out[-1].append(w)
        if w in STOPS:
            out.append([])
    return [x for x in out if x]


def _longest(words: list[str], template: frozenset[str]) -> int:
    """Most words in a row whose n-grams of three the template has."""
    best = now = 0
    for i in range(len(words) - 2):
        now = now + 1 if " ".join(words[i : i + 3]) in template else 0
        best = max(best, now)
    return best + 2 if best else 0


def forms(family: str) -> list[str]:
    """Names of a family's licences, one for each version."""
    written, versions = FORMS.get(family, ([], ""))
    return [x for form in written for x in ([form.format(v) for v in versions] if "{}" in form else [form])]


def names(family: str) -> frozenset[str]:
    """They as words."""
    return frozenset(" ".join(WORD.findall(x.lower())) for x in forms(family))


def _sums(rows: np.ndarray, take: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the sum of the rows taken for it; the places come in order."""
    out = np.zeros((n, rows.shape[1]))
    if len(to):
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        out[to[first]] = np.add.reduceat(rows[take], first, axis=0)
    return out


class Model:
    def __init__(self):
        self.names = {f: names(f) for f in TEMPLATES}
        self.own = {f: frozenset(w for n in self.names[f] for w in n.split()) for f in TEMPLATES}
        self.families = sorted(TEMPLATES)
        self.templates = {f: [frozenset(grams(WORD.findall(t.lower()))) for t in TEMPLATES[f]] for f in self.families}
        have = [frozenset().union(*t) for t in self.templates.values()]
        have.append(frozenset().union(*(grams(WORD.findall(t.lower())) for t in (*OTHERS, *ELSEWHERE, *CONTINUED))))
        self.rarity = {g: float(np.log((len(have) + 2) / (1 + sum(g in h for h in have)))) for g in frozenset().union(*have)}
        self.strange = float(np.log(len(have) + 2))

    def fit(self, corpus: list[str], seed: int = 1, rounds: int = 250) -> Model:
        """corpus: lines that are no licences, for all one knows."""
        rng = np.random.default_rng(seed)
        named = [p.format(n) for p in PATTERNS for n in NAMES] + [p.format(f"{n} License") for p in FRAMES for n in NAMES]
        others = [w for w in (WORD.findall(t.lower())[:PIECE] for t in (*corpus, *named)) if w]
        hard = [WORD.findall(t.lower()) for t in (*OTHERS, *ELSEWHERE, *CONTINUED, *sorted(ALONE))]
        noise = [w for line in (*others[: len(corpus)], *hard) for w in line if w not in STOPS]
        pool = np.array(noise)  # once: a draw from a list converts all of it
        examples: list[tuple[list[str], int, int]] = []  # words, class, fold
        for c, f in enumerate(self.families):
            for i, t in enumerate(TEMPLATES[f]):
                words = WORD.findall(t.lower())
                for k in range(16):
                    part = words
                    if k > 4 and len(words) > 12:  # a part of it
                        n = int(rng.integers(max(8, len(words) // 2), len(words) + 1))
                        first = int(rng.integers(0, len(words) - n + 1))
                        part = words[first : first + n]
                    if k % 4 == 3 and len(part) > 6:  # words left out
                        part = [w for w in part if rng.random() > 0.1]
                    if k % 2:  # strange sentences around
                        a, b = (list(rng.choice(pool, int(rng.integers(0, 12)))) for _ in range(2))
                        part = [*a, *["."] * bool(a), *part, *["."] * (part[-1] not in STOPS), *b]
                    examples.append((part, c, i % FOLDS))
            for i, name in enumerate(forms(f)):
                for k in [0, *rng.choice(len(FRAMES), 7, replace=False).tolist()]:
                    if FRAMES[k] != "{}" or name.lower() not in ALONE:
                        examples.append((WORD.findall(FRAMES[k].format(name).lower()), c, i % FOLDS))
        examples += [(w, len(self.families), i % FOLDS) for i, w in enumerate(others)]
        examples += [(w, len(self.families), i % FOLDS) for i, w in enumerate(hard) for _ in range(8)]
        every = [frozenset(grams(w)) for w, _, _ in examples]
        told = {x for g, (_, c, _) in zip(every, examples) if c < len(self.families) for x in g if not (COMMON | STOPS).issuperset(x.split())}
        formed = {x for f in self.families for name in (*(WORD.findall(t.lower()) for t in TEMPLATES[f]), *(n.split() for n in self.names[f])) for x in grams(name)}
        known = {x: i for i, x in enumerate(sorted(told & formed))}
        merged: dict[tuple, list[list[str]]] = {}  # examples alike count as one, as often as they come
        for g, (words, c, k) in zip(every, examples):
            merged.setdefault((tuple(sorted(known[x] for x in g if x in known)), c, k), []).append(words)
        rows = [np.array(cols, np.int64) for cols, _, _ in merged]
        times, first = np.array([len(x) for x in merged.values()], float), list(merged.values())
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.concatenate(rows)
        y, fold = (np.array([x[i] for x in merged]) for i in (1, 2))
        logits = np.zeros((len(rows), len(self.families) + 1))
        for k in range(FOLDS):
            w, bias = self._trained(at, col, y, times * (fold != k), len(known), rounds // 2)
            logits[fold == k] = self._logits(w, bias, at, col, len(rows))[fold == k]
        share = times / np.bincount(y, times, len(self.families) + 1)[y]  # classes count alike
        share[y == len(self.families)] *= len(self.families)
        heat = np.exp(np.linspace(-1.5, 1.5, 61))

        def loss(t: float) -> float:
            z = logits / t
            z -= z.max(1, keepdims=True)
            return float(((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]) * share).sum())

        self.heat = float(min(heat, key=loss))
        z = np.exp(logits / self.heat - (logits / self.heat).max(1, keepdims=True))
        c = z[:, :-1].argmax(1)
        q = z[:, :-1].max(1) / (z[:, :-1].max(1) + z[:, -1])
        counts = np.array([k < len(self.families) or q[i] >= 0.5 and any(self._alike(words, int(c[i])) >= ALIKE for words in first[i]) for i, k in enumerate(y)])
        order = np.flatnonzero(counts)[np.argsort(-q[counts], kind="stable")]
        right = np.cumsum((y != len(self.families))[order] * share[order]) / np.cumsum(share[order])
        good = np.flatnonzero(right >= RIGHT)
        self.sure = max(0.5, float(q[order][good[-1]])) if len(good) else 1.0
        w, self.bias = self._trained(at, col, y, times, len(known), rounds)
        kept = np.flatnonzero(np.abs(w).max(1) > 1e-4)
        order = list(known)
        self.weights = {order[i]: w[i] for i in kept.tolist()}
        self.words = frozenset(x for g in self.weights for x in g.split() if x not in STOPS)
        self.telling = self._telling(Counter(noise))
        return self

    def _telling(self, often: Counter) -> frozenset[str]:
        """Words of which a licence must have one. The others, as many of the frequent ones as can be, do not reach the
        threshold together: for no family is the sum of all that n-grams of them alone could add as much as it needs."""
        need = np.log(self.sure / max(1 - self.sure, 1e-12)) * self.heat - (self.bias[:-1] - self.bias[-1])
        of: dict[str, list[tuple[set[str], np.ndarray]]] = {}
        for g, w in self.weights.items():
            words = {x for x in g.split() if x not in STOPS}
            for x in words or {""}:  # the end of a sentence alone is in any line
                of.setdefault(x, []).append((words, np.maximum(w[:-1] - w[-1], 0)))
        sums, silent = sum((add for _, add in of.get("", [])), np.zeros(len(need))), set()
        for x in sorted(self.words, key=lambda x: (-often[x], x)):
            more = sums + sum((add for words, add in of[x] if words <= silent | {x}), np.zeros(len(need)))
            if (more < need).all():
                sums = more
                silent.add(x)
        return self.words - silent

    def _trained(self, at: np.ndarray, col: np.ndarray, y: np.ndarray, times: np.ndarray, size: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights and constants, by proximal steps (Adagrad) on the examples, each as often as times says."""
        k = len(self.families) + 1
        share = np.bincount(y, times, k)
        share[:-1] *= 2  # a family counts half as much as everything else
        weight = times / np.maximum(share[y], 1)
        weight /= weight.sum()
        w, bias = np.zeros((size, k)), np.zeros(k)
        bias[-1] = 2.0
        target = np.eye(k)[y]
        rate, sparse = 0.3, 2e-5
        g2 = np.full_like(w, 1e-6)
        order = np.argsort(col, kind="stable")
        turned, back = col[order], at[order]  # the examples of one n-gram after another
        for _ in range(rounds):
            logits = self._logits(w, bias, at, col, len(y))
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            e = (p - target) * weight[:, None]
            g = _sums(e, back, turned, size)
            g2 += g * g
            step = rate / np.sqrt(g2)
            w -= step * g
            w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(step, 50) * sparse)
            bias -= rate * e.sum(0)
        return w, bias

    @staticmethod
    def _logits(w, bias, at, col, n):
        return _sums(w, col, at, n) + bias

    def probabilities(self, words: list[str]) -> np.ndarray:
        g = grams(words)
        return self._softmax([self.weights[x] for x in g if x in self.weights])

    def _softmax(self, hits: list[np.ndarray]) -> np.ndarray:
        z = ((np.sum(hits, 0) if hits else 0) + self.bias) / self.heat
        p = np.exp(z - z.max())
        return p / p.sum()

    @staticmethod
    def _judged(p: np.ndarray) -> tuple[int, float]:
        """The likeliest family, and its probability against the unknown class."""
        c = int(p[:-1].argmax())
        return c, float(p[c] / (p[c] + p[-1]))

    def _weighted(self, words: list[str]) -> dict[str, int]:
        """The n-grams that have a weight, with the place of the first; their words are all known ones."""
        found: dict[str, int] = {}
        run: list[str] = []
        for i, w in enumerate(words):
            run = [*run[-2:], w] if w in self.words or w in STOPS else []
            for k in range(1, len(run) + 1):
                if (x := " ".join(run[-k:])) in self.weights:
                    found.setdefault(x, i - k + 1)
        return found

    def _weight(self, g) -> float:
        return sum(self.rarity.get(x, self.strange) for x in g)

    def _alike(self, words: list[str], c: int) -> float:
        """How like the paragraph, or one of its sentences, is to a template of a family."""
        best, whole = 0.0, grams(words)
        parts = _sentences(words)
        for t in self.templates[self.families[c]]:
            size = self._weight(t)
            for g in (whole, *(grams(x) for x in parts if len(parts) > 1)):
                best = max(best, self._weight(g & t) / max(size, self._weight(g)))
            if best < 1 and _longest(words, t) >= RUN:
                best = max(best, self._weight(whole & t) / self._weight(whole))
        return max(best, *(self._framed(x, self.families[c]) for x in parts), 0.0)

    def _framed(self, words: list[str], family: str) -> float:
        """How much of a sentence is a name of the family in a frame."""
        words = [w for w in words if w not in STOPS]
        for k in range(6, 0, -1):
            for i in range(len(words) - k + 1):
                if (name := " ".join(words[i : i + k])) in self.names[family]:
                    rest = [*words[:i], *words[i + k :]]
                    if k > 1 or name not in ALONE or any(w.startswith(("licen", "spdx")) or w == "under" for w in rest):
                        other = sum(w not in FRAME_WORDS and w not in self.own[family] and not NUMBER.fullmatch(w) for w in rest)
                        sure = 0.9 if name in ALONE else 1.9
                        return sure / (sure + other)
        return 0.0

    def unlike(self, words: list[str]) -> bool:
        """Whether a line is like no template of any family."""
        return all(self._alike(words, c) < ALIKE / 2 for c in range(len(self.families)))

    def _window(self, held: list[tuple[str, int, int]], hits: list[list]) -> list | None:
        """A licence over several lines that none of them has: first and last line, offset, family, probability,
        similarity. held: words with their line's number and offset."""
        own = [h for h in hits if h[1] >= held[0][1] and h[0] <= held[-1][1]]
        for part in (held, [x for x in held if not any(h[0] <= x[1] <= h[1] for h in own)] if own else []):
            words = [x[0] for x in part]
            if not (found := self._weighted(words)):
                continue
            c, p = self._judged(self._softmax([self.weights[x] for x in found]))
            if p >= self.sure:
                same = [h for h in own if h[3] == self.families[c]]
                if any(h[5] >= ALIKE for h in same):
                    return self._parts(held, same, c)
                first = part[min((i for x, i in found.items() if self.weights[x][c] > 0), default=0)]
                return [first[1], part[-1][1], first[2], self.families[c], p, self._alike(words, c)]
        return None

    def _parts(self, held: list[tuple[str, int, int]], same: list[list], c: int) -> list | None:
        """Lines that are different parts of one template as one licence; lines that repeat each other stay apart."""
        if len(same) < 2:
            return None
        whole = grams([x[0] for x in held])
        template = max(self.templates[self.families[c]], key=lambda t: len(whole & t))
        parts = [{g for g in grams([w for w, line, _ in held if h[0] <= line <= h[1]]) & template if g.count(" ") == 2} for h in same]
        if 2 * (sum(map(len, parts)) - len(set().union(*parts))) > min(map(len, parts)):
            return None
        best = max((h[4:6] for h in same), key=lambda x: (x[1] >= ALIKE, x))
        return [same[0][0], max(h[1] for h in same), same[0][2], self.families[c], *best]

    def scan(self, text: str) -> tuple[int, list[tuple[int, str, float, float]]]:
        """Number of paragraphs, and offset, family, probability and similarity of those that are licences."""
        hits: list[list] = []  # first and last line, offset, family, probability, similarity, whether of a window
        recent: list[list] = []  # those of lines that the window may hold
        held: list[tuple[str, int, int]] = []  # the window
        count, fresh, hot = 0, False, -1  # hot: the last line with a telling word

        def look() -> None:
            if fresh and held and held[0][1] <= hot and held[0][1] != held[-1][1] and not self.telling.isdisjoint([x[0] for x in held]) and (got := self._window(held, recent)):
                hits.append([*got, True])

        for line, at, words, new in numbered(text):
            count += 1
            if held and line > held[-1][1] + 1:
                look()
                held, recent, fresh = [], [], False
            if not self.telling.isdisjoint(words):
                hot = line
                c, p = self._judged(self.probabilities(words))
                if p >= self.sure:
                    hits.append([line, line, at, self.families[c], p, self._alike(words, c), False])
                    recent.append(hits[-1])
            while new:
                part, new = new[: PIECE - len(held)], new[PIECE - len(held) :]
                held += [(w, line, at) for w in part]
                fresh = True
                if len(held) == PIECE:
                    look()
                    held, fresh = held[PIECE // 2 :], False
                    recent = [h for h in recent if h[1] >= held[0][1]]
        look()
        found: dict[str, list[list]] = {}
        for h in sorted(hits, key=lambda h: (h[0], not h[6], h[2])):
            same = found.setdefault(h[3], [])
            if same and h[0] <= same[-1][1] and (h[6] or same[-1][6]):
                same[-1][1] = max(same[-1][1], h[1])
                same[-1][4:6] = max(same[-1][4:6], h[4:6], key=lambda x: (x[1] >= ALIKE, x))
                same[-1][6] = True
            else:
                same.append(h)
        return count, [tuple(h[2:6]) for h in sorted((h for x in found.values() for h in x), key=lambda h: (h[2], h[3]))]


CUE = re.compile(r"licen[sc]|copyright|rights|public|apache|permission|warrant|\bcc\b|creative|spdx|\bmit\b|\bgpl\b|\bbsd\b", re.I)


def fitted(docs: DataFrame) -> Model:
    """The corpus's part of the counter-examples is at most CORPUS_LINES distinct lines, of at most MOST_LINE characters:
    of each document of a sample the line that a hash names. Those with words that licences have take part if they are
    unlike all templates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.split(text, "\n").alias("lines"), F.xxhash64(text).alias("h"))
    line = F.substring(F.get("lines", F.pmod("h", F.size("lines")).cast("int")), 1, MOST_LINE)
    sample = some(lines.select(line.alias("line")), "line", 4 * CORPUS_LINES).collect()  # equal lines have one hash
    model = Model()
    found = sorted({r["line"] for r in sample})
    found = [x for x in found if not CUE.search(x) or model.unlike(WORD.findall(x.lower())[:PIECE])]
    order = sorted(found, key=lambda x: zlib.crc32(x.encode()))
    return model.fit(order[:CORPUS_LINES])


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, and found: offset, family, probability, similarity, confirmed of each licence paragraph."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches):
        for batch in batches:
            got = [shared.value.scan(x.as_py() or "") for x in batch.column(1)]
            found = [[{"offset": o, "family": f, "probability": p, "similarity": s, "confirmed": s >= ALIKE} for o, f, p, s in x] for _, x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array(found, kind)], names=["doc_id", "n_paragraphs", "found"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_paragraphs long, found array<struct<offset:long,family:string,probability:double,similarity:double,confirmed:boolean>>")


def summary(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, n_licences (confirmed), families (confirmed, in order), family, probability, similarity of
    the surest confirmed one (null without any)."""
    good = F.filter("found", lambda x: x["confirmed"])
    best = F.element_at(F.array_sort(F.transform(good, lambda x: F.struct((-x["probability"]).alias("p"), x["family"].alias("family"), x["similarity"].alias("similarity")))), 1)
    out = scanned(docs, model).select("doc_id", "n_paragraphs", F.size(good).cast("long").alias("n_licences"), F.array_sort(F.array_distinct(F.transform(good, lambda x: x["family"]))).alias("families"), F.when(F.size(good) > 0, best).alias("best"))
    return out.select("doc_id", "n_paragraphs", "n_licences", "families", F.col("best.family").alias("family"), (-F.col("best.p")).alias("probability"), F.col("best.similarity").alias("similarity"))
