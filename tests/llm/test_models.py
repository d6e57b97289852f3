"""Operators 1, 4, 10: held-out accuracy, brute force, odd input."""

import textwrap
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graniteql.llm import labelled, license_scan, quality, queries, toxicity

from ..conftest import MIDDLE


def scores(spark, name, label):
    got = queries.QUERIES[name](spark, MIDDLE).toPandas()
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out, strict=True))
    both = got.merge(labels, on="doc_id")
    return both[both.held_out], both[both.held_out][label]


def test_op4(spark):
    got, label = scores(spark, "op4_quality", "quality")
    assert (got.predicted == label).mean() > 0.97
    assert (got.predicted == (got.score >= 0.5)).all()


def test_op10(spark):
    got, label = scores(spark, "op10_toxicity", "toxic")
    assert (got.predicted == label).mean() > 0.93
    assert got.predicted[label == 0].mean() < 0.02 and got.predicted[label == 1].mean() > 0.6
    assert (got.predicted == (got.score >= 0.7)).all()


def test_toxic_documents_are_found_in_all_languages(spark):
    """Held out at sf0.1; one of twenty documents labelled toxic has no word that tells."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fitted(docs, labels)
    held = labels.where(labelled.held_out(F.col("doc_id")))
    got = toxicity.predictions(docs.join(held.select("doc_id"), "doc_id", "left_semi"), model).join(held, "doc_id").toPandas()
    assert got.predicted[got.toxic == 1].mean() >= 0.9 and got.predicted[got.toxic == 0].mean() <= 0.002
    assert (got.spans[(got.predicted == 1)].map(len) > 0).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_documents(spark, odd, empty, odd_rows, module):
    model = (quality.Model if module is quality else toxicity.Chain)().fit([("good words here. and more", 1), ("bad *** words", 0)] * 10)
    out = module.scored(odd, model)
    assert out.columns.count("score") == 1 and out.count() == len(odd_rows)
    rows = out.collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert module.scored(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.kept(odd, none).columns == odd.columns
    assert module.kept(empty, none).count() == 0
    one = spark.createDataFrame([(3, 1, 1), (None, 1, 1), (4, None, None), (5, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert 0 < module.predictions(odd, module.fitted(odd, one)).first()["score"] < 1


def test_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(1, "again"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic")
    trained = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1} - {7}
    assert len(got) == len(trained)
    assert len(labelled.sample(docs, labels, "toxic", per_class=5)) == 10
    assert sum(len(t) for t, _ in labelled.sample(docs, labels, "toxic", chars=50)) <= 50
    assert labelled.sample(docs, labels.limit(0), "toxic") == []


def test_passages_do_not_depend_on_neighbours(monkeypatch):
    texts = ["", "abc", "Hello, World! " * 100, "x" * 5000, "a\n" * 3000]
    together, counts = quality.passages(texts)
    alone = [quality.passages([t]) for t in texts]
    assert np.array_equal(together, np.concatenate([a[0] for a in alone])) and counts.tolist() == [int(a[1][0]) for a in alone]
    monkeypatch.setattr(quality, "AT_ONCE", quality.PASSAGE * 2)
    assert np.allclose(quality.passages(texts)[0], together)


def test_gradient():
    rng = np.random.default_rng(0)
    m = quality.Model()
    x, counts, y = rng.random((7, quality.FEATURES)), np.array([2, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality._sigmoid(m.forward(x, counts)["logit"])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = m._gradient(x, counts, y)
    for k, w in m.p.items():
        for i in list(np.ndindex(w.shape))[:: max(1, w.size // 5)]:
            old = w[i]
            w[i] = old + 1e-6
            up = loss()
            w[i] = old - 1e-6
            down = loss()
            w[i] = old
            assert abs((up - down) / 2e-6 - g[k][i]) < 1e-5


def test_marginals_are_those_of_all_taggings():
    rng = np.random.default_rng(1)
    chain = toxicity.Chain()
    chain.trans, chain.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = np.array([3, 1, 5, 4])
    scores = rng.normal(size=lengths.sum())
    got, at = chain.marginals(scores, lengths), 0
    for n in lengths:
        s, total, sums = scores[at : at + n], 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(chain.start[tags[0]] + sum(s[i] for i in range(n) if tags[i]) + sum(chain.trans[a, b] for a, b in itertools.pairwise(tags)))
            total += w
            sums += w * np.array(tags)
        assert np.allclose(got[at : at + n], sums / total)
        at += n


def test_spans():
    rows = [("you are a fool and more", 1), ("you are a friend and more", 0)] * 40
    chain = toxicity.Chain().fit(rows)
    text = "He is a Fool, they say."
    assert [text[a:b] for a, b, _ in chain.spans(text)] == ["Fool"]
    assert chain.scores([text])[0] > 0.7 > chain.scores(["He is a friend."])[0] and chain.spans("") == []


def test_spans_are_places_in_the_text(spark, monkeypatch):
    rows = [("you are a fool and more", 1), ("you are a friend and more", 0)] * 40
    chain = toxicity.Chain().fit(rows)
    text = "\u0130\u0130\u0130 \u0130stanbul. \U0001f600 You FOOL, \u00df.\nA Fool, so.\n" * 3
    want = ["FOOL", "Fool"] * 3
    docs = spark.createDataFrame([(1, text), (2, None), (3, "a friend"), (4, text * 4)], "doc_id long, text string")
    for part in (toxicity.PART, 20):
        monkeypatch.setattr(toxicity, "PART", part)
        assert [text[a:b] for a, b, _ in chain.spans(text)] == want
    got = {r["doc_id"]: r for r in toxicity.predictions(docs, chain).collect()}
    assert [text[s["start"] : s["end"]] for s in got[1]["spans"]] == want and all(0.5 < s["score"] <= 1 for s in got[1]["spans"])
    assert got[2]["spans"] == got[3]["spans"] == [] and [(text * 4)[s["start"] : s["end"]] for s in got[4]["spans"]] == want * 4
    both: list = []
    for part in ([text, "a friend"], ["you are a fool"]):
        chain.scores(part, both)
    assert [len(x) for x in both] == [6, 0, 1]
    constant = toxicity.Chain().fit([("a", 1)])
    assert constant.spans(text) == [] and constant.scores(["a", "b"], found := []).tolist() == [2 / 3] * 2 and found == [[], []]


def test_rare_words_of_a_group_are_tagged():
    rows = [(f"some text dreadf{chr(97 + i % 20)} here", 1) for i in range(40)] + [(f"some text with w{i} here", 0) for i in range(400)]
    found = toxicity.toxic_words(rows)
    assert found == {f"dreadf{chr(97 + i)}" for i in range(20)}
    assert toxicity.toxic_words([("a b c", 0)] * 5) == set()


def test_licences(spark, odd, empty, odd_rows):
    texts = ["A line.\nReleased under the MIT License.\nAnother.", "He holds a driving license.", None, "All rights reserved.", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = license_scan.fitted(docs)
    got = {r["doc_id"]: (r["n_paragraphs"], r["families"]) for r in license_scan.summary(docs, model).collect()}
    assert got == {0: (3, ["mit"]), 1: (1, []), 2: (0, []), 3: (1, ["proprietary"]), 4: (2, ["apache-2.0", "cc-by-nc"])}
    found = license_scan.scanned(docs, model).where("doc_id = 0").first()["found"]
    assert [(f["offset"], f["confirmed"]) for f in found] == [(8, True)]
    assert license_scan.summary(odd, model).count() == len(odd_rows)
    assert license_scan.summary(empty, license_scan.fitted(empty)).count() == 0


def test_notices_that_no_template_has():
    """Wordings, licences and sentences that are neither templates nor counter-examples."""
    model = license_scan.Model().fit(["Grapes ripen slowly on those hills.", "Rivers carry silt to valleys"] * 20)
    seen = {*license_scan.OTHERS, *license_scan.ELSEWHERE, *license_scan.CONTINUED, *(t for ts in license_scan.TEMPLATES.values() for t in ts)}
    licences = {
        "Distributed under the MIT license.": "mit",
        "Copyright 2019 Jane Roe. All rights reserved.": "proprietary",
        "This software is licensed under the BSD 3-Clause license": "bsd",
        "This work is licensed under a Creative Commons Attribution 3.0 License.": "cc-by",
        "(c) 2021. Unauthorized copying is strictly prohibited. All rights reserved.": "proprietary",
        "# Licensed under the Apache License, Version 2.0": "apache-2.0",
        "some code here. Released under the MIT License. More text follows here": "mit",
        "Licensed under the Mozilla Public License, v. 2.0.": "mpl-2.0",
    }
    others = [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This work is licensed under the Boost Software License.",
        "All rights reserved for the king of France.",
        "The MIT License is discussed in chapter two.",
        "Licensed under the Ruby License.",
        "The author reserved all rights to the film.",
        "Released under the Perl License, version 4.",
        "Anyone may use the software without permission of the owner of the house.",
        "She wrote a paper on public license plates and their general design.",
        "The terms of the lease were published under the mayor's name.",
    ]
    assert seen.isdisjoint(licences) and "This work is licensed under the Boost Software License." not in seen
    confirmed = lambda t: [f for _, f, _, alike in model.scan(t)[1] if alike >= license_scan.ALIKE]
    assert {t: confirmed(t) for t in licences} == {t: [f] for t, f in licences.items()}
    assert {t: confirmed(t) for t in others} == {t: [] for t in others}


#: Headings, identifiers and notices of one line, none of them a template, a name or a frame of the module.
WORDINGS = {
    "MIT License\n\nCopyright (c) 2021 Jane Doe": "mit",
    "This project is MIT licensed.": "mit",
    "License: MIT": "mit",
    "All code here is under the MIT license": "mit",
    "// SPDX-License-Identifier: MIT-0": "mit",
    "Distributed under the Expat license.": "mit",
    "Dual licensed, MIT": "mit",
    "MIT licence, see LICENSE.txt": "mit",
    "Licensed under the Apache License 2.0.": "apache-2.0",
    "Code is licensed under Apache License 2.0": "apache-2.0",
    "This program is distributed under the Apache 2.0 license.": "apache-2.0",
    "License: Apache-2.0": "apache-2.0",
    "Files are licensed under the Apache Software License 2.0": "apache-2.0",
    "BSD 2-Clause License": "bsd",
    "License: BSD-3-Clause": "bsd",
    "SPDX-License-Identifier: BSD-2-Clause": "bsd",
    "This code is released under the BSD 3-clause license.": "bsd",
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "bsd",
    "The library is available under the new BSD license": "bsd",
    "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
    "Mozilla Public License Version 2.0": "mpl-2.0",
    "You may use this under the terms of the MPL 2.0": "mpl-2.0",
    "SPDX-License-Identifier: LGPL-2.1-only": "lgpl",
    "Copying is governed by the GNU Lesser General Public License": "lgpl",
    "This package is covered by the LGPLv3": "lgpl",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "lgpl",
    "// SPDX-License-Identifier: GPL-2.0": "gpl",
    "Distributed under the terms of the GNU GPL version 3.": "gpl",
    "This software is available under the GNU General Public License.": "gpl",
    "The driver is licensed under the GPLv3.": "gpl",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl",
    "License GPLv2+": "gpl",
    "# SPDX-License-Identifier: AGPL-3.0-or-later": "agpl",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "agpl",
    "You can use it under the AGPL": "agpl",
    "CC BY-NC-SA 4.0": "cc-by-nc",
    "Free for use under Creative Commons Attribution-NonCommercial 3.0": "cc-by-nc",
    "Images: CC-BY-NC-4.0": "cc-by-nc",
    "Creative Commons Attribution 4.0 International": "cc-by",
    "Content is available under Creative Commons Attribution-ShareAlike 3.0 Unported": "cc-by",
    "The documentation is licensed under CC-BY-4.0.": "cc-by",
    "This text is in the public domain (CC0).": "cc0",
    "Released under the Unlicense": "cc0",
    "To the public domain dedicated, see CC0": "cc0",
}
MENTIONS = [
    "He read about the MIT License in a magazine.",
    "MIT is in Cambridge.",
    "The BSD daemon is a mascot.",
    "An Apache helicopter landed at the base.",
    "Licensed under the Harbour Licence.",
    "The GPL was the topic of her thesis.",
    "Critics of the GNU General Public License met in Paris.",
    "Public domain books are cheap.",
    "The Mozilla Foundation publishes a browser.",
    "License plates are made of metal.",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the Eclipse Public License 2.0",
    "Creative Commons is a foundation.",
    "The general public has free access.",
    "A fishing license is required at the lake.",
    "His MIT degree opened doors.",
    "Lawyers compared the Apache License with the Mozilla Public License.",
    "The court asked whether the GPL binds a buyer.",
]


def test_short_notices_and_mentions():
    model = license_scan.Model().fit(["Grapes ripen slowly on those hills.", "Rivers carry silt to valleys"] * 20)
    known = {*(t for ts in license_scan.TEMPLATES.values() for t in ts), *(f for x in license_scan.TEMPLATES for f in license_scan.forms(x))}
    assert known.isdisjoint(WORDINGS) and len(WORDINGS) >= 40
    confirmed = lambda t: [f for _, f, _, alike in model.scan(t)[1] if alike >= license_scan.ALIKE]
    missed = {t: confirmed(t) for t, f in WORDINGS.items() if confirmed(t) != [f]}
    assert len(missed) <= 0.1 * len(WORDINGS), missed
    assert {t: x for t in MENTIONS if (x := confirmed(t))} == {}


def test_pieces_of_long_lines_are_those_of_short_ones(monkeypatch):
    texts = [" ".join(f"w{i}." for i in range(n)) for n in (0, 1, 31, 32, 33, 48, 49, 64, 65, 200)] + ["", "\n\n", "a\r\nb\x0cc"]
    short = [list(license_scan.pieces(t)) for t in texts]
    monkeypatch.setattr(license_scan, "LONG", 0)
    assert [[(at, list(w)) for at, w in x] for x in map(license_scan.pieces, texts)] == short


def test_lines_that_are_passed_over_are_no_licences():
    model = license_scan.Model().fit(["Grapes ripen slowly on those hills of the valley."] * 20)
    silent = sorted(model.words - model.telling)
    assert len(silent) > 3 and model.telling
    lines = [" ".join(silent), *(" ".join(silent[i : i + 3]) + "." for i in range(len(silent)))]
    assert all(model._judged(model.probabilities(license_scan.WORD.findall(x)))[1] < model.sure for x in lines)


def test_likeness_is_two_sided():
    model = license_scan.Model()
    alike = lambda t, f: model._alike(license_scan.WORD.findall(t.lower()), model.families.index(f))
    assert alike("Released under the MIT License.", "mit") == pytest.approx(1)
    assert alike("All rights reserved for the king of France.", "proprietary") < license_scan.ALIKE
    assert alike("Rights.", "proprietary") < license_scan.ALIKE
    part = " ".join(license_scan.TEMPLATES["mit"][3].split()[:20]) if len(license_scan.TEMPLATES["mit"][3].split()) > 20 else license_scan.TEMPLATES["mit"][3]
    assert alike(part, "mit") > 0.9


def test_op1_finds_the_planted_lines(spark):
    planted = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "proprietary": "All rights reserved.", "mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    got = {r["doc_id"]: set(r["families"]) for r in queries.QUERIES["op1_license_scan"](spark, MIDDLE).collect()}
    for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect():
        lines = r["text"].split("\n")
        assert got[r["doc_id"]] == {f for f, line in planted.items() if line in lines}


def test_long_texts_are_tagged_in_parts(monkeypatch):
    chain = toxicity.Chain().fit([("you are a fool and more", 1), ("you are a friend and more", 0)] * 40)
    texts = ["he is a friend. " * 50 + "a fool he is. " * 3 + "so. " * 40, "no end here " * 30, "", "x" * 900]
    whole = chain.summaries(texts)
    monkeypatch.setattr(toxicity, "PART", 100)
    assert np.allclose(chain.summaries(texts[:1]), whole[:1]) and np.allclose(chain.summaries(texts)[2:], whole[2:])
    assert "".join(toxicity.sentences_of(texts[1])) == texts[1] and max(map(len, toxicity.sentences_of(texts[1]))) <= 200


def test_paragraphs():
    got = list(license_scan.pieces("a b\n\n" + " ".join(f"w{i}" for i in range(100)) + "\nend"))
    assert [(at, len(w)) for at, w in got] == [(0, 2), (5, 64), (5, 64), (5, 36), (5 + 389 + 1, 1)]
    assert [w for _, w in got][1][32:] == [w for _, w in got][2][:32]


def test_wrapped_notices_are_one_licence():
    model = license_scan.Model().fit([])
    prose = "Grapes ripen slowly on those hills\nwhile rivers carry silt to valleys\n"
    for family, notice in [("apache-2.0", license_scan.TEMPLATES["apache-2.0"][1]), ("mit", license_scan.TEMPLATES["mit"][2]), ("mpl-2.0", license_scan.TEMPLATES["mpl-2.0"][0])]:
        for width in (16, 30, 80):
            wrapped = "\n".join(f" * {x}" for x in textwrap.wrap(notice, width))
            count, found = model.scan(f"{prose}\n{wrapped}\n\n{prose}")
            assert count == len(wrapped.split("\n")) + 4
            assert [f for _, f, _, alike in found if alike >= license_scan.ALIKE] == [family], (family, width, found)
            assert all(len(prose) < at <= len(prose) + 1 + len(wrapped) for at, *_ in found)
    short = "Released\nunder the\nMIT\nLicense."
    assert [x[1] for x in model.scan(short)[1]] == ["mit"]
    assert [x[1] for x in model.scan("All rights reserved.\n\nplain words\n\nAll rights reserved.")[1]] == ["proprietary"] * 2
    assert [x[1] for x in model.scan("All rights reserved.\nplain words\nAll rights reserved.")[1]] == ["proprietary"] * 2
    assert model.scan(prose * 30)[1] == [] and model.scan("Released\n\nunder the\n\nMIT\n\nLicense.")[1] == [] and model.scan("") == (0, [])
