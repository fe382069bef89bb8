"""Licence lines of many wordings: the fitted model, the scan of whole tables, the bound of the sample."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postloom.llm import licenses
from postloom.llm.license_texts import NOTICES
from postloom.llm.shared import table

FOLDER = "/root/testdata/sf0.001"
WHOLE = " ".join(NOTICES["MIT"]) + " " + " ".join(NOTICES["Apache"])
# Line and the families it names.
LINES = [
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("Licensed under Apache-2.0.", "Apache"),
    ("License: GPL-3.0-or-later", "GPL"),
    ("Released\tunder\tthe\tMIT\tLicense.", "MIT"),
    ("Released under the ISC License.", "ISC"),
    ("Dual licensed under MIT and GPL version 3", "GPL|MIT"),
    ("MIT License", "MIT"),
    ("Apache License 2.0", "Apache"),
    ("Licensed under the GNU GPL v3", "GPL"),
    ("MIT License or the Apache License, Version 2.0", "Apache|MIT"),
    ("This code may be used under the LGPL-2.1-or-later.", "LGPL"),
    ("Provided under a GNU Affero General Public License, v3.", "AGPL"),
    ("Content is licensed under a Creative Commons Attribution-ShareAlike 4.0 licence", "CC-BY-SA"),
    ("Photos: CC BY-NC-SA 3.0", "CC-BY-NC"),
    ("Package license: BSD 3-Clause", "BSD"),
    ("Offered under the Mozilla Public License version 2.0", "MPL"),
    ("Covered by the EPL 2.0", "EPL"),
    ("This file is part of Foo and is subject to the GPLv2 license.", "GPL"),
    ("Licence MIT", "MIT"),
    ("Copyright 2021 Foo Inc. All rights reserved.", "Reserved"),
    ("Placed into the public domain by its author under CC0.", "Public domain"),
    ("Open source under the Apache 2 license.", "Apache"),
    ("Terms: GNU Lesser General Public License, version 3", "LGPL"),
    ("He went to MIT to study the law.", ""),
    ("Apache tribes lived here.", ""),
    ("The license was renewed in 2020.", ""),
    ("MIT", ""),
    ("The MIT team and the Boston team met.", ""),
    ("the general public license plate", ""),
    ("A public domain name server.", ""),
] + [(WHOLE, "Apache|MIT"), ("word " * 20_000 + "Released under the MIT License.", "MIT")]
# Wording whose misses led to two phrases and to templates without articles.
SEEN_LATE = [
    ("This repository uses the MIT license; see the file LICENSE.", "MIT"),
    ("All code here is MIT licensed.", "MIT"),
    ("LICENSE: Apache-2.0", "Apache"),
    ("Apache Software License 2.0 applies to this package.", "Apache"),
    ("Made available under GPL-2.0-only", "GPL"),
    ("Foo is free software, under the GNU General Public License v3 or later.", "GPL"),
    ("Documentation is released under CC BY-SA 4.0", "CC-BY-SA"),
    ("Images licensed under CC-BY-4.0 by the authors", "CC-BY"),
    ("Text under CC BY-NC-ND 4.0", "CC-BY-NC"),
    ("Distributed under the BSD-3-Clause license", "BSD"),
    ("This module is covered by the New BSD License", "BSD"),
    ("Subject to the terms of the Mozilla Public License, v. 2.0", "MPL"),
    ("Eclipse Public License - v 2.0", "EPL"),
    ("Distributed under the Boost Software License", "Boost"),
    ("Dual-licensed under Apache 2.0 or MIT", "Apache|MIT"),
    ("Choose GPLv2 or the BSD license", "BSD|GPL"),
    ("The library is under LGPL version 3", "LGPL"),
    ("Server code: AGPLv3", "AGPL"),
    ("Dedicated to the public domain under CC0 1.0", "Public domain"),
    ("Available under the ISC licence", "ISC"),
    ("The city was licensed to sell wine.", ""),
    ("Apache is a software foundation.", ""),
    ("She reads the MIT Technology Review.", ""),
    ("Common attribution errors are made by people.", ""),
    ("The eclipse was seen by the public.", ""),
    ("You may redistribute the flyers.", ""),
    ("All rights are equal.", ""),
]
# Wording written after all names, phrases and settings, which were left as they were.
UNSEEN = [
    ("Our sources carry the MIT license.", "MIT"),
    ("Package metadata says license: BSD-2-Clause", "BSD"),
    ("You may use this under the Apache License 2.0 only.", "Apache"),
    ("Kernel module, GPL v2 licensed.", "GPL"),
    ("Linked code falls under the GNU Lesser General Public License 2.1", "LGPL"),
    ("Hosted version governed by AGPL-3.0", "AGPL"),
    ("Files here are MPL-2.0", "MPL"),
    ("Figures are shared under CC BY 4.0", "CC-BY"),
    ("Wiki text: Creative Commons Attribution-ShareAlike 3.0", "CC-BY-SA"),
    ("For non commercial use, CC BY-NC 4.0 applies", "CC-BY-NC"),
    ("License ISC", "ISC"),
    ("Plugin under Eclipse Public License 1.0", "EPL"),
    ("This header uses the Boost Software License, version 1.0", "Boost"),
    ("The data set is CC0", "Public domain"),
    ("Your choice of the MIT license or GPL version 2", "GPL|MIT"),
    ("(c) Foo GmbH, all rights reserved", "Reserved"),
    ("The licence fee rose last year.", ""),
    ("MIT students won the prize.", ""),
    ("An eclipse license was sold to the public.", ""),
    ("Apache county voted in the spring.", ""),
    ("The software was distributed on a disc.", ""),
]


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(table(spark, FOLDER, "documents"))


def scanned(spark, lines, model):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r.doc_id: "|".join(r.licenses) for r in licenses.scan(docs, model).collect()}


def test_lines_of_many_wordings(spark, model):
    got = scanned(spark, [line for line, _ in LINES], model)
    assert [got[k] for k in range(len(LINES))] == [families for _, families in LINES]


@pytest.mark.parametrize("lines", [SEEN_LATE, UNSEEN])
def test_recall_on_other_wording(spark, model, lines):
    got = scanned(spark, [line for line, _ in lines], model)
    wanted = {(k, f) for k, (_, families) in enumerate(lines) for f in families.split("|") if f}
    found = {(k, f) for k, families in got.items() for f in families.split("|") if f}
    assert not found - wanted
    assert len(found & wanted) >= 0.9 * len(wanted)


def test_joined_scores_equal_the_plain_model(spark, model):
    docs = spark.createDataFrame(list(enumerate(line for line, _ in LINES)), "doc_id long, text string")
    rows = licenses.predicted(docs, model).join(licenses.paragraphs(docs), ["h1", "h2"])
    for r in rows.select("paragraph", F.col("families")).collect():
        plain = dict(zip(licenses.FAMILIES, model.chances(r.paragraph)))
        assert {f.family for f in r.families} == {f for f, p in plain.items() if p > 0.5}
        assert all(f.chance == pytest.approx(plain[f.family]) for f in r.families)


def test_agreement_equals_the_plain_form(spark, model):
    docs = spark.createDataFrame(list(enumerate(line for line, _ in LINES)), "doc_id long, text string")
    for r in licenses.scan_paragraphs(docs, model).collect():
        words = licenses.tokens(r.paragraph)
        pairs = licenses.grams(words, (2,))
        shares = []
        for t in licenses.templates():
            share = len((pairs | set(words)) & set(t["parts"])) / max(min(len(pairs), len(t["parts"])), 1)
            if t["family"] == r.family and share >= t["need"]:
                shares.append(share)
        assert r.agreement == pytest.approx(max(shares))


def test_unknown_is_what_no_family_claims(model):
    assert model.unknown("The river rose in the spring.") > 0.9
    assert model.unknown("Released under the MIT License.") < 0.1


def test_sample_is_bounded_also_where_lines_repeat(spark, monkeypatch):
    held = []
    monkeypatch.setattr(licenses, "fit", lambda rows: held.extend(rows))
    same = spark.range(3000).selectExpr("id AS doc_id", "'one line' AS text")
    other = spark.range(3000).selectExpr("id AS doc_id", "concat('line ', id, '\n', repeat('x', 3000)) AS text")
    licenses.train(same.unionByName(other), 200)
    assert 120 <= len(held) <= 300 and len(set(held)) == len(held)
    assert max(map(len, held)) <= licenses.LONGEST
    held.clear()
    licenses.train(same.limit(0), 200)
    assert held == []
