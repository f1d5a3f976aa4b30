"""Licence scan: held-out wordings, calibration, wrapped paragraphs, and the batch scorer against the plain one."""

import numpy as np
import pytest

from lectern.llm import licence

#: Wordings that are in no template, by family; and lines near licences that declare none.
HELD = [
    ("apache", "This file is made available to you under the Apache License 2.0, see the LICENSE file for details."),
    ("apache", "distributed under the License is distributed on an \"AS IS\" BASIS, without warranties or conditions of any kind, either express or implied."),
    ("mit", "This library is licensed under the MIT License, see LICENSE.txt."),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation"),
    ("mit", "The above copyright notice and this permission notice should be included in all copies of the Software"),
    ("gpl", "This program is free software; you may redistribute it and modify it under the GNU General Public License, version 2."),
    ("gpl", "version 3 of the License, or (at your option) any later version"),
    ("gpl", "You should have received a copy of the GNU General Public License; if not, see gnu.org."),
    ("cc-by-nc", "This photo is licensed under the Creative Commons Attribution-NonCommercial 4.0 licence."),
    ("cc-by", "Text is available under the Creative Commons Attribution-ShareAlike License, version 4.0"),
    ("bsd", "Redistribution and use in source and binary forms are permitted provided that the following conditions are met:"),
    ("bsd", "neither the name of the organisation nor the names of its contributors may be used to endorse or promote products"),
    ("reserved", "© 2020 Example Press. All rights reserved worldwide."),
    ("unknown", "He renewed his driving license in the public office last week."),
    ("unknown", "The committee granted permission to build the new bridge in March."),
    ("unknown", "An apache helicopter was seen over the town on Tuesday."),
    ("unknown", "The conditions of the contract are met by the supplier every year."),
    ("unknown", "We received a copy of the letter along with the program of the concert."),
    ("unknown", "Le permis de conduire est obligatoire pour tous les chauffeurs."),
    ("unknown", "All children reserved their seats in the bus."),
    ("unknown", "The new version of the software is faster and has fewer errors."),
    ("unknown", "General opinion in public places was that any later date would do."),
]


@pytest.fixture(scope="module")
def model(spark):
    return licence.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_wordings(model):
    got = [model.predict(t) for _, t in HELD]
    named = [(f, g[0]) for (f, _), g in zip(HELD, got, strict=True) if f != "unknown"]
    assert np.mean([a == b for a, b in named]) >= 0.75
    confirmed = [g for (f, _), g in zip(HELD, got, strict=True) if f == "unknown" and g[0] != "unknown" and g[2] >= licence.CONFIRM]
    assert not confirmed


def test_calibration(model):
    """Over fresh noisy rows and plain sentences, the mean probability of the named class is within 0.1 of the share that is right, above and below 0.9."""
    plain = [t for f, t in HELD if f == "unknown"] + [" ".join(t.split()[::-1]) for f, t in HELD if f == "unknown"]
    rows = licence.training_rows(plain, seed=77)
    p, right = [], []
    for t, k in rows:
        z = model.scores(licence.words(t)) / model.temperature
        q = np.exp(z - z.max())
        q /= q.sum()
        p.append(q.max())
        right.append(q.argmax() == k)
    p, right = np.array(p), np.array(right)
    for part in (p >= 0.9, p < 0.9):
        if part.sum() > 30:
            assert abs(p[part].mean() - right[part].mean()) < 0.12


def test_many_equals_one_by_one(model):
    texts = [t for _, t in HELD] + ["one", "two words", "a b c d e f g " * 40]
    ws = [licence.words(t) for t in texts]
    ends = np.cumsum([len(w) for w in ws])
    parts = np.stack([ends - [len(w) for w in ws], ends], axis=1)
    got = model.many(licence.codes([w for x in ws for w in x]), parts)
    assert np.allclose(got, [model.scores(w) for w in ws])


def test_whole_scan_equals_line_by_line(model, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = {(d, a, b): (f, round(p, 6), round(s, 6)) for d, _, f, p, s, a, b in licence.scan_texts(texts, model)}
    want = {}
    for d, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            if 0 < len(licence.words(line)) <= licence.WINDOW:
                f, p, s = model.predict(line)
                if f != "unknown":
                    want[d, at, at + len(line)] = (f, round(p, 6), round(s, 6))
            at += len(line) + 1
    assert want and {k: v for k, v in got.items() if k in want} == want


def test_wrapped_paragraphs_and_long_ones(model):
    wrapped = "Intro line.\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without restriction\n\nEnd."
    rows = [r for r in licence.scan_texts([wrapped, "w " * 500 + "Licensed under CC BY-NC 4.0. " + "w " * 500, "", "\n\n"], model) if r[4] >= licence.CONFIRM]
    assert {(r[0], r[2]) for r in rows} == {(0, "mit"), (1, "cc-by-nc")} and wrapped[rows[0][5] : rows[0][6]].startswith("Permission") and rows[0][1] == 2
    assert licence.paragraphs("a\nb.\nc\n\nd") == [(0, 0, 1, 1), (1, 2, 4, 1), (0, 0, 4, 2), (2, 5, 6, 1), (4, 8, 9, 1)]


def test_empty_and_clashing(model, spark):
    d = spark.createDataFrame([(None, None), (1, ""), (2, "İ All rights reserved. " + "x" * 50_000)], "doc_id long, text string").selectExpr("*", "1 AS family", "2 AS start")
    assert [(r.doc_id, r.family, r.start) for r in licence.scan(d, model).filter("confirmed").collect()] == [(2, "reserved", 0)]
    empty = d.limit(0)
    assert licence.scan(empty, licence.train(empty)).count() == 0
