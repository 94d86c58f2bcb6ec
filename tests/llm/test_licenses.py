import numpy as np
import regex

from tessera.llm import licenses

# Notices as they stand in files, none of them a training statement.
NOTICES = (
    ("mit", "Distributed under the terms of the MIT License (see LICENSE.txt for details)"),
    ("mit", "This package is open source software, MIT licensed."),
    ("mit", "The above copyright notice and this permission notice shall be\n# included in all copies or substantial portions of the Software"),
    ("apache", "Copyright 2014 The Authors\n\n * Licensed under the Apache License, Version 2.0 (the\n * \"License\"); you may not use this file except in\n * compliance with the License."),
    ("apache", "This product is provided to you under the Apache License 2.0"),
    ("bsd", "This file is covered by the 3-clause BSD license, as written in COPYING"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    ("gpl", "This editor is free software; you may copy and redistribute it under the GNU GPL, version 2 or any later version"),
    ("gpl", "You should have received a copy of the GNU General Public License\nalong with this package; see the file COPYING."),
    ("lgpl", "This library may be linked under the GNU Lesser General Public License, either version 3 or later"),
    ("agpl", "Server parts are covered by the GNU Affero General Public License, version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0."),
    ("epl", "All contributions are accepted under the Eclipse Public License only"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted"),
    ("cc-by", "Text and figures: Creative Commons Attribution 4.0 International"),
    ("cc-by-sa", "Content is available under CC BY-SA 4.0 unless otherwise noted"),
    ("cc-by-nc", "Photographs may be reused under CC BY-NC 4.0 with credit"),
    ("cc0", "The data set is in the public domain under CC0"),
    ("proprietary", "Copyright 1998 Some Press, Inc. All rights reserved"),
    ("unlicense", "This is free and unencumbered software\nreleased into the public domain"),
    ("unknown", "Her fishing license expired before the season began"),
    ("unknown", "The copyright office moved to a new building in spring"),
    ("unknown", "No warranty claim was accepted after the second year"),
    ("unknown", "The museum needs permission of the owner to show the painting"),
    ("unknown", "A table was reserved for eight, in the name of the board"),
    ("unknown", "The software was licensed to three banks for a fee"),
    ("unknown", "Its domain is the creative use of cheap materials"),
)


def paragraphs(text):
    return regex.split(licenses.PARAGRAPH, text)


def test_held_back_accuracy_and_calibration():
    model, held = licenses.train(), licenses.statements(1)
    p = model.probabilities([s for s, _ in held])
    right = np.array([model.classes[i] == c for i, (_, c) in zip(p.argmax(axis=1), held)])
    assert right.mean() >= 0.97 and abs(p.max(axis=1).mean() - right.mean()) < 0.05


def test_notices_that_training_did_not_see(spark):
    assert not {s for s, _ in licenses.statements()} & {s for _, s in NOTICES}
    docs = spark.createDataFrame([(i, f"Some prose before it.\n{s}\n\nSome prose after it.") for i, (_, s) in enumerate(NOTICES)], "doc_id long, text string")
    found = {}
    for r in docs.transform(licenses.scan).collect():
        if r.confirmed:
            found.setdefault(r.doc_id, set()).add(r.family)
    wrong = [(s, found.get(i)) for i, (c, s) in enumerate(NOTICES) if found.get(i, {"unknown"}) != {c}]
    assert len(wrong) <= 0.15 * len(NOTICES), wrong


def test_paragraphs(spark):
    text = "Title\n\nwrapped\nline ends.  \nnext: \r\n  one\r\n\r\n\r\ntwo\nthree"
    assert paragraphs(text) == ["Title", "wrapped\nline ends.  ", "next: \r", "one\r", "two\nthree"]
    texts = [text, "a.\n", "\n\n", "", "no break", ". " * 9 + "\nmit", "x!\n\ny"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "split(text, r'" + licenses.PARAGRAPH + "') AS p").collect()
    assert all(r.p == paragraphs(r.text) for r in rows)


def test_native_scores_equal_numpy(spark, documents):
    lines = ["Released under the MIT License.", "his driver license.", "plain text.", "", "Licensed under CC BY-NC 4.0. Apache!", "SPDX-License-Identifier: MPL-2.0.", "MIT and then a license;", "Copyright 2020. All rights reserved"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    model, terms = licenses.train(), set(licenses.TERMS)
    got = licenses.scan(docs).collect()
    want = sum(bool(terms & set(licenses.words(p))) for r in docs.collect() for p in paragraphs(r.text or ""))
    assert len(got) == want > 5
    for r in got:
        options = [paragraphs(t) for t in texts[r.doc_id] if t]
        p = [model.probabilities([o[r.paragraph]])[0] for o in options if len(o) > r.paragraph]
        fits = [x for x in p if abs(x.max() - r.probability) < 1e-9]
        assert any(r.family == (model.classes[x.argmax()] if x.max() >= 0.5 else "unknown") for x in fits)
    found = {r.paragraph: (r.family, r.overlap, r.confirmed) for r in got if r.doc_id == 1}
    assert found[0] == ("mit", 1.0, True) and found[1][0] == "unknown" and found[4] == ("mpl", 1.0, True)


def test_dirty_rows(spark, dirty, none):
    assert licenses.scan(dirty).columns == ["doc_id", "paragraph", "family", "probability", "overlap", "confirmed"]
    assert licenses.scan(dirty).count() == 0 and licenses.scan(none).count() == 0
    rows = [(None, "MIT License"), (7, "MIT License"), (7, "MIT License"), (8, None), (9, "x " * 30_000 + "MIT License " + "y " * 30_000)]
    named = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS w", "3 AS paragraph", "4 AS named")
    assert sorted((r.doc_id or 0, r.family, r.confirmed) for r in licenses.scan(named).collect()) == [(0, "mit", True), (7, "mit", True), (7, "mit", True), (9, "mit", True)]
