"""Each notice has its own label only."""

import re

from citesift.llm import license_scan, registry
from llm.conftest import SF_DIR

CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."


def test_each_template_has_exactly_its_label(spark):
    docs = list(enumerate(t for _, t in license_scan.TEMPLATES))
    want = {i: label for i, (label, _) in enumerate(license_scan.TEMPLATES)}
    docs += [(100, CC.format("")), (101, CC.format("-NonCommercial").replace("-", " ")), (102, f"{CC.format('')} x y z " * 3)]
    docs += [(103, CC.format("") + " some words between " + CC.format(" NonCommercial"))]
    docs += [(104, " ".join(t for _, t in license_scan.TEMPLATES))]
    want |= {100: "cc-by", 101: "cc-by-nc", 102: "cc-by", 103: "cc-by,cc-by-nc", 104: ",".join(sorted(set(want.values())))}
    rows = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r._id: r.labels for r in rows} == want
    assert all(r.score == 1.0 for r in rows)


def _labels(spark, texts):
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r._id: r.labels for r in rows}
    return [found.get(i, "") for i in range(len(texts))]


def test_echoes_of_a_notice_do_not_hide_it(spark):
    mit = license_scan.TEMPLATES[0][1]
    texts = [f"{mit} {'of the software ' * n}" for n in (1, 3, 20, 500)]
    texts += [f"{mit} {'of the software x ' * 20}", f"{'of the software ' * 20} {mit}", f"{'copies of the software ' * 9}"]
    # A word put in or left out here and there.
    words = mit.split()
    texts += [" ".join(words[:20] + ["quite"] + words[20:35] + words[36:]) + " of the software" * 20]
    assert _labels(spark, texts) == ["mit"] * 6 + ["", "mit"]


def test_neighbouring_licences_are_told_apart(spark):
    texts = [
        CC.format("-ShareAlike"),
        CC.format("-NoDerivatives"),
        CC.format("-NonCommercial-ShareAlike"),
        CC.format("-NonCommercial-NoDerivatives"),
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation",
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not '
        "distributed with this file, You can obtain one at https://example.org/",
    ]
    assert _labels(spark, texts) == ["cc-by-sa", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "lgpl", "agpl", "mpl-2"]


def test_base_columns_of_the_registered_query(spark, documents):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in registry.op9_license_scans(spark, SF_DIR).collect()}
    assert set(got) == set(documents)
    for i, text in documents.items():
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        places = [
            (k, label)
            for phrase, label in license_scan.PHRASES
            for k in range(len(words))
            if words[k : k + len(phrase.split())] == phrase.split()
        ]
        at, labels = sorted(k for k, _ in places), sorted({x for _, x in places})
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(labels))
        assert (r.first_word, r.last_word) == ((at[0], at[-1]) if at else (None, None))
        assert set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1
