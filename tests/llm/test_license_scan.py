import re

import pytest
from edge import docs, none

from reelsift.llm import license_scan as ls
from reelsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    places = sorted((i, label) for phrase, label in ls.BASE.items() for i in range(len(ws)) if ws[i:i + len(phrase.split())] == phrase.split())
    return (len(ws), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))


def test_base_columns_over_whole_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op7_license_scan"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute(r.text)
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1
        assert g.labels == ",".join(sorted(set(g.labels.split(","))))
        assert (g.score > 0) == (g.labels != "")


@pytest.mark.parametrize(("text", "labels"), [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("GNU Lesser General Public License v2.1 or later", "lgpl-2.1"),
    ("redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3", "agpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("The MIT License and the BSD 3-Clause License", "bsd-3-clause,mit"),
    ("GPLv2 here", "gpl-2.0"),
    ("Mozilla Public License 2.0", "mpl-2.0"),
    ("a general public license", ""), ("permit licensed drivers", ""), ("emits licenses", ""), ("", ""), (None, "")])
def test_statements(text, labels):
    assert ls.scan_text(None if text is None else text.encode())[5] == labels


def test_what_lies_inside_is_suppressed_by_priority():
    found = ls.detect(ls.in_words(b"licensed under the Apache License, Version 2.0 and again the Apache License")[0])
    assert [d[2] for d in found] == ["apache-2.0", "apache"]  # the mention inside the statement is gone, the later one stays


def test_rules_are_hundreds_and_gated_by_keywords_they_need():
    by_key, _ = ls.rules()
    assert sum(map(len, by_key.values())) >= 300
    assert all(r.keyword == k for k, rules in by_key.items() for r in rules)


def test_edges(spark):
    df = docs(spark, extra=("labels", "score", "n_words"))
    got = ls.scan(df).collect()
    assert len(got) == 10 and all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(r.text) for r in got)
    assert ls.scan(none(spark)).count() == 0
