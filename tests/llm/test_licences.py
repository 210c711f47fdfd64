import duckdb
import pytest

from tests.llm.conftest import TEXTS
from tickloom.llm import licences

GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
KEEP = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software."
)
CASES = [
    (101, "Released under the MIT License.\nSome prose.", "MIT", ""),
    (102, f"{GRANT}\n\n{KEEP}", "MIT-incomplete", ""),
    (103, f"{KEEP} {GRANT}\n", "", "mit-keep,mit-grant"),
    (104, "Prose. All rights reserved. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,proprietary", ""),
    (105, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in "
          "compliance with the License.", "Apache-2.0", ""),
    (106, "all RIGHTS reserved\r\nall rights reserved", "proprietary", ""),
    (107, "We reserve all rights. This licence is unknown.", None, None),
]


def test_cases(documents):
    docs = documents([*TEXTS, *[(i, t) for i, t, _, _ in CASES], (108, "x. " * 40_000 + "All rights reserved.")])
    got = {r["doc_id"]: (r["licences"], r["unmatched"]) for r in licences.recognise(docs).collect()}
    want = {i: (names, left) for i, _, names, left in CASES if names is not None}
    assert got == want | {108: ("proprietary", "")}


def test_check_sql_agrees(documents):
    docs = documents([*TEXTS, *[(i, t) for i, t, _, _ in CASES]])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    got = sorted(map(tuple, licences.recognise(docs).collect()))
    assert got == sorted(con.execute(licences.check_sql()).fetchall())


def test_every_sentence_is_normal_and_has_a_word():
    for sentence, name in licences.SENTENCES.items():
        assert any(w in sentence for w in licences.WORDS) and sentence == " ".join(sentence.split())
        assert any(name in ids for _, ids in licences.RULES)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_nothing_to_find(documents, rows):
    assert licences.recognise(documents(rows)).collect() == []
