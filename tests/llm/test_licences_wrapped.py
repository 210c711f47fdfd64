import textwrap

import pytest

from tests.llm.test_licences import GRANT, KEEP
from tickloom.llm import licences

WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
MIT = "\n\n".join(textwrap.fill(x, 72) for x in (GRANT, KEEP, WARRANTY))
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
APACHE_TIGHT = APACHE.replace("at\n\n", "at\n")


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_texts(documents, mark):
    texts = [MIT, APACHE_TIGHT, f"Copyright\n\n{MIT}\n\nThe end."]
    docs = documents([(i, "\n".join(mark + x for x in t.split("\n"))) for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["licences"], r["n_sentences"], r["unmatched"]) for r in licences.recognise(docs).collect()}
    assert got == {0: ("MIT", 3, ""), 1: ("Apache-2.0", 3, ""), 2: ("MIT", 3, "")}


def test_blank_lines_and_sentence_ends_part(documents):
    docs = documents([(1, "Released under\n\nthe MIT license"), (2, "All rights. Reserved"), (3, "We have all\nrights reserved")])
    assert licences.recognise(docs).collect() == []
