import hashlib

from tests.llm.conftest import TEXTS
from tickloom.llm import stages


def test_last_stage_gives_texts_back(documents):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    got = stages.tokens(documents(rows).sparkSession, documents(rows), "").collect()
    assert all(r["intact"] for r in got)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in got) == sorted((i, digest(t)) for i, t in rows)
