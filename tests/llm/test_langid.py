import random
import zlib

from tests.llm.conftest import TEXTS
from tickloom.llm import langid

WORDS = {
    "en": "the of and to in that is was for with his they have from this which would there their about".split(),
    "de": "der die und das ist nicht mit auf eine sich auch werden haben über nach durch zwischen könnte".split(),
    "fr": "le la les des est dans une pour que qui avec sur pas plus été être leurs cette après même".split(),
}


def corpus(n=240):
    rng, rows = random.Random(9), []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(30, 120))), lang))
    return rows


def test_held_out_accuracy(spark, documents):
    rows = corpus()
    docs = documents([]).select("doc_id", "text", "lang").union(
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    )
    dictionaries = langid.train(docs.filter(~langid.held_out()))
    assert sorted(dictionaries) == ["de", "en", "fr"] and all(len(d) <= langid.DICTIONARY for d in dictionaries.values())
    got = langid.classify(docs.select("doc_id", "text", langid.held_out().alias("out")), dictionaries, keep=("out",)).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_all_blocks_of_a_long_text_count():
    model = langid.Classifier({k: " ".join(w * 40).encode() for k, w in WORDS.items()})
    rng = random.Random(2)
    text = " ".join(rng.choices(WORDS["en"], k=200)) + " " + " ".join(rng.choices(WORDS["de"], k=20_000))
    assert model.predict(text)[0] == "de"
    blocks = [text.lower().encode()[k:k + langid.BLOCK] for k in range(0, len(text.encode()), langid.BLOCK)]
    assert model.sizes(text) == [sum(len(c.compress(b)) for b in blocks) for c in model.compressors]


def test_edge_rows(messy, documents):
    dictionaries = {"en": b"the cat sat on the mat", "de": b"die katze sitzt auf der matte"}
    got = langid.classify(messy, dictionaries).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        if r["doc_id"] in (3, 4, 5, 9):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        else:
            assert r["lang_pred"] in dictionaries
    assert {r["lang_pred"] for r in langid.classify(messy, {}).collect()} == {"und"}
    assert langid.train(documents([])) == {} and langid.classify(documents([]), dictionaries).collect() == []
    assert langid.train(documents([(1, "some text")], lang=None)) == {}


def test_equal_sizes_go_to_the_first_language():
    model = langid.Classifier({"b": b"same content", "a": b"same content"})
    assert model.predict("same content here") == ("a", 0.0)
