"""Licence recognition by sentence rules.

Only DataFrame functions. Known sentences that are wrapped over several lines, with comment
marks or without, are first put on one line; a blank line or a sentence's end is never
crossed. Then a text is cut into sentences (line ends, or a full stop,
exclamation or question mark before white space), each is normalised to lower-case
letters and digits, and those in ``SENTENCES`` become identifiers. The sequence of
a document's identifiers is matched against ``RULES`` in their order: what a rule matches
is taken out of the sequence before later, shorter rules are tried.

Defined results: documents without a known sentence give no row, so neither do null and
empty texts; a text of any length is searched whole; repeated rows give repeated
results; identifiers that no rule takes are reported as ``unmatched``. Columns other
than the id and the text are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software": "mit-keep",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache-2-notice",
    "licensed under the apache license version 2 0 the license": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-2-comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2-copy",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "all rights reserved": "reserved",
}
#: Licence names and the identifier sequences that stand for them, longest first.
RULES = (
    ("MIT", ("mit-grant", "mit-keep", "mit-warranty")),
    ("Apache-2.0", ("apache-2-notice", "apache-2-comply", "apache-2-copy")),
    ("Apache-2.0", ("apache-2-notice", "apache-2-comply")),
    ("MIT-incomplete", ("mit-grant", "mit-keep")),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache-2-notice",)),
    ("GPL-3.0", ("gpl-3-notice",)),
    ("GPL-2.0", ("gpl-2-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("proprietary", ("reserved",)),
)
#: Every known sentence has one of these words: other texts need not be cut.
WORDS = ("licen", "rights", "permission", "software")
SPLIT = r"[.!?]+[ \t\r\n]+|[\r\n]+"
#: What may stand between two words of a wrapped sentence: no sentence end, no blank line.
BETWEEN = r"(?![^a-z0-9]*[.!?][ \t\r\n])(?![^a-z0-9]*\n[^a-z0-9\n]*\n)[^a-z0-9]++"
#: A sentence stands between line ends, sentence ends or the ends of the text.
BEFORE, AFTER = r"(?<![^\r\n])([^a-z0-9\r\n]*)|(?<=[.!?][ \t])()", r"(?=[^a-z0-9\r\n]*+(?:[\r\n]|$)|[^a-z0-9\r\n]*[.!?][ \t])"


def _unwrapped(text: Column) -> Column:
    """Every known sentence on one line."""
    for sentence in SENTENCES:
        text = F.regexp_replace(text, f"(?:{BEFORE}){BETWEEN.join(sentence.split())}{AFTER}", f"$1{sentence}")
    return text


def _sequence(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a known sentence: id, ``n_sentences`` (known ones), ``licences``
    (names, sorted and comma-joined), ``sentence_ids`` (in order) and ``unmatched``."""
    text = F.lower(F.col(text_col))
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    sentences = F.transform(
        F.split("_text", SPLIT), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    )
    rows = (
        docs.filter(F.greatest(*[F.contains(text, F.lit(w)).cast("int") for w in WORDS]) > 0)
        .select(F.col(id_col).alias("id"), _unwrapped(text).alias("_text"))
        .select("id", F.filter(F.transform(sentences, lambda s: known[s]), lambda i: i.isNotNull()).alias("ids"))
        .filter(F.size("ids") > 0)
    )
    left = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    rows = rows.withColumn("_left", left)
    hits = []
    for n, (_, ids) in enumerate(RULES):
        # a bar keeps what stood before and after a taken sequence apart
        rows = rows.withColumn(f"_after{n}", F.replace("_left", F.lit(_sequence(ids)), F.lit("|")))
        hits.append(F.when(F.col(f"_after{n}") != F.col("_left"), F.lit(RULES[n][0])))
        rows = rows.withColumn(f"_hit{n}", hits[-1]).withColumn("_left", F.col(f"_after{n}")).drop(f"_after{n}")
    names = F.array_compact(F.array(*[F.col(f"_hit{n}") for n in range(len(RULES))]))
    return rows.select(
        F.col("id").alias(id_col), F.size("ids").cast("bigint").alias("n_sentences"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.translate(F.regexp_replace("_left", "><", ","), "<>|", "").alias("unmatched"),
    )


def check_sql(documents: str = "documents") -> str:
    """The same for DuckDB, from the same fixed values."""

    def quoted(x: str) -> str:
        return "'" + x + "'"

    known = f"map([{', '.join(map(quoted, SENTENCES))}], [{', '.join(map(quoted, SENTENCES.values()))}])"
    steps, last = [], "s"
    for n, (_, ids) in enumerate(RULES):
        steps.append(f"r{n} AS (SELECT *, replace(left_{n}, '{_sequence(ids)}', '|') AS left_{n + 1} FROM {last})")
        last = f"r{n}"
    names = ", ".join(
        f"CASE WHEN left_{n} <> left_{n + 1} THEN '{name}' END" for n, (name, _) in enumerate(RULES)
    )
    return f"""
WITH t AS (SELECT doc_id, list_filter(list_transform(
    regexp_split_to_array(lower(text), '[.!?]+[ \\t\\r\\n]+|[\\r\\n]+'),
    lambda x: {known}[trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL) AS ids FROM {documents}),
s AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '') AS left_0
  FROM t WHERE len(ids) > 0),
{', '.join(steps)}
SELECT doc_id, len(ids) AS n_sentences,
  array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ',') AS licences,
  array_to_string(ids, ',') AS sentence_ids,
  translate(replace(left_{len(RULES)}, '><', ','), '<>|', '') AS unmatched
FROM {last}"""
