"""Licence recognition by sentences: known sentences become letters, licence rules are words of letters.

A text is cut into sentences at line ends and after ``.``, ``!`` or ``?`` before white space. Each is
normalised (ASCII letters in lower case, everything but letters and digits one space), and looked up
among the known sentences, or taken as a copyright line. The text is then the sequence of the letters
of its sentences, unknown runs being one ``.``. Those are the columns n_sentences and sequence.

The licences are read from whole paragraphs, because texts are wrapped: a known sentence may go on
over line ends, as long as it begins and ends at a line end, a sentence end or a semicolon. Numbers
of lists and comment marks are dropped, and sentences that only complete texts have (``MORE``) are
known too. Rules are tried from the longest to the shortest; what one has matched is no longer open to
the shorter ones. A rule passes over the grant, conditions and disclaimers that a complete text has in
between. On notices of one line each this gives what the sequence gives (``SQL`` says no more).

All of it happens in the row, without a shuffle. Defined cases: a null or empty text has no sentences;
repeated rows and null doc_ids are scanned one by one; a very long text is scanned whole, in its row;
of rules that match the same sentences the longest counts; an empty table gives an empty result; columns
other than doc_id and text play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planewatch.llm.words import table

# Sentences of public licences and notices, normalised.
SENTENCES = {
    "A": "licensed under the apache license version 2 0",
    "B": "released under the mit license",
    "C": "this work is licensed under the gnu general public license version 3",
    "D": "licensed under cc by nc 4 0",
    "E": "you may not use this file except in compliance with the license",
    "F": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "G": "see the license for the specific language governing permissions and limitations under the license",
    "H": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "I": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "J": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "K": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "L": "all rights reserved",
    "M": "mit license",
    "N": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "O": "this work is licensed under a creative commons attribution 4 0 international license",
    "P": "spdx license identifier mit",
    "Q": "spdx license identifier apache 2 0",
}
COPYRIGHT = "Z"
COPYRIGHT_LINE = "^copyright( c)? [0-9]{4}( |$)"
# Sequences of sentences and the licence they are.
RULES = [
    ("apache-2.0-header", "AEFG"), ("apache-2.0-notice", "A"), ("apache-2.0-id", "Q"), ("mit-text", "MZH"), ("mit-text", "ZH"), ("mit-notice", "B"),
    ("mit-id", "P"), ("gpl-3.0-notice", "C"), ("gpl-3.0-or-later-notice", "N"), ("bsd-3-clause", "IJK"), ("bsd-2-clause", "IJ"),
    ("cc-by-nc-4.0-notice", "D"), ("cc-by-4.0-notice", "O"), ("all-rights-reserved", "ZL"),
]
ORDERED = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# Sentences that stand between those above in complete texts; (the "License") may follow A.
MORE = {
    "R": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "S": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "T": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "U": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "A": SENTENCES["A"] + " the license",
    "K": SENTENCES["K"].replace("neither", "and neither"),
}
# Where a rule has these two letters one after the other, a complete text may have what follows in between.
BETWEEN = {"ZH": "L?[R.]?", "FG": "[S.]?", "EF": r"\.?", "MZ": r"\.?"}
BREAK, LINE = "\x01", "\x02"


def _pattern(word: str) -> str:
    return word[0] + "".join(BETWEEN.get(a + b, "") + b for a, b in zip(word, word[1:], strict=False))


def _paragraphs(text: Column) -> Column:
    """The letters of the sentences of a text, wrapped or not."""
    steps = [
        (r"\r\n?", "\n"),
        (r"(?m)^([^A-Za-z0-9\n]*)\(?(?:[0-9]{1,2}|[A-Za-z])[.)][ \t]+", "$1"),  # numbers of lists
        (r"[.!?][ \t\n]+", BREAK),
        # An address on a line of its own belongs to the sentence before it.
        (";", LINE), (r"\n[^A-Za-z0-9\n]*\n(?![^A-Za-z0-9\n]*http)", BREAK), (r"\n", LINE),
    ]
    out = reduce(lambda t, step: F.regexp_replace(t, *map(F.lit, step)), steps, F.concat(F.lit(BREAK), text, F.lit(BREAK)))
    out = F.regexp_replace(F.translate(out, UPPER, LOWER), f"[^a-z0-9{BREAK}{LINE}]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, f"[ {LINE}]*{BREAK}[ {LINE}{BREAK}]*", BREAK), f" ?{LINE}[ {LINE}]*", LINE)
    edge = f"[{BREAK}{LINE}]"
    known = sorted([*SENTENCES.items(), *MORE.items()], key=lambda x: -len(x[1]))
    for letter, sentence in known:
        out = F.regexp_replace(out, f"(?<={edge}){sentence.replace(' ', f'[ {LINE}]')}(?={edge})", letter)
    line = f"(?<={edge}){COPYRIGHT_LINE[1:].replace('( |$)', f'(?: [^{BREAK}{LINE}A-Z]*)?')}(?={edge})"
    out = F.regexp_replace(out, line, COPYRIGHT)
    return F.regexp_replace(F.regexp_replace(out, "[^A-Z]*[a-z0-9][^A-Z]*", "."), edge, "")


def sentences(text: Column) -> Column:
    """The normalised sentences of a text that have a letter or digit."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\r\n]+", "$1\n"), "\n")
    plain = F.transform(lines, lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " ")))
    return F.filter(plain, lambda s: s != "")


def _letter(sentence: Column) -> Column:
    out = F.when(sentence.rlike(COPYRIGHT_LINE), COPYRIGHT)
    for letter, known in SENTENCES.items():
        out = out.when(sentence == known, letter)
    return out.otherwise(".")


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sequence, licences (comma-separated, in the order of the rules; null if none)."""
    # Every rule has a sentence with one of these words.
    lower = F.translate("text", UPPER, LOWER)
    letters = F.when(F.contains(lower, F.lit("licen")) | F.contains(lower, F.lit("copyright")), _paragraphs(F.col("text")))
    split = docs.select("doc_id", sentences(F.col("text")).alias("own"), F.coalesce(letters, F.lit("")).alias("letters"))
    read = split.select(
        "doc_id", F.size("own").cast("long").alias("n_sentences"),
        F.regexp_replace(F.array_join(F.transform("own", _letter), ""), r"\.+", ".").alias("sequence"), "letters",
    )
    # The open rest after each rule: what earlier rules matched is cut out.
    rests = reduce(lambda rests, rule: [*rests, F.regexp_replace(rests[-1], _pattern(rule[1]), ".")], ORDERED, [F.col("letters")])
    hits = [F.when(rest.rlike(_pattern(word)), F.lit(name)) for rest, (name, word) in zip(rests, ORDERED, strict=False)]
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    return read.select("doc_id", "n_sentences", "sequence", F.when(F.size(found) > 0, F.array_join(found, ",")).alias("licences"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


_RESTS = ["sequence"]
for _, _word in ORDERED:
    _RESTS.append(f"replace({_RESTS[-1]}, '{_word}', '.')")
_HITS = ", ".join(f"CASE WHEN contains({rest}, '{word}') THEN '{name}' END" for rest, (name, word) in zip(_RESTS, ORDERED, strict=False))
_LETTERS = " ".join(f"WHEN s = '{known}' THEN '{letter}'" for letter, known in SENTENCES.items())
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents), s AS (
  SELECT k, i, trim(regexp_replace(translate(l, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS s
  FROM (SELECT k, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
        FROM (SELECT k, string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)) AS ls FROM d))
), q AS (
  SELECT k, count(*) AS n, regexp_replace(string_agg(CASE WHEN regexp_matches(s, '{COPYRIGHT_LINE}') THEN '{COPYRIGHT}' {_LETTERS} ELSE '.' END, '' ORDER BY i), '\.+', '.', 'g') AS sequence
  FROM s WHERE s <> '' GROUP BY k
), f AS (SELECT k, n, sequence, list_filter([{_HITS}], lambda x: x IS NOT NULL) AS names FROM q)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(sequence, '') AS sequence,
  CASE WHEN len(names) > 0 THEN array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ',') END AS licences
FROM d LEFT JOIN f USING (k)
"""
