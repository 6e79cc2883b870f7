"""Licence recognition by sentences: known sentences become identifiers, rules match sequences of them.

All DataFrame expressions: a text is cut into sentences, each is normalised and looked
up in the (small, fixed) table of known licence sentences, the identifiers found in a
text are put in order, and a rule matches where its sequence of identifiers occurs without another known
sentence in between.  A rule whose sequence is part of a longer rule's yields to it.
Only sentences that are known leave their task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised (lower case, one blank between runs of a-z and 0-9).
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-the": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-title": "apache license version 2 0 january 2004",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-include": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx-mpl2": "spdx license identifier mpl 2 0",
}

# Other public wordings of known sentences, among them those that run on into an address without a full stop.
VARIANTS = {
    "apache license version 2 0 january 2004 http www apache org licenses": "apache-title",
    "apache license version 2 0 january 2004 https www apache org licenses": "apache-title",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-obtain",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-obtain",
}
#: A text without any of these holds no known sentence.
SIGNS = ("licen", "software", "redistribution", "warranty", "mpl")

# Rules as (licence, ordered sentences).
RULES = {
    "apache-2.0-notice": ("Apache-2.0", ("apache-notice",)),
    "apache-2.0-header": ("Apache-2.0", ("apache-notice-the", "apache-comply", "apache-obtain")),
    "apache-2.0-header-short": ("Apache-2.0", ("apache-notice", "apache-comply")),
    "apache-2.0-text": ("Apache-2.0", ("apache-title",)),
    "apache-2.0-spdx": ("Apache-2.0", ("spdx-apache",)),
    "mit-notice": ("MIT", ("mit-notice",)),
    "mit-licensed": ("MIT", ("mit-licensed",)),
    "mit-title": ("MIT", ("mit-title",)),
    "mit-text": ("MIT", ("mit-grant", "mit-include", "as-is")),
    "mit-grant": ("MIT", ("mit-grant",)),
    "mit-spdx": ("MIT", ("spdx-mit",)),
    "isc-text": ("ISC", ("isc-grant",)),
    "bsd-2-clause": ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    "bsd-3-clause": ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    "bsd-3-spdx": ("BSD-3-Clause", ("spdx-bsd3",)),
    "gpl-3.0-notice": ("GPL-3.0", ("gpl3-notice",)),
    "gpl-3.0-header": ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-received")),
    "gpl-3.0-grant": ("GPL-3.0-or-later", ("gpl-free",)),
    "gpl-2.0-header": ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-received")),
    "gpl-2.0-grant": ("GPL-2.0-or-later", ("gpl2-free",)),
    "gpl-3.0-spdx": ("GPL-3.0-or-later", ("spdx-gpl3",)),
    "mpl-2.0-header": ("MPL-2.0", ("mpl-subject", "mpl-obtain")),
    "mpl-2.0-subject": ("MPL-2.0", ("mpl-subject",)),
    "mpl-2.0-spdx": ("MPL-2.0", ("spdx-mpl2",)),
    "unlicense": ("Unlicense", ("unlicense",)),
    "cc-by-nc-4.0": ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    "cc-by-4.0": ("CC-BY-4.0", ("cc-by-4",)),
    "cc-by-sa-4.0": ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
}


def _sequence(rule: str) -> str:
    return "|" + "|".join(RULES[rule][1]) + "|"


def _longer(rule: str) -> list[str]:
    """The sequences of rules that contain this rule's."""
    own = _sequence(rule)
    return [_sequence(r) for r in RULES if _sequence(r) != own and own in _sequence(r)]


def _words_of(sentence: str) -> str:
    """A pattern of a known sentence's words, whatever stands between them but the end of a sentence.

    The sentence has to end there, or its first words may be another one.
    """
    gap = r"(?![^A-Za-z0-9]*[.!?]\s)[^A-Za-z0-9]++"
    first, *others = sentence.split(" ")
    pattern = rf"(?i)(?<![A-Za-z0-9])({first})"
    for before, word in zip([first, *others], others):
        pattern += (r"[^A-Za-z0-9]++" if before == "v" else gap) + word
    return pattern + r"(?=[^A-Za-z0-9\n]*(?:\z|\n(?![ \t]*(?-i:[a-z]))|[.!?;:]\s))"


def whole(text: Column) -> Column:
    """A text with its known sentences in one piece: no line breaks, comment marks, colons and so on inside."""
    lower, joined = F.lower(text), text
    for sentence in sorted({*SENTENCES.values(), *VARIANTS}, key=len, reverse=True):
        # The first word stays as it is: a line in lower case would go on the one before.
        joined = F.regexp_replace(joined, _words_of(sentence), " ".join(["$1", *sentence.split(" ")[1:]]))
    signs = F.lit(False)
    for sign in SIGNS:
        signs |= lower.contains(sign)
    return F.when(signs, joined).otherwise(text)


def sentences(text: Column) -> Column:
    """Normalised sentences of a text: cut at line breaks, and after . ! ? ; : before white space.

    A line that goes on in lower case belongs to the sentence before it, and nothing is cut inside a known sentence.
    """
    text = whole(F.regexp_replace(text, r"\r", ""))
    text = F.regexp_replace(text, r"\n[ \t]*([a-z])", " $1")
    text = F.regexp_replace(text, r"([.!?;:])[ \t]+", "$1\n")
    plain = F.lower(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9\n]+", " ")))
    return F.transform(F.split(plain, "\n"), lambda x: F.trim(x))


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table, as an expression."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def license_scan(documents: DataFrame) -> DataFrame:
    """Rules found in ``documents`` (doc_id, text): ``doc_id, rule, license, times, first_sentence, known_sentences``.

    One row per row and rule found; ``first_sentence`` is the place (from 0) of the
    row's first known sentence.  NULL and empty texts have no licences.  Rows that share
    a NULL or repeated ``doc_id`` are scanned each for itself only if their texts differ; equal rows give one
    result.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = documents.sparkSession
    known = _table(spark, [(v, k) for k, v in SENTENCES.items()] + list(VARIANTS.items()), ["sentence", "name"])
    digest = F.xxhash64("text")
    # Most texts hold no known sentence: what follows is for the few that do.
    cut = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).select("doc_id", digest.alias("digest"), F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))
    found = cut.join(F.broadcast(known), "sentence").select("doc_id", "digest", "place", "name").distinct()
    ordered = found.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("seen"))
    # A bar on both sides of every name, so that neighbours do not share one.
    names = F.concat(F.lit("|"), F.array_join("seen.name", "||"), F.lit("|"))
    ordered = ordered.select(
        "doc_id", names.alias("names"), F.col("seen")[0]["place"].alias("first_sentence"), F.size("seen").alias("known_sentences")
    )
    rows = []
    for rule in RULES:
        doubled = _sequence(rule)[1:-1].replace("|", "||")
        longer = [s[1:-1].replace("|", "||") for s in _longer(rule)]
        rows.append(_hits(rule, f"|{doubled}|", [f"|{x}|" for x in longer]))
    return ordered.select(
        "doc_id", F.explode(F.filter(F.array(*rows), lambda x: x["times"] > 0)).alias("hit"), "first_sentence", "known_sentences"
    ).select(
        "doc_id",
        F.col("hit.rule").alias("rule"),
        F.col("hit.license").alias("license"),
        F.col("hit.times").cast("long").alias("times"),
        F.col("first_sentence").cast("long").alias("first_sentence"),
        F.col("known_sentences").cast("long").alias("known_sentences"),
    )


def _hits(rule: str, sequence: str, longer: list[str]) -> Column:
    """How often a rule's sequence occurs outside those of longer rules."""
    names = F.col("names")
    for other in sorted(longer, key=len, reverse=True):
        names = F.replace(names, F.lit(other), F.lit("#"))
    times = (F.length(names) - F.length(F.replace(names, F.lit(sequence), F.lit("")))) / F.lit(len(sequence))
    return F.struct(F.lit(rule).alias("rule"), F.lit(RULES[rule][0]).alias("license"), F.floor(times).alias("times"))


def _oracle() -> str:
    known = ", ".join(f"('{v}', '{k}')" for k, v in SENTENCES.items())
    hits = []
    for rule, (name, _) in RULES.items():
        names = "names"
        for other in sorted(_longer(rule), key=len, reverse=True):
            names = f"replace({names}, '|{other[1:-1].replace('|', '||')}|', '#')"
        own = f"|{_sequence(rule)[1:-1].replace('|', '||')}|"
        hits.append(
            f"{{'rule': '{rule}', 'license': '{name}', 'times': (length({names}) - length(replace({names}, '{own}', ''))) // {len(own)}}}"
        )
    return rf"""
WITH known(sentence, name) AS (VALUES {known}),
plain AS (
  SELECT doc_id, text, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r', '', 'g'),
    '\n[ \t]*([a-z])', ' \1', 'g'), '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), '[^A-Za-z0-9\n]+', ' ', 'g'))) AS p FROM documents),
cut AS (SELECT doc_id, text, unnest(string_split(p, chr(10))) AS sentence, unnest(range(len(string_split(p, chr(10))))) AS place FROM plain),
found AS (SELECT DISTINCT doc_id, text, place, name FROM cut JOIN known ON trim(cut.sentence) = known.sentence),
ordered AS (
  SELECT doc_id, '|' || string_agg(name, '||' ORDER BY place) || '|' AS names, min(place) AS first_sentence, count(*) AS known_sentences
  FROM found GROUP BY doc_id, text)
SELECT doc_id, rule, license, times::BIGINT AS times, first_sentence::BIGINT AS first_sentence, known_sentences::BIGINT AS known_sentences
FROM (SELECT doc_id, first_sentence, known_sentences, unnest([{', '.join(hits)}], recursive := true) FROM ordered) WHERE times > 0
"""


ORACLE_SQL = _oracle()
