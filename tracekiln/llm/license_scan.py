r"""Operator 6 [native]: licence scans by sentence rules.

A text is normalised (lower case, runs of other characters than a-z and 0-9 as one
space) between its sentence ends (``.``, ``!`` or ``?`` before white space) and its
line ends. Known licence sentences are found from such an end to another, over any
single line ends and comment marks between their words, but not over blank lines or
sentence ends; so a document becomes a short sequence of identifiers. Ordered
rules over identifiers are then matched, longest first; what a rule matches
takes no part in later ones.

Defined cases: null and empty texts have no sentences and no licence. A repeated
notice gives its licence once and its identifiers each time. Identifiers that no
rule uses remain as ``unruled``. Repeated rows give equal rows; other columns are
ignored. The SQL of the query finds sentences that stand on one line, as it has no
wrapped ones; the query gives those rows, and more where a notice is wrapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekiln.llm.common import text_or_empty

#: Sentences of well-known licences and notices, normalised.
SENTENCES = {
    "A1": "licensed under the apache license version 2 0",
    "A2": "you may not use this file except in compliance with the license",
    "A3": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "A4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "M1": "released under the mit license",
    "M2": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "M3": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "M4": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "G1": "this work is licensed under the gnu general public license version 3",
    "G2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "G3": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "C1": "licensed under cc by nc 4 0",
    "C2": "licensed under cc by 4 0",
    "C3": "licensed under cc by sa 4 0",
    "B1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "B2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "R1": "all rights reserved",
}
_AN = "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
_USE = "the license you may not use this file except in compliance with the license"
_URL = "you may obtain a copy of the license at{} www apache org licenses license 2 0"
#: How genuine notices run sentences together, or write them otherwise: normalised, identifiers.
VARIANTS = {
    f"{SENTENCES['A1']} {_USE}": "A1 A2",
    f"the asf licenses this file to you under the apache license version 2 0 {_USE}": "A1 A2",
    f"the asf licenses this file under the apache license version 2 0 {_USE}": "A1 A2",
    _URL.format(" https"): "A3",
    f"{SENTENCES['A3']} {_AN}": "A3 A4",
    f"{_URL.format(' https')} {_AN}": "A3 A4",
    f"{SENTENCES['M2']} {SENTENCES['M3']}": "M2 M3",
    **{f"{title} {SENTENCES['M2']}{rest}": ids for title in ("mit license", "the mit license") for rest, ids in (("", "M2"), (f" {SENTENCES['M3']}", "M2 M3"))},
    SENTENCES["M4"].replace("noninfringement", "non infringement"): "M4",
    f"{SENTENCES['B1']} 1": "B1",
    f"{SENTENCES['B1']} {SENTENCES['B2']}": "B1 B2",
}
#: Fixed values: (licence, identifiers in order); the first that matches takes its sentences.
RULES = (
    ("Apache-2.0-notice", "A1 A2 A3 A4"),
    ("Apache-2.0-notice", "A1 A2 A4"),
    ("MIT-text", "M2 M3 M4"),
    ("MIT-text", "M2 M3"),
    ("GPL-3.0-or-later-notice", "G2 G3"),
    ("BSD-text", "B1 B2"),
    ("Apache-2.0", "A1"),
    ("MIT", "M1"),
    ("GPL-3.0", "G1"),
    ("GPL-3.0-or-later", "G2"),
    ("CC-BY-NC-4.0", "C1"),
    ("CC-BY-SA-4.0", "C3"),
    ("CC-BY-4.0", "C2"),
    ("all-rights-reserved", "R1"),
)
#: A text without any of these holds no known sentence, and is not split.
ANY = r"(?i)licen[sc]e|permission|reserved|redistribution|warrant|compliance|copyright|free software"

_ENDS = r"([.!?])[\x20\x09-\x0D]+"
_STOP = "\x01"


def _sentences() -> str:
    """Every known sentence between two ends; its words stand on one line or on successive ones, a link below a blank one."""
    known = sorted([*SENTENCES.values(), *VARIANTS], key=len, reverse=True)
    words = "|".join(x.replace(" ", "[ \n]").replace("[ \n]http", "[ \n]\n?http") for x in known)
    return rf"(?<![^\n{_STOP}])(?:{words})(?![^\n{_STOP}])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for k, v in [*((v, k) for k, v in SENTENCES.items()), *VARIANTS.items()] for x in (k, v)])
    ended = F.regexp_replace(F.translate(F.lower(text), _STOP, " "), _ENDS, _STOP)
    plain = F.regexp_replace(F.regexp_replace(ended, rf"[^a-z0-9\n{_STOP}]+", " "), rf"^ | $| ?([\n{_STOP}]) ?", "$1")
    found = F.regexp_extract_all(plain, F.lit(_sentences()), F.lit(0))
    ids = F.flatten(F.transform(found, lambda s: F.split(F.try_element_at(known, F.regexp_replace(s, "[ \n]+", " ")), " ")))
    return F.when(text.rlike(ANY), ids).otherwise(F.array().cast("array<string>"))


def licenses(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, sentence_ids, licenses, unruled, n_licenses."""
    ids = docs.select(docs["doc_id"], sentence_ids(text_or_empty(docs["text"])).alias("ids"))
    row = ids.select("doc_id", F.array_join("ids", " ").alias("sentence_ids"), F.concat(F.lit(" "), F.array_join(F.transform("ids", lambda x: F.concat(x, F.lit(" "))), " ")).alias("rest"))
    # Each identifier has its own spaces on both sides, so that a removed one leaves a gap no rule spans.
    hits = []
    for k, (_, sequence) in enumerate(RULES):
        pattern = F.lit(" " + "  ".join(sequence.split()) + " ")
        row = row.withColumn(f"hit_{k}", F.contains("rest", pattern)).withColumn("rest", F.when(F.col(f"hit_{k}"), F.replace("rest", pattern, F.lit(" . "))).otherwise(F.col("rest")))
        hits.append(F.when(F.col(f"hit_{k}"), F.lit(RULES[k][0])))
    names = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return row.select(
        "doc_id",
        "sentence_ids",
        F.array_join(names, " ").alias("licenses"),
        F.btrim(F.regexp_replace("rest", r"[. ]+", " ")).alias("unruled"),
        F.size(names).cast("long").alias("n_licenses"),
    )
