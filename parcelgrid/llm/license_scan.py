"""License scans by sentence rules: known sentences become identifiers, sequences of them licences.

A text is normalised to lower-case letters and digits with single blanks between, so comment signs
and white space go; line ends, and full stops, colons and semicolons before white space, are kept
as cuts. A known sentence (SENTENCES, SPELLINGS) is found where its words stand in a row from one
cut (and a list number after it) to another, whatever cuts are between: wrapped at any width, or
on one line. One of LONG words or more may also follow other words, as after the names in a
copyright line that has no end. It becomes its identifier; all else is passed over. RULES, in order, are then looked
for as runs of the identifiers; a rule that matches names its licence and takes those identifiers
out, so a longer licence text is not also reported as the shorter ones it contains.

All of it is expressions over one row; nothing is shuffled.

Defined results: a null or blank text has no sentence and no licence; repeated rows are scanned
each; a null doc_id is passed on; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import text_or_empty

#: Normalised sentences of licence notices and texts.
SENTENCES = {
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-limit": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-ref": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "mpl-ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "ccbync-ref": "licensed under cc by nc 4 0",
    "ccby-ref": "licensed under cc by 4 0",
    "cc0-ref": "this work is dedicated to the public domain",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
    "reserved": "all rights reserved",
}

#: Further sentences of the canonical texts that have an identifier of SENTENCES.
SPELLINGS = {
    "licensed under the apache license version 2 0 the license": "apache-ref",
    "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "spdx license identifier gpl 3 0 or later": "spdx-gpl3+",
}

#: Words of a sentence that tell it wherever it begins.
LONG = 9

#: Ordered: the first that matches takes its identifiers.
RULES = (
    ("Apache-2.0", ("apache-ref", "apache-limit", "apache-copy", "apache-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("CC-BY-NC-4.0", ("ccbync-ref",)),
    ("CC-BY-4.0", ("ccby-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("proprietary", ("reserved",)),
)

#: Before RULES: canonical texts whose copyright line ends in a sentence that is a rule by itself.
WHOLE = (
    ("BSD-3-Clause", ("reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("reserved", "bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("spdx-gpl3+",)),
)


def _key(ids: tuple[str, ...]) -> str:
    return "".join(f"|{i}|" for i in ids)


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses): both arrays; licences in the order of WHOLE and RULES, each once."""
    own = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    # of the whole text at once: words are then parted by a blank, or by a line end at a cut
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("text"), "[.:;](\\s|\\z)", "\n"), "[^a-z0-9\\n]+", " "), "(?: ?\n)+ ?", "\n")
    sentences = {s: i for i, s in SENTENCES.items()} | SPELLINGS
    known = F.create_map(*[F.lit(x) for s, i in sentences.items() for x in (s, i)])
    ways = [s.replace(" ", "[ \\n]") for s in sorted(sentences, key=len, reverse=True)]
    long = [w for w in ways if w.count("[") >= LONG - 1]
    begin = f"^(?:[0-9]{{1,2}}[ \\n])?|(?<= )(?={'|'.join(long)})"
    found = F.regexp_extract_all(F.trim(flat), F.lit(f"(?md)(?:{begin})({'|'.join(ways)}) ?$"), F.lit(1))
    cut = own.select("doc_id", found.alias("found"))
    named = cut.select(
        "doc_id",
        F.filter(F.transform("found", lambda s: F.try_element_at(known, F.translate(s, "\n", " "))), lambda i: i.isNotNull()).alias("sentence_ids"),
    )
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(_key(k)).alias("key")) for n, k in WHOLE + RULES])
    start = F.struct(
        F.concat(F.lit(""), F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "")).alias("left"),
        F.array().cast("array<string>").alias("names"),
    )

    def apply(now, rule):
        hit = F.contains(now["left"], rule["key"])
        return F.struct(
            F.replace(now["left"], rule["key"], F.lit("#")).alias("left"),
            F.when(hit, F.array_append(now["names"], rule["name"])).otherwise(now["names"]).alias("names"),
        )

    names = F.when(F.size("sentence_ids") == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.aggregate(rules, start, apply)["names"])
    )
    return named.select("doc_id", "sentence_ids", names.alias("licenses"))


def _sql() -> str:
    known = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
    steps = []
    for n, (name, ids) in enumerate(RULES):
        steps.append(
            f"s{n + 1} AS (SELECT * REPLACE (replace(k, '{_key(ids)}', '#') AS k, "
            f"CASE WHEN contains(k, '{_key(ids)}') THEN list_append(names, '{name}') ELSE names END AS names) FROM s{n})"
        )
    return f"""
WITH known(id, sentence) AS (VALUES {known}),
cut AS (
  SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')),
      '[.](\\s|$)', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), chr(10))) AS s,
    generate_subscripts(string_split(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')),
      '[.](\\s|$)', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), chr(10)), 1) AS n
  FROM documents
), hits AS (
  SELECT doc_id, list(id ORDER BY n) AS ids FROM cut JOIN known ON trim(s) = sentence GROUP BY doc_id
), s0 AS (
  SELECT doc_id, array_to_string(list_transform(ids, lambda x: '|' || x || '|'), '') AS k, ids,
    CAST([] AS VARCHAR[]) AS names FROM hits
), {', '.join(steps)}
SELECT d.doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences,
  coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licenses
FROM documents d LEFT JOIN s{len(RULES)} f ON d.doc_id = f.doc_id
"""


SQL = _sql()
