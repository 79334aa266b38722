"""Licence recognition by sentences and ordered rules.

A text is cut into sentences, each is normalised and looked up among known licence sentences, and the sequence of their
identifiers is matched against rules. Rules are tried in order, longer ones first; what a rule matches is used up, so a
part of a full licence text doesn't count again as a short notice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences (lower case, runs of anything but a-z and 0-9 are one space).
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2-by",
    "licensed under the apache license version 2 0 the license": "apache-2-by",
    "you may not use this file except in compliance with the license": "apache-2-use",
    "you may obtain a copy of the license at": "apache-2-copy",
    "http www apache org licenses license 2 0": "apache-2-url",
    "released under the mit license": "mit-by",
    "licensed under the mit license": "mit-by",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3-by",
    "licensed under the gnu general public license version 3": "gpl-3-by",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "licensed under cc by 4 0": "cc-by-4-by",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-by",
    "licensed under cc by sa 4 0": "cc-by-sa-4-by",
    "licensed under cc by nc 4 0": "cc-by-nc-4-by",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4-by",
    "licensed under cc by nd 4 0": "cc-by-nd-4-by",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "licensed under the bsd 2 clause license": "bsd-2-by",
    "released under the bsd 2 clause license": "bsd-2-by",
    "licensed under the bsd 3 clause license": "bsd-3-by",
    "released under the bsd 3 clause license": "bsd-3-by",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2-basis",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2-see",
    "released under the apache license version 2 0": "apache-2-by",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or": "gpl-3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the": "agpl-3-later",
    "either version 2 of the license or at your option any later version": "later-2",
    "either version 2 of the license or": "later-2",
    "either version 2 1 of the license or at your option any later version": "later-2-1",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "gnu general public license for more details": "gpl-see",
    "licensed under the gnu affero general public license version 3": "agpl-3-by",
    "licensed under the gnu lesser general public license version 3": "lgpl-3-by",
    "the isc license": "isc-title",
    "isc license": "isc-title",
    "licensed under the isc license": "isc-by",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2-by",
    "licensed under the mozilla public license version 2 0": "mpl-2-by",
    "released under the mozilla public license version 2 0": "mpl-2-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc0 1 0": "cc0-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-by",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-4-by",
    "all rights reserved": "reserved",
    "this work has been released into the public domain": "public-domain",
}
# Ordered rules, a sequence of sentence identifiers and the licence it stands for.
RULES = [
    (("apache-2-by", "apache-2-use", "apache-2-copy", "apache-2-url", "apache-2-basis", "apache-2-see"), "Apache-2.0"),
    (("apache-2-by", "apache-2-use", "apache-2-copy", "apache-2-url"), "Apache-2.0"),
    (("apache-2-by", "apache-2-use"), "Apache-2.0"),
    (("mit-title", "mit-grant", "mit-notice", "mit-warranty"), "MIT"),
    (("mit-grant", "mit-notice", "mit-warranty"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("gpl-3-later", "gpl-warranty", "gpl-see", "gpl-copy"), "GPL-3.0-or-later"),
    (("gpl-2-later", "gpl-warranty", "gpl-see", "gpl-copy"), "GPL-2.0-or-later"),
    (("gpl-3-later",), "GPL-3.0-or-later"),
    (("gpl-2-later",), "GPL-2.0-or-later"),
    (("gpl-terms", "later-2", "gpl-warranty", "gpl-see", "gpl-copy"), "GPL-2.0-or-later"),
    (("gpl-terms", "later-2"), "GPL-2.0-or-later"),
    (("lgpl-terms", "later-2-1"), "LGPL-2.1-or-later"),
    (("agpl-3-later",), "AGPL-3.0-or-later"),
    (("agpl-3-by",), "AGPL-3.0-only"),
    (("lgpl-3-by",), "LGPL-3.0-only"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-2-by",), "BSD-2-Clause"),
    (("bsd-3-by",), "BSD-3-Clause"),
    (("isc-title", "isc-grant"), "ISC"),
    (("isc-grant",), "ISC"),
    (("isc-title",), "ISC"),
    (("isc-by",), "ISC"),
    (("mpl-2-by",), "MPL-2.0"),
    (("unlicense",), "Unlicense"),
    (("cc0-by",), "CC0-1.0"),
    (("apache-2-by",), "Apache-2.0"),
    (("mit-by",), "MIT"),
    (("mit-title",), "MIT"),
    (("gpl-3-by",), "GPL-3.0-only"),
    (("cc-by-4-by",), "CC-BY-4.0"),
    (("cc-by-sa-4-by",), "CC-BY-SA-4.0"),
    (("cc-by-nc-4-by",), "CC-BY-NC-4.0"),
    (("cc-by-nd-4-by",), "CC-BY-ND-4.0"),
    (("public-domain",), "public-domain"),
    (("reserved",), "all-rights-reserved"),
]
#: Every known sentence holds one of these, so other texts need not be cut into sentences.
TRIGGER = "licens|copyright|redistribut|warrant|reserved|either version 2|public[^a-z0-9]+domain"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A line that goes on in lower case, indented or not, belongs to the sentence before it.
WRAP, END = r"\n *([a-z])", r"([.!?:;]) +"


def _sequence(text: Column) -> Column:
    """``<id><id>...`` of a text's known sentences in order."""
    joined = F.translate(F.regexp_replace(text, WRAP, " $1"), _UPPER, _LOWER)
    lines = F.split(F.regexp_replace(joined, END, "$1\n"), "\n")
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    normal = F.transform(
        F.filter(lines, lambda s: s.rlike(TRIGGER)), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    )
    ids = F.filter(F.transform(normal, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``sentences`` (identifiers in order, ``<a><b>``), ``n_sentences`` and ``licences`` (joined by commas, in
    the order of the rules, each once), one row per input row.

    Sentences end at one of ``. ! ? : ;`` before a blank, or at a line end unless the next line goes on in lower case. Null and empty texts have no licences; equal
    rows give equal results; other columns are ignored; an empty table gives no rows. Whole texts are scanned row by
    row without a shuffle.
    """
    lower = F.translate(F.col(text_col), _UPPER, _LOWER)
    seq = F.when(lower.rlike(TRIGGER), _sequence(F.col(text_col))).otherwise(F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), seq.alias("sentences")).withColumn("sentences", F.coalesce("sentences", F.lit("")))

    rules = F.array(*[F.struct(F.lit("".join(f"<{x}>" for x in ids)).alias("ids"), F.lit(name).alias("name")) for ids, name in RULES])
    start = F.struct(F.col("sentences").alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.when(F.contains(state["left"], rule["ids"]), F.array(rule["name"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.replace(state["left"], rule["ids"], F.lit("<>")).alias("left"), F.concat(state["found"], hit).alias("found"))

    # One expression, however many rules; texts without a known sentence skip it.
    found = F.when(F.col("sentences") != "", F.aggregate(rules, start, step)["found"])
    rows = rows.withColumn("_found", found)
    names = F.array(*[F.lit(name) for name in dict.fromkeys(name for _, name in RULES)])
    return rows.select(
        F.col("id").alias(id_col),
        "sentences",
        (F.length("sentences") - F.length(F.replace("sentences", F.lit("<"), F.lit("")))).cast("long").alias("n_sentences"),
        F.coalesce(F.array_join(F.filter(names, lambda n: F.array_contains("_found", n)), ","), F.lit("")).alias("licences"),
    )


def _sql() -> str:
    known = ", ".join(f"('{s}', '<{i}>')" for s, i in SENTENCES.items())
    sql = f"""
WITH known(sentence, mark) AS (VALUES {known}),
cut AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(regexp_replace(translate(
    regexp_replace(coalesce(text, ''), '{WRAP}', ' \\1', 'g'), '{_UPPER}', '{_LOWER}'), '{END}', '\\1' || chr(10), 'g'), chr(10)) AS l
  FROM documents
), line AS (SELECT rid, doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM cut),
hit AS (
  SELECT rid, doc_id, coalesce(string_agg(mark, '' ORDER BY pos), '') AS sentences
  FROM (SELECT rid, doc_id, pos, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS n FROM line) x LEFT JOIN known ON n = sentence
  GROUP BY rid, doc_id
), c0 AS (SELECT doc_id, sentences, sentences AS s0 FROM hit)"""
    flags: dict[str, list[str]] = {}
    for i, (ids, name) in enumerate(RULES):
        pattern = "".join(f"<{x}>" for x in ids)
        flags.setdefault(name, []).append(f"f{i}")
        sql += f",\nc{i + 1} AS (SELECT *, replace(s{i}, '{pattern}', '<>') AS s{i + 1}, contains(s{i}, '{pattern}') AS f{i} FROM c{i})"
    names = ", ".join(f"CASE WHEN {' OR '.join(f)} THEN '{name}' END" for name, f in flags.items())
    return f"""{sql}
SELECT doc_id, sentences, CAST(length(sentences) - length(replace(sentences, '<', '')) AS BIGINT) AS n_sentences,
  concat_ws(',', {names}) AS licences
FROM c{len(RULES)}
"""


SQL = _sql()
