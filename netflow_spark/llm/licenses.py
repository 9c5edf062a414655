"""License scans by sentence rules, in DataFrame functions only.

A text is cut into pieces (at sentence punctuation followed by white space, and at line ends
unless the next line goes on in lower case), pieces are normalised (A-Z lower-cased, everything
but letters and digits one space) and looked up among known licence sentences. A known sentence is
one piece or several in a row: ``;``, ``:`` and line ends may lie inside it, wherever a notice is
wrapped, but no ``.``, ``!`` or ``?``; of several that start at one piece the longest counts. The
identifiers a text yields, in order, are matched against ordered rules: a rule is a sequence of
identifiers that must follow each other; the first rules take what they match, later ones see the
rest. Known sentences that no rule takes are reported as left over.

Everything happens inside a row, so nothing is shuffled. Texts without any of the single
words that the known sentences draw on (``hint_words``) are not cut at all. Null and empty texts have no licence; null ids and repeated
rows are treated like any other; empty tables give empty results. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache2-name",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2plus-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3plus-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "licensed under cc by nc 4 0": "ccbync4-name",
    "licensed under cc by 4 0": "ccby4-name",
    "licensed under cc by sa 4 0": "ccbysa4-name",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-name",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4-name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}


def hint_words(known: Iterable[str]) -> tuple[str, ...]:
    """Single words (parts of words), of which every known sentence holds one; a word holds nothing that normalising changes."""
    words: list[str] = []
    for s in sorted(known, key=lambda s: (len(s.split(" ")), s)):
        if not any(w in s for w in words):
            words.append(max(s.split(" "), key=len))
    return tuple(words)


#: Every known sentence holds one of these.
WORDS = hint_words(SENTENCES)

# Rules in the order they are tried.
RULES = (
    ("Apache-2.0", ("apache2-head", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-name", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-see")),
    ("GPL-3.0-or-later", ("gpl3plus-grant", "gpl-warranty", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2plus-grant", "gpl-warranty", "gpl-see", "gpl-copy")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3plus-grant",)),
    ("GPL-2.0-or-later", ("gpl2plus-grant",)),
    ("GPL-3.0-only", ("gpl3-name",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-name",)),
    ("Apache-2.0", ("apache2-head",)),
    ("Apache-2.0", ("apache2-name",)),
    ("CC-BY-NC-4.0", ("ccbync4-name",)),
    ("CC-BY-SA-4.0", ("ccbysa4-name",)),
    ("CC-BY-4.0", ("ccby4-name",)),
    ("Unlicense", ("unlicense",)),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence ends at the first; the second may lie inside of one.
_END, _CUT = "\x01", "\x02"


def pieces(text: Column) -> Column:
    """Normalised pieces, in order, with ``_END`` or ``_CUT`` between them."""
    cut = F.regexp_replace(F.translate(text, _CUT, ","), r"[.!?][ \t\r\n\f]+", _END)
    cut = F.regexp_replace(cut, r"[;:][ \t\r\n\f]+", _CUT)
    cut = F.regexp_replace(cut, r"[ \t\r\f]*\n[ \t\r\n\f]*([^a-z \t\r\n\f])", _CUT + "$1")
    cut = F.regexp_replace(F.translate(cut, _UPPER, _LOWER), r"[^a-z0-9\x01\x02\x{80}-\x{10FFFF}]+", " ")
    cut = F.regexp_replace(cut, r" *\x02[ \x02]*", _CUT)
    return F.trim(F.regexp_replace(cut, r"[ \x02]?\x01[ \x01\x02]*", _END))


def sentence_ids(text: Column, known: dict[str, str] = SENTENCES) -> Column:
    none = F.array().cast("array<string>")
    if not known:
        return none
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    longest_first = sorted(known, key=lambda s: (-len(s.split(" ")), s))
    any_known = "|".join(s.replace(" ", r"[ \x02]") for s in longest_first)
    # whole pieces only: before and after are a cut or the text's ends
    found = F.regexp_extract_all(pieces(text), F.lit(rf"(?<![^\x01\x02])(?:{any_known})(?![^\x01\x02])"), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(table, F.translate(s, _CUT, " ")))
    hint = F.translate(text, _UPPER, _LOWER).rlike("|".join(hint_words(known)))
    return F.when(hint, ids).otherwise(none)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] = SENTENCES,
                  rules: tuple = RULES) -> DataFrame:
    """Per row of ``docs``: id, ``sentence_ids``, ``licenses`` (in rule order, each once) and ``left_over`` (arrays)."""
    ids = docs.select(F.col(id_col), sentence_ids(F.coalesce(F.col(text_col).cast("string"), F.lit("")), known).alias("sentence_ids"))
    # " a b c " with every identifier between two spaces; a match becomes " | ", which no rule can span
    spaced = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(seq) + " ").alias("seq")) for name, seq in rules])
    zero = F.struct(spaced.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, rule: Column) -> Column:
        hit = s["rest"].contains(rule["seq"])
        return F.when(hit, F.struct(F.replace(s["rest"], rule["seq"], F.lit(" | ")).alias("rest"),
                                    F.array_union(s["found"], F.array(rule["name"])).alias("found"))).otherwise(s)

    done = F.when(F.size("sentence_ids") > 0, F.aggregate(steps, zero, step)).otherwise(
        F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("found")))
    left = F.filter(F.split(F.col("_done.rest"), r"[ |]+"), lambda x: x != "")
    return ids.withColumn("_done", done).select(id_col, "sentence_ids", F.col("_done.found").alias("licenses"), left.alias("left_over"))
