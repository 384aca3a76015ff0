"""Licence recognition by sentence rules (DataFrame functions only).

A text is cut into sentences, each sentence is unwrapped and normalised, known sentences become identifiers, and a licence
is found where its rule, an ordered list of identifiers, is a subsequence of the text's identifiers. A sentence that is not known as
it stands is looked up once more with its slots (holder, project, place of the licence) put in a common form; what it is licensed
under may be several names. SPDX tags are read as expressions.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivet.llm.common import let

NOT_WORD = r"[^a-z0-9]+"
#: Licences: name, SPDX identifiers, and how texts call them, in normal form. Public names.
LICENCES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("0bsd", ("0BSD",), ("zero clause bsd license", "0bsd license")),
    ("afl-3.0", ("AFL-3.0",), ("academic free license version 3 0", "academic free license 3 0")),
    ("agpl-3.0", ("AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0"), ("gnu affero general public license version 3", "affero gpl version 3", "agplv3", "agpl 3 0")),
    ("apache-2.0", ("Apache-2.0",), ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0", "apache 2 license")),
    ("artistic-2.0", ("Artistic-2.0",), ("artistic license 2 0", "artistic license version 2 0")),
    ("bsd-2-clause", ("BSD-2-Clause",), ("bsd 2 clause license", "bsd 2 clause", "simplified bsd license", "2 clause bsd license", "freebsd license")),
    ("bsd-3-clause", ("BSD-3-Clause",), ("bsd 3 clause license", "bsd 3 clause", "new bsd license", "3 clause bsd license", "modified bsd license", "revised bsd license")),
    ("bsl-1.0", ("BSL-1.0",), ("boost software license version 1 0", "boost software license 1 0")),
    ("cc0-1.0", ("CC0-1.0",), ("creative commons zero v1 0 universal license", "cc0 1 0 universal license", "cc0 1 0", "cc0")),
    ("cc-by-3.0", ("CC-BY-3.0",), ("cc by 3 0", "creative commons attribution 3 0 license", "creative commons attribution 3 0 unported license")),
    ("cc-by-4.0", ("CC-BY-4.0",), ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license")),
    ("cc-by-nc-4.0", ("CC-BY-NC-4.0",), ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license")),
    ("cc-by-nc-nd-4.0", ("CC-BY-NC-ND-4.0",), ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license")),
    ("cc-by-nc-sa-4.0", ("CC-BY-NC-SA-4.0",), ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license")),
    ("cc-by-nd-4.0", ("CC-BY-ND-4.0",), ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license")),
    ("cc-by-sa-3.0", ("CC-BY-SA-3.0",), ("cc by sa 3 0", "creative commons attribution sharealike 3 0 license", "creative commons attribution sharealike 3 0 unported license", "creative commons attribution share alike 3 0 unported license")),
    ("cc-by-sa-4.0", ("CC-BY-SA-4.0",), ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 license")),
    ("cddl-1.0", ("CDDL-1.0",), ("common development and distribution license version 1 0", "common development and distribution license 1 0")),
    ("epl-1.0", ("EPL-1.0",), ("eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0")),
    ("epl-2.0", ("EPL-2.0",), ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0")),
    ("eupl-1.2", ("EUPL-1.2",), ("european union public licence version 1 2", "european union public licence 1 2", "eupl version 1 2", "eupl 1 2")),
    ("gpl-2.0", ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"), ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2", "gnu general public license v2 0")),
    ("gpl-3.0", ("GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"), ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3", "gnu general public license v3 0")),
    ("isc", ("ISC",), ("isc license", "isc")),
    ("lgpl-2.1", ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1"), ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgpl v2 1", "lgplv2 1")),
    ("lgpl-3.0", ("LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0"), ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl version 3", "gnu lgpl v3", "lgpl v3", "lgplv3")),
    ("mit", ("MIT",), ("mit license", "expat license", "mit expat license", "mit")),
    ("mit-0", ("MIT-0",), ("mit no attribution license", "mit 0 license")),
    ("mpl-1.1", ("MPL-1.1",), ("mozilla public license version 1 1", "mozilla public license 1 1")),
    ("mpl-2.0", ("MPL-2.0",), ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0")),
    ("ms-pl", ("MS-PL",), ("microsoft public license",)),
    ("odbl-1.0", ("ODbL-1.0",), ("open database license version 1 0", "open data commons open database license", "open database license")),
    ("ofl-1.1", ("OFL-1.1",), ("sil open font license version 1 1", "sil open font license 1 1")),
    ("osl-3.0", ("OSL-3.0",), ("open software license version 3 0", "open software license 3 0")),
    ("postgresql", ("PostgreSQL",), ("postgresql license",)),
    ("python-2.0", ("Python-2.0",), ("python software foundation license version 2", "psf license")),
    ("unlicense", ("Unlicense",), ("unlicense",)),
    ("upl-1.0", ("UPL-1.0",), ("universal permissive license version 1 0", "universal permissive license v 1 0")),
    ("wtfpl", ("WTFPL",), ("do what the fuck you want to public license", "do what the fuck you want to public license version 2", "wtfpl", "wtfpl version 2")),
    ("zlib", ("Zlib",), ("zlib license", "zlib libpng license")),
)
#: Sentences of licence texts in normal form (lower case, letters and digits only), as :func:`sentences` yields them from
#: the notices. Wording of public licences.
NOTICES: dict[str, int] = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": 3,
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": 4,
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": 5,
    "licensed under the apache license version 2 0 the license": 7,
    "you may not use this file except in compliance with the license": 8,
    "you may obtain a copy of the license at": 9,
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": 10,
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": 12,
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": 13,
    "without even the implied warranty of merchantability or fitness for a particular purpose": 14,
    "either version 2 of the license or at your option any later version": 15,
    "either version 3 of the license or at your option any later version": 16,
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": 17,
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": 18,
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": 19,
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": 20,
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": 21,
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 22,
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 23,
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": 24,
    "this source code form is subject to the terms of the mozilla public license v": 25,
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": 26,
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": 26,
    "this is free and unencumbered software released into the public domain": 27,
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": 28,
    "either version 2 1 of the license or at your option any later version": 29,
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": 30,
    "this software is provided as is without any express or implied warranty": 31,
    "in no event will the authors be held liable for any damages arising from the use of this software": 32,
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": 33,
    "boost software license version 1 0 august 17th 2003": 34,
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": 35,
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": 36,
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": 22,
    "you just do what the fuck you want to": 37,
    "the contents of this file are subject to the mozilla public license version 1 1 the license": 38,
    "the contents of this file are subject to the terms of the common development and distribution license the license": 39,
    "the accompanying program is provided under the terms of this eclipse public license agreement": 40,
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": 41,
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": 42,
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": 43,
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": 44,
    "either version 3 of the license or any later version": 16,
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 23,
    "if you use the software you accept this license": 45,
}

#: A licence and the ordered identifiers that its presence needs; other known sentences may stand between them.
NOTICE_RULES: tuple[tuple[str, tuple[int, ...]], ...] = (
    ("0bsd", (41, 24)),
    ("agpl-3.0", (35, 14)),
    ("agpl-3.0", (36, 16, 14)),
    ("apache-2.0", (7, 8, 9, 10)),
    ("bsd-2-clause", (19, 20, 21)),
    ("bsd-3-clause", (19, 20, 21, 22)),
    ("bsl-1.0", (34,)),
    ("bsl-1.0", (43,)),
    ("cc0-1.0", (30,)),
    ("cddl-1.0", (39,)),
    ("epl-1.0", (40,)),
    ("gpl-2.0", (13, 15, 14)),
    ("gpl-3.0", (12, 14)),
    ("gpl-3.0", (13, 16, 14)),
    ("isc", (23, 24)),
    ("lgpl-2.1", (18, 29, 14)),
    ("lgpl-3.0", (17, 14)),
    ("lgpl-3.0", (18, 16, 14)),
    ("mit", (3, 4, 5)),
    ("mit-0", (44, 5)),
    ("mpl-1.1", (38,)),
    ("mpl-2.0", (25, 26)),
    ("ms-pl", (45,)),
    ("postgresql", (42,)),
    ("unlicense", (27, 28)),
    ("wtfpl", (37,)),
    ("zlib", (31, 32, 33)),
)
NAMED = 1000  # the identifier of the first licence's name; sentences that only name a licence say the same


def normal(name: str) -> str:
    """The normal form of ASCII text."""
    return " ".join(re.sub(NOT_WORD, " ", name.lower()).split())


#: What stands before a name of a licence, and before an identifier of an SPDX expression, in the table of sentences.
UNDER, SPDX = "licensed under ", "spdx "
VERBS = "licensed|released|distributed|available|published|provided|offered|covered"
#: Slots, in order: what sentences of a kind have in place of a common form. Names of holders and projects, the subject and the
#: verb of a grant (twenty words at most stand before it), and where a licence can be read. A grant that is denied is none.
SLOTS: tuple[tuple[str, str], ...] = (
    (r"^neither the names? of .+ nor the names of (?:its|their|the) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (r"^(?:the )?names? of .+ may not be used to endorse or promote products", "the name of the author may not be used to endorse or promote products"),
    (rf"^(?:[a-z0-9]+ ){{0,20}}not (?:{VERBS}) under .*", ""),
    (rf"^(?:[a-z0-9]+ ){{0,20}}(?:{VERBS}) under (?:the terms (?:and conditions )?of )?(?:either )?(?:the |an? )?", UNDER),
    (r"^(licensed under .+?) (?:which|that|see|as published by|as found in|found in|https?|with the|the license$|or at your option|or any later|or later).*$", r"\1"),
)
#: Between names that a grant offers together.
JOINT = r" (?:and|or)(?: the)? "

#: All known sentences: those of notices, and each licence by its names and its SPDX identifiers.
SENTENCES: dict[str, int] = NOTICES | {
    sentence: NAMED + i
    for i, (_, tags, names) in enumerate(LICENCES)
    for sentence in (*(SPDX + normal(t) for t in tags), *(UNDER + name for name in names))
}
RULES = NOTICE_RULES + tuple((name, (NAMED + i,)) for i, (name, _, _) in enumerate(LICENCES))

#: Where sentences end: marks before white space, and lines that are empty but for a comment's mark. (No look-around: SQL
#: shares these.)
SENTENCE_END = r"[.;:!?][ \t\r\n]+|[ \t\r]*\n[ \t]*(?:[#*/;]+)?[ \t]*\r?\n[ \t\r\n]*"
#: A tag and its value are one sentence.
TAG = r"(?i)(spdx-license-identifier):"
#: Abbreviations in names of holders end no sentence where small letters follow.
ABBREVIATED = r"\b([Ii]nc|[Ll]td|[Cc]orp|[Cc]o)\.(,?[ \t\r\n#*/;]+[a-z])"
#: An SPDX expression behind its tag, to the end of its line at most: identifiers joined by AND, OR and WITH, with parentheses.
EXPRESSION = r"(?i)spdx-license-identifier[ \t]+(\(*[a-z0-9.+-]+\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9.+-]+\)*)*)"
TERMS = r"[ \t()]+"
#: A line break inside a sentence, with comment marks after it.
LINE_BREAK = r"[ \t]*\r?\n[ \t]*(?:[#*/;]+[ \t]*)?"


def words(text: Column) -> Column:
    """The normal form."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def common_form(form: Column) -> Column:
    """A sentence in normal form with its slots in their common form."""
    for pattern, to in SLOTS:
        form = F.regexp_replace(form, pattern, to.replace("\\1", "$1"))
    return form


def sentences(text: Column) -> Column:
    """A text's sentences, in order, lines in them still broken; empty ones stay, so positions count every end."""
    return F.split(F.regexp_replace(F.regexp_replace(text, TAG, "$1"), ABBREVIATED, "$1$2"), SENTENCE_END, -1)


def stems(known: Iterable[str]) -> str:
    """A pattern of letters that every known sentence holds, whatever its slots: a text without any of them has no known sentence.
    Built from the sentences: the most frequent words first, until each sentence has one. Of a grant the verb counts, of an
    SPDX identifier the tag."""
    known = list(known)
    sources = {s for s in known if not s.startswith((UNDER, SPDX))}
    fixed = [to for pattern, to in SLOTS[:2] if to and any(s.startswith(to) for s in sources)]
    left = {s: set(s.split()) - {"copyright", "holder", "author", "neither", "names", "its"} if any(s.startswith(f) for f in fixed) else set(s.split()) for s in sources}
    found: list[str] = []
    while left:
        top = Counter(w for ws in left.values() for w in ws)
        word = max(top, key=lambda w: (top[w] * (len(w) > 4) or top[w] / 1000, len(w), w))
        found.append(word)
        left = {s: ws for s, ws in left.items() if word not in ws}
    grants = VERBS.split("|") if any(s.startswith(UNDER) for s in known) else []
    tags = [SPDX.strip()] if any(s.startswith(SPDX) for s in known) else []
    return "|".join(sorted({*found, *grants, *tags}))


def rule_pattern(ids: tuple[int, ...]) -> str:
    """A regular expression over ``,3,17,4,`` that holds where ``ids`` are an ordered subsequence."""
    return ",(?:[0-9]+,)*?".join(f",{ids[0]}" if i == 0 else str(x) for i, x in enumerate(ids)) + ","


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: dict[str, int] = SENTENCES,
    rules: tuple[tuple[str, tuple[int, ...]], ...] = RULES,
) -> DataFrame:
    """Return ``doc_id, hits array<struct<position,sentence_id>>, licenses array<string>`` for every row.

    A sentence is known as a whole, its line breaks taken as spaces, or else by single lines of it; a grant of several licences and an
    SPDX expression give a hit for each. ``position`` counts
    sentences from 0. ``licenses`` is sorted and distinct. The table of sentences is a literal of the plan: it has the size
    of ``known``, whatever the input.

    * null and empty texts, and texts without a known sentence, have empty arrays; an empty table gives no rows.
    * repeated rows each give a row; a sentence that repeats is a hit each time. Very long texts are scanned whole.
    * where several rules of one licence hold, it is named once; other columns of the input are not read.
    """
    may = stems(known)
    by_sentence = F.from_json(F.lit(json.dumps(known)), "map<string,int>")
    by_sentence = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if len(known) <= 20 else by_sentence
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nothing = F.array().cast("array<int>")

    def looked_up(key: Column) -> Column:
        return F.array_compact(F.array(F.try_element_at(by_sentence, key)))

    def slotted(form: Column) -> Column:
        """By the common form: one sentence, or the names that a grant joins."""
        names = F.flatten(F.transform(F.split(F.substring(form, len(UNDER) + 1, 1 << 20), JOINT), lambda n: looked_up(F.concat(F.lit(UNDER), n))))
        return let(looked_up(form), lambda one: F.when((F.size(one) > 0) | ~form.startswith(UNDER), one).otherwise(names))

    def ids_of(part: Column) -> Column:
        """Identifiers of a sentence or a line."""
        again = lambda form: let(common_form(form), slotted)
        known_as = lambda form: let(looked_up(form), lambda one: F.when(F.size(one) > 0, one).otherwise(again(form)))
        return F.when(part.rlike(f"(?i){may}"), let(words(part), known_as)).otherwise(nothing)

    def tagged(sentence: Column) -> Column:
        """Identifiers of SPDX expressions."""
        terms = F.flatten(F.transform(F.regexp_extract_all(sentence, F.lit(EXPRESSION), F.lit(1)), lambda e: F.split(e, TERMS)))
        return F.flatten(F.transform(terms, lambda t: looked_up(F.concat(F.lit(SPDX), words(t)))))

    def hits_in(sentence: Column, position: Column) -> Column:
        by_line = F.flatten(F.transform(F.split(sentence, "\n"), ids_of))
        whole = lambda ids: F.when((F.size(ids) > 0) | ~F.contains(sentence, F.lit("\n")), ids).otherwise(by_line)
        plain = let(ids_of(F.regexp_replace(sentence, LINE_BREAK, " ")), whole)
        ids = F.when(sentence.rlike(EXPRESSION), F.concat(tagged(sentence), plain)).otherwise(plain)
        return F.transform(ids, lambda i: F.struct(position.alias("position"), i.alias("sentence_id")))

    def hits_of(parts: Column) -> Column:
        return F.flatten(F.transform(parts, hits_in))

    none = F.from_json(F.lit("[]"), "array<struct<position:int,sentence_id:int>>")
    hits = F.when(F.col("text").rlike(f"(?i){may}"), let(sentences(F.col("text")), hits_of)).otherwise(none)
    scanned = src.select("doc_id", hits.alias("hits"))

    def licenses_of(seq: Column) -> Column:
        named = F.array(*[F.when(seq.rlike(rule_pattern(ids)), F.lit(name)) for name, ids in rules])
        return F.array_sort(F.array_distinct(F.array_compact(named)))

    seq = F.concat(F.lit(","), F.array_join(F.transform("hits", lambda h: h["sentence_id"].cast("string")), ","), F.lit(","))
    empty = F.array().cast("array<string>")
    return scanned.withColumn("licenses", F.when(F.size("hits") > 0, let(seq, licenses_of)).otherwise(empty))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_hits long, sentence_ids string, first_position int (-1: none), licenses string`` of :func:`scan_licenses`."""
    found = scan_licenses(docs, id_col, text_col)
    return found.select(
        "doc_id",
        F.size("hits").cast("long").alias("n_hits"),
        F.array_join(F.transform("hits", lambda h: h["sentence_id"].cast("string")), ",").alias("sentence_ids"),
        F.coalesce(F.get("hits", F.lit(0))["position"], F.lit(-1)).alias("first_position"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def _oracle() -> str:
    known = ", ".join(f"('{s}', {i})" for s, i in SENTENCES.items())
    named = ", ".join(f"CASE WHEN regexp_matches(seq, '{rule_pattern(ids)}') THEN '{name}' END" for name, ids in RULES)
    norm = lambda part: f"trim(regexp_replace(lower({part}), '{NOT_WORD}', ' ', 'g'))"
    form = "w"
    for pattern, to in SLOTS:
        form = f"regexp_replace({form}, '{pattern}', '{to}')"
    # Identifiers of texts in normal form: as they are, in common form, or by the names that a grant joins.
    return f"""
WITH known(sentence, sid) AS (VALUES {known}),
parts AS (
  SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS position
  FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '{TAG}', '\\1', 'g'), '{ABBREVIATED}', '\\1\\2', 'g'), '{SENTENCE_END}') AS p FROM documents)),
asked AS (
  SELECT doc_id, position, -1 AS line, {norm(f"regexp_replace(part, '{LINE_BREAK}', ' ', 'g')")} AS w FROM parts
  UNION ALL
  SELECT doc_id, position, line, {norm("part")} FROM (
    SELECT doc_id, position, unnest(l) AS part, generate_subscripts(l, 1) AS line FROM (SELECT *, string_split(part, chr(10)) AS l FROM parts WHERE contains(part, chr(10))))),
forms AS (SELECT *, {form} AS f FROM (SELECT DISTINCT w FROM asked WHERE w <> '')),
joint AS (SELECT w, unnest(n) AS name, generate_subscripts(n, 1) AS k FROM (SELECT w, regexp_split_to_array(substr(f, {len(UNDER) + 1}), '{JOINT}') AS n FROM forms WHERE starts_with(f, '{UNDER}'))),
ids AS (
  SELECT w, 0 AS k, sid FROM forms JOIN known ON sentence = w
  UNION ALL SELECT w, 0, sid FROM forms JOIN known ON sentence = f WHERE w NOT IN (SELECT sentence FROM known)
  UNION ALL SELECT j.w, j.k, sid FROM joint j JOIN forms USING (w) JOIN known ON sentence = '{UNDER}' || j.name
    WHERE j.w NOT IN (SELECT sentence FROM known) AND f NOT IN (SELECT sentence FROM known)),
found AS (SELECT doc_id, position, line, k, sid FROM asked JOIN ids USING (w)),
tags AS (
  SELECT doc_id, position, unnest(t) AS term, generate_subscripts(t, 1) AS k
  FROM (SELECT doc_id, position, flatten(list_transform(regexp_extract_all(part, '{EXPRESSION}', 1), lambda e: regexp_split_to_array(e, '{TERMS}'))) AS t FROM parts WHERE regexp_matches(part, '{EXPRESSION}'))),
hits AS (
  SELECT doc_id, position, -2 AS line, k, sid FROM tags JOIN known ON sentence = '{SPDX}' || {norm("term")}
  UNION ALL SELECT * FROM found WHERE line = -1
  UNION ALL SELECT l.* FROM found l ANTI JOIN (SELECT * FROM found WHERE line = -1) w ON l.doc_id = w.doc_id AND l.position = w.position WHERE l.line >= 0),
seqs AS (
  SELECT doc_id, count(*) AS n_hits, string_agg(sid::VARCHAR, ',' ORDER BY position, line, k) AS sentence_ids, min(position) AS first_position
  FROM hits GROUP BY doc_id),
named AS (
  SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{named}], lambda x: x IS NOT NULL))), ',') AS licenses
  FROM (SELECT doc_id, ',' || sentence_ids || ',' AS seq FROM seqs))
SELECT d.doc_id, coalesce(n_hits, 0) AS n_hits, coalesce(sentence_ids, '') AS sentence_ids,
       coalesce(first_position, -1)::INTEGER AS first_position, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN seqs USING (doc_id) LEFT JOIN named USING (doc_id)
"""


ORACLE = _oracle()
