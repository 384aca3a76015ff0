import random
import re
import textwrap

import pytest

from trivet.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language."""
HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the License for more details."
GPL3 = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n{HOPE}"
GPL2 = f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\n{HOPE}"
LGPL21 = f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\n{HOPE}"
AGPL3 = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n{HOPE}"
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.'
BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD3 = BSD2 + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
TEXTS = {"mit": MIT, "apache-2.0": APACHE, "gpl-3.0": GPL3, "gpl-2.0": GPL2, "lgpl-2.1": LGPL21, "agpl-3.0": AGPL3, "mpl-2.0": MPL, "isc": ISC, "bsd-2-clause": BSD2, "bsd-3-clause": BSD3, "unlicense": UNLICENSE, "zlib": ZLIB}


def wrapped(text, mark, width=72, end="\n"):
    lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width, initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False, break_long_words=False), mark.rstrip()]]
    return end.join(lines)


def ids_of(part, known):
    form = re.sub("[^a-z0-9]+", " ", part.lower()).strip()
    if form in known:
        return [known[form]]
    for pattern, to in licenses.SLOTS:
        form = re.sub(pattern, to, form, count=1)
    if form in known:
        return [known[form]]
    names = re.split(" (?:and|or) (?:the )?", form.removeprefix("licensed under ")) if form.startswith("licensed under ") else []
    return [known[f"licensed under {n}"] for n in names if f"licensed under {n}" in known]


def brute(text, known=licenses.SENTENCES, rules=licenses.RULES):
    hits = []
    for i, s in enumerate(re.split(licenses.SENTENCE_END, re.sub(licenses.ABBREVIATED, r"\1\2", re.sub(licenses.TAG, r"\1", text or "")))):
        for m in re.finditer(licenses.EXPRESSION, s):
            tags = ["spdx " + re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in re.split(r"[ \t()]+", m[1])]
            hits += [(i, known[t]) for t in tags if t in known]
        whole = ids_of(re.sub(licenses.LINE_BREAK, " ", s), known)
        hits += [(i, x) for x in whole or ([x for line in s.split("\n") for x in ids_of(line, known)] if "\n" in s else [])]

    def holds(ids):
        rest = iter([x for _, x in hits])
        return all(i in rest for i in ids)

    return hits, sorted({name for name, ids in rules if holds(ids)})


def found(spark, texts, **more):
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, hits string, licenses string")
    return {r.doc_id: ([tuple(h) for h in r.hits], r.licenses) for r in licenses.scan_licenses(rows, **more).collect()}


def test_whole_notices_in_every_wrapping(spark):
    cases = [(name, f(text)) for name, text in TEXTS.items() for f in (str, lambda t: wrapped(t, ""), lambda t: wrapped(t, "# "), lambda t: wrapped(t, " * ", 60), lambda t: wrapped(t, "// ", 50, "\r\n"), lambda t: "some words before\n\n" + wrapped(t, "", 65) + "\n\nand after")]
    got = found(spark, [t for _, t in cases])
    for i, (name, text) in enumerate(cases):
        assert name in got[i][1], (name, text, got[i])
        assert got[i] == brute(text)
        assert got[i][1] == ([name] if name != "bsd-3-clause" else ["bsd-2-clause", "bsd-3-clause"])


def test_order_repeats_lines_and_nothing(spark):
    named = "Released under the MIT License."
    texts = [None, "", "\n\n", named, f"prose without end\n{named}\nmore prose", f"{named} {named}", "SPDX-License-Identifier: GPL-2.0-or-later", "\n\n".join(reversed(MIT.split("\n\n"))), "the license of this text is unknown", "Licensed under CC BY-NC 4.0.", named.lower() * 3000, ("word " * 20 + ". ") * 3000 + named]
    got = found(spark, texts)
    assert all(got[i] == brute(t) for i, t in enumerate(texts))
    assert [got[i][1] for i in range(len(texts))] == [[], [], [], ["mit"], ["mit"], ["mit"], ["gpl-2.0"], [], [], ["cc-by-nc-4.0"], [], ["mit"]]
    assert len(got[5][0]) == 2 and got[4][0][0][0] == 0


def test_random_mixtures_and_own_tables(spark):
    rng = random.Random(3)
    pieces = [*[s for t in TEXTS.values() for s in re.split(r"(?<=[.;:]) ", t)], "Released under the MIT License.", "word", "a b", "\n", "\n\n", "\r\n", "# ", ". ", "; ", "É "]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 12))) for _ in range(150)]
    got = found(spark, texts)
    assert all(got[i] == brute(t) for i, t in enumerate(texts))
    known, rules = {"alpha beta": 1, "gamma": 2}, (("x", (1, 2)), ("y", (2, 1)))
    got = found(spark, ["Alpha beta. gamma", "gamma. alpha\nbeta. gamma", "alpha"], known=known, rules=rules)
    assert got == {0: ([(0, 1), (1, 2)], ["x"]), 1: ([(0, 2), (1, 1), (2, 2)], ["x", "y"]), 2: ([], [])}


def test_empty_table_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "Licensed under CC BY 4.0"), (None, None), (1, "x"), (1, "x")], "doc_id long, text string")
    assert sorted((r.doc_id is None, tuple(r.licenses)) for r in licenses.scan_licenses(rows).collect()) == [(False, ()), (False, ()), (True, ()), (True, ("cc-by-4.0",))]
    assert licenses.scan_licenses(rows.limit(0)).count() == 0


WORDINGS = {
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": ["cc-by-4.0"],
    "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License. To view a copy, visit the site.": ["cc-by-sa-3.0"],
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n": ["epl-2.0"],
    "SPDX-License-Identifier: Apache-2.0 OR MIT": ["apache-2.0", "mit"],
    "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */": ["bsd-3-clause", "gpl-2.0"],
    "# SPDX-License-Identifier: MIT\n# isc zlib unlicense are words here": ["mit"],
    "SPDX-License-Identifier: LicenseRef-Own": [],
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS\n\n  0. You just DO WHAT THE FUCK YOU WANT TO.": ["wtfpl"],
    "Dual licensed under the MIT license and the Apache License, Version 2.0.": ["apache-2.0", "mit"],
    "Licensed under either the MIT License or the Apache License 2.0, at your choice": ["mit"],
    "The library is released under the terms of the Mozilla Public License 2.0; see LICENSE.": ["mpl-2.0"],
    "This data is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/.": ["odbl-1.0"],
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.": ["ofl-1.1"],
    "Licensed under the Academic Free License version 3.0": ["afl-3.0"],
    "It is published under the GNU GPL v3 or later.": ["gpl-3.0"],
    "Licensed under the EUPL, Version 1.2 or - as soon they will be approved - later": ["eupl-1.2"],
    "This text is not licensed under the MIT License.": [],
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use it otherwise.": ["mpl-1.1"],
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").": ["cddl-1.0"],
    "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").": ["epl-1.0"],
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. ": ["0bsd"],
    "If you use the software, you accept this license.": ["ms-pl"],
    "under the mit license nothing is said": [],
}


def test_common_wordings(spark):
    got = found(spark, list(WORDINGS))
    for i, (text, want) in enumerate(WORDINGS.items()):
        assert got[i] == brute(text), text
        if want or got[i][1]:
            assert got[i][1] == want, (text, got[i])


@pytest.mark.parametrize("holder", ["the University of Somewhere", "Example, Inc.", "the <organization>", "Jane Doe"])
def test_named_holders(spark, holder):
    third = f"Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    older = f"The name of {holder} may not be used to endorse or promote products derived from this software without specific prior written permission."
    for clause in (third, older):
        for text in (f"{BSD2}\n\n3. {clause}", wrapped(f"{BSD2}\n\n3. {clause}", " * ", 50)):
            (hits, names) = found(spark, [text])[0]
            assert names == ["bsd-2-clause", "bsd-3-clause"] and (hits, names) == brute(text)


@pytest.mark.parametrize("sentence", ["mit license", "under"])
def test_stems_hold_in_every_sentence(sentence):
    assert all(re.search(licenses.stems(licenses.SENTENCES), s) for s in licenses.SENTENCES)
    assert re.search(licenses.stems([sentence]), sentence)
