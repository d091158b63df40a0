"""Licence scans by sentence rules.

Texts are cut into sentences, which are normalised and looked up among known licence sentences; the identifiers found
in a document, in their order, are then matched against rules, each an ordered sequence of identifiers. Of rules that
match, the one with most identifiers takes its sentences first; what it leaves can match shorter rules.

A sentence may be wrapped over lines, or stand on a line of its own without an end mark: where no sentence end lies
between lines, every run of them is looked up, the longest known one first. A text without any of a few words, of
which every known sentence has one, holds none of them; it is told by a built-in expression and not read further.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Known licence sentences by identifier, as their licences have them; some in several forms.
SENTENCES = {
    "apache-2.0-notice": ("Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    "apache-2.0-comply": "you may not use this file except in compliance with the License",
    "apache-2.0-obtain": "You may obtain a copy of the License at",
    "apache-2.0-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "gpl-3.0-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "agpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-notice": ("Released under the BSD License", "Licensed under the BSD License"),
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "cc-by-nc-4.0-notice": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-4.0-notice": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-4.0-notice": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nd-4.0-notice": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc0-notice": "Released under CC0 1.0",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-2.0-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-bsd-2-clause": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-gpl-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-mpl-2.0": "SPDX-License-Identifier: MPL-2.0",
    "spdx-isc": "SPDX-License-Identifier: ISC",
}
#: Rules: a licence holds where these identifiers follow each other among those found.
RULES = [
    ("Apache-2.0", ("apache-2.0-notice", "apache-2.0-comply", "apache-2.0-obtain", "apache-2.0-basis")),
    ("MIT", ("mit-grant", "mit-include", "mit-as-is")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-or-later", "lgpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-3.0-or-later", "gpl-hope")),
    ("GPL-3.0-only", ("gpl-3.0-only", "gpl-hope")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("MPL-2.0", ("mpl-2.0-notice", "mpl-2.0-obtain")),
    ("Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-3.0-or-later", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-2.0-or-later", "gpl-hope")),
    ("MIT", ("mit-grant", "mit-include")),
    ("Apache-2.0", ("apache-2.0-notice", "apache-2.0-comply")),
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0-only", ("gpl-3.0-work",)),
    ("GPL-3.0-or-later", ("gpl-3.0-or-later",)),
    ("GPL-2.0-or-later", ("gpl-2.0-or-later",)),
    ("ISC", ("isc-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-notice",)),
    ("CC-BY-4.0", ("cc-by-4.0-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("MPL-2.0", ("mpl-2.0-notice",)),
    ("Unlicense", ("unlicense-domain",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-or-later",)),
    ("AGPL-3.0-or-later", ("agpl-3.0-or-later",)),
    ("GPL-3.0-only", ("gpl-3.0-only",)),
    ("BSD", ("bsd-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4.0-notice",)),
    ("BSL-1.0", ("boost-notice",)),
    ("Zlib", ("zlib-grant",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache-2.0",)),
    ("BSD-3-Clause", ("spdx-bsd-3-clause",)),
    ("BSD-2-Clause", ("spdx-bsd-2-clause",)),
    ("GPL-2.0-only", ("spdx-gpl-2.0-only",)),
    ("GPL-3.0-or-later", ("spdx-gpl-3.0-or-later",)),
    ("MPL-2.0", ("spdx-mpl-2.0",)),
    ("ISC", ("spdx-isc",)),
]
#: Licences by their identifiers, with the names that notices have for them. Identifiers are names as well.
NAMES = {
    "0BSD": ("Zero-Clause BSD License",),
    "AFL-3.0": ("Academic Free License version 3.0", "Academic Free License 3.0"),
    "AGPL-3.0-only": ("GNU Affero General Public License version 3", "GNU Affero General Public License v3.0", "GNU AGPLv3", "AGPLv3", "AGPL v3", "AGPL-3.0"),
    "AGPL-3.0-or-later": ("GNU Affero General Public License version 3 or later", "AGPLv3 or later"),
    "Apache-1.1": ("Apache Software License, Version 1.1", "Apache License 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License, v2.0", "Apache 2.0 License", "Apache 2.0", "Apache Software License 2.0"),
    "Artistic-1.0": ("Artistic License 1.0",),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"),
    "CC-BY-3.0": ("Creative Commons Attribution 3.0 Unported License", "CC BY 3.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "CC-BY-SA-3.0": ("Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 3.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0", "CDDL 1.0"),
    "CDDL-1.1": ("Common Development and Distribution License 1.1", "CDDL 1.1"),
    "ECL-2.0": ("Educational Community License, Version 2.0", "Educational Community License v2.0"),
    "EPL-1.0": ("Eclipse Public License v1.0", "Eclipse Public License 1.0", "Eclipse Public License, Version 1.0"),
    "EPL-2.0": ("Eclipse Public License v2.0", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"),
    "EUPL-1.2": ("European Union Public Licence v1.2", "European Union Public License 1.2", "EUPL v1.2"),
    "GPL-2.0-only": ("GNU General Public License version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPLv2", "GNU GPL v2", "GPLv2", "GPL v2", "GPL version 2", "GPL-2.0"),
    "GPL-2.0-or-later": ("GNU General Public License version 2 or later", "GNU General Public License v2.0 or later", "GPLv2 or later", "GPL v2 or later", "GPL version 2 or later"),
    "GPL-3.0-only": ("GNU General Public License version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPLv3", "GNU GPL v3", "GPLv3", "GPL v3", "GPL version 3", "GPL-3.0"),
    "GPL-3.0-or-later": ("GNU General Public License version 3 or later", "GNU General Public License v3.0 or later", "GPLv3 or later", "GPL v3 or later", "GPL version 3 or later"),
    "ISC": ("ISC License",),
    "LGPL-2.1-only": ("GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL v2.1", "LGPL-2.1"),
    "LGPL-2.1-or-later": ("GNU Lesser General Public License version 2.1 or later", "LGPLv2.1 or later"),
    "LGPL-3.0-only": ("GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0", "GNU LGPLv3", "LGPLv3", "LGPL v3", "LGPL-3.0"),
    "LGPL-3.0-or-later": ("GNU Lesser General Public License version 3 or later", "LGPLv3 or later"),
    "MIT": ("MIT License", "MIT Licence", "Expat License"),
    "MIT-0": ("MIT No Attribution License",),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License Version 1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License v2.0"),
    "MS-PL": ("Microsoft Public License",),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "PostgreSQL": ("PostgreSQL License",),
    "PSF-2.0": ("Python Software Foundation License 2.0", "Python Software Foundation License"),
    "Ruby": ("Ruby License",),
    "Unlicense": ("The Unlicense",),
    "WTFPL": ("Do What The F*ck You Want To Public License",),
    "Zlib": ("zlib License",),
}
#: What stands before the name in a notice, and the words of which every notice or expression has one.
GIVEN = r"\b(?:licensed|licenced|released|distributed|available|published|provided|redistributed) under (?:the (?:terms|conditions) of )?(?:(?:the|a|an) )?"
GIVEN_WORDS = ("licensed", "licenced", "released under", "distributed under", "available under", "published under", "provided under", "spdx")
#: Fixed value: the mark of an expression, which is on its line; and older identifiers that leave open whether later versions are meant.
MARK = r"SPDX-License-Identifier:[^\S\n]*([^\n]*)"
OPEN = re.compile(r"(A?L?GPL-\d\.\d)(\+?)$")
#: A sentence ends at a blank line, or at one of .;:!? before white space or the end.
SENTENCE_END = r"\n[^\S\n]*\n|[.;:!?](?=\s|$)"


def normalised(sentence: str) -> str:
    """Lower case, with runs of ASCII punctuation and white space as one blank."""
    return re.sub(r"[\s!-/:-@\[-`{-~]+", " ", sentence.lower()).strip()


def identifiers(expression: str, names=NAMES) -> list[str]:
    """The licences of an expression (``A OR (B AND C WITH x)``), in their order; none if it is none, or of other licences.

    What follows the expression on its line, as the end of a comment, is left out.
    """
    marks = re.findall(r"[()]|[A-Za-z0-9.+-]+|\S", expression)
    known, out, at = {x.lower(): x for x in names}, [], 0

    def word(*wanted: str) -> bool:
        return at < len(marks) and marks[at].upper() in wanted

    def one() -> bool:
        nonlocal at
        if word("("):
            at += 1
            if not any_of() or not word(")"):
                return False
            at += 1
            return True
        own = marks[at] if at < len(marks) else ""
        if older := OPEN.match(own.upper()):
            own = f"{older[1]}-{'or-later' if older[2] else 'only'}"
        found = known.get(own.lower()) or (own if re.match(r"(?i)LicenseRef-[a-z0-9.-]+$", own) else None)
        at += 1
        if found is None:
            return False
        out.append(found)
        if word("WITH"):
            at += 2
        return True

    def any_of() -> bool:
        nonlocal at
        if not one():
            return False
        while word("OR", "AND"):
            at += 1
            if not one():
                return False
        return True

    return list(dict.fromkeys(out)) if any_of() else []


class Known:
    """Known sentences by their pieces: a licence's sentence can hold sentence ends; and names that notices give."""

    def __init__(self, sentences: dict[str, str | tuple[str, ...]], names: dict[str, tuple[str, ...]] = NAMES):
        self.names = {normalised(x): name for name, forms in names.items() for x in (name, *forms)}
        longest_first = sorted(self.names, key=lambda x: (-len(x), x))
        self.given = re.compile(GIVEN + "(" + "|".join(map(re.escape, longest_first)) + r")\b") if self.names else None
        self.identifiers = names
        self.forms = []
        for name, known in sentences.items():
            for form in (known,) if isinstance(known, str) else known:
                self.forms.append((name, tuple(p for p in map(normalised, re.split(SENTENCE_END, form)) if p)))
        self.by_first: dict[str, list] = {}
        for name, pieces in sorted(self.forms, key=lambda f: -len(f[1])):
            self.by_first.setdefault(pieces[0], []).append((name, pieces))
        self.pieces = {p for _, pieces in self.forms for p in pieces}
        self.longest = max(map(len, self.pieces), default=0)

    def words(self) -> list[str]:
        """A few words of which every known sentence has one, long ones first, since those are rare elsewhere."""
        left, out = [" ".join(pieces) for _, pieces in self.forms], []
        while left:
            out.append(max({w for form in left for w in form.split()}, key=lambda w: (sum(w in form for form in left) * len(w) ** 2, w)))
            left = [form for form in left if out[-1] not in form]
        return out

    def units(self, text: str) -> list[str]:
        """The text's sentences, normalised; where lines are not ended, known runs of lines, else single lines."""
        out = []
        for sentence in re.split(SENTENCE_END, text):
            lines = [x for x in map(normalised, sentence.split("\n")) if x]
            at = 0
            while at < len(lines):
                run, end, size = lines[at], at + 1, 1
                while len(run) <= self.longest:
                    if run in self.pieces:
                        end = at + size
                    if at + size == len(lines):
                        break
                    run, size = f"{run} {lines[at + size]}", size + 1
                out.append(" ".join(lines[at:end]))
                at = end
        return out

    def found(self, text: str) -> list[str]:
        """Identifiers of the known sentences in a text, in their order; those of notices and expressions end in the licence's name."""
        units, out, unknown, pieces_left = self.units(text), [], [], 0
        stated = iter(re.findall(MARK, text, re.I))

        def notices() -> None:
            if unknown and self.given:
                out.extend(f"notice-{self.names[x]}" for x in self.given.findall(" ".join(unknown)))
            unknown.clear()

        for k, unit in enumerate(units):
            for name, pieces in self.by_first.get(unit, ()):
                if tuple(units[k : k + len(pieces)]) == pieces:
                    notices()
                    out.append(name)
                    pieces_left = max(pieces_left, len(pieces))
                    break
            marked = unit.startswith("spdx license identifier") or " spdx license identifier" in unit
            expression = next(stated, "") if marked else ""
            if marked and not pieces_left:
                notices()
                out.extend(f"spdx-{x}" for x in identifiers(expression, self.identifiers))
            elif not pieces_left:
                unknown.append(unit)
            pieces_left = max(0, pieces_left - 1)
        notices()
        return out


def match(found: list[str], rules: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, int, int]]:
    """(licence, first, last position) of rules whose identifiers follow each other in found; longest rules first.

    An identifier of a notice or an expression is a rule by itself."""
    free, out = [True] * len(found), []
    by_form = {x: x.partition("-")[2] for x in found if x.partition("-")[0] in ("notice", "spdx")}
    named = {r for _, r in rules}
    rules = [*rules, *((licence, (x,)) for x, licence in by_form.items() if (x,) not in named)]
    for licence, rule in sorted(rules, key=lambda r: -len(r[1])):
        n = len(rule)
        for i in range(len(found) - n + 1):
            if all(free[i : i + n]) and tuple(found[i : i + n]) == tuple(rule):
                free[i : i + n] = [False] * n
                out.append((licence, i, i + n - 1))
    return sorted(out, key=lambda m: m[1])


def may_hold(text: str, words: list[str]) -> Column:
    """Whether a text column holds one of the words."""
    return F.coalesce(reduce(Column.__or__, [F.lower(text).contains(w) for w in words], F.lit(False)), F.lit(False))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", known: dict[str, str | tuple[str, ...]] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """(id, licenses, sentences, matches) of every document.

    licenses are the sorted distinct licences, comma-separated (empty if none); sentences the identifiers found in
    their order, comma-separated; matches the number of rule matches. A repeated sentence counts each time. Null or
    empty texts have none; each row counts for itself, whatever ids it shares. No documents give no rows. All work is
    local to a row, so nothing is shuffled.
    """
    table = Known(known)
    words = [*table.words(), *GIVEN_WORDS]
    schema = T.StructType([docs.schema[id_col], T.StructField("licenses", T.StringType()), T.StructField("sentences", T.StringType()), T.StructField("matches", T.IntegerType())])

    def rule(batches):
        for batch in batches:
            out = []
            for value in batch["candidate"].to_pylist():
                names = table.found(value) if value else []
                matches = match(names, rules)
                out.append((",".join(sorted({m[0] for m in matches})), ",".join(names), len(matches)))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.when(may_hold(text, words), F.col(text)).alias("candidate")).mapInArrow(rule, schema)
