"""Licence scans by sentence rules.

A text is cut into sentences at line ends and after closing punctuation. Each is
normalised to lower-case letters and digits between single spaces, and looked up
among known licence sentences; so is what consecutive lines make together, as
licence texts are wrapped. Comment markers go with the normalisation; a line
without letters and digits, or closing punctuation, ends a sentence. The identifiers found, in order, are a sequence;
ordered rules, each a sequence of identifiers that names a licence, are matched
against it, and what a rule matches is taken out before the next rule is tried.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import id_column, over_chunks

BREAK = r"\n|[.!?;:][^A-Za-z0-9 \n]*[ \t]+"
# Sentences of public licence texts and notices, normalised, with their identifiers.
SENTENCES = {
    "released under the mit license": "mit_notice",
    "licensed under the mit license": "mit_notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice_kept",
    "licensed under the apache license version 2 0": "apache2_notice",
    "licensed under the apache license version 2 0 the license": "apache2_notice",
    "you may not use this file except in compliance with the license": "apache2_compliance",
    "you may obtain a copy of the license at": "apache2_copy",
    "this work is licensed under the gnu general public license version 3": "gpl3_notice",
    "this program is free software": "gnu_free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_later",
    "licensed under cc by nc 4 0": "cc_by_nc4_notice",
    "licensed under cc by 4 0": "cc_by4_notice",
    "licensed under cc by sa 4 0": "cc_by_sa4_notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_notice",
    "all rights reserved": "all_rights",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_as_is",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_as_is",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_as_is",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_specific",
    "this library is free software": "gnu_free",
    "this program is distributed in the hope that it will be useful but without any warranty": "gnu_no_warranty",
    "this library is distributed in the hope that it will be useful but without any warranty": "gnu_no_warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gnu_implied",
    "see the gnu general public license for more details": "gpl_details",
    "see the gnu lesser general public license for more details": "lgpl_details",
    "see the gnu affero general public license for more details": "agpl_details",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_later",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2_only",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "this software is provided as is without any express or implied warranty": "zlib_as_is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib_liable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl2_notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0": "epl1_notice",
    "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0_dedication",
    "licensed under cc0 1 0": "cc0_notice",
    "distributed under the boost software license version 1 0": "bsl1_notice",
    "licensed under the artistic license 2 0": "artistic2_notice",
    "licensed under the bsd 3 clause license": "bsd3_notice",
    "licensed under the bsd 2 clause license": "bsd2_notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2_copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2_copy",
}
# Rules in the order in which they are tried.
RULES = (
    (("mit_grant", "mit_notice_kept", "mit_as_is"), "MIT"),
    (("mit_grant", "mit_notice_kept"), "MIT"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_as_is"), "BSD-3-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_names"), "BSD-3-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is"), "BSD-2-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary"), "BSD-2-Clause"),
    (("apache2_notice", "apache2_compliance", "apache2_copy", "apache2_as_is", "apache2_specific"), "Apache-2.0"),
    (("apache2_notice", "apache2_compliance", "apache2_copy"), "Apache-2.0"),
    (("apache2_notice", "apache2_compliance"), "Apache-2.0"),
    (("gnu_free", "gpl3_later"), "GPL-3.0-or-later"),
    (("gnu_free", "gpl2_later"), "GPL-2.0-or-later"),
    (("gnu_free", "gpl2_only"), "GPL-2.0-only"),
    (("gnu_free", "lgpl21_later"), "LGPL-2.1-or-later"),
    (("gnu_free", "lgpl3_later"), "LGPL-3.0-or-later"),
    (("gnu_free", "agpl3_later"), "AGPL-3.0-or-later"),
    (("zlib_as_is", "zlib_liable", "zlib_grant"), "Zlib"),
    (("mpl2_notice", "mpl2_copy"), "MPL-2.0"),
    (("mit_notice",), "MIT"),
    (("mit_grant",), "MIT"),
    (("apache2_notice",), "Apache-2.0"),
    (("gpl3_notice",), "GPL-3.0-only"),
    (("gpl3_later",), "GPL-3.0-or-later"),
    (("gpl2_later",), "GPL-2.0-or-later"),
    (("gpl2_only",), "GPL-2.0-only"),
    (("lgpl21_later",), "LGPL-2.1-or-later"),
    (("lgpl3_later",), "LGPL-3.0-or-later"),
    (("agpl3_later",), "AGPL-3.0-or-later"),
    (("isc_grant",), "ISC"),
    (("zlib_grant",), "Zlib"),
    (("epl2_notice",), "EPL-2.0"),
    (("epl1_notice",), "EPL-1.0"),
    (("cc0_dedication",), "CC0-1.0"),
    (("cc0_notice",), "CC0-1.0"),
    (("bsl1_notice",), "BSL-1.0"),
    (("artistic2_notice",), "Artistic-2.0"),
    (("bsd3_notice",), "BSD-3-Clause"),
    (("bsd2_notice",), "BSD-2-Clause"),
    (("cc_by_nc4_notice",), "CC-BY-NC-4.0"),
    (("cc_by4_notice",), "CC-BY-4.0"),
    (("cc_by_sa4_notice",), "CC-BY-SA-4.0"),
    (("mpl2_notice",), "MPL-2.0"),
    (("unlicense",), "Unlicense"),
    (("all_rights",), "LicenseRef-all-rights-reserved"),
)
#: A sentence that no known one equals but that has one of these words is a candidate for the table of sentences.
MARK = "(^| )(licen[cs]e[ds]?|copyright|warrant(y|ies)|redistribut(e|ion)|sublicense)( |$)"
#: Rows of the tables of sentences and rules at most; they are held by every task.
MAX_BOOK = 100_000

_break = re.compile(f"({BREAK})")
_mark = re.compile(MARK)
_near = re.compile("licen[cs]e|copyright|warrant|redistribut", re.IGNORECASE)
_drop = re.compile("[^a-z0-9]+")
_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalised(sentence: str) -> str:
    return _drop.sub(" ", sentence.translate(_lower)).strip()


class Book:
    """Known sentences, normalised, with their identifiers, and rules (identifiers, licence) in order."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES):
        self.sentences = {s: i for k, i in sentences.items() if (s := normalised(k))}
        self.rules = [("," + ",,".join(ids) + ",", name) for ids, name in rules if ids]
        #: What known sentences can begin with, whole words, and the least length of one.
        self.begins = {" ".join(w[:i]) for w in map(str.split, self.sentences) for i in range(1, len(w))}
        self.least = min(map(len, self.sentences), default=0)

    def identify(self, text: str) -> tuple[list[str], list[str]]:
        """Identifiers of the known sentences of a text, in order, and its candidates."""
        cut = _break.split(text)  # sentences and, between them, what ends each
        parts, ends, out, other, i = cut[::2], [*cut[1::2], ""], [], [], 0
        legal = bool(_near.search(text))
        while i < len(parts):
            s = normalised(parts[i]) if len(parts[i]) > 1 else ""
            own = s
            got, j = self.sentences.get(s) if len(parts[i]) >= self.least else None, i
            while not got and s in self.begins and ends[j] == "\n" and not parts[j].rstrip().endswith((".", "!", "?", ";", ":")) and (more := normalised(parts[j + 1])):
                s, j = f"{s} {more}", j + 1
                got = self.sentences.get(s)
            if got:
                out.append(got)
            elif legal and _mark.search(own):
                other.append(own)
            i = j + 1 if got else i + 1
        return out, other

    def match(self, ids: list[str]) -> list[str]:
        """Licences that the rules name, in rule order, each once."""
        left, out = "," + "".join(f"{i},," for i in ids), []
        for want, name in self.rules:
            if want in left:
                left = left.replace(want, ",/,")
                if name not in out:
                    out.append(name)
        return out


def book(sentences: DataFrame | None = None, rules: DataFrame | None = None) -> Book:
    """A book from tables: sentences (sentence, id) as they stand in texts, rules (rank, ids, licence) with ids joined by commas and tried by rank; where one is missing, the table of this module. Nulls are left out; of equal sentences the least id counts."""

    def few(table, *names):
        got = table.select(*(F.col(n).cast("string" if n != "rank" else "long") for n in names)).dropna().distinct().limit(MAX_BOOK + 1).collect()
        if len(got) > MAX_BOOK:
            raise ValueError(f"more than {MAX_BOOK} rows of licence sentences or rules")
        return got

    known = SENTENCES if sentences is None else {r[0]: r[1] for r in sorted(few(sentences, "sentence", "id"), reverse=True)}
    tried = RULES if rules is None else [(tuple(r[1].split(",")), r[2]) for r in sorted(few(rules, "rank", "ids", "licence"))]
    return Book(known, tried)


def scan_licences(docs: DataFrame, sentences: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """doc_id, n_sentences, sentences (identifiers joined by commas), licences (joined by commas), n_candidates, candidates (joined by " | ") for each row of docs (doc_id, text).

    Known sentences and rules are those of the tables (see ``book``). Candidates:
    sentences that speak of licences but equal no known one. Null and empty
    texts have none, and empty strings; very long texts are read whole; repeated
    rows get the same; an empty table gives an empty one; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(book(sentences, rules))

    def rows(c):
        raw, b = c.data.tobytes(), shared.value
        got = [b.identify(raw[x:y].decode("utf-8", "replace")) for x, y in zip(c.offs[:-1], c.offs[1:], strict=True)]
        yield {"doc_id": id_column(c), "n_sentences": [len(x) for x, _ in got], "sentences": [",".join(x) for x, _ in got], "licences": [",".join(b.match(x)) for x, _ in got], "n_candidates": [len(x) for _, x in got], "candidates": [" | ".join(x) for _, x in got]}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_chunks(docs, rows, "doc_id long, n_sentences long, sentences string, licences string, n_candidates long, candidates string")


def sql() -> str:
    """The same in DuckDB, from the same tables of sentences and rules, but for sentences that are wrapped over lines."""
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items())
    left, place = "left0", []
    steps = ["SELECT doc_id, ids, other, ',' || array_to_string(list_transform(ids, lambda i: i || ',,'), '') AS left0 FROM found"]
    for j, (rule, _) in enumerate(RULES):
        want = "," + ",,".join(rule) + ","
        steps.append(f"SELECT *, contains({left}, '{want}') AS m{j}, replace({left}, '{want}', ',/,') AS left{j + 1} FROM ({steps[-1]})")
        left = f"left{j + 1}"
    # A licence stands where the first of its rules that matched stands.
    for name in dict.fromkeys(n for _, n in RULES):
        own = [j for j, (_, n) in enumerate(RULES) if n == name]
        place.append("CASE " + " ".join(f"WHEN m{j} THEN {{'j': {j}, 'n': '{name}'}}" for j in own) + " END")
    return f"""
WITH known AS (SELECT MAP {{{pairs}}} AS m),
cut AS (SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '{BREAK}'), lambda s: trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))) AS s FROM documents),
found AS (SELECT doc_id, list_filter(list_transform(s, lambda x: m[x]), lambda x: x IS NOT NULL) AS ids, list_filter(s, lambda x: m[x] IS NULL AND regexp_matches(x, '{MARK}')) AS other FROM cut, known),
ruled AS ({steps[-1]})
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentences,
       array_to_string(list_transform(list_sort(list_filter([{', '.join(place)}], lambda x: x IS NOT NULL)), lambda x: x.n), ',') AS licences,
       CAST(len(other) AS BIGINT) AS n_candidates, array_to_string(other, ' | ') AS candidates
FROM ruled"""
