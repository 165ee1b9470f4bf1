"""License scans by sentence rules: known licence sentences become identifiers, identifier sequences meet ordered licence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of licences in prose (normalized, without article and the word "license" at the end), by SPDX identifier.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit", "expat", "mit x11"),
    "Apache-2.0": ("apache license version 2 0", "apache license v2 0", "apache license 2 0", "apache 2 0", "apache version 2 0", "apache software license version 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgpl version 2 1", "lgpl v2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl version 3", "lgpl version 3", "lgpl v3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl version 3", "agpl version 3", "agpl v3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "mpl 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "epl 2 0"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license v1 0", "epl 1 0"),
    "EUPL-1.2": ("european union public licence version 1 2", "european union public license version 1 2", "eupl version 1 2", "eupl 1 2"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd"),
    "0BSD": ("bsd zero clause", "zero clause bsd", "0bsd"),
    "ISC": ("isc", "internet systems consortium"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "boost version 1 0"),
    "Zlib": ("zlib", "zlib libpng"),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1"),
    "Unlicense": ("unlicense",),
    "WTFPL": ("wtfpl", "do what the fuck you want to public"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal"),
    "CC-BY-3.0": ("cc by 3 0", "creative commons attribution 3 0", "creative commons attribution 3 0 unported", "creative commons attribution 3 0 international"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0", "creative commons attribution 4 0 international"),
    "CC-BY-SA-3.0": ("cc by sa 3 0", "creative commons attribution sharealike 3 0", "creative commons attribution sharealike 3 0 unported", "creative commons attribution share alike 3 0 unported"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0", "creative commons attribution sharealike 4 0 international", "creative commons attribution share alike 4 0 international"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial 4 0 international"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international"),
}

#: What stands before and after the name in a sentence that refers to a licence, on normalized text; the rest of it is the name.
REFERENCE = r"^(?:(?:all |the )?(?:this|these|that|our|source|contents?) ?(?:file|files|work|works|project|software|program|code|source code|library|package|module|repository|document|documentation|material|article|page|site|content|text|font|dataset|data)?(?: of this (?:project|repository|site|page|package))? (?:is|are) )?(?:dual )?(?:licensed|released|distributed|available|made available|provided|published|shared)(?: to you)? under (?:the )?(?:terms of )?(?:the )?(?:a )?"
TAIL = r"(?: licen[sc]e)?(?: or later| or any later version| or at your option any later version)?$"

# SPDX identifiers whose tag alone names the licence, besides those that have their own rule below.
SPDX = ("AGPL-3.0-only", "AGPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "ISC", "0BSD", "BSL-1.0", "EPL-2.0", "EUPL-1.2", "OFL-1.1", "Artistic-2.0", "Zlib", "WTFPL", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "EPL-1.0", "CC-BY-3.0", "CC-BY-SA-3.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")

# Licence sentences as they stand in public licence texts and headers (normalized: lower case, everything
# but a-z and 0-9 is one blank), each with its identifier.
SENTENCES: dict[str, str] = {
    "spdx license identifier mit": "MITspdx",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITperm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITasis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITliab",
    "spdx license identifier apache 2 0": "APspdx",
    "licensed under the apache license version 2 0 the license": "APhead",
    "you may not use this file except in compliance with the license": "APuse",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APcopyasis",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "APcopy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "APcopy",
    "you may obtain a copy of the license at": "APcopyat",
    "http www apache org licenses license 2 0": "APurl",
    "https www apache org licenses license 2 0": "APurl",
    "unless required by applicable law or agreed to in writing software": "APunless",
    "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APdist",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APasis",
    "see the license for the specific language governing permissions and limitations under the license": "APsee",
    "spdx license identifier gpl 3 0 only": "GPL3spdx",
    "spdx license identifier gpl 3 0 or later": "GPL3spdxlater",
    "spdx license identifier gpl 3 0": "GPL3spdx",
    "spdx license identifier gpl 2 0 only": "GPL2spdx",
    "spdx license identifier gpl 2 0 or later": "GPL2spdxlater",
    "spdx license identifier gpl 2 0": "GPL2spdx",
    **{"spdx license identifier " + "".join(c if c.isalnum() else " " for c in name.lower()): f"SPDX-{name}" for name in SPDX},
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPLv3whole",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPLv2whole",
    "this program is free software": "GPLfree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLredist",
    "either version 3 of the license or at your option any later version": "GPLv3later",
    "either version 2 of the license or at your option any later version": "GPLv2later",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPLhope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GPLimplied",
    "see the gnu general public license for more details": "GPLsee",
    "you should have received a copy of the gnu general public license along with this program": "GPLcopy",
    "if not see https www gnu org licenses": "GPLurl",
    "if not see http www gnu org licenses": "GPLurl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2head",
    "spdx license identifier bsd 3 clause": "BSD3spdx",
    "spdx license identifier bsd 2 clause": "BSD2spdx",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDredist",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "neither the name of the nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSDperm",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCasis",
    "this software is provided as is without any express or implied warranty": "ZlibAsis",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibPerm",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSLperm",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21whole",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3whole",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3whole",
    "gnu general public license version 3 29 june 2007": "GPL3title",
    "gnu general public license version 2 june 1991": "GPL2title",
    "gnu lesser general public license version 2 1 february 1999": "LGPL21title",
    "gnu lesser general public license version 3 29 june 2007": "LGPL3title",
    "gnu affero general public license version 3 19 november 2007": "AGPL3title",
    "mozilla public license version 2 0": "MPL2title",
    "apache license version 2 0 january 2004": "APtitle",
    "eclipse public license v 2 0": "EPL2title",
    "boost software license version 1 0 august 17th 2003": "BSLtitle",
    "creative commons attribution 4 0 international public license": "CCBY4title",
    "creative commons attribution sharealike 4 0 international public license": "CCBYSA4title",
    "creative commons attribution noncommercial 4 0 international public license": "CCBYNC4title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2head",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2copy",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseAny",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "WTFPLcopy",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "CC0waive",
    "this font software is licensed under the sil open font license version 1 1": "OFLhead",
    "all rights reserved": "AllRights",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this work is dedicated to the public domain": "PublicDomain",
}

# Ordered licence rules; a rule that matches takes its identifiers away from those below it.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MITperm", "MITnotice", "MITasis", "MITliab")),
    ("MIT", ("MITperm", "MITnotice", "MITasis")),
    ("MIT", ("MITperm",)),
    ("Apache-2.0", ("APhead", "APuse", "APcopyasis", "APsee")),
    ("Apache-2.0", ("APhead", "APuse", "APcopy", "APasis", "APsee")),
    ("Apache-2.0", ("APhead", "APuse", "APcopyat", "APurl", "APunless", "APdist", "APsee")),
    ("Apache-2.0", ("APhead", "APuse", "APcopyat", "APurl", "APasis", "APsee")),
    ("Apache-2.0", ("APhead", "APuse", "APcopy", "APunless", "APdist", "APsee")),
    ("Apache-2.0", ("APhead",)),
    ("GPL-3.0-or-later", ("GPLv3whole", "GPLhope", "GPLimplied", "GPLsee", "GPLcopy", "GPLurl")),
    ("GPL-2.0-or-later", ("GPLv2whole", "GPLhope", "GPLimplied", "GPLsee", "GPLcopy", "GPLurl")),
    ("GPL-3.0-or-later", ("GPLv3whole",)),
    ("GPL-2.0-or-later", ("GPLv2whole",)),
    ("GPL-3.0-or-later", ("GPLfree", "GPLredist", "GPLv3later")),
    ("GPL-2.0-or-later", ("GPLfree", "GPLredist", "GPLv2later")),
    ("BSD-3-Clause", ("BSDredist", "BSDsource", "BSDbinary", "BSDendorse")),
    ("BSD-2-Clause", ("BSDredist", "BSDsource", "BSDbinary")),
    ("MPL-2.0", ("MPL2head", "MPL2copy")),
    ("MPL-2.0", ("MPL2head",)),
    ("ISC", ("ISCperm", "ISCasis")),
    ("ISC", ("ISCperm",)),
    ("0BSD", ("0BSDperm", "ISCasis")),
    ("0BSD", ("0BSDperm",)),
    ("Zlib", ("ZlibAsis", "ZlibPerm")),
    ("Zlib", ("ZlibPerm",)),
    ("BSL-1.0", ("BSLtitle", "BSLperm")),
    ("BSL-1.0", ("BSLperm",)),
    ("Unlicense", ("Unlicense", "UnlicenseAny")),
    ("LGPL-2.1-or-later", ("LGPL21whole",)),
    ("LGPL-3.0-or-later", ("LGPL3whole",)),
    ("AGPL-3.0-or-later", ("AGPL3whole",)),
    *((name, (title,)) for title, name in (("GPL3title", "GPL-3.0"), ("GPL2title", "GPL-2.0"), ("LGPL21title", "LGPL-2.1"), ("LGPL3title", "LGPL-3.0"), ("AGPL3title", "AGPL-3.0"), ("MPL2title", "MPL-2.0"), ("APtitle", "Apache-2.0"), ("EPL2title", "EPL-2.0"), ("EPL2head", "EPL-2.0"), ("BSLtitle", "BSL-1.0"),
        ("CCBY4title", "CC-BY-4.0"), ("CCBYSA4title", "CC-BY-SA-4.0"), ("CCBYNC4title", "CC-BY-NC-4.0"), ("WTFPLcopy", "WTFPL"), ("CC0waive", "CC0-1.0"), ("OFLhead", "OFL-1.1"))),
    ("MIT", ("MITspdx",)),
    ("Apache-2.0", ("APspdx",)),
    ("GPL-3.0-or-later", ("GPL3spdxlater",)),
    ("GPL-2.0-or-later", ("GPL2spdxlater",)),
    *((name, (f"SPDX-{name}",)) for name in SPDX),
    ("GPL-3.0", ("GPL3spdx",)),
    ("GPL-2.0", ("GPL2spdx",)),
    ("BSD-3-Clause", ("BSD3spdx",)),
    ("BSD-2-Clause", ("BSD2spdx",)),
    *((name, (f"ref:{name}",)) for name in NAMES),
    ("Unlicense", ("Unlicense",)),
    ("Public-Domain", ("PublicDomain",)),
    ("All-Rights-Reserved", ("AllRights",)),
)

# Words with which licence sentences open, at which a new line begins a new sentence.
OPENERS = "licensed|released|available under|made available|distributed under|this work is|this project is|this software is|this program is|this file is|this code is|this library is|this package is|this document is|this dataset is|these files are|this source code form|the contents of this|permission to use|permission is granted|if a copy of|anyone is free|everyone is permitted|to the extent|this font software|all rights reserved|permission is hereby|redistribution|the above copyright|the software is provided|in no event|you may|unless required|neither the name|see the|spdx-license-identifier"

#: Steps that mark sentence ends with \x01: blank lines, ends of sentences, new lines before openers, ends of tag lines.
BREAKS: tuple[tuple[str, str], ...] = (
    (r"\r?\n[ \t]*\r?\n", "\x01"),
    (r"([.!?;])[ \t\r\n]+", "$1\x01"),
    (r"(?i)\n[ \t*#/]*(" + OPENERS + r")\b", "\x01$1"),
    (r"(?i)(spdx-license-identifier:[^\n\x01]*)", "$1\x01"),
)
#: Unknown sentences that may stand between two of a rule's; the text above a longer gap and that below it do not make one sequence.
MAX_GAP = 3
GAP = f"~{{{MAX_GAP + 1},}}"
UPPER, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normalized(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER_AZ), "[^a-z0-9]+", " "))


def _identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order, as "<A><B>"; "|" stands for a gap of more than MAX_GAP others."""
    for pattern, by in BREAKS:
        text = F.regexp_replace(text, pattern, by)
    of = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    names = F.create_map(*[F.lit(x) for name, forms in NAMES.items() for form in forms for x in (form, f"ref:{name}")])
    forms = [form for some in NAMES.values() for form in some]

    def mark(s: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(s, REFERENCE, ""), TAIL, "")
        wrap = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
        return F.when(s.isin(list(SENTENCES)), wrap(F.element_at(of, s))).when(s.rlike(REFERENCE) & name.isin(forms), wrap(F.element_at(names, name))).otherwise(F.when(s == "", "").otherwise("~"))

    marks = F.array_join(F.transform(F.transform(F.split(text, "\x01"), _normalized), mark), "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(marks, GAP, "|"), "~", ""), r"^\|+|\|+$", "")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licences, n_licences, n_unmatched) for every row of docs.

    sentence_ids: the identifiers in text order, as "<A><B>", with "|" where more than MAX_GAP other sentences stand between two;
    no rule matches across it. A sentence that refers to a licence by name has the identifier "ref:" and the name. licences: the distinct licences, sorted, joined by ",".
    n_unmatched: identifiers that no rule took. Null, empty and other texts without known sentences give empty strings
    and zeros; rows are scanned one by one, so repeated rows give equal results. Everything stays in one scan, without a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("doc_id", _identifiers(F.col("t")).alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in ids)).alias("ids")) for name, ids in RULES])
    none = F.struct(F.col("sentence_ids").alias("rest"), F.array().cast("array<string>").alias("hits"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.struct(F.replace(acc["rest"], rule["ids"], F.lit("-")).alias("rest"), F.array_append(acc["hits"], rule["name"]).alias("hits"))
        return F.when(F.contains(acc["rest"], rule["ids"]), hit).otherwise(acc)

    matched = F.when(F.col("sentence_ids") == "", none).otherwise(F.aggregate(rules, none, step))
    rows = rows.select("doc_id", "sentence_ids", matched.alias("m"))
    names = F.array_sort(F.array_distinct("m.hits"))
    left = F.length("m.rest") - F.length(F.replace("m.rest", F.lit("<"), F.lit("")))
    return rows.select("doc_id", "sentence_ids", F.array_join(names, ",").alias("licences"), F.size(names).cast("long").alias("n_licences"), left.cast("long").alias("n_unmatched"))


def oracle_sql() -> str:
    """The same in DuckDB SQL, made from the same fixed values."""
    t = "coalesce(text, '')"
    for pattern, by in BREAKS:
        t = f"regexp_replace({t}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    named = ", ".join(f"('{form}', 'ref:{name}')" for name, forms in NAMES.items() for form in forms)
    sql = f"""WITH k(s, i) AS (VALUES {known}), nm(s, i) AS (VALUES {named}),
p AS (SELECT doc_id, trim(regexp_replace(translate(unnest(string_split(x, chr(1))), '{UPPER}', '{LOWER_AZ}'), '[^a-z0-9]+', ' ', 'g')) AS s, generate_subscripts(string_split(x, chr(1)), 1) AS pos FROM (SELECT doc_id, {t} AS x FROM documents)),
q AS (SELECT p.doc_id, string_agg(CASE WHEN k.i IS NOT NULL THEN '<' || k.i || '>' WHEN nm.i IS NOT NULL THEN '<' || nm.i || '>' WHEN p.s = '' THEN '' ELSE '~' END, '' ORDER BY pos) AS marks
  FROM p LEFT JOIN k ON k.s = p.s LEFT JOIN nm ON regexp_matches(p.s, '{REFERENCE}') AND nm.s = regexp_replace(regexp_replace(p.s, '{REFERENCE}', ''), '{TAIL}', '') GROUP BY 1),
q2 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(marks, '{GAP}', '|', 'g'), '~', '', 'g'), '^\\|+|\\|+$', '', 'g') AS ids FROM q),
r0 AS (SELECT d.doc_id, coalesce(q2.ids, '') AS ids, coalesce(q2.ids, '') AS rest, CAST([] AS VARCHAR[]) AS hits FROM documents d LEFT JOIN q2 USING (doc_id))"""
    for n, (name, ids) in enumerate(RULES, 1):
        seq = "".join(f"<{x}>" for x in ids)
        sql += f",\nr{n} AS (SELECT doc_id, ids, replace(rest, '{seq}', '-') AS rest, CASE WHEN contains(rest, '{seq}') THEN list_append(hits, '{name}') ELSE hits END AS hits FROM r{n - 1})"
    return sql + f"""
SELECT doc_id, ids AS sentence_ids, array_to_string(list_sort(list_distinct(hits)), ',') AS licences, len(list_distinct(hits))::BIGINT AS n_licences,
  (length(rest) - length(replace(rest, '<', '')))::BIGINT AS n_unmatched FROM r{len(RULES)}"""
