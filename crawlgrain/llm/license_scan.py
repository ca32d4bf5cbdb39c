"""Licence scans by sentence rules.

A text is cut into parts at line ends and at the ends of sentences, and normalised. A known licence sentence
is found where it is one part, or several that only line ends or semicolons divide, as notices are wrapped. Beside the
sentences of notices there are two forms with a slot: "licensed under the NAME" and its like, and SPDX tags.
The identifiers found, in order, are matched against ordered rules: a rule is a sequence of
identifiers that must stand next to each other, longer rules come first, and what a rule has
matched is gone for the later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm.common import only

#: Identifier: normalised sentence.
SENTENCES = {
    "a1": "licensed under the apache license version 2 0",
    "a2": "you may not use this file except in compliance with the license",
    "a3": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "a4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "g1": "this work is licensed under the gnu general public license version 3",
    "g2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "g3": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "m1": "released under the mit license",
    "m2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "m3": "the software is provided as is without warranty of any kind express or implied",
    "c1": "licensed under cc by nc 4 0",
    "c2": "licensed under cc by 4 0",
    "c3": "licensed under cc by sa 4 0",
    "p1": "all rights reserved",
    "g4": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "l1": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "l2": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "n1": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "b1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "b2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "b3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "b4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "o1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "m0": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "u1": "this is free and unencumbered software released into the public domain",
    "k1": "distributed under the boost software license version 1 0",
    "k2": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "z1": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "e1": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "x1": "this software is provided as is without any express or implied warranty",
    "x2": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "i1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}
#: Other wordings of the same, as standard notices have them: normalised sentence (a bar for an end within), identifier.
WORDINGS = {
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "a3",
    "this source code form is subject to the terms of the mozilla public license v|2 0": "o1",
    "licensed under the mit license": "m1",
    "this project is licensed under the mit license": "m1",
    "this work is licensed under a creative commons attribution 4 0 international license": "c2",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "c3",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "c1",
    "licensed under the apache license version 2 0 the license": "a1",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "m3",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1": "b1",
}
#: Identifiers that only a name or an SPDX tag gives.
NAMED_ONLY = ["b5", "b6", "i2", "g5", "l3", "l4", "n2"]
#: Normalised name of a licence, as it stands in "licensed under the NAME": identifier.
NAMES = {
    "mit license": "m1", "mit": "m1", "expat license": "m1", "apache license version 2 0": "a1", "apache license 2 0": "a1", "apache 2 0 license": "a1", "apache 2 0": "a1",
    "gnu general public license version 3": "g1", "gnu general public license v3 0": "g1", "gnu gpl v3": "g1", "gpl v3": "g1", "gplv3": "g1", "gpl 3 0": "g1",
    "gnu general public license version 2": "g5", "gnu general public license v2 0": "g5", "gpl v2": "g5", "gplv2": "g5", "gpl 2 0": "g5",
    "gnu lesser general public license version 2 1": "l3", "lgpl v2 1": "l3", "gnu lesser general public license version 3": "l4", "lgpl v3": "l4", "lgplv3": "l4",
    "gnu affero general public license version 3": "n2", "agpl v3": "n2", "agplv3": "n2", "mozilla public license 2 0": "o1", "mozilla public license version 2 0": "o1", "mpl 2 0": "o1",
    "bsd 3 clause license": "b5", "3 clause bsd license": "b5", "new bsd license": "b5", "bsd 2 clause license": "b6", "2 clause bsd license": "b6", "simplified bsd license": "b6", "isc license": "i2",
    "boost software license version 1 0": "k1", "boost software license 1 0": "k1", "cc0 1 0": "z1", "cc0 1 0 universal": "z1", "creative commons zero v1 0 universal": "z1", "unlicense": "u1",
    "eclipse public license 2 0": "e1", "eclipse public license version 2 0": "e1", "eclipse public license v 2 0": "e1", "zlib license": "x1",
}
#: SPDX identifier: identifier.
SPDX = {
    "MIT": "m1", "Apache-2.0": "a1", "GPL-3.0-only": "g1", "GPL-3.0": "g1", "GPL-3.0-or-later": "g2", "GPL-2.0-only": "g5", "GPL-2.0": "g5", "GPL-2.0-or-later": "g4", "LGPL-2.1-only": "l3", "LGPL-2.1-or-later": "l1",
    "LGPL-3.0-only": "l4", "LGPL-3.0-or-later": "l2", "AGPL-3.0-only": "n2", "AGPL-3.0-or-later": "n1", "MPL-2.0": "o1", "BSD-3-Clause": "b5", "BSD-2-Clause": "b6", "ISC": "i2", "BSL-1.0": "k1", "CC0-1.0": "z1",
    "Unlicense": "u1", "EPL-2.0": "e1", "Zlib": "x1", "CC-BY-4.0": "c2", "CC-BY-SA-4.0": "c3", "CC-BY-NC-4.0": "c1",
}
#: (licence, identifiers) in the order of trial.
RULES = [
    ("mit-full-text", ["m0", "m2", "m3"]),
    ("zlib-text", ["x1", "x2"]),
    ("apache-2.0-notice", ["a1", "a2", "a3", "a4"]),
    ("gpl-3.0-notice", ["g2", "g3"]),
    ("mit-text", ["m2", "m3"]),
    ("bsd-3-clause", ["b1", "b2", "b3", "b4"]),
    ("bsd-2-clause", ["b1", "b2", "b3"]),
    ("apache-2.0", ["a1"]),
    ("gpl-3.0", ["g1"]),
    ("gpl-3.0-or-later", ["g2"]),
    ("mit", ["m1"]),
    ("cc-by-nc-4.0", ["c1"]),
    ("cc-by-4.0", ["c2"]),
    ("cc-by-sa-4.0", ["c3"]),
    ("gpl-2.0-or-later", ["g4"]),
    ("lgpl-2.1-or-later", ["l1"]),
    ("lgpl-3.0-or-later", ["l2"]),
    ("agpl-3.0-or-later", ["n1"]),
    ("mpl-2.0", ["o1"]),
    ("isc", ["i1"]),
    ("mit-grant", ["m0"]),
    ("unlicense", ["u1"]),
    ("bsl-1.0", ["k1"]),
    ("bsl-1.0-text", ["k2"]),
    ("cc0-1.0", ["z1"]),
    ("epl-2.0", ["e1"]),
    ("zlib", ["x1"]),
    ("bsd-3-clause-named", ["b5"]),
    ("bsd-2-clause-named", ["b6"]),
    ("isc-named", ["i2"]),
    ("gpl-2.0", ["g5"]),
    ("lgpl-2.1", ["l3"]),
    ("lgpl-3.0", ["l4"]),
    ("agpl-3.0", ["n2"]),
    ("proprietary", ["p1"]),
]
#: Each known sentence has one of these, each within a word, so that a text without them needs no cutting however it is spaced.
HINT = "(?i)licen|permission|warrant|redistribut|reserved|unencumbered|neighboring"
KNOWN = {v: k for k, v in SENTENCES.items()} | WORDINGS
#: After marking, a bar ends a sentence and a slash stands for a line end or a semicolon; a known sentence may go over slashes.
_any = lambda texts: "(?:" + "|".join(sorted(texts, key=lambda t: (-len(t), t))) + ")"
_TAGS = {k.lower().replace("-", " ").replace(".", " "): v for k, v in SPDX.items()}
#: The forms with a slot; the name or the tags are group 1.
NAMED = (
    "(?:this (?:code|project|software|program|library|work|file|package|repository) is )?(?:dual )?(?:licensed|released|distributed|available|made available) under (?:the )?(?:terms of the )?"
    f"({_any(NAMES)})(?:,? see (?:the )?license(?: file| md| txt)?(?: for (?:more )?(?:details|information))?)?"
)
TAGGED = f"spdx license identifier ({_any(_TAGS)}(?: (?:or|and) {_any(_TAGS)})*)"
_spaced = lambda pattern: pattern.replace(" ", "[ /]")
SOUGHT = "(?<=[|/])(?:" + "|".join([*(_spaced(s.replace("|", "\\|")) for s in sorted(KNOWN, key=len, reverse=True)), _spaced(NAMED), _spaced(TAGGED)]) + ")(?=[|/])"
MARKS = [
    ("[^a-z0-9\\s.;!?]", "_"), ("(?<![.;!?]);++(?=\\s|$)", "/"), ("(?<![.;!?])[.;!?]++(?=\\s|$)", "|"), ("\n", "/"), ("[^a-z0-9|/]+", " "),
    ("(?<=[|/]) | (?=[|/])", ""), ("/{2,}", "/"), ("/?\\|[|/]*+", "|"),
]


def _identifiers(text: Column) -> Column:
    marked = F.concat(F.lit("\n"), F.lower(text), F.lit("\n"))
    for pattern, by in MARKS:
        marked = F.regexp_replace(marked, pattern, by)
    found = F.regexp_extract_all(F.concat(F.lit("|"), marked, F.lit("|")), F.lit(SOUGHT), F.lit(0))
    known, names, tags = (F.create_map(*(F.lit(x) for item in table.items() for x in item)) for table in (KNOWN, NAMES, _TAGS))

    def ids(sentence: Column) -> Column:
        s = F.translate(sentence, "/", " ")
        spdx = F.transform(F.regexp_extract_all(F.regexp_extract(s, f"^{TAGGED}$", 1), F.lit(f"{_any(_TAGS)}(?= or | and |$)"), F.lit(0)), lambda t: F.element_at(tags, t))
        one = F.coalesce(F.try_element_at(known, s), F.try_element_at(names, F.regexp_extract(s, f"^{NAMED}$", 1)))
        return F.when(F.startswith(s, F.lit("spdx ")), spdx).otherwise(F.array(one))

    return F.flatten(F.transform(found, ids))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses) for every row of docs.

    sentence_ids: identifiers found, in order, comma-joined; licenses: rules that matched, in the
    order of trial, comma-joined. A null or empty text has none of either. Rows are scanned one by one and whole, however long:
    repeated rows give repeated results, an empty table an empty one. Other columns, whatever their names, are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, doc_id="long", text="string").select(
        "doc_id", F.when(text.rlike(HINT), _identifiers(text)).otherwise(F.expr("cast(array() as array<string>)")).alias("ids")
    )
    # identifiers stand between bars, so that a rule is a plain substring
    left = F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(ids) + "|").alias("sought")) for name, ids in RULES))
    start = F.struct(left.alias("left"), F.expr("cast(array() as array<string>)").alias("named"))

    def tried(acc: Column, rule: Column) -> Column:
        named = F.when(F.contains(acc["left"], rule["sought"]), F.concat(acc["named"], F.array(rule["name"]))).otherwise(acc["named"])
        return F.struct(F.replace(acc["left"], rule["sought"], F.lit("~")).alias("left"), named.alias("named"))

    licenses = F.aggregate(rules, start, tried, lambda acc: F.array_join(acc["named"], ","))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.when(F.size("ids") > 0, licenses).otherwise("").alias("licenses")
    )
