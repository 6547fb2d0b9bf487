"""License scans by sentence rules, with DataFrame functions only.

Texts are normalised as wholes, with marks where a sentence ends or may end. Known licence
sentences between two marks become identifiers, whether on a line of their own or wrapped over
lines and comment signs; all else falls away. Beside whole sentences there are two templates: that
something is licensed under a licence of a list, and a line of licence identifiers joined by `or`,
`and` or `with`. The sequence of identifiers is matched against rules in their order; a rule takes
the identifiers that it matches out of the sequence.

The SQL knows sentences on one line only. Both agree on texts without wrapped ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences and their identifiers; {} stands for the name of a holder or author.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2-under",
    "licensed under the apache license version 2.0 the license": "apache2-under",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-under",
    "licensed under the mit license": "mit-under",
    "this project is licensed under the mit license": "mit-under",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-no-warranty",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-under",
    "this work is licensed under the gnu general public license version 2": "gpl2-under",
    "licensed under cc by-nc 4.0": "cc-by-nc4-under",
    "licensed under cc by 4.0": "cc-by4-under",
    "licensed under cc by-sa 4.0": "cc-by-sa4-under",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by4-under",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl2-subject",
    "all rights reserved": "reserved",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this software is provided as-is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-free",
    "to the extent possible under law {} has waived all copyright and related or neighboring rights to this work": "cc0-waived",
    "distributed under the boost software license version 1.0": "bsl1-under",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-no-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "see the gnu affero general public license for more details": "agpl-see",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-copy",
    "you should have received a copy of the gnu lesser general public license along with this program": "lgpl-copy",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at http www.eclipse.org legal epl-v10.html": "epl1-under",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0": "epl2-under",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl2-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl2-obtain",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "fsf-verbatim",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3-preamble",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "the licenses for most software are designed to take away your freedom to share and change it": "gpl2-preamble",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu lesser general public license version 2.1 february 1999": "lgpl21-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "agpl3-preamble",
    "apache license version 2.0 january 2004": "apache2-title",
    "apache license version 2.0 january 2004 http www.apache.org licenses": "apache2-title",
    "apache license version 2.0 january 2004 https www.apache.org licenses": "apache2-title",
    "terms and conditions for use reproduction and distribution": "apache2-terms",
    "mozilla public license version 2.0": "mpl2-title",
    "eclipse public license - v 1.0": "epl1-title",
    "eclipse public license - v 2.0": "epl2-title",
    "the accompanying program is provided under the terms of this eclipse public license agreement": "epl-provided",
    "the accompanying program is provided under the terms of this eclipse public license": "epl-provided",
    "boost software license - version 1.0 - august 17th 2003": "bsl1-title",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following": "bsl1-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit0-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "cc0 1.0 universal": "cc0-title",
    "this font software is licensed under the sil open font license version 1.1": "ofl-under",
    "sil open font license version 1.1 - 26 february 2007": "ofl-title",
    "the artistic license 2.0": "artistic2-title",
    "do what the fuck you want to public license version 2 december 2004": "wtfpl-title",
}
#: Names that something may be licensed under, and their identifiers.
UNDER = {
    "mit license": "mit-under", "mit licence": "mit-under", "mit": "mit-under", "apache license version 2.0": "apache2-under", "apache license 2.0": "apache2-under",
    "apache 2.0 license": "apache2-under", "apache-2.0 license": "apache2-under", "apache license v2.0": "apache2-under", "bsd 3-clause license": "bsd3-under", "3-clause bsd license": "bsd3-under",
    "bsd-3-clause license": "bsd3-under", "new bsd license": "bsd3-under", "bsd 2-clause license": "bsd2-under", "2-clause bsd license": "bsd2-under", "bsd-2-clause license": "bsd2-under",
    "simplified bsd license": "bsd2-under", "gnu general public license version 3": "gpl3-under", "gnu general public license v3.0": "gpl3-under", "gnu gplv3": "gpl3-under", "gplv3": "gpl3-under",
    "gnu general public license version 2": "gpl2-under", "gnu general public license v2.0": "gpl2-under", "gnu gplv2": "gpl2-under", "gplv2": "gpl2-under",
    "gnu lesser general public license version 3": "lgpl3-under", "gnu lesser general public license v3.0": "lgpl3-under", "gnu lgplv3": "lgpl3-under", "lgplv3": "lgpl3-under",
    "gnu lesser general public license version 2.1": "lgpl21-under", "gnu lesser general public license v2.1": "lgpl21-under", "lgpl 2.1": "lgpl21-under",
    "gnu affero general public license version 3": "agpl3-under", "gnu affero general public license v3.0": "agpl3-under", "agplv3": "agpl3-under",
    "mozilla public license version 2.0": "mpl2-under", "mozilla public license 2.0": "mpl2-under", "mpl 2.0": "mpl2-under", "eclipse public license 2.0": "epl2-under", "eclipse public license 1.0": "epl1-under",
    "eclipse public license v2.0": "epl2-under", "boost software license version 1.0": "bsl1-under", "boost software license 1.0": "bsl1-under", "isc license": "isc-under", "zlib license": "zlib-under",
    "artistic license 2.0": "artistic2-under", "sil open font license version 1.1": "ofl-under", "sil open font license 1.1": "ofl-under", "unlicense": "unlicense-under", "cc0 1.0 universal": "cc0-under", "cc0": "cc0-under",
}
#: Licences and the identifiers that show them, in the order of trial.
RULES = [
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-no-warranty", "gpl-see", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-no-warranty", "gpl-see", "gpl-copy"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-no-warranty", "gpl-see", "gpl-copy"]),
    ("LGPL-2.1-or-later", ["lgpl21-later", "gpl-no-warranty", "lgpl-see", "lgpl-copy"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "gpl-no-warranty", "lgpl-see", "lgpl-copy"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-no-warranty", "agpl-see", "agpl-copy"]),
    ("Apache-2.0", ["apache2-under", "apache-comply", "apache-copy", "apache-basis", "apache-see"]),
    ("Apache-2.0", ["apache2-under"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-under"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-no-warranty", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-no-warranty", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-3.0-only", ["gpl3-under"]),
    ("GPL-2.0-only", ["gpl2-under"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-under"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-under"]),
    ("CC-BY-4.0", ["cc-by4-under"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-obtain"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Unlicense", ["unlicense-free"]),
    ("CC0-1.0", ["cc0-waived"]),
    ("BSL-1.0", ["bsl1-under"]),
    ("EPL-1.0", ["epl1-under"]),
    ("EPL-2.0", ["epl2-under"]),
    ("GPL-3.0-only", ["gpl3-title", "fsf-verbatim", "gpl3-preamble"]),
    ("GPL-2.0-only", ["gpl2-title", "fsf-verbatim", "gpl2-preamble"]),
    ("LGPL-2.1-only", ["lgpl21-title", "fsf-verbatim", "gpl2-preamble"]),
    ("AGPL-3.0-only", ["agpl3-title", "fsf-verbatim", "agpl3-preamble"]),
    ("GPL-3.0-only", ["gpl3-title", "fsf-verbatim"]),
    ("GPL-2.0-only", ["gpl2-title", "fsf-verbatim"]),
    ("LGPL-3.0-only", ["lgpl3-title", "fsf-verbatim"]),
    ("LGPL-2.1-only", ["lgpl21-title", "fsf-verbatim"]),
    ("AGPL-3.0-only", ["agpl3-title", "fsf-verbatim"]),
    ("GPL-3.0-only", ["gpl3-title"]),
    ("GPL-2.0-only", ["gpl2-title"]),
    ("LGPL-3.0-only", ["lgpl3-title"]),
    ("LGPL-2.1-only", ["lgpl21-title"]),
    ("AGPL-3.0-only", ["agpl3-title"]),
    ("GPL-3.0-only", ["gpl3-preamble"]),
    ("AGPL-3.0-only", ["agpl3-preamble"]),
    ("Apache-2.0", ["apache2-title", "apache2-terms"]),
    ("Apache-2.0", ["apache2-title"]),
    ("LGPL-3.0-only", ["lgpl3-under"]),
    ("LGPL-2.1-only", ["lgpl21-under"]),
    ("AGPL-3.0-only", ["agpl3-under"]),
    ("BSD-3-Clause", ["bsd3-under"]),
    ("BSD-2-Clause", ["bsd2-under"]),
    ("MPL-2.0", ["mpl2-under"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("EPL-1.0", ["epl1-title", "epl-provided"]),
    ("EPL-2.0", ["epl2-title", "epl-provided"]),
    ("EPL-1.0", ["epl1-title"]),
    ("EPL-2.0", ["epl2-title"]),
    ("BSL-1.0", ["bsl1-title", "bsl1-grant"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("BSL-1.0", ["bsl1-title"]),
    ("MIT-0", ["mit0-grant", "mit-as-is"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("ISC", ["isc-under"]),
    ("Zlib", ["zlib-under"]),
    ("Unlicense", ["unlicense-under"]),
    ("CC0-1.0", ["cc0-under"]),
    ("CC0-1.0", ["cc0-title"]),
    ("OFL-1.1", ["ofl-under", "ofl-title"]),
    ("OFL-1.1", ["ofl-under"]),
    ("OFL-1.1", ["ofl-title"]),
    ("Artistic-2.0", ["artistic2-under"]),
    ("Artistic-2.0", ["artistic2-title"]),
    ("WTFPL", ["wtfpl-title"]),
    ("All-rights-reserved", ["reserved"]),
]
# Creative Commons licences by their parts: short names, whole names and titles
for _parts in ("", "-nc", "-nd", "-sa", "-nc-nd", "-nc-sa"):
    _id = {"-nc": "cc-by-nc4-under", "-sa": "cc-by-sa4-under", "": "cc-by4-under"}.get(_parts, f"cc-by{_parts}4-under")
    _long = "attribution" + _parts.replace("-nc", "-noncommercial").replace("-nd", "-noderivatives").replace("-sa", "-sharealike")
    for _name in (f"cc by{_parts} 4.0", f"cc-by{_parts}-4.0", f"a creative commons {_long} 4.0 international license", f"creative commons {_long} 4.0 international license"):
        UNDER[_name] = _id
    SENTENCES[f"creative commons {_long} 4.0 international public license"] = _id
    SENTENCES[f"{_long} 4.0 international"] = f"cc-by{_parts}4-title"
    RULES.insert(-1, (f"CC-BY{_parts.upper()}-4.0", [f"cc-by{_parts}4-title", _id]))
    if _parts not in ("", "-nc", "-sa"):
        RULES.insert(-1, (f"CC-BY{_parts.upper()}-4.0", [_id]))
    RULES.insert(-1, (f"CC-BY{_parts.upper()}-4.0", [f"cc-by{_parts}4-title"]))
# a line that names a licence by its identifier, for each licence of the rules
for _name in dict.fromkeys(name for name, _ in RULES[:-1]):
    SENTENCES[f"spdx-license-identifier {_name.lower()}"] = f"spdx-{_name.lower()}"
    RULES.append((_name, [f"spdx-{_name.lower()}"]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the SQL: a sentence ends at a mark before white space, and at each line break.
BREAK = r"[.;:!?]+[ \t]*[\r\n]+|[.;:!?]+[ \t]+|[\r\n]+"
#: Of the SQL: what a normalised sentence keeps: ASCII letters, digits, hyphen, dot and whatever is not ASCII.
DROPPED = r"[\x00-\x2C\x2F\x3A-\x60\x7B-\x7F]+"
EDGE = r"^[ .-]+|[ .-]+$"
#: A sentence ends here, written |; or it may end here or go on, written ~, with the signs of a line comment. Two ~ in a row, as at a blank line, end it.
ENDS = r"[.!?][.;:!?]*[ \t\r\n]+"
MAY_END = r"[;:]+[ \t]*(?:\r\n|[\r\n])(?:[ \t]*;+[ \t]+)?|[;:]+[ \t]+|(?:\r\n|[\r\n])(?:[ \t]*;+[ \t]+)?"
#: DROPPED without | and ~.
SPACED = r"[\x00-\x2C\x2F\x3A-\x60\x7B\x7D\x7F]+"
JOINT = "[ .-]*~[ .-]*"
#: The name of a holder, initials with their dots too.
NAME = ".{1,120}?"


#: What is licensed, and how it is put.
TEMPLATE = (
    "(?:(?:this|the) (?:program|project|software|library|code|source code|file|work|package|repository|module|tool|document|content|dataset) (?:is|are) )?"
    "(?:licensed|released|distributed|made available|available|published) under (?:the )?(?:terms of )?(?:the )?"
)
#: A line of licence identifiers.
SPDX, JOIN = "spdx-license-identifier ", " (?:or|and|with) "


def marked(text):
    """Texts with A-Z lowered, punctuation and white space as single spaces, and marks."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + "|~", LOWER + "__")
    for found, put in ((ENDS, "|"), (MAY_END, "~"), (SPACED, " ")):
        plain = F.regexp_replace(plain, found, put)
    return F.concat(F.lit("|"), plain, F.lit("|"))


def known() -> str:
    """Any known sentence between two marks, the longer ones first."""
    own = [s for s in SENTENCES if not s.startswith(SPDX)]
    words = [s.replace(".", r"\.").replace(" ", f"(?: |{JOINT})").replace("{}", NAME) for s in sorted(own, key=len, reverse=True)]
    names = "|".join(s.replace(".", r"\.") for s in sorted(UNDER, key=len, reverse=True))
    ids = "|".join(s.removeprefix(SPDX).replace(".", r"\.") for s in sorted(SENTENCES, key=len, reverse=True) if s.startswith(SPDX))
    words.append(f"{TEMPLATE}(?:{names})".replace(" ", f"(?: |{JOINT})"))
    words.append(f"{SPDX}(?:{ids})(?:{JOIN}[a-z0-9.-]*[a-z0-9])*+".replace(" ", f"(?: |{JOINT})"))
    return rf"(?<=[|~])[ .-]*+({'|'.join(words)})(?=[ .-]*[|~])"


def named() -> list[tuple[str, str]]:
    """What finds a sentence with a name in it, and the sentence as the table has it."""
    return [(f"^{s.replace('.', chr(92) + '.').replace('{}', NAME)}$", s) for s in SENTENCES if "{}" in s]


def pattern(rule: list[str]) -> str:
    """The rule's identifiers in order and side by side, in a sequence written |a||b||c|."""
    return "".join(rf"\|{i}\|" for i in rule)


def scan(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds sentence_ids (comma-joined, in order of the text) and licenses (comma-joined, in order of the rules).

    Identifiers that no rule takes are left over and give the licence `unknown`. Null and empty
    texts have neither identifiers nor licences. Columns of these names are replaced; all rows stay.
    """
    every = SENTENCES | {f"under {s}": i for s, i in UNDER.items()}
    every = {s.replace(" - ", " "): i for s, i in every.items()}  # a hyphen between words may stand at a line's end, and goes there
    names = F.create_map(*[F.lit(x) for pair in every.items() for x in pair])
    sentences = F.regexp_extract_all(marked(F.col(column)), F.lit(known()), F.lit(1))
    plain = lambda s: reduce(lambda x, n: F.regexp_replace(x, *n), named(), F.replace(F.regexp_replace(s, JOINT, " "), F.lit(" - "), F.lit(" ")))
    under = lambda s: F.regexp_replace(s, f"^{TEMPLATE}({_under_names()})$", "under $1")
    listed = lambda s: F.transform(F.split(F.substring(s, len(SPDX) + 1, 10**6), JOIN), lambda n: F.coalesce(F.element_at(names, F.concat(F.lit(SPDX), F.trim(n))), F.lit("spdx-other")))
    one = lambda s: F.when(s.startswith(SPDX), listed(s)).otherwise(F.array(F.element_at(names, F.when(names[s].isNotNull(), s).otherwise(under(s)))))
    found = F.array_compact(F.flatten(F.transform(F.transform(sentences, plain), one)))
    step = df.withColumn("sentence_ids", F.array_join(found, ","))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(sequence(rule)).alias("ids")) for name, rule in RULES])
    begin = F.struct(sequence_of("sentence_ids").alias("seq"), F.array().cast("array<string>").alias("hits"))
    taken = lambda z, r: F.when(F.contains(z.seq, r.ids), F.struct(F.replace(z.seq, r.ids, F.lit("")).alias("seq"), F.array_append(z.hits, r["name"]).alias("hits"))).otherwise(z)
    shown = lambda z: F.array_join(F.array_distinct(F.when(z.seq != "", F.array_append(z.hits, F.lit("unknown"))).otherwise(z.hits)), ",")
    licenses = F.when(F.col("sentence_ids") != "", F.aggregate(rules, begin, taken, shown)).otherwise("")
    return step.withColumn("licenses", licenses)


def sequence(rule: list[str]) -> str:
    """Identifiers in order and side by side, written |a||b||c|."""
    return "".join(f"|{i}|" for i in rule)


def sequence_of(column: str):
    return F.concat(F.lit("|"), F.replace(F.col(column), F.lit(","), F.lit("||")), F.lit("|"))


def _under_names() -> str:
    return "|".join(s.replace(".", r"\.") for s in sorted(UNDER, key=len, reverse=True))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses of every row."""
    return scan(documents.select("doc_id", "text")).select("doc_id", "sentence_ids", "licenses")


def sql() -> str:
    """The same in DuckDB."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    normal = f"regexp_replace(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '{DROPPED}', ' ', 'g'), '{EDGE}', '', 'g')"
    for with_name, without in named():
        normal = f"regexp_replace({normal}, '{with_name}', '{without}')"
    every = SENTENCES | {f"under {s}": i for s, i in UNDER.items()}
    under = f"regexp_replace(n, '^{TEMPLATE}({_under_names()})$', 'under \\1')"
    first = "|".join(s.removeprefix(SPDX).replace(".", r"\.") for s in SENTENCES if s.startswith(SPDX))
    line = f"^{SPDX}(?:{first})(?:{JOIN}[a-z0-9.-]+)*$"
    steps = f"""WITH k AS (SELECT map([{quoted(every)}], [{quoted(every.values())}]) AS names),
n AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '{BREAK}'), lambda s: {normal}) AS ns FROM documents),
f AS (SELECT doc_id, list_filter(flatten(list_transform(ns, lambda n: CASE WHEN regexp_matches(n, '{line}')
        THEN list_transform(regexp_split_to_array(substr(n, {len(SPDX) + 1}), '{JOIN}'), lambda i: coalesce(names['{SPDX}' || i], 'spdx-other'))
        ELSE [CASE WHEN n LIKE 'under %' THEN NULL ELSE coalesce(names[n], names[{under}]) END] END)), lambda i: i IS NOT NULL) AS ids FROM n, k),
s0 AS (SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
        CASE WHEN len(ids) = 0 THEN '' ELSE '|' || array_to_string(ids, '||') || '|' END AS seq, []::VARCHAR[] AS hits FROM f)"""
    for k, (name, rule) in enumerate(RULES):
        steps += f""",
s{k + 1} AS (SELECT doc_id, sentence_ids, regexp_replace(seq, '{pattern(rule)}', '', 'g') AS seq,
        CASE WHEN regexp_matches(seq, '{pattern(rule)}') AND NOT list_contains(hits, '{name}')
             THEN list_append(hits, '{name}') ELSE hits END AS hits FROM s{k})"""
    return f"""{steps}
SELECT doc_id, sentence_ids,
  array_to_string(CASE WHEN seq <> '' THEN list_append(hits, 'unknown') ELSE hits END, ',') AS licenses FROM s{len(RULES)}"""
