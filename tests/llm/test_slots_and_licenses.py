import textwrap
import zlib

import pytest

from driftline.llm import license_scan, slot_shards


def test_shards_are_near_equal_and_places_gapless(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('é', cast(1 + pow(id % 97, 2) AS int)) AS text")
    rows = slot_shards.sharded(docs).collect()
    assert len(rows) == 3000
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    total = {}
    for k in range(8):
        own = [r for r in rows if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        total[k] = sum(r["size"] for r in own)
    assert max(total.values()) < 1.02 * min(total.values())
    for r in rows[:200]:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)


def test_growing_moves_rows_into_the_new_shard_only(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('a', cast(id % 50 AS int)) AS text")
    sizes, store = slot_shards.slot_sizes(slot_shards.sized(docs)), str(tmp_path / "map")
    slot_shards.save_map(slot_shards.first_map(spark, 8), store)
    slot_shards.save_map(slot_shards.rebalanced_map(slot_shards.load_map(spark, store), sizes, 8), store)
    slot_shards.save_map(slot_shards.grown_map(slot_shards.load_map(spark, store), 8), store)
    old, new = (
        {r["vslot"]: r for r in slot_shards.load_map(spark, store, v).collect()} for v in (2, None)
    )
    assert len(old) == slot_shards.SLOTS and old.keys() == new.keys() and {r["version"] for r in new.values()} == {3}
    moved = [s for s in old if old[s]["shard"] != new[s]["shard"]]
    assert moved and all(new[s]["shard"] == 8 for s in moved)
    share = sum(new[s]["bytes"] for s in moved) / sum(r["bytes"] for r in new.values())
    assert 0.08 < share < 0.1112


def test_a_map_places_rows_that_it_was_not_made_from(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('b', cast(id % 90 AS int)) AS text")
    store = str(tmp_path / "map")
    early = slot_shards.slot_sizes(slot_shards.sized(docs.filter("doc_id < 1000")))
    slot_shards.save_map(slot_shards.first_map(spark, 8), store)
    slot_shards.save_map(slot_shards.rebalanced_map(slot_shards.load_map(spark, store), early, 8), store)
    later = slot_shards.sized(docs.filter("doc_id >= 1000"))
    rows = slot_shards.assign(later, slot_shards.load_map(spark, store)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1000, 3000))
    for k in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
    with pytest.raises(Exception, match="(?i)exist"):
        slot_shards.save_map(slot_shards.first_map(spark, 8), store)
    with pytest.raises(Exception, match="the map has no slot"):
        slot_shards.assign(later, slot_shards.load_map(spark, store).filter("vslot < 9")).collect()


def test_equal_rows_and_null_ids_spread_over_slots(spark):
    docs = spark.range(9000).selectExpr("cast(null AS long) AS doc_id", "'the same text' AS text")
    rows = slot_shards.sharded(docs).collect()
    assert len(rows) == 9000 and len({r["vslot"] for r in rows}) >= 8
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted({(r["shard"], r["slot"]) for r in rows})


def test_odd_rows(odd_documents, no_documents):
    rows = slot_shards.sharded(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert [r["size"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert slot_shards.sharded(no_documents).count() == 0
    found = license_scan.report(odd_documents).collect()
    assert len(found) == odd_documents.count() and {r["licenses"] for r in found} == {""}
    assert license_scan.report(no_documents).count() == 0


def test_license_rules_in_order(spark):
    bsd = [k.replace("{}", "the copyright holder") for k, v in license_scan.SENTENCES.items() if v.startswith("bsd")]
    cases = {
        "Licensed under the Apache License, Version 2.0.\nmore": "Apache-2.0",
        "x. Released under the MIT License.\nReleased under the MIT License.": "MIT",
        "Licensed under CC BY-NC 4.0. All rights reserved.": "CC-BY-NC-4.0,All-rights-reserved",
        ".\n".join(bsd) + ".": "BSD-3-Clause",
        ".\n".join(bsd[:3]) + ".": "BSD-2-Clause",
        bsd[1] + ".": "unknown",
        "nothing of the kind": "",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").selectExpr("*", "1 AS licenses")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.report(frame).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_every_sentence_and_rule_on_one_line_and_wrapped(spark):
    """Wrapped, with comment signs, in capitals, and with a name: the same identifiers; each rule's sentences give its licence."""
    by_id = {}
    for sentence, i in license_scan.SENTENCES.items():
        by_id.setdefault(i, sentence.replace("{}", "J. Doe, of Example Inc"))
    for name, i in license_scan.UNDER.items():
        by_id.setdefault(i, f"this software is licensed under the terms of the {name}")
    texts = []
    for sentence in license_scan.SENTENCES:
        full = sentence.replace("{}", "J. Doe, of Example Inc")
        texts += [(full + ".", sentence), ("\n".join(f" * {x}" for x in textwrap.wrap(full.upper(), 40, break_on_hyphens=False)) + ".", sentence), ("x " + full, None)]
    got = license_scan.report(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    for r in got:
        sentence = texts[r["doc_id"]][1]
        assert r["sentence_ids"] == (license_scan.SENTENCES[sentence] if sentence else ""), texts[r["doc_id"]]
    rules = [(k, ".\n".join(by_id[i] for i in rule) + ".") for k, (_, rule) in enumerate(license_scan.RULES)]
    got = license_scan.report(spark.createDataFrame(rules, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["licenses"]) for r in sorted(got)] == [(k, name) for k, (name, _) in enumerate(license_scan.RULES)]


APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
MIT = '''MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
GPL = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
'''


def test_wrapped_licences(spark):
    texts = {"Apache-2.0": APACHE, "MIT": MIT, "BSD-3-Clause": BSD, "GPL-3.0-or-later": GPL}
    rows = []
    for name, text in texts.items():
        for sign in ("", "# ", "// ", " * ", ";; ", "-- "):
            made = "".join((sign + line).rstrip() + "\n" for line in text.splitlines())
            rows += [(name, made), (name, made.replace("\n", "\r\n")), (name, f"code|~\n/*\n{made}*/\nmore")]
    rows.append(("", "Permission is hereby granted,\n\nfree of charge. All rights\n\nreserved"))
    rows.append(("MIT,All-rights-reserved", "Released under the MIT License\nAll rights reserved\nx"))
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.report(frame).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]


OPENINGS = {
    "GPL-3.0-only": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
""",
    "GPL-2.0-only": """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Copyright (C) 1989, 1991 Free Software Foundation, Inc.,
 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
""",
    "LGPL-2.1-only": """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 2.1, February 1999
""",
    "LGPL-3.0-only": """                   GNU LESSER GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
""",
    "AGPL-3.0-only": """                    GNU AFFERO GENERAL PUBLIC LICENSE
                       Version 3, 19 November 2007
""",
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.
""",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n",
    "EPL-2.0": "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE (\"AGREEMENT\").\n",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge,\n",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

The software is provided "as is" and the author disclaims all warranties
with regard to this software including all implied warranties of
merchantability and fitness.
""",
    "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike 4.0 International\n\n=====\n",
    "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International Public\nLicense\n",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.\n",
    "Artistic-2.0": "                       The Artistic License 2.0\n\n           Copyright (c) 2000-2006, The Perl Foundation.",
    "WTFPL": "            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n                    Version 2, December 2004\n",
}
LINES = {
    "// SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0,MIT",
    "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0-only,unknown",
    "/* SPDX-License-Identifier: (MIT AND BSD-3-Clause) */": "MIT,BSD-3-Clause",
    "This program is licensed under the MIT License.": "MIT",
    "This project is licensed under the terms of the MIT license.": "MIT",
    "The code is released under the Apache License, Version 2.0.": "Apache-2.0",
    "This library is distributed under the terms of the GNU\n# Lesser General Public License version 2.1.": "LGPL-2.1-only",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "The software is available under the Mozilla Public License 2.0.": "MPL-2.0",
    "This work is licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0\nInternational License.": "CC-BY-NC-ND-4.0",
    "This document is published under CC-BY-SA-4.0.": "CC-BY-SA-4.0",
    "The dataset is made available under the ISC license.": "ISC",
    "This program is licensed under the terms that we agree on.": "",
    "Whether it is licensed under the MIT License we do not say": "",
}


def test_openings_of_whole_licences_templates_and_expressions(spark):
    cases = [*OPENINGS.items(), *[(want, text) for text, want in LINES.items()]]
    frame = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.report(frame).collect()}
    assert {k: got[k] for k in got} == {k: want for k, (want, _) in enumerate(cases)}
