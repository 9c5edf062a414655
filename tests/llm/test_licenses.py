import re

from cases import AWKWARD, docs

from netflow_spark.llm.licenses import RULES, SENTENCES, WORDS, hint_words, scan_licenses

MIT = """The MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def scan(spark, rows):
    return {r.doc_id: r for r in scan_licenses(docs(spark, rows)).collect()}


def test_known_sentences_hold_a_hint_word():
    assert all(any(w in s for w in WORDS) for s in SENTENCES)
    assert {i for _, seq in RULES for i in seq} <= set(SENTENCES.values())


def test_sequences_and_order(spark):
    apache = "Some code.\nLicensed under the Apache License, Version 2.0.\nMore text. Released under the MIT License."
    got = scan(spark, [(1, MIT), (2, apache), (3, "Not licensed under the MIT license at all."), (4, "x\nAll rights reserved.\nLicensed under CC BY-NC 4.0."),
                       (5, "The MIT license. Released under the MIT License."), (6, "unlicensed under CC BY 4.0.")])
    assert got[1].licenses == ["MIT"] and got[1].left_over == []
    assert got[1].sentence_ids == ["mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]
    assert got[2].sentence_ids == ["apache2-name", "mit-name"] and got[2].licenses == ["MIT", "Apache-2.0"]
    assert got[3].sentence_ids == [] and got[6].licenses == []
    assert got[4].licenses == ["CC-BY-NC-4.0"] and got[4].left_over == ["reserved"]
    assert got[5].licenses == ["MIT"] and got[5].left_over == ["mit-title"]


def test_awkward_rows(spark):
    got = scan_licenses(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(r.licenses == [] and r.sentence_ids == [] for r in got)
    assert scan_licenses(docs(spark, [])).count() == 0


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program{3}
"""
GPL2 = GPL.format(";", ";", 2, "; if not, write to the Free Software Foundation, Inc.,\n51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")
GPL3 = GPL.format(":", ",", 3, ".  If not, see <https://www.gnu.org/licenses/>.")
APACHE = """Licensed under the Apache License, Version 2.0{0}
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
#: One notice per rule, in the order of the rules: text, identifiers and licence.
NOTICES = [
    (APACHE.format(' (the "License");'), RULES[0]), (APACHE.format("."), RULES[1]), (GPL3, RULES[2]), (GPL2, RULES[3]),
    ("MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + MIT_BODY, RULES[4]), (MIT_BODY, RULES[5]), (BSD3, RULES[6]), (BSD2, RULES[7]),
    (GPL3.split("\n\n")[0], RULES[8]), (GPL2.split("\n\n")[0], RULES[9]), ("This work is licensed under the GNU General Public\nLicense, version 3.", RULES[10]),
    (MIT_BODY.split("\n\n")[0], RULES[11]), ("Released under the\nMIT License.", RULES[12]), ('Licensed under the Apache License, Version 2.0\n(the "License").', RULES[13]),
    ("Licensed under the\nApache License, Version 2.0.", RULES[14]), ("Licensed under\nCC BY-NC 4.0.", RULES[15]),
    ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", RULES[16]),
    ("This work is licensed under a Creative Commons\nAttribution 4.0 International License.", RULES[17]),
    ("This is free and unencumbered software released into the public domain.", RULES[18])]


def test_every_rule_on_its_official_notice(spark):
    assert [r for _, r in NOTICES] == list(RULES)
    layouts = {"wrapped": lambda t: t, "unwrapped": lambda t: re.sub(r"(?<=\S) *\n *(?=\S)", " ", t), "dos": lambda t: t.replace("\n", "\r\n"),
               "commented": lambda t: "# " + t.replace("\n", "\n# "),
               "narrow": lambda t: re.sub(r"(?<=\S) +(?=\S)", "\n", t), "wide": lambda t: re.sub(r"(?<=\S) +(?=\S)", " \t ", t)}
    got = scan(spark, [(100 * k + i, layout(t)) for k, layout in enumerate(layouts.values()) for i, (t, _) in enumerate(NOTICES)])
    for k, name in enumerate(layouts):
        for i, (_, (license, seq)) in enumerate(NOTICES):
            r = got[100 * k + i]
            assert (name, i, r.sentence_ids, r.licenses, r.left_over) == (name, i, list(seq), [license], [])


def test_sentence_ends_and_other_words_part_known_sentences(spark):
    got = scan(spark, [(1, "All rights. Reserved."), (2, "All rights\nare\nReserved."), (3, "Not all rights\nReserved."), (4, "All rights\x02reserved"),
                       (5, "All; rights:\n\n* Reserved\nMIT License"), (6, "All rights\x01reserved")])
    assert {i: r.sentence_ids for i, r in got.items()} == {1: [], 2: [], 3: [], 4: ["reserved"], 5: ["reserved", "mit-title"], 6: []}


def test_hint_misses_no_known_sentence(spark):
    gaps = [" ", "  ", "\t", "\n", "-", " -- ", "/"]
    data = [(100 * k + i, gap.join(s.upper().split(" "))) for k, gap in enumerate(gaps) for i, s in enumerate(SENTENCES)]
    got = scan(spark, data)
    for k in range(len(gaps)):
        assert [got[100 * k + i].sentence_ids for i in range(len(SENTENCES))] == [[i] for i in SENTENCES.values()]


def test_known_sentences_of_ones_own(spark):
    known, rules = {"do what you want": "wtf", "frei f\u00fcr alle": "frei"}, (("WTF", ("wtf",)),)
    assert all(any(w in s for w in hint_words(known)) for s in known)
    got = scan_licenses(docs(spark, [(1, "Do what\nyou want."), (2, "Frei f\u00fcr alle!"), (3, "MIT License")]), known=known, rules=rules)
    assert {r.doc_id: (r.licenses, r.left_over) for r in got.collect()} == {1: (["WTF"], []), 2: ([], ["frei"]), 3: ([], [])}
    assert {r.doc_id for r in scan_licenses(docs(spark, [(1, "MIT License")]), known={}).where("size(sentence_ids) = 0").collect()} == {1}
