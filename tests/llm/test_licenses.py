import random

from weftline.llm import licenses as lc

APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def found(text):
    return [m[:2] for m in lc.match_rules(lc.known_sentences(text)[0])]


def test_sentences_are_normal_and_have_a_trigger():
    for id_, text in lc.SENTENCES.items():
        assert lc.normal(text) == text and any(t in text for t in lc.TRIGGERS), id_
    assert len(set(lc.SENTENCES.values())) == len(lc.SENTENCES)
    assert all(lc.normal(t) == t.replace(" * ", " ") and any(x in t for x in lc.TRIGGERS) for t in lc.TEMPLATES.values())
    assert {s for _, _, ids in lc.RULES for s in ids} <= {*lc.SENTENCES, *lc.TEMPLATES}


def test_texts():
    assert found(GPL) == [("gpl-3-header", "GPL-3.0-or-later")]
    assert found("Intro without a stop\nReleased under the MIT License.\nmore words") == [("mit-short", "MIT")]
    assert found("Some text. Licensed under CC BY-NC 4.0. All rights reserved.") == [("cc-by-nc-short", "CC-BY-NC-4.0"), ("reserved", "LicenseRef-all-rights-reserved")]
    assert found("This work is licensed under the GNU General Public License, version 3.") == [("gpl-3-short", "GPL-3.0-only")]
    assert found("We talked about the MIT License and all its rights reserved for them. It is not released under the MIT License.") == []
    assert found("") == [] and found("\n\n.") == []


def licences(text):
    return [m[1] for m in lc.match_rules(lc.known_sentences(text)[0])]


def test_wordings_of_one_licence():
    for text, licence in {
        "This file is licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Distributed under the Apache 2.0 license.": "Apache-2.0",
        "This project is licensed under the MIT License.": "MIT",
        "The source code of this library is released under the terms of the MIT license": "MIT",
        "License: MIT": "MIT",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-only",
        "This program is distributed under the GPLv3.": "GPL-3.0-only",
        "Licensed under the GNU GPL v2 or later.": "GPL-2.0-or-later",
        "This software is available under the terms of version 3 of the GNU General Public License.": "GPL-3.0-only",
        "Licensed under the GNU Lesser General Public License, version 2.1 or (at your option) any later version.": "LGPL-2.1-or-later",
        "Released under the GNU Lesser General Public License v3.0": "LGPL-3.0-only",
        "Licensed under AGPL-3.0-or-later.": "AGPL-3.0-or-later",
        "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
        "This package is published under the Simplified BSD License.": "BSD-2-Clause",
        "Released under the Mozilla Public License 2.0.": "MPL-2.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "Licensed under CC BY 3.0.": "CC-BY-3.0",
        "Released under CC0 1.0 Universal.": "CC0-1.0",
        "This work is released into the public domain.": "LicenseRef-public-domain",
    }.items():
        assert licences(text) == licences(f"Words before.\n{text}\nMore words") == [licence], text


def test_sentences_that_start_at_a_line_and_run_on():
    assert licences("Intro without a stop\nThis file is licensed under the Apache License,\nVersion 2.0.\nmore") == ["Apache-2.0"]
    assert licences("# A tool\n# Released\n# under the MIT License\nimport x") == ["MIT"]
    assert licences("A program\n" + GPL) == ["GPL-3.0-or-later"]
    assert licences("Our text is not\nreleased under the MIT License.") == []
    assert licences("This file is not licensed under the Apache License, Version 2.0.") == []


def test_spdx_lines():
    assert licences("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\ncode") == ["MIT", "Apache-2.0", "GPL-2.0-only"]
    assert licences("/* SPDX-License-Identifier: LGPL-2.1-or-later */\n") == ["LGPL-2.1-or-later"]


def test_a_header_of_several_sentences():
    assert [r for r, _ in found(APACHE)] == ["apache-2.0-header"]


def test_order_and_gaps():
    s = lambda *x: [(10 * i, i, id_) for i, id_ in x]
    bsd = ("bsd-grant", "bsd-source", "bsd-binary")
    assert [m[0] for m in lc.match_rules(s(*enumerate(bsd)))] == ["bsd-2-text"]
    assert [m[0] for m in lc.match_rules(s(*enumerate((*bsd, "bsd-endorse"))))] == ["bsd-3-text"]
    assert lc.match_rules(s(*enumerate(reversed(bsd)))) == []
    assert [m[0] for m in lc.match_rules(s((0, "bsd-grant"), (3, "bsd-source"), (6, "bsd-binary")))] == ["bsd-2-text"]
    assert lc.match_rules(s((0, "bsd-grant"), (4, "bsd-source"), (5, "bsd-binary"))) == []


def slow(text):
    """known_sentences without any of its shortcuts: every span and every run from a line start to any end is compared."""
    text = lc._MARKS.sub(lambda m: " " * len(m[0]), text)
    known = lambda a, b: lc._IDS.get(lc.normal(text[a:b])) or next((i for _, i, p in lc._SLOTTED if p.fullmatch(lc.normal(text[a:b]))), None) or lc._variant(lc.normal(text[a:b]))
    spans, lines = list(lc._spans(text, lc._ENDS)), list(lc._spans(text, lc._LINES))
    found, covered, i = {}, [], 0
    for m in lc._SPDX.finditer(text):
        for j, name in enumerate(lc._spdx(m[1])):
            found[m.start() + j] = f"spdx:{name}"
            covered.append((m.start(), m.end()))
    marked = {a for a, _ in covered}
    while i < len(spans):
        for n in (3, 2, 1):
            if i + n <= len(spans) and spans[i][0] not in marked and (id_ := known(spans[i][0], spans[i + n - 1][1])):
                found[spans[i][0]] = id_
                covered.append((spans[i][0], spans[i + n - 1][1]))
                i += n - 1
                break
        i += 1
    upto = -1
    for a, b in lines:
        if a < upto or any(x <= a < y for x, y in covered) or not lc.normal(text[a:b]):
            continue
        before = lc.normal(text[max(x for x, _ in spans if x <= a) : a]).split()
        if before and before[-1] in lc._DENIALS:
            continue
        for end in sorted({e for _, e in lines + spans if e > a}, reverse=True):
            if id_ := known(a, end):
                for x in [x for x in found if a <= x < end]:
                    del found[x]
                found[a], upto = id_, end
                break
    return [found[x] for x in sorted(found)]


def test_against_a_scan_without_shortcuts():
    rng = random.Random(3)
    pieces = [*lc.SENTENCES.values(), *(t.replace("*", w) for t in lc.TEMPLATES.values() for w in ("the regents", "ACME, Inc", " ".join(["word"] * 25)))]
    pieces += ["Licensed under the Apache License, Version 2.0", "This project is licensed under the\nMIT License", "SPDX-License-Identifier: MIT OR Zlib", "not", "Some words; and more: x", "we never", "License", "GNU GPL v3 or later", "released under\n    the MIT license", "1) item", "all rights"]
    for _ in range(400):
        text = ""
        for piece in rng.choices(pieces, k=rng.randint(1, 6)):
            if rng.random() < 0.5:  # as a comment with wide indents, a few words to a line
                words, piece = piece.split(" "), ""
                for i in range(0, len(words), n := rng.randint(2, 9)):
                    piece += "\n" + rng.choice(["# ", " * ", "//", " " * 3000, ""]) + " ".join(words[i : i + n])
            text += piece + rng.choice([". ", ".\n", "\n", "; ", "\n\n", " "])
        assert [x[2] for x in lc.known_sentences(text)[0]] == slow(text), text


def test_full_texts_with_any_holder_and_layout():
    holder = "the Regents of the University of Somewhere and others"
    bsd = [lc.SENTENCES["bsd-grant"], lc.SENTENCES["bsd-source"], lc.SENTENCES["bsd-binary"], *(lc.TEMPLATES[x].replace("*", holder) for x in ("bsd-endorse", "bsd-as-is", "bsd-liability"))]
    wide = (".\n" + " " * 5000 + "*").join(x.replace(" ", " \t" * 40) for x in bsd)
    assert found(". ".join(bsd)) == found(wide) == [("bsd-3-full", "BSD-3-Clause")]
    assert found(". ".join(bsd[:3] + bsd[4:])) == [("bsd-2-full", "BSD-2-Clause")]
    lgpl = GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1").replace("This program", "This library")
    assert found(lgpl) == [("lgpl-2.1-header", "LGPL-2.1-or-later")] and found(GPL.replace("GNU General", "GNU Affero General")) == [("agpl-3-header", "AGPL-3.0-or-later")]
    too_long = lc.TEMPLATES["bsd-endorse"].replace("*", " ".join(["w"] * (lc.SLOT + 1)))
    assert found(too_long) == []


def test_table(spark):
    rows = [(1, "a. Released under the MIT License."), (None, GPL), (2, None), (2, ""), (3, "word " * 100_000 + ".\nAll rights reserved.\n"), (1, "a. Released under the MIT License.")]
    out = lc.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.licenses, r.n_matches) for r in out) == [
        ("1", ["MIT"], 1), ("1", ["MIT"], 1), ("2", [], 0), ("2", [], 0), ("3", ["LicenseRef-all-rights-reserved"], 1), ("None", ["GPL-3.0-or-later"], 1)]
    assert [r.starts for r in out if r.doc_id == 1][0] == [3]
    assert lc.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
