"""Operator 3: licence scans by sentences: known sentences get identifiers, and sequences of these match ordered rules."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import bounded_batches, documents, slices

#: Identifiers of licence sentences, each with the sentence as normalised by normal().
SENTENCES = {
    "apache2-short": "licensed under the apache license version 2 0",
    "apache2-grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl3-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "mpl2-short": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "cc-by-nc-short": "licensed under cc by nc 4 0",
    "cc-by-short": "licensed under cc by 4 0",
    "cc-by-sa-short": "licensed under cc by sa 4 0",
    "reserved": "all rights reserved",
    "lgpl2.1-grant": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl3-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
    "unlicense-free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}

#: Sentences in which * stands for 1 to SLOT words, as the name of who grants the licence.
TEMPLATES = {
    "bsd-endorse": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "mit-liability": "in no event shall * be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-liability": "in no event shall * be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
}
SLOT = 20

#: Rules in order of precedence, as (rule, licence, sentence identifiers in order).
RULES = [
    ("apache-2.0-header", "Apache-2.0", ("apache2-grant", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "as-is", "mit-liability")),
    ("bsd-3-full", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("bsd-2-full", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("isc-full", "ISC", ("isc-grant", "isc-as-is", "isc-liability")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ("lgpl2.1-grant", "lgpl-warranty", "lgpl-see")),
    ("lgpl-3-header", "LGPL-3.0-or-later", ("lgpl3-grant", "gpl-warranty", "lgpl-see")),
    ("agpl-3-header", "AGPL-3.0-or-later", ("agpl3-grant", "gpl-warranty", "agpl-see")),
    ("unlicense-text", "Unlicense", ("unlicense-grant", "unlicense-free")),
    ("zlib-text", "Zlib", ("zlib-as-is", "zlib-grant")),
    ("bsd-3-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd-2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("gpl-3-header", "GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty", "gpl-see")),
    ("gpl-2-header", "GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty", "gpl-see")),
    ("mpl-2.0-header", "MPL-2.0", ("mpl2-short", "mpl2-copy")),
    ("apache-2.0-grant", "Apache-2.0", ("apache2-grant",)),
    ("apache-2.0-short", "Apache-2.0", ("apache2-short",)),
    ("mit-grant", "MIT", ("mit-grant",)),
    ("mit-short", "MIT", ("mit-short",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("gpl-3-grant", "GPL-3.0-or-later", ("gpl3-grant",)),
    ("gpl-2-grant", "GPL-2.0-or-later", ("gpl2-grant",)),
    ("lgpl-2.1-grant", "LGPL-2.1-or-later", ("lgpl2.1-grant",)),
    ("lgpl-3-grant", "LGPL-3.0-or-later", ("lgpl3-grant",)),
    ("agpl-3-grant", "AGPL-3.0-or-later", ("agpl3-grant",)),
    ("unlicense-grant", "Unlicense", ("unlicense-grant",)),
    ("boost-grant", "BSL-1.0", ("boost-grant",)),
    ("zlib-grant", "Zlib", ("zlib-grant",)),
    ("gpl-3-short", "GPL-3.0-only", ("gpl3-short",)),
    ("mpl-2.0-short", "MPL-2.0", ("mpl2-short",)),
    ("cc-by-nc-short", "CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("cc-by-sa-short", "CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("cc-by-short", "CC-BY-4.0", ("cc-by-short",)),
    ("reserved", "LicenseRef-all-rights-reserved", ("reserved",)),
]

def _version(number: str) -> str:
    """2.1 as it stands after a name: version 2 1, v2 1, v 2 1 or 2 1; a last 0 may be left out."""
    whole = number.replace(".", " ")
    short = f"(?: {whole[2:]})?" if whole.endswith(" 0") else whole[1:]
    return f"(?:version |v ?)?{whole[0]}{short}"


_LICENSE = "licen[cs]e"
_GNU = {"gpl": "(?:gnu )?(?:general public LICENSE|gpl)", "lgpl": "(?:gnu )?(?:(?:lesser|library) general public LICENSE|lgpl)", "agpl": "(?:gnu )?(?:affero general public LICENSE|agpl)"}
_CC = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s"}


def _names() -> list[tuple[str, str, str]]:
    """(sentence identifier, licence, pattern of its normalised names). Those of SENTENCES keep their identifiers."""
    out = [
        ("apache2-short", "Apache-2.0", f"(?:apache(?: software)? LICENSE {_version('2.0')}|apache {_version('2.0')}(?: LICENSE)?|asl {_version('2.0')})"),
        ("apache1.1-short", "Apache-1.1", "(?:apache(?: software)? LICENSE (?:version |v ?)?1 1|apache 1 1(?: LICENSE)?)"),
        ("mit-short", "MIT", "(?:(?:mit|expat|mit x11|mit expat)(?: (?:open source )?(?:software )?LICENSE)?)"),
        ("bsd3-short", "BSD-3-Clause", "(?:(?:new|modified|revised|(?:3|three) clause) bsd(?: LICENSE)?|bsd (?:3|three) clause(?: (?:new|revised|new or revised))?(?: LICENSE)?)"),
        ("bsd2-short", "BSD-2-Clause", "(?:(?:simplified|(?:2|two) clause) bsd(?: LICENSE)?|freebsd LICENSE|bsd (?:2|two) clause(?: simplified)?(?: LICENSE)?)"),
        ("bsd-short", "LicenseRef-BSD", "bsd(?: style)?(?: LICENSE)?"),
        ("isc-short", "ISC", "isc(?: LICENSE)?"),
        ("mpl2-licensed", "MPL-2.0", f"(?:mozilla public LICENSE|mpl) {_version('2.0')}"),
        ("mpl1.1-licensed", "MPL-1.1", f"(?:mozilla public LICENSE|mpl) {_version('1.1')}"),
        ("epl2-short", "EPL-2.0", f"(?:eclipse public LICENSE|epl) {_version('2.0')}"),
        ("epl1-short", "EPL-1.0", f"(?:eclipse public LICENSE|epl) {_version('1.0')}"),
        ("eupl1.2-short", "EUPL-1.2", f"(?:european union public LICENSE|eupl) {_version('1.2')}"),
        ("boost-short", "BSL-1.0", f"boost software LICENSE(?: {_version('1.0')})?"),
        ("artistic2-short", "Artistic-2.0", f"artistic LICENSE {_version('2.0')}"),
        ("ofl-short", "OFL-1.1", f"(?:sil )?open font LICENSE(?: {_version('1.1')})?"),
        ("zlib-short", "Zlib", "zlib(?: LICENSE)?"),
        ("unlicense-short", "Unlicense", "unlicen[cs]e"),
        ("wtfpl-short", "WTFPL", "(?:wtfpl|do what the fuck you want to public LICENSE)"),
        ("cc0-short", "CC0-1.0", "(?:(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: (?:public domain dedication|LICENSE))?|creative commons zero(?: v?1 0)?(?: universal)?(?: LICENSE)?)"),
    ]
    later = "(?: (?:as published by the free software foundation )?(?:either )?{})(?: of the LICENSE)? (?:or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?|and later(?: versions?)?)"
    for kind, name in _GNU.items():
        for number in {"gpl": ("2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("3.0",)}[kind]:
            version, mark = _version(number), kind + (number[0] if number.endswith(".0") else number)
            joined = f"{kind}v?{number[0]}" + ("(?: 0)?" if number.endswith(".0") else f" {number[2]}")
            full = f"(?:{name}(?: LICENSE)? {version}|{joined}|gnu {joined})"
            after = later.format(version)
            out.append((f"{mark}-later", f"{kind.upper()}-{number}-or-later", f"(?:{name}(?: LICENSE)?{after}|(?:gnu )?{joined} (?:or (?:any )?later(?: versions?)?|plus))(?: LICENSE)?"))
            out.append((f"{mark}-short", f"{kind.upper()}-{number}-only", f"{full}(?: LICENSE)?(?: only)?"))
        out.append((f"{kind}-short", f"{kind.upper()}-{'1.0' if kind != 'lgpl' else '2.0'}-or-later", name))
    for kind, name in _CC.items():
        for number in ("4.0", "3.0", "2.5", "2.0", "1.0"):
            spaced, version = kind.replace("-", " "), number.replace(".", " ")
            made = "" if number == "4.0" else number
            out.append((f"cc-{kind}{made}-short", f"CC-{kind.upper()}-{number}", f"(?:a )?(?:(?:creative commons |cc )(?:{name}|{spaced})|cc{spaced})(?: LICENSE)? (?:version |v ?)?{version}(?: (?:international|unported|generic))?(?: (?:public )?LICENSE)?"))
    return [(id_, licence, pattern.replace("LICENSE", _LICENSE)) for id_, licence, pattern in out]


_NAMES = _names()
#: Short forms of these licences, whose other wordings get the same identifier (see _variant).
SENTENCES |= {id_: "licensed under " + (licence.lower().replace("-", " ").replace(".", " ") if id_[:-6] not in _GNU else f"the {id_[:-6]}") for id_, licence, _ in _NAMES if id_ not in SENTENCES}
RULES += [(id_, licence, (id_,)) for id_, licence, _ in _NAMES if not any(r[2] == (id_,) for r in RULES)]
SENTENCES |= {"public-domain": "released into the public domain without rights reserved"}
RULES.append(("public-domain", "LicenseRef-public-domain", ("public-domain",)))

#: Words of the subject of a licence sentence; "not" and the like are none of them, so a denial is no licence.
_SUBJECT = "this|these|the|all|any|our|its|it|that|of|in|and|for|with|from|by|source|code|sources|file|files|project|software|program|programme|work|works|library|package|repository|repo|document|documentation|docs|data|dataset|database|content|contents|text|article|material|materials|module|script|scripts|product|book|page|site|website|app|application|tool|tools|model|models|image|images|font|fonts|paper|plugin|extension|framework|component|crate|gem|distribution|release|is|are|has|been|have|was|were|hereby|also|free|open|dual|everything|except|otherwise|where|unless|noted"
_VERB = "(?:licen[cs]ed|released|distributed|available|made available|provided|published|offered|shared|redistributed|covered|redistributable|usable|open sourced|dual licen[cs]ed)"
_LEAD = (
    rf"(?:(?:(?:{_SUBJECT}) ){{1,12}})?(?:{_VERB}(?: (?:and|or) {_VERB})?(?: to you)?(?: freely)? (?:under|by)|(?:is |are )?subject to|licen[cs]e(?:d as)?|under) (?:(?:the |a )?(?:terms(?: and conditions)?|conditions) of )?(?:version (?P<early>\d(?: \d)?) of )?(?:the )?"
)
_VARIANT = re.compile(_LEAD + "(?P<name>.+)")
_DOMAIN = re.compile(rf"(?:(?:(?:{_SUBJECT}) ){{1,12}})?(?:(?:released|placed|dedicated|put) (?:in|into|to) |in )the public domain")
_NAME = [(id_, re.compile(pattern)) for id_, _, pattern in _NAMES]
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_SPDX_ID = re.compile(r"[A-Za-z][A-Za-z0-9.+:-]*[A-Za-z0-9+]|[A-Za-z]")


def _variant(sentence: str) -> str | None:
    """Identifier of a normalised short form: an optional subject, a verb, and the licence by one of its names."""
    m = _VARIANT.fullmatch(sentence)
    if m:
        name = m["name"] if m["early"] is None else f"{m['name']} {m['early']}"
        name = name.removesuffix(" as published by the free software foundation") if m["early"] is None else name.replace(" as published by the free software foundation", "")
        return next((id_ for id_, pattern in _NAME if pattern.fullmatch(name)), None)
    return "public-domain" if _DOMAIN.fullmatch(sentence) else None


def _spdx(line: str) -> list[str]:
    """Licences that an SPDX line names, in order, each once; what follows WITH is an exception and no licence."""
    out, skip = [], False
    for word in _SPDX_ID.findall(line):
        if word in ("AND", "OR", "WITH", "and", "or", "with"):
            skip = word.upper() == "WITH"
        elif skip:
            skip = False
        elif word not in out:
            out.append(word)
    return out


#: Every known sentence holds one of these or a verb before "under", so texts and spans without any are passed over.
TRIGGERS = ("licen", "permi", "rights", "warrant", "redistribut", "copyright", "liab", "mpl", "endorse", "gpl", "spdx", "public domain", "creative commons", "cc0", "cc by", "cc-by", "commercial")
_UNDER = re.compile(r"(?:released|distributed|available|provided|published|offered|shared|covered|subject)[\s#*/;-]+(?:under|by|to)\b|public[\s#*/;-]+domain|creative[\s#*/;-]+commons")
#: Words of which each match of _UNDER has one.
_HINTS = ("released", "distributed", "available", "provided", "published", "offered", "shared", "covered", "subject", "domain", "commons")

#: Unknown sentences that may stand between two of a rule's.
GAP = 2

_ENDS = re.compile(r"(?<=[.!?;:])\s+|\n[ \t\r]*\n")
_LINES = re.compile(r"\n")
_OTHER = re.compile(r"[^0-9a-z]+")
_MARKS = re.compile(r"(?m)^[ \t]*(?:#+|//+|/?\*+|--+|;+|\d+[.)])[ \t]?")


def normal(sentence: str) -> str:
    """Lower-cased; anything but a-z and 0-9 is one space."""
    return _OTHER.sub(" ", sentence.lower()).strip()


_IDS = {text: id_ for id_, text in SENTENCES.items()}
#: Templates by the words before their slot.
_SLOTTED = [(text.split(" *")[0] + " ", id_, re.compile(text.replace("*", rf"(?:[0-9a-z]+ ){{0,{SLOT - 1}}}[0-9a-z]+"))) for id_, text in TEMPLATES.items()]
#: Words of the longest known sentence, and of the longest short form: spans with more can't be one.
_LONGEST = max(len(x.split()) for x in [*_IDS, *TEMPLATES.values()]) + SLOT
_SHORT = 80
#: Words that a known sentence starts with.
_FIRST = {x.split()[0] for x in [*_IDS, *TEMPLATES.values()]} | set(_SUBJECT.split("|")) | set("licensed licenced released distributed available made provided published offered shared redistributed covered redistributable usable open dual subject license licence under placed dedicated put in".split())
_BY_FIRST = {w: [x for x in _IDS if x.split()[0] == w] for w in _FIRST}
_START = re.compile(f"{_LEAD}|{_DOMAIN.pattern}")
_WORD = re.compile(r"[0-9a-z]+")
_TOKEN = re.compile(r"[0-9A-Za-z]+")
_DENIALS = {"not", "never", "no", "nor", "t", "without"}


class _Words:
    """The words of a text, so that spans are compared by words, however wide the marks and blanks between them are."""

    def __init__(self, text: str):
        found = list(_TOKEN.finditer(text))
        self.starts = [m.start() for m in found]
        self.words = [m[0].lower() for m in found]

    def at(self, place: int) -> int:
        """Number of the first word that starts at a place or after it."""
        return bisect.bisect_left(self.starts, place)

    def known(self, first: int, last: int) -> str | None:
        """Identifier of words[first:last] as a sentence."""
        if last - first > _LONGEST:
            return None
        sentence = " ".join(self.words[first:last])
        if id_ := _IDS.get(sentence):
            return id_
        for lead, slotted, pattern in _SLOTTED:
            if sentence.startswith(lead) and pattern.fullmatch(sentence):
                return slotted
        return _variant(sentence) if last - first <= _SHORT else None


def _triggered(text: str) -> bool:
    low = text.lower()
    return any(t in low for t in TRIGGERS) or (any(h in low for h in _HINTS) and _UNDER.search(low) is not None)


def _spans(text: str, ends: re.Pattern):
    start = 0
    for m in ends.finditer(text):
        yield start, m.start()
        start = m.end()
    yield start, len(text)


def known_sentences(text: str) -> tuple[list[tuple[int, int, str]], int]:
    """(start, ordinal, identifier) of the licence sentences of a whole text in order, and the number of its sentences.

    Sentences end at stops, question and exclamation marks, colons and semicolons before white space, and at blank
    lines, comment marks and list numbers at line starts counting as blanks. A licence sentence with one of these marks
    inside is also sought over up to three neighbouring spans. It may also start at any line start, and run on over
    following lines up to the end of one or of a sentence, unless a denial stands right before it. An SPDX line gives
    'spdx:' and its licence for each that it names.
    """
    if not _triggered(text):
        return [], 0
    text = _MARKS.sub(lambda m: " " * len(m[0]), text)
    spans = list(_spans(text, _ENDS))
    starts = [a for a, _ in spans]
    found: dict[int, tuple[int, int, str]] = {}
    covered: dict[int, int] = {}
    for m in _SPDX.finditer(text):
        for i, id_ in enumerate(_spdx(m[1])):
            found[m.start() + i] = (m.start() + i, _last(starts, m.start()), f"spdx:{id_}")
            covered[m.start()] = m.end()
    words = _Words(text)
    hot = [_triggered(text[a:b]) for a, b in spans]
    bounds = [(words.at(a), words.at(b)) for a, b in spans]
    i = 0
    while i < len(spans):
        step = 1
        if any(hot[i : i + 3]) and spans[i][0] not in covered:
            for n in (3, 2, 1):
                if i + n <= len(spans) and any(hot[i : i + n]) and (id_ := words.known(bounds[i][0], bounds[i + n - 1][1])):
                    found[spans[i][0]] = (spans[i][0], i, id_)
                    covered[spans[i][0]] = spans[i + n - 1][1]
                    step = n
                    break
        i += step
    lines = list(_spans(text, _LINES))
    ends = sorted({b for _, b in lines} | {b for _, b in spans})
    last_words = [words.at(b) for b in ends]
    taken, upto = sorted(covered), -1
    for a, b in lines:
        owner = _last(taken, a)
        if a < upto or (owner >= 0 and a < covered[taken[owner]]):
            continue
        first = words.at(a)
        if first == words.at(b) or words.words[first] not in _FIRST:
            continue
        k = _last(starts, a)
        if first > words.at(starts[k]) and words.words[first - 1] in _DENIALS:
            continue
        ahead = " ".join(words.words[first : first + _LONGEST])
        whole = any(map(ahead.startswith, _BY_FIRST[words.words[first]])) or any(ahead.startswith(lead) for lead, _, _ in _SLOTTED)
        most = _LONGEST if whole else _SHORT if _START.match(ahead) else 0
        low, high = bisect.bisect_right(ends, a), bisect.bisect_right(last_words, first + most)
        # of ends after the same word the first one
        for j in sorted({last_words[j]: j for j in range(high - 1, low - 1, -1)}.values(), reverse=True) if most else ():
            if id_ := words.known(first, last_words[j]):
                # a sentence that was found by itself and starts further on is part of this longer one
                for x in [x for x in found if a <= x < ends[j]]:
                    del found[x]
                found[a] = (a, k, id_)
                upto = ends[j]
                break
    return sorted(found.values()), len(spans)


def _last(ordered: list[int], at: int) -> int:
    return bisect.bisect_right(ordered, at) - 1


def match_rules(sentences: list[tuple[int, int, str]], gap: int = GAP) -> list[tuple[str, str, int]]:
    """(rule, licence, start) of matches in order. At each sentence the first rule that fits is taken, and its sentences
    are used up; a rule's sentences stand in order with at most `gap` sentences between two of them."""
    out, i = [], 0
    while i < len(sentences):
        if sentences[i][2].startswith("spdx:"):
            out.append(("spdx-identifier", sentences[i][2].removeprefix("spdx:"), sentences[i][0]))
            i += 1
            continue
        for rule, licence, ids in RULES:
            part = sentences[i : i + len(ids)]
            if tuple(x[2] for x in part) == ids and all(b[1] - a[1] <= gap + 1 for a, b in zip(part, part[1:], strict=False)):
                out.append((rule, licence, sentences[i][0]))
                i += len(ids)
                break
        else:
            i += 1
    return out


SCHEMA = "doc_id long, licenses array<string>, rules array<string>, starts array<long>, sentences array<string>, n_matches long"


def _scan(batches):
    for batch in batches:
        for part, _ in slices(batch):
            rows = []
            for text in part.column("text").to_pylist():
                sentences, _ = known_sentences(text or "")
                matches = match_rules(sentences)
                rows.append((sorted({m[1] for m in matches}), [m[0] for m in matches], [m[2] for m in matches], [s[2] for s in sentences], len(matches)))
            kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], [c.split()[0] for c in SCHEMA.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """Licences (ascending, each once), rules and their starts (code points) in order, and licence sentences of each text.

    Whole texts are read. Null and empty texts, and texts without a licence sentence, have empty lists. Every row of
    docs (doc_id long, text) gives one.
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that each document names. Null and empty texts name none; repeated rows are scanned each."""
    return scan(documents(spark, sf_dir))
