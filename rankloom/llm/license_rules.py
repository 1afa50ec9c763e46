"""Signature rules of the license scan.

A rule is (label, priority, keyword, pattern, confidence). Patterns run over the
lower-case words of a text joined by single blanks, so they need not care for
punctuation, case or line breaks. The keyword is a literal that every match
contains. A lower priority number wins where detections overlap.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern
    confidence: float


#: Phrases that every scan reports, with the labels they give.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label stem, versions, keyword, pattern of the name; {v} is the version)
_FAMILIES = [
    ("apache", "1.0 1.1 2.0", "apache", r"apache (?:software )?license (?:version |v )?{v}"),
    ("gpl", "1.0 2.0 3.0", "general public license", r"(?<!lesser )(?<!library )(?<!affero )general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?){v}"),
    ("gpl", "1.0 2.0 3.0", "gpl", r"gpl ?(?:version |v ?){v}"),
    ("lgpl", "2.0 2.1 3.0", "general public license", r"(?:lesser|library) general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?){v}"),
    ("lgpl", "2.0 2.1 3.0", "lgpl", r"lgpl ?(?:version |v ?){v}"),
    ("agpl", "1.0 3.0", "affero", r"affero general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?){v}"),
    ("agpl", "1.0 3.0", "agpl", r"agpl ?(?:version |v ?){v}"),
    ("gfdl", "1.1 1.2 1.3", "free documentation license", r"free documentation license (?:version |v ?){v}"),
    ("mpl", "1.0 1.1 2.0", "mozilla public", r"mozilla public license (?:version |v ?)?{v}"),
    ("mpl", "1.0 1.1 2.0", "mpl", r"mpl ?(?:version |v ?)?{v}"),
    ("epl", "1.0 2.0", "eclipse public", r"eclipse public license (?:version |v ?)?{v}"),
    ("cddl", "1.0 1.1", "common development", r"common development and distribution license (?:version |v ?)?{v}"),
    ("eupl", "1.0 1.1 1.2", "european union public", r"european union public licen[cs]e (?:version |v ?)?{v}"),
    ("artistic", "1.0 2.0", "artistic", r"artistic license (?:version |v ?)?{v}"),
    ("osl", "1.0 2.0 2.1 3.0", "open software license", r"open software license (?:version |v ?)?{v}"),
    ("afl", "1.1 2.0 2.1 3.0", "academic free", r"academic free license (?:version |v ?)?{v}"),
    ("cecill", "1.0 2.0 2.1", "cecill", r"cecill (?:free software license agreement )?(?:version |v ?)?{v}"),
    ("ofl", "1.0 1.1", "open font", r"(?:sil )?open font license (?:version |v ?)?{v}"),
    ("lppl", "1.0 1.1 1.2 1.3", "latex project", r"latex project public license (?:version |v ?)?{v}"),
    ("zpl", "1.1 2.0 2.1", "zope public", r"zope public license (?:version |v ?)?{v}"),
    ("odbl", "1.0", "open database", r"open database license (?:version |v ?)?{v}"),
    ("odc-by", "1.0", "open data commons", r"open data commons attribution license (?:version |v ?)?{v}"),
    ("cpl", "1.0", "common public", r"common public license (?:version |v ?)?{v}"),
    ("ncsa", "1.0", "ncsa", r"university of illinois ncsa open source license(?: v ?{v})?"),
    ("upl", "1.0", "universal permissive", r"universal permissive license (?:version |v ?)?{v}"),
    ("bsl", "1.0", "boost software", r"boost software license (?:version |v ?)?{v}"),
    ("ecl", "1.0 2.0", "educational community", r"educational community license (?:version |v ?)?{v}"),
    ("rpl", "1.1 1.5", "reciprocal public", r"reciprocal public license (?:version |v ?)?{v}"),
    ("spl", "1.0", "sun public", r"sun public license (?:version |v ?)?{v}"),
    ("cpal", "1.0", "common public attribution", r"common public attribution license (?:version |v ?)?{v}"),
    ("sspl", "1.0", "server side public", r"server side public license (?:version |v ?)?{v}"),
    ("busl", "1.1", "business source", r"business source license (?:version |v ?)?{v}"),
    ("elastic", "2.0", "elastic license", r"elastic license (?:version |v ?)?{v}"),
    ("cc0", "1.0", "cc0", r"cc0 (?:universal )?(?:version |v ?)?{v}"),
]

_TERMS = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
_TERM_NAMES = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(?:ative)?s?",
    "by nc": "attribution non ?commercial",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
_CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

#: (label, keyword, pattern, confidence): names without a version, and sentences of license texts.
_SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "mit license", r"(?:the )?mit license", 0.85),
    ("mit", "mit licence", r"(?:the )?mit licence", 0.85),
    ("mit", "expat license", r"expat license", 0.8),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("isc", "isc license", r"isc license", 0.85),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd-2-clause", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd license)", 0.9),
    ("bsd-3-clause", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)", 0.9),
    ("bsd-4-clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)", 0.9),
    ("bsd-0-clause", "bsd", r"(?:0bsd|(?:zero|0) clause bsd|bsd (?:zero|0) clause)", 0.9),
    ("bsd", "bsd license", r"bsd license", 0.7),
    ("bsd", "bsd style", r"bsd style license", 0.7),
    ("bsd-3-clause", "endorse or promote", r"neither the name of .{1,80}? may be used to endorse or promote products", 0.85),
    ("apache", "apache license", r"apache license", 0.7),
    ("apache-2.0", "licensed under the apache", r"licensed under the apache license version 2 0 the license", 0.95),
    ("gpl", "gpl", r"(?:gnu gpl|gpl license|under the gpl)", 0.7),
    ("gpl-or-later", "any later version", r"either version \d of the license or at your option any later version", 0.9),
    ("gpl", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation", 0.9),
    ("gpl", "copyleft", r"copyleft", 0.5),
    ("lgpl", "lesser general public", r"lesser general public license", 0.8),
    ("lgpl", "library general public", r"library general public license", 0.8),
    ("lgpl", "lgpl", r"lgpl", 0.6),
    ("agpl", "affero", r"affero general public license", 0.8),
    ("agpl", "agpl", r"agpl", 0.6),
    ("gfdl", "free documentation license", r"free documentation license", 0.8),
    ("gfdl", "gfdl", r"gfdl", 0.7),
    ("mpl", "mozilla public", r"mozilla public license", 0.75),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0.95),
    ("epl", "eclipse public", r"eclipse public license", 0.75),
    ("cddl", "cddl", r"cddl", 0.7),
    ("eupl", "eupl", r"eupl", 0.7),
    ("zlib", "zlib license", r"zlib license", 0.85),
    ("zlib", "as is without any express", r"this software is provided as is without any express or implied warranty in no event", 0.85),
    ("bsl-1.0", "boost software", r"boost software license", 0.8),
    ("unlicense", "unlicense", r"unlicense", 0.8),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain", 0.95),
    ("wtfpl", "wtfpl", r"wtfpl", 0.85),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public license", 0.95),
    ("psf", "python software foundation", r"python software foundation license", 0.9),
    ("openssl", "openssl", r"openssl license", 0.85),
    ("ruby", "ruby license", r"ruby license", 0.7),
    ("php", "php license", r"php license", 0.8),
    ("artistic", "artistic license", r"artistic license", 0.7),
    ("ofl", "open font license", r"open font license", 0.8),
    ("ms-pl", "microsoft public", r"microsoft public license", 0.85),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license", 0.85),
    ("beerware", "beer ware", r"(?:the )?beer ware license", 0.85),
    ("json", "shall be used for good", r"the software shall be used for good not evil", 0.95),
    ("curl", "curl license", r"curl license", 0.8),
    ("cc0", "cc0", r"cc0", 0.8),
    ("cc0", "creative commons zero", r"creative commons zero", 0.85),
    ("cc", "creative commons", r"creative commons (?:licen[cs]e|legal code)", 0.6),
    ("cc", "creativecommons", r"creativecommons org licenses", 0.7),
    ("cc0", "publicdomain", r"creativecommons org publicdomain zero", 0.9),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", 0.7),
    ("public-domain", "public domain", r"dedicated to the public domain", 0.8),
    ("public-domain", "no rights reserved", r"no rights reserved", 0.8),
    ("pddl", "public domain dedication", r"public domain dedication and licen[cs]e", 0.85),
    ("odbl", "open database", r"open database license", 0.8),
    ("odbl", "odbl", r"odbl", 0.7),
    ("ogl", "open government", r"open government licen[cs]e", 0.8),
    ("ogl", "crown copyright", r"crown copyright", 0.7),
    ("cecill", "cecill", r"cecill", 0.6),
    ("etalab", "licence ouverte", r"licence ouverte(?: etalab)?", 0.7),
    ("etalab", "etalab", r"etalab", 0.7),
    ("dl-de", "datenlizenz deutschland", r"datenlizenz deutschland", 0.8),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 0.5),
    ("copyright", "copyright", r"(?:this|the) (?:work|document|article|book|text) is protected by copyright", 0.6),
    ("reserved", "some rights reserved", r"some rights reserved", 0.6),
    ("reserved", "rechte vorbehalten", r"alle rechte vorbehalten", 0.7),
    ("reserved", "droits r", r"tous droits réservés", 0.7),
    ("reserved", "derechos reservados", r"todos los derechos reservados", 0.7),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.8),
    ("proprietary", "confidential", r"confidential information of", 0.6),
    ("proprietary", "prior written permission", r"(?:may not|no part of .{1,60}? may) be reproduced .{0,120}?without .{0,40}?prior written permission", 0.85),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) .{0,80}?(?:is )?(?:strictly )?prohibited", 0.8),
    ("proprietary", "end user license", r"end user licen[cs]e agreement", 0.75),
    ("proprietary", "eula", r"eula", 0.5),
    ("proprietary", "evaluation purposes", r"for evaluation purposes only", 0.6),
    ("noncommercial", "non commercial", r"for non commercial (?:use|purposes) only", 0.75),
    ("noncommercial", "noncommercial", r"for noncommercial (?:use|purposes) only", 0.75),
    ("noncommercial", "polyform", r"polyform noncommercial", 0.85),
    ("personal-use", "personal use", r"for personal use only", 0.7),
    ("research", "research purposes", r"for (?:academic|research) (?:use|purposes) only", 0.7),
    ("responsible-ai", "openrail", r"openrail", 0.8),
    ("responsible-ai", "responsible ai", r"responsible ai license", 0.8),
    ("terms", "terms of use", r"subject to (?:the|our) terms of use", 0.5),
    ("terms", "terms of service", r"subject to (?:the|our) terms of service", 0.5),
    ("no-derivatives", "derivative works", r"you may not (?:create|distribute|make) derivative works", 0.7),
    ("warranty", "without warranties", r"without warranties or conditions of any kind", 0.6),
    ("warranty", "without warranty", r"without warranty of any kind", 0.5),
    ("share-alike", "same license", r"distribute your contributions under the same license", 0.7),
]


def _version(text: str) -> str:
    """A version as words: its zero may be left out, its point is a blank."""
    major, minor = text.split(".")
    return rf"{major}(?: 0)?(?! \d)" if minor == "0" else rf"{major} {minor}"


def _compiled(label: str, priority: int, keyword: str, pattern: str, confidence: float) -> Rule:
    return Rule(label, priority, keyword, re.compile(rf"(?<= )(?:{pattern})(?= )"), confidence)


def build_rules() -> list[Rule]:
    """All rules, the most specific first: identifiers, versions, then names and sentences."""
    rules = []
    tagged = set()
    for stem, versions, keyword, pattern in _FAMILIES:
        for version in versions.split():
            named = pattern.replace("{v}", _version(version))
            rules.append(_compiled(f"{stem}-{version}", 20, keyword, named, 0.9))
        tag = rf"spdx license identifier {re.escape(stem).replace(chr(92) + '-', ' ')}"
        for version in versions.split():
            if (stem, version) in tagged:  # a family may have two spellings, its identifiers have one
                continue
            tagged.add((stem, version))
            rules.append(_compiled(f"{stem}-{version}", 10, "spdx", rf"{tag} {_version(version)}(?: only)?", 1.0))
            rules.append(
                _compiled(f"{stem}-{version}-or-later", 9, "spdx", rf"{tag} {_version(version)} or later", 1.0)
            )
    for terms in _TERMS:
        label = "cc-" + terms.replace(" ", "-")
        end = r"(?! (?:sa|nd|nc))"
        for version in _CC_VERSIONS.split():
            v = _version(version)
            rules.append(_compiled(f"{label}-{version}", 20, f"cc {terms}", rf"cc {terms} {v}", 0.9))
            rules.append(_compiled(f"{label}-{version}", 20, "creative", rf"creative ?commons (?:org licenses )?(?:{terms}|{_TERM_NAMES[terms]}) (?:international |unported |generic )?(?:license )?{v}", 0.9))
        rules.append(_compiled(label, 30, f"cc {terms}", rf"cc {terms}{end}", 0.8))
        rules.append(_compiled(label, 30, "creative", rf"creative ?commons (?:org licenses )?(?:{terms}{end}|{_TERM_NAMES[terms]}(?! (?:non|no|share)))", 0.8))
    for identifier in ("mit", "isc", "zlib", "unlicense", "wtfpl", "0bsd", "bsd 2 clause", "bsd 3 clause", "cc by 4 0", "cc by sa 4 0", "cc0 1 0", "proprietary"):
        rules.append(
            _compiled(identifier.replace(" ", "-"), 10, "spdx", rf"spdx license identifier {identifier}", 1.0)
        )
    rules += [_compiled(label, 40, keyword, pattern, sure) for label, keyword, pattern, sure in _SENTENCES]
    return sorted(rules, key=lambda r: r.priority)
