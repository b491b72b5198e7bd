"""Signature rules of the licence scan.

Rules are regular expressions over normalised text: A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by single spaces. Each has a
keyword, a word part that every match contains, so a text without the keyword
needs no try. Hand-written: the name of every licence family, its SPDX names,
sentences from the body of some licences, and the ways a text refers to a
licence. The rules are all families in all ways of reference, plus the sentences.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int  # higher wins
    confidence: float
    keyword: str
    pattern: str


#: Label, words of the name, words of the SPDX identifier.
FAMILIES = [
    ("agpl", r"(?:gnu )?affero general public|agpl(?: ?v?[123](?: 0)?)?", r"agpl [123] 0"),
    ("apache", r"apache(?: software)?(?: 2(?: 0)?)?", r"apache [12] [01]"),
    ("artistic", r"(?:perl )?artistic(?: 2 0)?", r"artistic [12] 0"),
    ("apsl", r"apple public source|apsl", r"apsl [12] [012]"),
    ("afl", r"academic free|afl", r"afl [123] [012]"),
    ("beerware", r"beer ?ware", r"beerware"),
    ("blueoak", r"blue oak model", r"blueoak 1 0 0"),
    ("boost", r"boost software|bsl 1 0", r"bsl 1 0"),
    ("bsd", r"bsd|berkeley software distribution", r"bsd source code"),
    ("bsd-2", r"(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd", r"bsd 2 clause(?: \w+)?"),
    ("bsd-3", r"(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|revised|modified) bsd", r"bsd 3 clause(?: \w+)?"),
    ("bsd-4", r"(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd", r"bsd 4 clause(?: \w+)?"),
    ("busl", r"business source", r"busl 1 1"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero", r"cc0 1 0"),
    ("cc-by", r"cc by(?: [1234] [05])?|creative commons attribution", r"cc by [1234] [05]"),
    ("cc-by-sa", r"cc by sa(?: [1234] [05])?|creative commons attribution share ?alike", r"cc by sa [1234] [05]"),
    ("cc-by-nc", r"cc by nc(?: [1234] [05])?|creative commons attribution non ?commercial", r"cc by nc [1234] [05]"),
    ("cc-by-nd", r"cc by nd(?: [1234] [05])?|creative commons attribution no ?deriv\w+", r"cc by nd [1234] [05]"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1234] [05])?|creative commons attribution non ?commercial share ?alike", r"cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1234] [05])?|creative commons attribution non ?commercial no ?deriv\w+", r"cc by nc nd [1234] [05]"),
    ("cddl", r"common development and distribution|cddl", r"cddl 1 [01]"),
    ("cecill", r"cecill(?: [abc12])?", r"cecill [abc12](?: [01])?"),
    ("commons-clause", r"commons clause", r"commons clause"),
    ("cpl", r"common public|cpl", r"cpl 1 0"),
    ("curl", r"curl", r"curl"),
    ("ecl", r"educational community", r"ecl [12] 0"),
    ("elastic", r"elastic(?: 2 0)?", r"elastic 2 0"),
    ("epl", r"eclipse public|epl", r"epl [12] 0"),
    ("eupl", r"european union public|eupl", r"eupl 1 [012]"),
    ("gfdl", r"(?:gnu )?free documentation|gfdl", r"gfdl 1 [123]"),
    ("gpl", r"(?:gnu )?general public|(?:gnu )?gpl ?v?[123]?(?: 0)?", r"gpl [123] 0"),
    ("hpnd", r"historical permission notice", r"hpnd"),
    ("ijg", r"independent jpeg group", r"ijg"),
    ("intel", r"intel open source", r"intel"),
    ("ipl", r"ibm public", r"ipl 1 0"),
    ("isc", r"isc|internet systems consortium", r"isc"),
    ("json", r"json", r"json"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public|lgpl ?v?[23]?(?: [01])?", r"lgpl [23] [01]"),
    ("libpng", r"libpng", r"libpng(?: 2 0)?"),
    ("lppl", r"latex project public|lppl", r"lppl 1 [0123]c?"),
    ("mit", r"mit|expat|x11", r"mit(?: 0)?"),
    ("mpl", r"mozilla public|mpl", r"mpl [12] [01]"),
    ("ms-pl", r"microsoft public", r"ms pl"),
    ("ms-rl", r"microsoft reciprocal", r"ms rl"),
    ("mulan", r"mulan (?:psl|permissive software)", r"mulanpsl [12] 0"),
    ("ncsa", r"university of illinois ncsa(?: open source)?|ncsa", r"ncsa"),
    ("odbl", r"open database|odbl", r"odbl 1 0"),
    ("odc-by", r"open data commons attribution", r"odc by 1 0"),
    ("ofl", r"(?:sil )?open font|ofl", r"ofl 1 [01]"),
    ("openssl", r"openssl", r"openssl"),
    ("osl", r"open software|osl", r"osl [123] [01]"),
    ("pddl", r"public domain dedication and", r"pddl 1 0"),
    ("php", r"php", r"php 3 0(?:1)?"),
    ("postgresql", r"postgresql", r"postgresql"),
    ("python", r"python software foundation|psf", r"psf 2 0|python 2 0"),
    ("qpl", r"q public|qpl", r"qpl 1 0"),
    ("rpl", r"reciprocal public", r"rpl 1 [15]"),
    ("ruby", r"ruby", r"ruby"),
    ("sleepycat", r"sleepycat", r"sleepycat"),
    ("sspl", r"server side public|sspl", r"sspl 1 0"),
    ("tcl", r"tcl(?: tk)?", r"tcl"),
    ("unicode", r"unicode", r"unicode dfs 201[56]"),
    ("unlicense", r"unlicense", r"unlicense"),
    ("upl", r"universal permissive", r"upl 1 0"),
    ("vim", r"vim", r"vim"),
    ("w3c", r"w3c(?: software)?", r"w3c"),
    ("wtfpl", r"do what the f\w+ you want to(?: public)?|wtfpl", r"wtfpl"),
    ("zlib", r"zlib", r"zlib"),
    ("zpl", r"zope public|zpl", r"zpl [12] [01]"),
    ("0bsd", r"zero clause bsd|0bsd", r"0bsd"),
]

#: Ways of reference. ``{n}``: the name, ``{s}``: the SPDX identifier.
REFERENCES = [
    ("spdx", 50, 0.99, "spdx", r"spdx license identifier (?:{s})(?: only| or later)?"),
    ("under", 40, 0.95, "under", r"(?:licen[cs]ed|released|distributed|published|available|provided|offered|covered) (?:\w+ )?under (?:an? |the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{n})(?: public)?(?: licen[cs]e)?(?: agreement)?(?: (?:version|v) ?[0-9]+(?: [0-9]+)?)?"),
    ("terms", 35, 0.9, "terms", r"(?:subject to|governed by|according to|by|accept) the terms (?:and conditions )?of (?:the )?(?:{n})(?: public)?(?: licen[cs]e)?"),
    ("title", 30, 0.9, "licen", r"(?:{n})(?: public)? licen[cs]e(?: agreement)?(?: (?:version|v) ?[0-9]+(?: [0-9]+)?)?"),
    ("heading", 20, 0.6, "licen", r"licen[cs]e(?:d)?(?: type| name| is)? (?:the )?(?:{n})"),
]

#: Sentences of licence bodies and notices.
SENTENCES = [
    ("mit-grant", "mit", 45, 0.97, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "mit", 44, 0.9, "copyright", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc-grant", "isc", 45, 0.95, "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("hpnd-grant", "hpnd", 43, 0.8, "permission", r"permission to use copy modify and distribute this software and its documentation"),
    ("bsd-grant", "bsd", 45, 0.95, "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-name", "bsd-3", 46, 0.95, "endorse", r"neither the name of (?:(?!neither the name of )[^ ]+ )+?may be used to endorse or promote products"),
    ("bsd-4-advert", "bsd-4", 47, 0.95, "advertising", r"all advertising materials mentioning features or use of this software"),
    ("gpl-grant", "gpl", 45, 0.95, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl-grant", "lgpl", 46, 0.95, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl-grant", "agpl", 46, 0.95, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl-copy", "gpl", 42, 0.9, "gnu", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("apache-notice", "apache", 45, 0.95, "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-url", "apache", 44, 0.95, "apache", r"www apache org licenses license 2 0"),
    ("mpl-notice", "mpl", 45, 0.97, "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-url", "mpl", 44, 0.9, "mozilla", r"(?:www )?mozilla org mpl(?: 2 0)?"),
    ("epl-notice", "epl", 45, 0.95, "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("unlicense-body", "unlicense", 45, 0.97, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib-body", "zlib", 45, 0.95, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("boost-body", "boost", 45, 0.95, "boost", r"distributed under the boost software licen[cs]e"),
    ("wtfpl-body", "wtfpl", 45, 0.95, "want", r"you just do what the f\w+ you want to"),
    ("beerware-body", "beerware", 45, 0.95, "beer", r"you can buy me a beer in return"),
    ("cc-url-by", "cc-by", 45, 0.95, "creativecommons", r"creativecommons org licenses by [1234] [05]"),
    ("cc-url-by-sa", "cc-by-sa", 46, 0.95, "creativecommons", r"creativecommons org licenses by sa [1234] [05]"),
    ("cc-url-by-nc", "cc-by-nc", 46, 0.95, "creativecommons", r"creativecommons org licenses by nc [1234] [05]"),
    ("cc-url-by-nd", "cc-by-nd", 46, 0.95, "creativecommons", r"creativecommons org licenses by nd [1234] [05]"),
    ("cc-url-by-nc-sa", "cc-by-nc-sa", 47, 0.95, "creativecommons", r"creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-url-by-nc-nd", "cc-by-nc-nd", 47, 0.95, "creativecommons", r"creativecommons org licenses by nc nd [1234] [05]"),
    ("cc0-url", "cc0", 47, 0.95, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "public-domain", 25, 0.7, "domain", r"(?:released (?:in)?to|in|dedicated to|part of) the public domain"),
    ("all-rights", "proprietary", 25, 0.6, "rights", r"all rights (?:are )?reserved"),
    ("proprietary", "proprietary", 30, 0.8, "proprietary", r"(?:proprietary and confidential|confidential and proprietary|proprietary (?:software|licen[cs]e))"),
    ("no-copy", "proprietary", 30, 0.7, "reproduc", r"(?:may|must) not be reproduced (?:\w+ ){0,6}without (?:\w+ ){0,4}permission"),
]


def rules() -> list[Rule]:
    """Every family in every way of reference, then the sentences."""
    out = [
        Rule(f"{label}-{way}", label, priority, confidence, keyword, pattern.replace("{n}", name).replace("{s}", spdx))
        for label, name, spdx in FAMILIES
        for way, priority, confidence, keyword, pattern in REFERENCES
    ]
    return out + [Rule(*x) for x in SENTENCES]
