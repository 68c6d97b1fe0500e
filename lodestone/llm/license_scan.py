"""License scans by ordered signature rules (DataFrame functions only).

Texts are normalised to lower-case words (letters and digits of ASCII, and everything beyond ASCII) joined by single
spaces.  A rule is a regular expression over that form with a label, a priority and a confidence.  Only texts that a gate
lets through are normalised, and of those only rules one of whose keywords occurs are run; both are derived from the
expressions' alternatives, so every match holds one.  A detection
is suppressed if its interval lies within that of another one of higher priority, or of equal priority and greater length.

Texts are scanned in windows: blocks of ``BLOCK`` characters with ``MARGIN`` more on both sides, which is more than any match
is long; a detection belongs to the block that it starts in.  Positions are running sums, and suppression is a sweep over
the detections in order of their starts, so the work grows with the text and not with the square of its detections.

Defined results: a null text is empty: no words, no places, null positions, empty labels, score 0.  Places of a phrase
are counted each; texts of any length are read whole; rows that repeat are scanned alike; an empty table gives an empty
result; other input columns are ignored.
"""

from __future__ import annotations

import re
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD_ANY_CASE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: Phrase -> label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, name in normalised words, SPDX identifier's words, words of a URL or of the license's own text)
FAMILIES = [
    ("mit", "(?:the )?mit|expat", "mit", "opensource org licenses mit|permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-0", "mit no attribution|mit 0", "mit 0", "opensource org licenses mit 0"),
    ("isc", "isc", "isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("0bsd", "(?:zero clause|0 clause) bsd|0bsd", "0bsd", "opensource org licenses 0bsd"),
    ("bsd-2", "(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3", "(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4", "(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause", "bsd 4 clause", "all advertising materials mentioning features or use of this software"),
    ("bsd", "bsd(?! (?:2|3|4|two|three|four) clause)", "bsd", "opensource org licenses bsd license"),
    ("apache-1", "apache (?:software )?license (?:version )?1 [01]", "apache 1 [01]", "apache org licenses license 1 [01]"),
    ("apache-2", "apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache", "apache(?! (?:software )?(?:license )?(?:version |v)?[12])", "apache", "apache org licenses(?! license)"),
    ("gpl-1", "(?:gnu general public license|gnu gpl|gpl) ?(?:version |v)?1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses gpl 1 0"),
    ("gpl-2", "(?:gnu general public license|gnu gpl|gpl) ?(?:version |v)?2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses gpl 2 0"),
    ("gpl-3", "(?:gnu general public license|gnu gpl|gpl) ?(?:version |v)?3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("gpl", "(?:gnu general public license|gnu gpl|gpl)(?! ?(?:version |v)?[123])", "gpl", "gnu org licenses gpl(?! [123])"),
    ("lgpl-2", "(?:gnu (?:lesser|library) general public license|gnu lgpl|lgpl) ?(?:version |v)?2(?: 0)?(?! 1)", "lgpl 2 0(?: only| or later)?", "gnu org licenses lgpl 2 0"),
    ("lgpl-2.1", "(?:gnu (?:lesser|library) general public license|gnu lgpl|lgpl) ?(?:version |v)?2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses lgpl 2 1"),
    ("lgpl-3", "(?:gnu (?:lesser|library) general public license|gnu lgpl|lgpl) ?(?:version |v)?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("lgpl", "(?:gnu (?:lesser|library) general public license|gnu lgpl|lgpl)(?! ?(?:version |v)?[123])", "lgpl", "gnu org licenses lgpl(?! [123])"),
    ("agpl-3", "(?:gnu affero general public license|gnu agpl|agpl) ?(?:version |v)?3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("agpl", "(?:gnu affero general public license|gnu agpl|agpl)(?! ?(?:version |v)?3)", "agpl", "gnu org licenses agpl(?! 3)"),
    ("gfdl", "gnu free documentation", "gfdl 1 [123](?: only| or later)?", "gnu org licenses fdl"),
    ("mpl-1", "(?:mozilla public license|mpl) ?(?:version |v)?1 [01]", "mpl 1 [01]", "mozilla org mpl 1 [01]"),
    ("mpl-2", "(?:mozilla public license|mpl) ?(?:version |v)?2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("mpl", "mozilla public(?! license (?:version |v)?[12])", "mpl", "mozilla org mpl(?! [12])"),
    ("epl-1", "(?:eclipse public license|epl) ?(?:version |v)?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2", "(?:eclipse public license|epl) ?(?:version |v)?2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl", "common development and distribution|cddl", "cddl 1 [01]", "opensource org licenses cddl"),
    ("cpl", "common public", "cpl 1 0", "opensource org licenses cpl"),
    ("eupl", "european union public|eupl", "eupl 1 [012]", "joinup ec europa eu (?:software )?page eupl"),
    ("artistic-1", "artistic license 1 0", "artistic 1 0", "opensource org licenses artistic license 1"),
    ("artistic-2", "artistic license 2 0|artistic 2 0", "artistic 2 0", "opensource org licenses artistic license 2"),
    ("artistic", "(?:perl )?artistic(?! (?:license )?[12] 0)", "artistic", "perlfoundation org artistic"),
    ("zlib", "zlib(?: libpng)?", "zlib", "opensource org licenses zlib"),
    ("libpng", "libpng", "libpng", "libpng org pub png src libpng license"),
    ("boost", "boost software(?: license (?:version )?1 0)?", "bsl 1 0", "boost org license 1 0"),
    ("busl", "business source(?: license 1 1)?|busl 1 1", "busl 1 1", "mariadb com bsl11"),
    ("sspl", "server side public|sspl", "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic", "elastic(?: license)?(?: 2 0| v2)", "elastic 2 0", "elastic co licensing elastic license"),
    ("unlicense", "(?:the )?unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "do what the [a-z]{1,20} you want to public|wtfpl", "wtfpl", "wtfpl net"),
    ("beerware", "beer ?ware", "beerware", "if we meet some day and you think this stuff is worth it"),
    ("cc0", "cc0(?: 1 0)?|creative commons (?:cc0|zero)", "cc0 1 0", "creativecommons org publicdomain zero"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1-4] 0)?|creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "cc by nc nd [1-4] 0", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "cc by nc sa(?: [1-4] 0)?|creative commons attribution non ?commercial share ?alike", "cc by nc sa [1-4] 0", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "cc by nc(?! (?:nd|sa))(?: [1-4] 0)?|creative commons attribution non ?commercial(?! (?:share|no))", "cc by nc [1-4] 0", "creativecommons org licenses by nc(?! (?:nd|sa))"),
    ("cc-by-nd", "cc by nd(?: [1-4] 0)?|creative commons attribution no ?deriv(?:ative)?s?", "cc by nd [1-4] 0", "creativecommons org licenses by nd"),
    ("cc-by-sa", "cc by sa(?: [1-4] 0)?|creative commons attribution share ?alike", "cc by sa [1-4] 0", "creativecommons org licenses by sa"),
    ("cc-by", "cc by(?! (?:nc|nd|sa))(?: [1-4] 0)?|creative commons attribution(?! (?:non|no|share))", "cc by [1-4] 0", "creativecommons org licenses by(?! (?:nc|nd|sa))"),
    ("odbl", "open database|odbl", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by", "open data commons attribution|odc by", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl", "public domain dedication and|pddl", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("ofl", "sil open font|open font|ofl 1 1", "ofl 1 1", "scripts sil org ofl"),
    ("python", "python software foundation|psf", "psf 2 0|python 2 0", "docs python org 3 license"),
    ("ruby", "ruby(?: s)?", "ruby", "ruby lang org en about license"),
    ("php", "php(?: license 3 0[01]?)?", "php 3 0(?:1)?", "php net license"),
    ("postgresql", "postgresql", "postgresql", "postgresql org about licence"),
    ("openssl", "openssl", "openssl", "openssl org source license"),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa", "opensource org licenses ncsa"),
    ("w3c", "w3c(?: software)?(?: notice and)?", "w3c", "w3 org consortium legal"),
    ("ms-pl", "microsoft public|ms pl", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft reciprocal|ms rl", "ms rl", "opensource org licenses ms rl"),
    ("osl-3", "open software license (?:version )?3(?: 0)?|osl 3 0", "osl 3 0", "opensource org licenses osl 3 0"),
    ("afl-3", "academic free(?: license (?:version )?3 0)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("upl", "universal permissive|upl 1 0", "upl 1 0", "opensource org licenses upl"),
    ("ecl-2", "educational community(?: license (?:version )?2 0)?", "ecl 2 0", "opensource org licenses ecl 2 0"),
    ("vim", "vim", "vim", "vimhelp org uganda"),
    ("llama", "llama (?:2|3|3 1|3 2)? ?community", "llama [23](?: [12])?", "llama meta com llama license"),
    ("openrail", "(?:bigscience |creativeml )?open ?rail(?: m| s)?", "openrail", "huggingface co spaces bigscience license"),
]

GRANT = "(?:licensed|licenced|released|distributed|available|provided|published|covered|offered|issued|shared) under (?:the )?(?:terms of (?:the )?)?"

#: (label, expression, priority, confidence): rules by hand, for sentences of licenses and their notices, and for what
#: belongs to no family.  Sentences of a license's own text and customary headers have priority 5, hints 1 to 3.
GENERAL = [
    ("all-rights-reserved", "all rights reserved", 1, 0.5),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 1, 0.4),
    ("public-domain", "(?:in|into|to) the public domain", 2, 0.7),
    ("proprietary", "proprietary and confidential|proprietary licen[cs]e", 2, 0.7),
    ("permissive-notice", "redistribution and use in source and binary forms", 2, 0.8),
    ("warranty-disclaimer", "without warranty of any kind|without any warranty", 1, 0.4),
    ("non-commercial", "for non ?commercial (?:use|purposes) only", 2, 0.6),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", 5, 0.95),
    ("mit", "mit licen[cs]ed?", 2, 0.7),
    ("x11", "the name of the x consortium|x11 licen[cs]e|except as contained in this notice the names? of", 5, 0.9),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 5, 0.95),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted", 5, 0.9),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 5, 0.95),
    ("bsd-3", "neither the names? of (?:the )?(?:copyright holders?|authors?|university|company|organization)(?: nor the names of its contributors)?", 5, 0.9),
    ("bsd-3", "nor the names of its contributors may be used to endorse or promote products", 5, 0.95),
    ("bsd-2", "redistributions of source code must retain the above copyright notice", 3, 0.7),
    ("bsd-2", "redistributions in binary form must reproduce the above copyright notice", 3, 0.7),
    ("bsd", "use of this source code is governed by a bsd style", 5, 0.95),
    ("bsd-4", "this product includes software developed by", 4, 0.8),
    ("apache-2", "you may not use this file except in compliance with the license", 4, 0.85),
    ("apache-2", "you may obtain a copy of the license at http www apache org", 5, 0.95),
    ("apache-2", "grant of patent license subject to the terms and conditions of this license", 5, 0.9),
    ("apache-1", "the names apache and apache software foundation must not be used", 5, 0.95),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 5, 0.95),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 5, 1.0),
    ("gpl-2", "gnu general public license version 2 as published by the free software foundation", 5, 1.0),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 5, 1.0),
    ("gpl-1", "gnu general public license as published by the free software foundation either version 1", 5, 1.0),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1", 5, 1.0),
    ("lgpl-2", "gnu library general public license as published by the free software foundation either version 2", 5, 1.0),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3", 5, 1.0),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3", 5, 1.0),
    ("gpl-classpath", "classpath exception|as a special exception the copyright holders of this library give you permission to link", 4, 0.9),
    ("gpl-gcc-exception", "gcc runtime library exception", 4, 0.9),
    ("gpl-linux-note", "linux syscall note", 4, 0.9),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 5, 1.0),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", 5, 1.0),
    ("mpl-2", "incompatible with secondary licenses", 3, 0.7),
    ("mpl-1", "the contents of this file are subject to the mozilla public license version 1 1", 5, 1.0),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", 5, 0.95),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", 5, 1.0),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", 5, 0.95),
    ("perl", "(?:same|under the same) terms as perl itself", 4, 0.95),
    ("ruby", "you may (?:redistribute|distribute) the software (?:in binary|and or modify it) under (?:either )?the terms of the gpl or the conditions below", 4, 0.9),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 5, 0.95),
    ("zlib", "the origin of this software must not be misrepresented", 4, 0.9),
    ("boost", "distributed under the boost software license version 1 0", 5, 1.0),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 5, 0.95),
    ("busl", "additional use grant|the business source license this document or the license is not an open source license", 4, 0.85),
    ("sspl", "making the functionality of the program available to third parties as a service", 4, 0.8),
    ("commons-clause", "commons clause(?: license condition)?", 4, 0.95),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service", 5, 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5, 1.0),
    ("wtfpl", "you just do what the [a-z]{1,20} you want to", 5, 0.95),
    ("beerware", "you can buy me a beer in return", 5, 0.95),
    ("cc0", "to the extent possible under law(?: the)?(?: authors?| person)?[a-z ]{0,60} waived all copyright", 5, 0.95),
    ("cc-by", "creative commons attribution (?:[1-4] 0 )?(?:international|unported|generic)", 4, 0.9),
    ("cc-by-sa", "creative commons attribution share ?alike (?:[1-4] 0 )?(?:international|unported|generic)", 4, 0.9),
    ("cc-by-nc", "creative commons attribution non ?commercial (?:[1-4] 0 )?(?:international|unported|generic)", 4, 0.9),
    ("cc", "some rights reserved", 2, 0.6),
    ("cc", "creative commons licen[cs]e", 2, 0.6),
    ("ofl", "reserved font names?", 4, 0.9),
    ("ofl", "this font software is licensed under the sil open font license", 5, 1.0),
    ("bitstream-vera", "bitstream vera is a trademark of bitstream", 5, 0.95),
    ("ubuntu-font", "ubuntu font licen[cs]e", 4, 0.95),
    ("python", "psf is making python available to licensee on an as is basis", 5, 1.0),
    ("python", "cnri open source license agreement|beopen python open source license", 5, 0.95),
    ("php", "this product includes php software", 5, 0.95),
    ("openssl", "this product includes software developed by the openssl project", 5, 1.0),
    ("openssl", "this product includes cryptographic software written by eric young", 5, 0.95),
    ("w3c", "w3c document licen[cs]e|w3c software notice and license", 4, 0.9),
    ("json", "the software shall be used for good not evil", 5, 1.0),
    ("ncsa", "developed by [a-z0-9 ]{1,80} redistributions of source code must retain", 3, 0.6),
    ("cecill", "cecill(?: [abc])?|ce(?:a cnrs inria)? free software license agreement", 3, 0.85),
    ("zpl", "zope public licen[cs]e", 3, 0.9),
    ("ipl", "ibm public licen[cs]e", 3, 0.9),
    ("npl", "netscape public licen[cs]e", 3, 0.9),
    ("qpl", "q public licen[cs]e", 3, 0.9),
    ("apsl", "apple public source licen[cs]e", 3, 0.9),
    ("ecos", "ecos licen[cs]e", 3, 0.8),
    ("latex", "latex project public licen[cs]e|lppl", 3, 0.9),
    ("mulan", "mulan (?:psl|permissive software licen[cs]e|publ)", 3, 0.9),
    ("blueoak", "blue oak model licen[cs]e", 3, 0.95),
    ("hippocratic", "hippocratic licen[cs]e", 3, 0.95),
    ("prosperity", "prosperity public licen[cs]e", 3, 0.95),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial)(?: licen[cs]e)?", 3, 0.95),
    ("parity", "parity public licen[cs]e", 3, 0.95),
    ("fair-source", "functional source licen[cs]e|fair source licen[cs]e|fair core licen[cs]e", 3, 0.9),
    ("confluent", "confluent community licen[cs]e", 3, 0.95),
    ("redis", "redis source available licen[cs]e", 3, 0.95),
    ("timescale", "timescale licen[cs]e", 3, 0.9),
    ("eupl", "licen[cs]ed under the eupl", 4, 0.95),
    ("cern-ohl", "cern open hardware licen[cs]e|cern ohl", 3, 0.95),
    ("solderpad", "solderpad hardware licen[cs]e", 3, 0.95),
    ("cdla", "community data licen[cs]e agreement|cdla (?:permissive|sharing)", 3, 0.95),
    ("ogl", "open government licen[cs]e", 3, 0.95),
    ("etalab", "licence ouverte|etalab open licen[cs]e", 3, 0.95),
    ("dl-de", "datenlizenz deutschland", 3, 0.95),
    ("gemma", "gemma terms of use", 3, 0.9),
    ("responsible-ai", "responsible ai licen[cs]e", 3, 0.9),
    ("ms-research", "microsoft research licen[cs]e", 3, 0.9),
    ("unicode", "unicode (?:licen[cs]e|terms of use)", 3, 0.85),
    ("ijg", "independent jpeg group", 3, 0.85),
    ("libtiff", "sam leffler and silicon graphics", 5, 0.9),
    ("curl", "curl licen[cs]e", 3, 0.85),
    ("info-zip", "info zip licen[cs]e", 3, 0.9),
    ("bzip2", "bzip2 licen[cs]e", 3, 0.85),
    ("freetype", "freetype (?:project )?licen[cs]e", 3, 0.9),
    ("imagemagick", "imagemagick licen[cs]e", 3, 0.9),
    ("sleepycat", "sleepycat (?:public )?licen[cs]e", 3, 0.9),
    ("tcl", "tcl tk licen[cs]e", 3, 0.85),
    ("nasa", "nasa open source agreement", 3, 0.9),
    ("naist", "naist licen[cs]e", 3, 0.85),
    ("evaluation-only", "for evaluation purposes only", 2, 0.6),
    ("internal-use", "for internal use only", 2, 0.5),
    ("no-redistribution", "may not be (?:reproduced|redistributed|copied)(?: or transmitted| in whole or in part| in any form)?", 2, 0.5),
    ("fair-use", "fair use notice", 2, 0.5),
    ("trade-secret", "contains trade secrets", 2, 0.6),
    ("dual-license", "dual licen[cs]ed|dual licen[cs]ing", 2, 0.6),
    ("as-is", "provided as is without(?: any)? (?:express or implied )?warrant(?:y|ies)", 1, 0.4),
    ("liability", "in no event shall the (?:authors?|copyright holders?)", 1, 0.4),
]

#: Literals of many rules; where one stands in every match of an expression, it is that expression's gate.
GATES = ["licen", "copyright", "rights reserved", "public", "proprietary", "redistribution", "warranty", "commercial", "permission", "spdx", "advertising materials", "legal", "creativecommons", "wtfpl", "if we meet", "vimhelp", "php", "perlfoundation", "mozilla"]
#: Words that tell little of a rule.
COMMON = re.compile("licen[cs]es?|public|version|software|terms|under|the|of")
BREAK = "\0"
#: Characters of the normalised text that are scanned together, and how many more on both sides.
BLOCK, MARGIN = 4096, 512


def alternatives(regex: str) -> list[str]:
    """The alternatives of an expression; what may be absent, vary without end or looks around is ``BREAK``."""

    def spell(parsed) -> list[str]:
        out = [""]
        for op, x in parsed:
            name = str(op)
            if name == "LITERAL":
                more = [chr(x)]
            elif name == "BRANCH":
                more = [t for part in x[1] for t in spell(part)]
            elif name == "SUBPATTERN":
                more = spell(x[-1])
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in x):
                more = [chr(c) for _, c in x]
            else:
                more = [BREAK]
            out = [t + m for t in out for m in more]
        return out

    return spell(_parser.parse(regex))


def _worth(piece: str) -> tuple[int, int]:
    return len(COMMON.sub("", piece)), len(piece)


def _least(pieces: set[str]) -> list[str]:
    return sorted(p for p in pieces if not any(q != p and q in p for q in pieces))


def keywords(regex: str) -> list[str]:
    """Literals of which every match of ``regex`` contains one."""
    return _least({max(a.split(BREAK), key=_worth) for a in alternatives(regex)})


def gates() -> tuple[list[str], list[str]]:
    """(words, literals of several words): every match of a rule has one of them; grants are told by ``GRANT`` itself."""
    words, more = {g for g in GATES if " " not in g}, set()
    for _, _, regex, _, _ in rules():
        if regex.startswith(f" {GRANT}"):
            continue
        for a in alternatives(regex):
            pieces = a.split(BREAK)
            if not any(w in p for w in words for p in pieces):
                more.add(max(pieces, key=_worth).rstrip(" "))
    return sorted(words), _least(more)


def rules() -> list[tuple[str, list[str], str, int, float]]:
    """(label, keywords, expression, priority, confidence): four for each family, in order, then the general ones.

    Priority: the license's own words and addresses 5, SPDX lines 4, grants 3, names 2.
    """
    out = []
    for label, name, spdx, words in FAMILIES:
        own = keywords(name)
        out.append((label, keywords(words), f" (?:{words})(?= )", 5, 0.95))
        out.append((label, ["spdx"], f" spdx license identifier (?:{spdx})(?= )", 4, 1.0))
        out.append((label, own, f" {GRANT}(?:{name})(?: (?:public )?licen[cs]e)?(?= )", 3, 0.9))
        out.append((label, own, f" (?:{name}) (?:public )?licen[cs]e(?= )" if "license" not in name else f" (?:{name})(?= )", 2, 0.6))
    return out + [(label, keywords(regex), f" (?:{regex})(?= )", priority, confidence) for label, regex, priority, confidence in GENERAL]


def _normalised(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NOT_WORD, " ")), F.lit(" "))


def _blanks(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", gated: bool = True) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans``: array<struct<start, end, label, priority, confidence>> over the normalised text, in characters, after
    suppression.  ``score`` is the greatest confidence; 1 where a base phrase stands.  Without ``gated`` every text and every rule is run; the results are the same.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_low", F.lower("_t"))
    words, more = gates()
    gate = F.lit(False)
    for word in words:
        gate = gate | F.contains("_low", F.lit(word))
    verbs = GRANT[: GRANT.index(")") + 1] + " under"
    for piece in ["cc by", *more, verbs]:
        raw = piece.strip().replace(" ", NOT_WORD)
        one = "under" if piece == verbs else max(piece.split(), key=len)
        gate = gate | (F.contains("_low", F.lit(one)) & F.rlike("_low", F.lit(f"(?:^|{NOT_WORD}){raw}" if piece[0] == " " else raw)))
    rows = rows.withColumn("n_words", F.regexp_count("_t", F.lit(WORD_ANY_CASE)).cast("long")).withColumn("_s", F.when(gate if gated else F.lit(True), _normalised(F.col("_t"))))
    rows = rows.select(key, "n_words", "_s")

    table = F.array(*[F.struct(F.lit(a).alias("label"), F.array(*[F.lit(k) for k in b]).alias("keywords"), F.lit(c).alias("regex"), F.lit(d).alias("priority"), F.lit(e).alias("confidence")) for a, b, c, d, e in rules()])

    spans = "array<struct<start:int,size:int,neg_priority:int,label:string,confidence:double>>"
    none = F.array().cast(spans)

    def found(text: Column, base: Column, rule: Column) -> Column:
        """A rule's matches in ``text``, which begins ``base`` characters into the document."""
        hits = F.regexp_extract_all(text, rule["regex"], F.lit(0))
        gaps = F.slice(F.split(text, rule["regex"], -1), F.lit(1), F.size(hits))
        sizes = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size")))
        span = lambda at, x: F.struct(at.alias("start"), x["size"].alias("size"), (-rule["priority"]).alias("neg_priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))
        step = lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["spans"], F.array(span(s["at"] + x["gap"] + 1, x)).cast(spans)).alias("spans"))
        return F.when(F.size(hits) > 0, F.aggregate(sizes, F.struct(base.cast("int").alias("at"), none.alias("spans")), step, lambda s: s["spans"])).otherwise(none)

    def left(found_: Column) -> Column:
        """Detections that lie within no stronger one.  By start, longest and of highest priority first, a stronger one
        comes before all it holds; of those met, only ones that reach further and are not suppressed themselves matter."""
        order = F.array_sort(F.transform(found_, lambda x: F.struct(x["start"].alias("start"), (-x["size"]).alias("neg_size"), x["neg_priority"].alias("neg_priority"), x["label"].alias("label"), x["confidence"].alias("confidence"))))
        end = lambda x: x["start"] - x["neg_size"]
        stronger = lambda y, x: (end(y) >= end(x)) & ((y["neg_priority"] < x["neg_priority"]) | ((y["neg_priority"] == x["neg_priority"]) & (y["neg_size"] < x["neg_size"])))
        kind = "array<struct<start:int,neg_size:int,neg_priority:int,label:string,confidence:double>>"
        empty = F.array().cast(kind)

        def step(s: Column, x: Column) -> Column:
            own = F.when(F.exists(s["open"], lambda y: stronger(y, x)), empty).otherwise(F.array(x).cast(kind))
            return F.struct(F.concat(F.filter(s["open"], lambda y: end(y) > x["start"]), own).alias("open"), F.concat(s["kept"], own).alias("kept"))

        return F.aggregate(order, F.struct(empty.alias("open"), empty.alias("kept")), step, lambda s: s["kept"])

    def window(block: Column, i: Column) -> Column:
        before = F.when(i > 0, F.right(F.get("_blocks", i - 1), F.lit(MARGIN))).otherwise(F.lit(""))
        text = F.concat(before, block, F.coalesce(F.left(F.get("_blocks", i + 1), F.lit(MARGIN)), F.lit("")))
        return F.struct(text.alias("text"), (i * BLOCK - F.length(before)).alias("base"), (i * BLOCK).alias("core"))

    def scanned(w: Column) -> Column:
        run = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(w["text"], k))) if gated else table
        inside = F.filter(left(F.flatten(F.transform(run, lambda r: found(w["text"], w["base"], r)))), lambda x: (x["start"] > w["core"]) & (x["start"] <= w["core"] + BLOCK))
        return F.transform(inside, lambda x: F.struct(x["start"].alias("start"), (x["start"] - x["neg_size"] - 1).alias("end"), x["label"].alias("label"), (-x["neg_priority"]).alias("priority"), x["confidence"].alias("confidence")))

    rows = rows.withColumn("_blocks", F.regexp_extract_all("_s", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    rows = rows.withColumn("_windows", F.transform("_blocks", window))
    rows = rows.withColumn("spans", F.when(F.col("_s").isNotNull(), F.flatten(F.transform("_windows", scanned)))).drop("_blocks", "_windows")

    places = {p: F.regexp_count("_s", F.lit(f" {p}(?= )")) for p in BASE}
    any_of = f" (?:{'|'.join(BASE)})(?= )"
    n = sum((F.coalesce(c, F.lit(0)) for c in places.values()), F.lit(0)).cast("long")
    rows = rows.withColumn("n_base", n)
    own = F.array_sort(F.array_compact(F.array(*[F.when(places[p] > 0, label) for p, label in BASE.items()])))
    rows = rows.withColumn("_own", F.when(F.col("n_base") > 0, own).otherwise(F.array().cast("array<string>")))
    kept = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string,priority:int,confidence:double>>"))
    labels = F.array_sort(F.array_distinct(F.concat("_own", F.transform(kept, lambda x: x["label"]))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(kept, lambda x: x["confidence"])), F.lit(0.0)))
    first = F.when(F.col("n_base") > 0, _blanks(F.regexp_extract("_s", f"(?s)^(.*?){any_of}", 1)))
    last = F.when(F.col("n_base") > 0, _blanks(F.regexp_extract("_s", f"(?s)^(.*){any_of}", 1)))
    return rows.select(key, "n_words", "n_base", first.alias("first_word"), last.alias("last_word"), F.array_join("_own", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), kept.alias("spans"))
