"""License scans by ordered signature rules.

DataFrame expressions only. A text is brought to lower-case words between single blanks. One pattern over all keywords lets most
texts pass untouched; in the others each group of rules whose keyword occurs runs. A rule is a hand-written signature: a key
sentence of a license text, a header, an identifier, or a name in the forms in which licenses are declared. The rules of a
group are tried in order at every word, and the first that matches makes a detection. Detections of all groups are ordered by
start, longest first, then by rule; one that lies inside an earlier interval is suppressed.

Plain phrases are counted besides, whatever the rules find. ``lower`` also folds letters beyond A-Z, which are word characters
before and after; none of them turns into a letter of the rules.

Defined results: NULL and empty texts have no words, no places (NULL first and last word), empty labels and score 0; NULL keys
keep their rows; repeated rows come out repeatedly; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from .common import by_slices, let, texts

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PHRASE_SCORE = 0.5

# Signatures: keyword -> rules of (label, weight, pattern over normalised words), most telling first. A keyword is a word or
# words, whole unless it ends in ``~``, that every match of its rules holds.
ANY = "(?: [a-z0-9]+){0,12}?"  # up to a dozen words that vary, such as names
SENTENCES = {
    "hereby granted": [
        ("boost-1.0", 1.0, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
        ("ofl-1.1", 1.0, "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
        ("icu", 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute and or sell copies"),
        ("ncsa", 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
        ("mit", 1.0, "permission is hereby granted free of charge to any person obtaining a copy of (?:this|the) software(?: and associated documentation files)?"),
        ("unicode", 1.0, "permission is hereby granted free of charge to any person obtaining a copy of (?:the )?unicode data files"),
        ("hpnd", 1.0, "permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose(?: and)?(?: without fee)? is hereby granted(?: without fee)?"),
        ("0bsd", 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
        ("isc", 1.0, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
        ("postgresql", 1.0, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
        ("permissive", 0.7, "permission(?: [a-z]+){0,12}? is hereby granted"),
    ],
    "hereby grant": [("tcl", 1.0, "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose")],
    "this permission notice": [("mit", 1.0, "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
                               ("isc", 0.9, "provided that the above copyright notice and this permission notice appear in all copies"),
                               ("hpnd", 0.9, "both that copyright notice and this permission notice appear in supporting documentation")],
    "redistribution and use": [
        ("bsd", 1.0, "redistribution and use(?: of this software)? in source and binary forms with or without modification are permitted"),
        ("bsd", 0.9, "redistribution and use in source and compiled forms"),
    ],
    "redistributions": [("bsd", 0.9, "redistributions of source code must retain the(?: above)? copyright notice(?: this list of conditions)?"),
                        ("bsd", 0.9, "redistributions in binary form must reproduce the(?: above)? copyright notice(?: this list of conditions)?")],
    "endorse or promote": [("bsd-3-clause", 1.0, f"neither the names? of{ANY} nor the names of(?: its| any other)? contributors may be used to endorse or promote products(?: derived from this software)?"),
                           ("bsd-3-clause", 0.95, f"the names? of{ANY} may not be used to endorse or promote products(?: derived from this software)?"),
                           ("apache-1.1", 0.95, f"the names{ANY} must not be used to endorse or promote products derived from this software")],
    "advertising materials": [("bsd-4-clause", 1.0, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment")],
    "openssl": [("openssl", 1.0, "this product includes software developed by the openssl project"), ("openssl", 0.95, "openssl licen[cs]e"), ("gpl-linking-exception", 0.9, f"permission to link{ANY} with the openssl")],
    "apache": [
        ("apache-2.0", 1.0, "licensed under the apache license version 2 0(?: the license)?(?: you may not use this file except in compliance with the license)?"),
        ("apache-2.0", 1.0, "apache license version 2 0 january 2004"),
        ("apache-1.1", 1.0, "the apache software license version 1 1"), ("apache-1.0", 1.0, "the apache license version 1 0"),
        ("apache-2.0", 0.9, "(?:the )?apache license v(?:ersion)? ?2(?: 0)?"),
    ],
    "apache org": [("apache-2.0", 0.95, "(?:http|https) www apache org licenses license 2 0(?: txt| html)?"), ("apache-2.0", 0.7, "www apache org licenses"), ("apache-1.1", 0.9, "this product includes software developed by the apache software foundation http www apache org")],
    "in compliance with the license": [("apache-2.0", 0.9, "you may not use this file except in compliance with the license")],
    "distributed under the license": [("apache-2.0", 0.8, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis")],
    "general public license": [
        ("agpl-3.0", 1.0, f"you can redistribute it and or modify it under the terms of the gnu affero general public license{ANY} (?:either )?version 3(?: of the license)?(?: or at your option any later version)?"),
        ("lgpl-2.1", 1.0, f"you can redistribute it and or modify it under the terms of the gnu lesser general public license{ANY} (?:either )?version 2 1(?: of the license)?(?: or at your option any later version)?"),
        ("lgpl-3.0", 1.0, f"you can redistribute it and or modify it under the terms of the gnu lesser general public license{ANY} (?:either )?version 3(?: of the license)?(?: or at your option any later version)?"),
        ("lgpl-2.0", 1.0, f"you can redistribute it and or modify it under the terms of the gnu library general public license{ANY} (?:either )?version 2(?: of the license)?(?: or at your option any later version)?"),
        ("gpl-2.0", 1.0, f"you can redistribute it and or modify it under the terms of the gnu general public license{ANY} (?:either )?version 2(?: of the license)?(?: or at your option any later version)?"),
        ("gpl-3.0", 1.0, f"you can redistribute it and or modify it under the terms of the gnu general public license{ANY} (?:either )?version 3(?: of the license)?(?: or at your option any later version)?"),
        ("gpl-1.0", 1.0, f"you can redistribute it and or modify it under the terms of the gnu general public license{ANY} (?:either )?version 1(?: of the license)?(?: or at your option any later version)?"),
        ("gpl", 0.7, "see the gnu (?:lesser |library |affero )?general public license for more details"),
        ("gpl", 0.7, "you should have received a copy of the gnu (?:lesser |library |affero )?general public license(?: along with this (?:program|library))?"),
        ("gpl", 0.8, "the gnu general public license is a free copyleft license for software and other kinds of works"),
        ("agpl-3.0", 0.9, "(?:gnu )?affero general public license(?: version| v)? 3(?: 0)?"), ("agpl", 0.8, "(?:gnu )?affero general public license"),
        ("lgpl-2.1", 0.9, "(?:gnu )?lesser general public license(?: version| v)? 2 1"), ("lgpl-3.0", 0.9, "(?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?"), ("lgpl-2.0", 0.9, "(?:gnu )?library general public license(?:(?: version| v)? 2(?: 0)?)?"),
        ("lgpl", 0.8, "(?:gnu )?lesser general public license"),
        ("gpl-1.0", 0.9, "(?:gnu )?general public license(?: version| v)? 1(?: 0)?"), ("gpl-2.0", 0.9, "(?:gnu )?general public license(?: version| v)? 2(?: 0)?"), ("gpl-3.0", 0.9, "(?:gnu )?general public license(?: version| v)? 3(?: 0)?"),
        ("gpl", 0.8, "gnu general public license"),
    ],
    "free software foundation": [("gpl", 0.6, "as published by the free software foundation"), ("gpl", 0.5, "free software foundation inc(?: 51 franklin street| 59 temple place| 675 mass ave)")],
    "gnu org": [("gpl", 0.6, "(?:http|https) (?:www )?gnu org (?:licenses|copyleft)(?: (?:gpl|lgpl|agpl|fdl)(?: [0-9] [0-9])?(?: html| txt)?)?")],
    "gpl~": [
        ("gpl-2.0-classpath", 0.95, "gpl(?: ?v)? ?2(?: 0)? with(?: the)? classpath exception"),
        ("gpl-2.0", 0.9, "gpl ?v? ?2(?: 0)?(?: only| or later)?|gpl2|gplv2|gpl version 2"), ("gpl-3.0", 0.9, "gpl ?v? ?3(?: 0)?(?: only| or later)?|gpl3|gplv3|gpl version 3"),
        ("gpl-1.0", 0.9, "gpl v? ?1(?: 0)?(?: only| or later)?|gplv1"), ("gpl", 0.7, "(?:under(?: the)?|licen[cs]ed?|gnu) gpl|gpl (?:licen[cs]ed?|compatible)|gpled"),
    ],
    "lgpl~": [("lgpl-2.1", 0.9, "lgpl ?v? ?2 1(?: only| or later)?|lgplv2 1"), ("lgpl-3.0", 0.9, "lgpl ?v? ?3(?: 0)?(?: only| or later)?|lgplv3"), ("lgpl-2.0", 0.9, "lgpl ?v? ?2(?: 0)?(?: only| or later)?|lgplv2"), ("lgpl", 0.8, "lgpl")],
    "agpl~": [("agpl-3.0", 0.9, "agpl ?v? ?3(?: 0)?(?: only| or later)?|agplv3"), ("agpl-1.0", 0.9, "agpl ?v? ?1(?: 0)?(?: only| or later)?"), ("agpl", 0.8, "agpl")],
    "mozilla public": [
        ("mpl-2.0", 1.0, "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"), ("mpl-1.1", 1.0, "the contents of this file are subject to the mozilla public license version 1 1"),
        ("mpl-1.0", 1.0, "the contents of this file are subject to the mozilla public license version 1 0"), ("mpl-2.0", 0.9, "mozilla public license(?: version| v)? 2(?: 0)?"), ("mpl-1.1", 0.9, "mozilla public license(?: version| v)? 1 1"),
        ("mpl-1.0", 0.9, "mozilla public license(?: version| v)? 1 0"), ("mpl", 0.8, "mozilla public license")],
    "mpl": [("mpl-2.0", 0.9, "mpl (?:v )?2 0|mpl v2"), ("mpl-1.1", 0.9, "mpl (?:v )?1 1"), ("mpl-2.0", 0.8, "if a copy of the mpl was not distributed with this file")],
    "eclipse public": [("epl-2.0", 1.0, f"made available under the terms of the eclipse public license(?: version| v)? 2 0"), ("epl-1.0", 1.0, "made available under the terms of the eclipse public license(?: version| v)? 1 0"),
                       ("epl-2.0", 0.9, "eclipse public license(?: version| v)? 2(?: 0)?"), ("epl-1.0", 0.9, "eclipse public license(?: version| v)? 1(?: 0)?"), ("epl", 0.8, "eclipse public license")],
    "eclipse distribution": [("bsd-3-clause", 0.9, "eclipse distribution license(?: version| v)?(?: 1 0)?")],
    "common development and distribution": [("cddl-1.1", 0.95, "common development and distribution license(?: cddl)?(?: version| v)? 1 1"), ("cddl-1.0", 0.95, "common development and distribution license(?: cddl)?(?: version| v)? 1 0"), ("cddl", 0.85, "common development and distribution license")],
    "cddl": [("cddl-1.0", 0.9, "cddl (?:v|version )?1 0"), ("cddl-1.1", 0.9, "cddl (?:v|version )?1 1"), ("cddl", 0.7, "cddl")],
    "common public license": [("cpl-1.0", 0.9, "common public license(?:(?: version| v)? 1 0)?")],
    "ibm public license": [("ipl-1.0", 0.9, "ibm public license(?:(?: version| v)? 1 0)?")],
    "sun public license": [("spl-1.0", 0.9, "sun public license(?:(?: version| v)? 1 0)?")],
    "european union public": [("eupl-1.2", 0.9, "european union public licen[cs]e(?: version| v)? 1 2"), ("eupl-1.1", 0.9, "european union public licen[cs]e(?: version| v)? 1 1"), ("eupl", 0.85, "european union public licen[cs]e")],
    "eupl": [("eupl-1.2", 1.0, "(?:licensed under(?: the)? )?eupl (?:version |v ?)?1 2|eupl v1 2"), ("eupl-1.1", 1.0, "(?:licensed under(?: the)? )?eupl (?:version |v ?)?1 1|eupl v1 1"), ("eupl", 0.85, "eupl")],
    "open software license": [("osl-3.0", 0.9, "(?:licensed under the )?open software license(?: version| v)? 3 0"), ("osl", 0.8, "open software license")],
    "academic free license": [("afl-3.0", 0.9, "(?:licensed under the )?academic free license(?: version| v)? 3 0"), ("afl-2.1", 0.9, "academic free license(?: version| v)? 2 1"), ("afl", 0.8, "academic free license")],
    "artistic license": [("artistic-2.0", 0.9, "artistic license(?: version| v)? 2(?: 0)?"), ("artistic-1.0", 0.9, "artistic license(?: version| v)? 1(?: 0)?"), ("artistic", 0.8, "artistic license")],
    "a package": [("artistic-1.0", 0.9, "the intent of this document is to state the conditions under which a package may be copied")],
    "same terms as perl": [("perl", 0.95, "(?:under|redistribute it and or modify it under) the same terms as perl itself")],
    "creative commons": [
        ("cc-by-nc-sa", 1.0, "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"), ("cc-by-nc-nd", 1.0, "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
        ("cc-by-nc", 1.0, "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"), ("cc-by-sa", 1.0, "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
        ("cc-by-nd", 1.0, "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"), ("cc-by", 1.0, "creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
        ("cc0", 1.0, "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"), ("cc", 0.6, "creative commons licen[cs]ed?")],
    "creativecommons org": [("cc-by-nc-sa", 0.95, "creativecommons org licenses by nc sa(?: [1-4] [05])?"), ("cc-by-nc-nd", 0.95, "creativecommons org licenses by nc nd(?: [1-4] [05])?"), ("cc-by-nc", 0.95, "creativecommons org licenses by nc(?: [1-4] [05])?"),
                            ("cc-by-sa", 0.95, "creativecommons org licenses by sa(?: [1-4] [05])?"), ("cc-by-nd", 0.95, "creativecommons org licenses by nd(?: [1-4] [05])?"), ("cc-by", 0.95, "creativecommons org licenses by(?: [1-4] [05])?"),
                            ("cc0", 0.95, "creativecommons org publicdomain zero(?: 1 0)?"), ("public-domain", 0.9, "creativecommons org (?:publicdomain mark|licenses publicdomain)(?: 1 0)?")],
    "cc by": [("cc-by-nc-sa", 0.9, "cc by nc sa(?: [1-4] [05])?"), ("cc-by-nc-nd", 0.9, "cc by nc nd(?: [1-4] [05])?"), ("cc-by-nc", 0.9, "cc by nc(?: [1-4] [05])?"), ("cc-by-sa", 0.9, "cc by sa(?: [1-4] [05])?"), ("cc-by-nd", 0.9, "cc by nd(?: [1-4] [05])?"), ("cc-by", 0.9, "cc by [1-4] [05]")],
    "cc0": [("cc0", 0.9, "cc0(?: 1 0)?(?: universal)?")],
    "public domain": [("unlicense", 1.0, "this is free and unencumbered software released into the public domain"), ("cc0", 1.0, "the person who associated a work with this deed has dedicated the work to the public domain"),
                      ("public-domain", 0.9, "(?:released|placed|dedicated|given|put)(?: [a-z]+){0,4}? (?:in|into|to) the public domain"), ("public-domain", 0.8, "(?:in|into|to) the public domain"), ("public-domain", 0.8, "public domain(?: dedication| software| work)")],
    "unlicense": [("unlicense", 0.9, "(?:http |https )?unlicense org"), ("unlicense", 0.9, "(?:the |licensed under the )?unlicense")],
    "what the fuck": [("wtfpl", 1.0, "do what the fuck you want to(?: public license)?")],
    "wtfpl": [("wtfpl", 0.9, "(?:licensed under the )?wtfpl(?: version 2| v2)?")],
    "beer": [("beerware", 1.0, "if we meet some day and you think this stuff is worth it you can buy me a beer in return"), ("beerware", 0.9, "the beer ware license")],
    "good not evil": [("json", 1.0, "the software shall be used for good not evil")],
    "altered source versions": [("zlib", 1.0, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software")],
    "in no event will the authors": [("zlib", 1.0, "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software")],
    "font software": [("ofl-1.1", 1.0, "this font software is licensed under the sil open font license version 1 1"), ("bitstream-vera", 0.9, "font software(?: [a-z]+){0,10}? bitstream vera")],
    "open font license": [("ofl-1.1", 0.9, "(?:sil )?open font license(?: version| v)?(?: 1 1)?")],
    "open database license": [("odbl-1.0", 0.95, "(?:made available under the )?open database license(?: odbl)?(?:(?: version| v)? 1 0)?")],
    "open data commons": [("pddl-1.0", 0.9, "open data commons public domain dedication and license"), ("odc-by-1.0", 0.9, "open data commons attribution license")],
    "boost software license": [("boost-1.0", 1.0, "distributed under the boost software license(?: version| v)? 1 0"), ("boost-1.0", 0.9, "boost software license(?:(?: version| v)? 1 0)?")],
    "python software foundation": [("psf-2.0", 1.0, "python software foundation license(?: version| v)?(?: 2)?"), ("psf-2.0", 0.8, "python software foundation psf")],
    "python available": [("psf-2.0", 0.9, "psf is making python available to licensee on an as is basis")],
    "php license": [("php-3.01", 0.95, "the php license(?: version| v)? 3 01"), ("php-3.0", 0.9, "php license(?: version| v)? 3 0"), ("php", 0.8, "php license")],
    "ruby license": [("ruby", 0.85, "ruby license")],
    "same terms as ruby": [("ruby", 0.85, "(?:under )?(?:the )?same terms as ruby")],
    "zope public license": [("zpl-2.1", 0.9, "zope public license(?:(?: version| v)? 2 [01])?")],
    "microsoft public license": [("ms-pl", 0.95, "microsoft public license(?: ms pl)?")],
    "microsoft reciprocal license": [("ms-rl", 0.95, "microsoft reciprocal license(?: ms rl)?")],
    "ms pl": [("ms-pl", 0.9, "ms pl")],
    "q public license": [("qpl-1.0", 0.9, "q public license(?: version 1 0)?")],
    "server side public": [("sspl-1.0", 0.95, "server side public license(?:(?: version| v)? 1)?")],
    "sspl": [("sspl-1.0", 0.9, "sspl(?: v? ?1(?: 0)?)?")],
    "business source license": [("busl-1.1", 0.95, "business source license(?:(?: version| v)? 1 1)?")],
    "elastic license": [("elastic-2.0", 0.95, "elastic license(?: version| v)? 2 0"), ("elastic", 0.85, "elastic license")],
    "commons clause": [("commons-clause", 0.95, "commons clause(?: license condition)?(?: v? ?1 0)?")],
    "polyform": [("polyform-noncommercial", 0.95, "polyform noncommercial license(?: 1 0 0)?"), ("polyform", 0.8, "polyform [a-z]+ license")],
    "free documentation license": [("gfdl-1.3", 0.95, "(?:gnu )?free documentation license(?: version| v)? 1 3"), ("gfdl-1.2", 0.95, "(?:gnu )?free documentation license(?: version| v)? 1 2"), ("gfdl", 0.85, "(?:gnu )?free documentation license")],
    "vim license": [("vim", 0.85, "vim license")],
    "openrail": [("openrail", 0.9, "(?:bigscience |creativeml )?openrail(?: m| license)*")],
    "llama~": [("llama", 0.85, "llama(?: [23])? community license(?: agreement)?")],
    "end user license": [("proprietary", 0.8, "end user license agreement")],
    "proprietary": [("proprietary", 0.9, "proprietary and confidential"), ("proprietary", 0.85, "proprietary (?:license|software|information)"), ("proprietary", 0.8, "(?:confidential|unpublished) proprietary")],
    "without the express": [("proprietary", 0.7, "(?:reproduction|distribution|disclosure|use)(?: [a-z]+){0,8}? without the express written (?:permission|consent)")],
    "unauthorized copying": [("proprietary", 0.9, "unauthorized copying of this file via any medium is strictly prohibited")],
    "without warranty": [("disclaimer", 0.4, "(?:the software is )?provided as is without warranty of any kind(?: express or implied)?"), ("disclaimer", 0.4, "without warranty of any kind")],
    "merchantability": [("disclaimer", 0.4, "warranties of merchantability(?: and)? fitness for a particular purpose(?: and noninfringement)?"), ("disclaimer", 0.4, "without even the implied warranty of merchantability or fitness for a particular purpose")],
    "spdx": [("spdx", 0.6, "spdx license identifier")],
}
#: Names for declarations: label, pattern of the name; more specific names first.
V = "(?: version| v)?"
NAMES = [
    ("apache-2.0", f"apache(?: software)?(?: license)?{V} ?2(?: 0)?|apache2|asl 2 0|al2"), ("apache-1.1", f"apache(?: software)?(?: license)?{V} 1 1"), ("apache", "apache(?: software)?"),
    ("mit-0", "mit 0|mit no attribution"), ("mit", "mit(?: x11| expat)?|expat|x11"), ("bsd-2-clause", "bsd 2(?: clause)?|(?:2|two) clause bsd|simplified bsd|freebsd"), ("bsd-3-clause", "bsd 3(?: clause)?|(?:3|three) clause bsd|(?:new|modified|revised) bsd"),
    ("bsd-4-clause", "bsd 4(?: clause)?|(?:4|four) clause bsd|original bsd"), ("0bsd", "0bsd|zero clause bsd"), ("bsd", "bsd(?: style)?"), ("isc", "isc"),
    ("agpl-3.0", f"(?:gnu )?agpl ?v? ?3(?: 0)?(?: only| or later)?"), ("lgpl-2.1", "(?:gnu )?lgpl ?v? ?2 1(?: only| or later)?"), ("lgpl-3.0", "(?:gnu )?lgpl ?v? ?3(?: 0)?(?: only| or later)?"), ("lgpl-2.0", "(?:gnu )?lgpl ?v? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-1.0", "(?:gnu )?gpl ?v? ?1(?: 0)?(?: only| or later)?"), ("gpl-2.0", "(?:gnu )?gpl ?v? ?2(?: 0)?(?: only| or later)?"), ("gpl-3.0", "(?:gnu )?gpl ?v? ?3(?: 0)?(?: only| or later)?"), ("agpl", "(?:gnu )?agpl"), ("lgpl", "(?:gnu )?lgpl"), ("gpl", "(?:gnu )?gpl"),
    ("mpl-2.0", "mpl ?v? ?2(?: 0)?"), ("mpl-1.1", "mpl ?v? ?1 1"), ("mpl", "mpl|mozilla public"), ("epl-2.0", "epl ?v? ?2(?: 0)?"), ("epl-1.0", "epl ?v? ?1(?: 0)?"), ("epl", "epl"), ("cddl", "cddl(?: 1 [01])?"), ("eupl-1.2", "eupl ?v? ?1 2"), ("eupl", "eupl(?: ?v? ?1 1)?"),
    ("artistic-2.0", "artistic 2 0"), ("artistic", "artistic"), ("zlib", "zlib(?: libpng)?"), ("boost-1.0", "bsl 1 0|boost(?: software)?"), ("psf-2.0", "psf(?: 2 0)?|python(?: 2 0)?"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("busl-1.1", "busl 1 1|bsl 1 1"),
    ("sspl-1.0", "sspl(?: 1 0)?"), ("odbl-1.0", "odbl(?: 1 0)?"), ("ofl-1.1", "(?:sil )?ofl(?: 1 1)?"), ("cc0", "cc0(?: 1 0)?"), ("cc-by-nc-sa", "cc by nc sa(?: [1-4] [05])?"), ("cc-by-nc-nd", "cc by nc nd(?: [1-4] [05])?"), ("cc-by-nc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa(?: [1-4] [05])?"), ("cc-by-nd", "cc by nd(?: [1-4] [05])?"), ("cc-by", "cc by(?: [1-4] [05])?"), ("postgresql", "postgresql"), ("ncsa", "(?:university of illinois )?ncsa"), ("openssl", "openssl"), ("curl", "curl"), ("vim", "vim"), ("ruby", "ruby"),
    ("php", "php(?: 3 01)?"), ("zpl-2.1", "zpl(?: 2 [01])?"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("gfdl", "gfdl(?: 1 [1-3])?|gnu fdl"), ("hpnd", "hpnd"), ("icu", "icu"), ("ijg", "ijg"), ("libpng", "libpng"), ("osl-3.0", "osl 3 0"), ("afl-3.0", "afl 3 0"), ("upl-1.0", "upl(?: 1 0)?"),
    ("beerware", "beerware"), ("proprietary", "proprietary|commercial"), ("public-domain", "public domain"),
]
#: Forms a declaration takes, most telling first: weight and the words around {name}, which ends it but for the word license. All hold
#: ``licen``. The last one goes on with a list of licenses, for names that are nothing else.
NEAR = "(?=(?:[a-z0-9]++ ){1,9}licen)"  # before a name is tried, the word must be near
DECLARED = "(?:dual |triple )?(?:licen[cs]ed|licen[cs]e)"
FORMS = [
    (1.0, "(?:spdx )?licen[cs]e identifier (?:{name})"),
    (0.95, DECLARED + "(?: to you)? (?:under|by|as|is|type|name|on)(?: either| both)?(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:{name})(?: licen[cs]es?)?"),
    (0.9, "(?:released|distributed|published|available|provided|covered|redistributed|used|governed)(?: [a-z]+)? (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:{name})(?: style)? licen[cs]es?"),
    (0.85, "licen[cs]es? (?:the )?(?:{name})"),
    (0.85, NEAR + "(?:{name}) licen[cs]ed"),
    (0.7, NEAR + "(?:the )?(?:{name})(?: style)? licen[cs]es?"),
]
LISTED = (0.9, "(?<=licen[cs]e[ds]? [a-z0-9 ]{1,60})(?:and|or|and or)(?: the)? (?:{name})(?: licen[cs]es?)?")
WORDS = {"apache", "artistic", "psf-2.0", "ruby", "php", "vim", "curl", "postgresql", "openssl", "libpng", "boost-1.0", "mpl", "epl", "eupl", "proprietary", "public-domain"}  # also mean other things
NAMED = "licen~"


def named_patterns() -> list[str]:
    """Every form with every name: the form decides before the name does, and its words are looked for once."""
    every = "|".join(name for _, name in NAMES)
    return [shape.replace("{name}", every) for _, shape in FORMS] + [LISTED[1].replace("{name}", "|".join(name for label, name in NAMES if label not in WORDS))]


def groups() -> dict[str, list[str]]:
    """Keyword -> patterns in the order they are tried."""
    return {keyword: [pattern for _, _, pattern in rules] for keyword, rules in SENTENCES.items()} | {NAMED: named_patterns()}


def verdicts(keyword: str) -> tuple[list[dict], list[dict]]:
    """What a hit of the group means: rows of (pattern, label) and of (pattern, weight, priority), of which the first whose pattern
    the hit matches counts."""
    first = 0
    for other, rules in SENTENCES.items():
        if other == keyword:
            rows = [{"pattern": f"^(?:{pattern})$", "label": label, "weight": weight, "priority": first + k} for k, (label, weight, pattern) in enumerate(rules)]
            return rows, rows
        first += len(rules)
    labels = [{"pattern": f"(?:^| )(?:{name})(?: style)?(?: licen[cs]e[sd]?)?$", "label": label} for label, name in NAMES]
    any_name = "[a-z0-9 ]+?"
    shapes = [*FORMS, (LISTED[0], "(?:and|or) {name}")]
    return labels, [{"pattern": f"^(?:{shape.replace('{name}', any_name)})$", "weight": weight, "priority": first + k} for k, (weight, shape) in enumerate(shapes)]


def bounded(keyword: str) -> str:
    """A keyword as it stands in a text of words between single blanks."""
    return f" {keyword[:-1]}" if keyword.endswith("~") else f" {keyword} "


def trie(words: list[str]) -> str:
    """A pattern of these strings that shares their beginnings, so few alternatives are tried at a place."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [head + trie(rest) for head, rest in sorted(heads.items())]
    body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""
    return f"(?:{body})?" if body and "" in words else body


def blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def intervals(padded: Column, pattern: str, kind: str, made) -> Column:
    """``made(first word, word after the last, hit)`` (of type ``kind``) wherever the pattern matches at a word, overlapping matches
    included, one a word."""
    look = f"(?<= )(?=({pattern})(?= ))"
    gaps = F.split(F.regexp_replace(padded, F.lit(look), F.lit("\u0001")), "\u0001", -1)
    pairs = let(F.regexp_extract_all(padded, F.lit(look), F.lit(1)), lambda hits: F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")))

    def add(state, pair):
        at = state["at"] + blanks(pair["gap"])
        return F.struct(at.alias("at"), F.array_append(state["out"], made(at - 1, at + blanks(pair["hit"]), pair["hit"])).alias("out"))

    def step(state, part):
        done = F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")), add)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(state["out"], d["out"]).alias("out")))

    return F.flatten(by_slices(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), step)["out"])


DETECTION = "struct<start:int,minus:int,priority:int,label:string,weight:double>"


def constant(rows: list[dict], kind: str) -> Column:
    """Rows as one constant, which costs the planner one expression."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def detections(padded: Column) -> Column:
    """Every group's intervals: start, minus stop, priority, label, weight; sorted, so that containers come first."""
    parts = []
    for keyword, patterns in groups().items():
        labels, weights = verdicts(keyword)

        def made(start, stop, hit, labels=labels, weights=weights):
            met = lambda table: F.filter(table, lambda r: F.regexp_like(hit, r["pattern"]))[0]
            label, weight = constant(labels, "pattern:string,label:string"), constant(weights, "pattern:string,weight:double,priority:int")
            return let(met(weight), lambda w: F.struct(start.cast("int").alias("start"), (-stop).cast("int").alias("minus"), w["priority"].alias("priority"), met(label)["label"].alias("label"), w["weight"].alias("weight")))

        found = intervals(padded, "|".join(f"(?:{p})" for p in patterns), DETECTION, made)
        parts.append(F.when(F.contains(padded, F.lit(bounded(keyword))), found).otherwise(F.array().cast(f"array<{DETECTION}>")))
    return F.array_sort(F.flatten(F.array(*parts)))


def resolved(found: Column) -> Column:
    """Labels and the strongest weight of the detections that lie in no earlier one."""
    def add(state, d):
        keep = -d["minus"] > state["end"]
        return F.struct(F.greatest(state["end"], -d["minus"]).alias("end"), F.when(keep, F.array_union(state["labels"], F.array(d["label"]))).otherwise(state["labels"]).alias("labels"),
                        F.when(keep, F.greatest(state["weight"], d["weight"])).otherwise(state["weight"]).alias("weight"))

    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))
    return F.aggregate(found, start, add, lambda s: F.struct(s["labels"].alias("labels"), s["weight"].alias("weight")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    words = F.btrim(F.regexp_replace(F.lower("text"), GAP, " "))
    phrases = " (?:" + "|".join(PHRASES) + ") "
    gate = trie(sorted({bounded(k) for k in groups()} | {f" {p} " for p in PHRASES}))
    listed = texts(docs, id_col, text_col).select("doc_id", F.concat(F.lit(" "), words, F.lit(" ")).alias("padded"))
    kinds = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    place = "struct<start:int,label:string>"
    base = intervals(F.col("padded"), "|".join(PHRASES), place, lambda start, stop, hit: F.struct(start.cast("int").alias("start"), F.element_at(kinds, hit).alias("label")))
    empty = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))
    found = listed.select("doc_id", F.when(F.col("padded") == "  ", 0).otherwise(blanks(F.col("padded")) - 1).cast("long").alias("n_words"),
                          F.when(F.col("padded").rlike(phrases), base).otherwise(F.array().cast(f"array<{place}>")).alias("base"),
                          F.when(F.col("padded").rlike(gate), resolved(detections(F.col("padded")))).otherwise(empty).alias("more"))
    starts = F.transform("base", lambda b: b["start"])
    labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                        F.array_join(F.array_sort(labels), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels, F.col("more.labels"))), ",").alias("labels"),
                        F.greatest(F.col("more.weight"), F.when(F.size("base") > 0, PHRASE_SCORE).otherwise(0.0)).alias("score"))
