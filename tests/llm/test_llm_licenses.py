"""License signatures: what they say of real declarations, and that every rule can be reached."""
import itertools
import re._parser as parser

import regex

from paneltide.llm import licenses

SAID = {
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction': "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:": "bsd-4-clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided": "isc",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.": "apache-2.0",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "gpl,gpl-3.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Released under the Expat License.": "mit", "See the PSF License": "psf-2.0", "GNU Lesser General Public License": "gpl,lgpl", "Lesser General Public License version 2.1": "gpl,lgpl-2.1",
    "licensed under MIT": "mit", "License: MIT": "mit", "BSD licensed": "bsd", "LICENSED under the GPL": "gpl", "Licensed under EUPL v1.2": "eupl-1.2", "GPL-3.0-or-later": "gpl-3.0",
    "Dual licensed under MIT and Apache-2.0": "apache-2.0,mit", "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2.0,mit", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0",
    "limit and permit the committee": "", "mit der Zeit, license": "", "the island discount": "", "MIT": "", "all rights reserved": "reserved",
}


def test_declarations_and_license_texts(docs):
    found = {r.doc_id: r for r in licenses.scan(docs(list(enumerate(SAID)))).collect()}
    assert {text: found[k].labels for k, text in enumerate(SAID)} == SAID
    assert all((found[k].score > 0) == bool(labels) for k, labels in enumerate(SAID.values()))


def spelled(parsed):
    """Some text for every branch of a pattern; repetitions once, and not at all where that is allowed."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            kind, x = arg[0]
            parts.append([chr(x[0] if str(kind) == "RANGE" else x)])
        elif name == "SUBPATTERN":
            parts.append(spelled(arg[-1]))
        elif name == "BRANCH":
            parts.append([t for branch in arg[1] for t in spelled(branch)])
        else:
            low, high, inner = arg
            assert name in ("MAX_REPEAT", "MIN_REPEAT")
            parts.append(([""] if low == 0 else []) + spelled(inner)[:4])
    return ["".join(p) for p in itertools.islice(itertools.product(*parts), 200)]


def test_every_signature_holds_its_keyword():
    gate = regex.compile(licenses.trie(sorted({licenses.bounded(k) for k in licenses.groups()})))
    for keyword, rules in licenses.SENTENCES.items():
        for _, _, pattern in rules:
            for text in spelled(parser.parse(pattern)):
                assert licenses.bounded(keyword) in f" {text} ", (keyword, text)
                assert gate.search(f" {text} ")


def test_the_trie_matches_the_words_alone():
    words = [" mit ", " mitx ", " gpl", " gnu org ", " g"]
    pattern = regex.compile(licenses.trie(words))
    assert all(pattern.fullmatch(w) for w in words) and not any(pattern.fullmatch(w) for w in (" mi", " gp", "mit", " gnu "))
    assert sum(map(len, licenses.SENTENCES.values())) > 150 and len(licenses.NAMES) * len(licenses.FORMS) > 300
