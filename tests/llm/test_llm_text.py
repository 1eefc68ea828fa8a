"""Personal data, licenses, tokens, id files."""
import base64
import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paneltide.llm import bpe, idfiles, licenses, mph, personal

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def luhn(d):
    return sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
             "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15)}
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules.values()) for m in re.finditer(p, text) if ok(m[0])]
    return ",".join(f"{list(rules)[k]}:{a}:{b}" for a, k, b in sorted(found))


CARD = "4111 1111 1111 1111"
TEXTS = [None, "", "\U0001F600 mail é a.b@c.de_f@g.h@i.jk", "1.2.3.4.5.6.7.8 256.1.1.1 000.0300.1.1 0255.1.2.3", f"x{CARD}y {CARD.replace(' ', '-')} {CARD} 5", "+1 (206) 555-0100. +12 +44-20-7946-0958x",
         "a@b a@b.c. @x.y a@@b.c %@-.-", "9" * 5000, "1 " * 3000, "a" * 5000 + "@" + "b" * 3000, "+" + "1 " * 4000 + "+1" + "(" * 3000, "1." * 4000, CARD * 30, "IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432, GB83WEST12345698765432"]


def test_spans_equal_brute_force(docs):
    chance = random.Random(6)
    texts = TEXTS + ["".join(chance.choice(["1", "23", ".", "@", "+", "-", " ", "a.", "(", CARD, "9.8", "é", "x@y.z"]) for _ in range(40)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, TEXTS[3]), (3, TEXTS[3])]
    found = personal.summary(docs(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = (TEXTS[3] if r.doc_id is None else texts[r.doc_id]) or ""
        slow = slow_spans(text)
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in personal.KINDS[:personal.BASE]) == slow
        assert len(r.scores.split(",")) == len(r.spans.split(","))
        assert r.base_sha256 == hashlib.sha256(slow.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(k + ":", slow)) for k in ("email", "ip", "card", "phone")]
    ibans = next(r.spans for r in found if r.doc_id == len(TEXTS) - 1)
    assert ibans.count("iban") == 2 and personal.summary(docs([])).count() == 0


def found_in(docs, texts):
    return {r.doc_id: (r.spans, r.scores) for r in personal.summary(docs(list(enumerate(texts)))).collect()}


def test_context_moves_the_score_and_decides_about_weak_patterns(docs):
    got = found_in(docs, [f"pay by card {CARD}", f"order serial {CARD}", CARD, "the hotel +1 206 555 0100", "tel +1 206 555 0100", "the ship 10.0.0.1", "he said +1 206 555 0100",
                          "SSN: 123-45-6789", "number 123-45-6789", "my part ssn 123-45-6789", "call (206) 555-0100 or 206.555.0101", "hotel 206 555 0100", "Passport no. X12345678", "X12345678",
                          "passport é AB1234567, order AB1234568", "serial GB82 WEST 1234 5698 7654 32", "social security number 123-45-67890"])
    assert [got[k][1] for k in range(7)] == ["1.00", "0.50", "0.80", "0.50", "0.80", "0.50", "0.50"]
    assert [got[k][0] for k in range(7, 17)] == ["ssn:5:16", "", "", "local_phone:5:19", "", "passport:13:22", "", "passport:11:20", "iban:7:34", ""]


def test_very_many_spans_in_one_text(docs):
    """More than a slice of matches, of several kinds; positions and the redacted text stay those of brute force."""
    text = "é " + " ".join(f"u{i}@ex.org +1 206 555 {i:04d} 10.0.{i % 256}.1" for i in range(900)) + " end"
    found = personal.summary(docs([(1, text)])).first()
    assert found.base_sha256 == hashlib.sha256(slow_spans(text).encode()).hexdigest() and found.n_email == 900
    clean = docs([(1, text)]).select(personal.redacted(F.col("text"), personal.spans(F.col("text"))).alias("t")).first().t
    assert clean == slow_redacted(text)


def slow_redacted(text):
    at, out = 0, []
    for span in slow_spans(text).split(","):
        kind, a, b = span.split(":")
        if int(a) >= at:
            out += [text[at:int(a)], f"<{kind.upper()}>"]
        at = max(at, int(b))
    return "".join(out) + text[at:]


def test_no_python_runs(docs):
    df = personal.summary(docs([(1, "x")]))
    plan = df._jdf.queryExecution().executedPlan().toString() + licenses.scan(docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redaction_merges_overlaps(docs):
    text = "é write to a.b@c.de or 10.0.0.1, +1 206 555 0100 end"
    df = docs([(1, text), (2, "clean"), (3, "")]).select("doc_id", personal.redacted(F.col("text"), personal.spans(F.col("text"))).alias("t"))
    found = {r.doc_id: r.t for r in df.collect()}
    assert found == {1: "é write to <EMAIL> or <IP>, <PHONE> end", 2: "clean", 3: ""}


compiled = functools.cache(regex.compile)


def slow_scan(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    found = []
    padded = f" {' '.join(words)} "
    for keyword, patterns in licenses.groups().items():
        if licenses.bounded(keyword) not in padded:
            continue
        labels, weights = licenses.verdicts(keyword)
        for i, place in enumerate(m.end() for m in re.finditer(" (?=[^ ])", padded)):
            hit = next((m[0] for m in (compiled(f"(?:{p})(?= )").match(padded, place) for p in patterns) if m), None)
            if hit is not None:
                label = next(r["label"] for r in labels if compiled(r["pattern"]).search(hit))
                priority = next(r["priority"] for r in weights if compiled(r["pattern"]).search(hit))
                found.append((i, -(i + hit.count(" ") + 1), priority, label))
    labels, end = {label for _, label in at}, 0
    for start, minus, _, label in sorted(found):
        if -minus > end:
            labels.add(label)
        end = max(end, -minus)
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels))


def test_license_scan_equals_brute_force(docs):
    chance = random.Random(5)
    bits = ["Licensed under the Apache License, Version 2.0", "the", "MIT License", "CC BY", "cc-by-nc-sa 4.0", "All rights reserved.", "GNU General Public License, version 3", "SPDX-License-Identifier: BSD-3-Clause",
            "é", "\n", "General Public", "License", "released under the terms of the Mozilla Public License 2.0", "into the public domain", "cc", "by", "x11", "İ", "and", "or", "Apache-2.0", "licensed under MIT", "GPL-2.0-or-later", "License: ISC",
            "Redistribution and use in source and binary forms, with or without modification, are permitted", "LGPL", "EUPL v1.2", "creativecommons.org/licenses/by-sa/4.0", "provided as is without warranty of any kind"]
    texts = [None, "", "...", "ccby cc by", "CC BY cc  by"] + [" ".join(chance.choice(bits) for _ in range(chance.randrange(1, 25))) for _ in range(120)] + ["cc by " * 2000]
    rows = list(enumerate(texts)) + [(None, "cc by"), (4, texts[4])]
    found = licenses.scan(docs(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        slow = slow_scan("cc by" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == slow
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    assert licenses.scan(docs([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-2**63, 2**63 - 1), max_size=300))
def test_perfect_hash_is_minimal_and_perfect(keys):
    hashes = mph.mix(np.array(sorted(keys), np.int64).view(np.uint64)) if keys else np.zeros(0, np.uint64)
    index = mph.PerfectHash.build(hashes)
    assert sorted(index.slots(hashes).tolist()) == list(range(len(keys)))


@pytest.fixture(scope="module")
def pair():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return theirs, bpe.codec(RANKS, public_tokenizers.PATTERN).ready()


def ids_of(own, text):
    return np.frombuffer(own.encode([text])[0], "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_the_library(pair, text):
    theirs, own = pair
    ids = ids_of(own, text)
    assert ids == theirs.encode_ordinary(text) and own.decode(np.array(ids, "<u4").tobytes()) == text.encode()


def test_bpe_on_every_character_and_long_runs(pair, monkeypatch):
    theirs, own = pair
    texts = [f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c < 0x3000 or c % 257 == 0 and not 0xD800 <= c < 0xE000]
    texts += ["a" * 5000, "the" * 2000, " " * 3000, "<|endoftext|>", "é" * 999]
    bad = [t for t, i in zip(texts, own.encode(texts)) if np.frombuffer(i, "<u4").tolist() != theirs.encode_ordinary(t)]
    assert not bad
    monkeypatch.setattr(bpe, "MEMO", 3)
    assert ids_of(own, "forget and learn again") == theirs.encode_ordinary("forget and learn again")


def test_round_trip_with_odd_rows(docs):
    rows = [(None, None), (1, ""), (2, "héllo\n wörld"), (2, "héllo\n wörld"), (3, "x" * 20_000)]
    found = bpe.round_trip(docs(rows), RANKS, public_tokenizers.PATTERN).collect()
    text = {i: t or "" for i, t in rows}
    assert len(found) == 5 and all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in found)
    assert {r.n_tokens for r in found if not text[r.doc_id]} == {0}
    assert bpe.round_trip(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS), idfiles.WordTokenizer(open(WORDS, encoding="utf-8").read()).ready()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="'stveDrlm éÉß1²\x1c\n<|>endoftxKÅµ×\xa0\x85", max_size=40))
def test_word_pieces_equal_the_library(words, text):
    theirs, own = words
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_id_files_with_odd_rows(spark, docs, prose, tmp_path, monkeypatch):
    theirs = Tokenizer.from_file(WORDS)
    monkeypatch.setattr(idfiles, "SHARD_ROWS", 7)
    rows = [(i * 3 - 50, prose(i % 40, i)) for i in range(120)] + [(None, None), (None, "null key"), (7, "again and again"), (7, "seven"), (-500, "")] + [(999, f"hot {i}") for i in range(30)]
    folder = str(tmp_path / "ids")
    manifest = idfiles.write(docs(rows).repartition(5), open(WORDS, encoding="utf-8").read(), folder, shards=4)
    found = sorted(((r.doc_id is not None, r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in idfiles.read(spark, manifest, folder).collect())
    assert len(found) == len(rows)
    by_key = {}
    for i, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids + [2]
        by_key.setdefault((i is not None, i), []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got, at = {}, 0
    for key, start, n, crc in sorted(found, key=lambda r: r[1]):
        assert start == at
        at += n
        got.setdefault(key, []).append((n, crc))
    assert {k: Counter(v) for k, v in got.items()} == {k: Counter(v) for k, v in by_key.items()}
    assert list(got) == sorted(got)
    shards = [idfiles.Shard(folder, r.path) for r in manifest.collect()]
    assert len(shards) > 10
    sought = np.array([10, 7, 11, 10**15], np.int64)
    counts = sum(s.rows_of(sought)[1] for s in shards)
    assert counts.tolist() == [1, 3, 0, 0]
    home = next(s for s in shards if s.rows_of(sought[:1])[1][0])
    first = int(home.rows_of(sought[:1])[0][0])
    assert home.ids(first, first + 1).tolist() == theirs.encode(prose(20, 20), add_special_tokens=False).ids + [2]
    assert max(len(s.keys) for s in shards) == 7  # a key met often is split as well
    encoded = lambda t: theirs.encode(t, add_special_tokens=False).ids + [2]
    reader = idfiles.Reader(folder, [r.asDict() for r in manifest.collect()])
    assert [x.tolist() for x in reader.get(10)] == [encoded(prose(20, 20))] and len(reader.opened) == 1
    assert sorted(x.tolist() for x in reader.get(999)) == sorted(encoded(f"hot {i}") for i in range(30)) and len(reader.opened) >= 5
    assert len(reader.get(7)) == 3 and reader.get(11) == reader.get(10**15) == []
    assert idfiles.write_and_read(docs([]), WORDS).count() == 0


def test_known_chunks_are_not_cut_again(monkeypatch):
    tokenizer, own = Tokenizer.from_file(WORDS), idfiles.WordTokenizer(open(WORDS, encoding="utf-8").read()).ready()
    monkeypatch.setattr(own, "memo", {})
    texts = ["It's  tea-time,\nno\tmore \x1c12 plums. ", "plums. 12", "na\u00efve no", "\u65e5\u672c no", ""]
    wanted = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode(texts) == wanted
    cut = []

    class Pieces:
        def findall(self, text):
            cut.append(text)
            return real.findall(text)

    real = idfiles.PIECES
    monkeypatch.setattr(idfiles, "PIECES", Pieces())
    assert own.encode([texts[0], texts[1]]) == wanted[:2] and cut == []
