"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

DataFrame expressions only. A pattern's matches (``regexp_extract_all``) and what lies between them (``split`` at the same
pattern) alternate, so their lengths add up to positions in code points. Patterns are possessive and start where a run of
their characters starts (or the last match ended), which changes no match but keeps long runs linear.

Kinds of the base: email, ip (parts up to 255), card (14 to 19 digits, Luhn) and phone (a plus and 10 to 15 digits). Added: iban
(ISO 13616, mod 97), ssn (three, two and four digits with hyphens), local_phone (three, three and four digits) and passport (one
or two capitals and seven or eight digits). A span's score starts at what its pattern proves (``PROOF``), gains 0.3 from a
helpful whole word in the 40 characters before it (after the last match of its pattern) and loses 0.3 for a misleading one.
Spans of the base are reported whatever their score; those of added kinds from ``THRESHOLD`` on, so a weak pattern, which has no
checksum, counts only where the words before it say so.

Matches are worked through in slices of 256 that hand on nothing but the position, so a text with very many costs no more for
each.

Defined results: NULL and empty texts have no spans; NULL keys keep their rows; repeated rows come out repeatedly; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import by_slices, let, texts

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "local_phone", "passport"]
BASE = 4  # the first kinds are always reported as the plain rules find them
LOCAL = "[A-Za-z0-9._%+-]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3}[ .(-]{1,2})(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "passport": r"(?<![A-Za-z0-9])(?:[A-Z][0-9]{8}|[A-Z]{2}[0-9]{7})(?![A-Za-z0-9])",
}
#: Cheap conditions without which a pattern cannot match a valid span.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+", "iban": r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{9}",
         "ssn": "[0-9]-[0-9]{2}-[0-9]{4}", "local_phone": r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}", "passport": "[A-Z][0-9]{7}"}
PROOF = {"email": 0.6, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3, "passport": 0.2}
THRESHOLD = 0.45
HELPFUL = {"email": "e ?mail|mail|contact|write to|reach", "ip": "ip|address|host|server|from", "card": "card|visa|mastercard|credit|debit|payment|account",
           "phone": "phone|call|tel|telephone|mobile|fax|contact|whatsapp", "iban": "iban|account|bank|transfer", "ssn": "ssn|social security|social security number|taxpayer",
           "local_phone": "phone|call|tel|telephone|mobile|fax|contact|whatsapp", "passport": "passport|passport no|travel document"}
MISLEADING = {"email": "example|sample", "ip": "version|release|section", "card": "order|serial|isbn|tracking", "phone": "order|serial|id", "iban": "serial|order",
              "ssn": "order|serial|part|invoice", "local_phone": "order|serial|id|part|invoice", "passport": "order|serial|part|invoice"}
SPAN = "struct<start:int,kind:int,stop:int,score:double>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def places(x: Column) -> Column:
    return F.sequence(F.lit(1), F.length(x))


def luhn(x: Column) -> Column:
    doubled = F.array(*[F.lit(2 * d if d < 5 else 2 * d - 9) for d in range(10)])

    def add(total, at):
        digit = F.substring(x, at, F.lit(1)).cast("int")
        return total + F.when((F.length(x) - at) % 2 == 1, F.element_at(doubled, digit + 1)).otherwise(digit)

    return F.aggregate(places(x), F.lit(0), add) % 10 == 0


def mod97(x: Column) -> Column:
    """The ISO 7064 check of an account number without blanks."""
    moved = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))

    def add(rest, at):
        code = F.ascii(F.substring(moved, at, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(places(moved), F.lit(0), add) == 1


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(hit)).between(14, 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(hit, F.lit(" "), F.lit("")))
    return F.lit(True)


def whole_word(words: str) -> str:
    return rf"(?<![a-z])(?:{words})(?![a-z])"


def spans_of(kind: str, text: Column) -> Column:
    """Confirmed spans: start, kind's place in KINDS, stop, score; code points, stop exclusive."""
    pattern, gate = PATTERNS[kind], GATES[kind]
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")), lambda p: p["hit"].isNotNull())
    nothing = F.array().cast(f"array<{SPAN}>")

    def add(state, pair):
        start = state["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["hit"])
        near = F.lower(F.right(pair["gap"], F.lit(40)))
        score = F.least(F.lit(1.0), F.lit(PROOF[kind]) + F.when(near.rlike(whole_word(HELPFUL[kind])), 0.3).otherwise(0.0) - F.when(near.rlike(whole_word(MISLEADING[kind])), 0.3).otherwise(0.0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"), score.alias("score"))
        enters = confirmed(kind, pair["hit"])
        if KINDS.index(kind) >= BASE:
            enters &= score > THRESHOLD
        return F.struct(stop.alias("at"), F.when(enters, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    def step(state, part):
        done = F.aggregate(part, F.struct(state["at"].alias("at"), nothing.alias("out")), add)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(state["out"], d["out"]).alias("out")))

    found = F.flatten(by_slices(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")), step)["out"])
    possible = F.contains(text, F.lit(gate)) if len(gate) == 1 else text.rlike(gate)
    return F.when(possible, found).otherwise(nothing)


def spans(text: Column) -> Column:
    """All spans by start, kind, stop."""
    return F.array_sort(F.concat(*[spans_of(k, text) for k in KINDS]))


def written(found: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans``, an array of (start, kind, stop, score)."""
    return texts(docs, id_col, text_col).select("doc_id", spans(F.col("text")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every stretch of overlapping or touching spans replaced by the first one's kind in brackets. A slice of spans
    is cut out of its own stretch of the text."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(state, part):
        end = F.greatest(state["at"], F.array_max(F.transform(part, lambda s: s["stop"])))
        stretch = F.substring(text, state["at"] + 1, end - state["at"])

        def merge(inner, s, here):
            fresh = s["start"] >= inner["at"]
            marks = F.array(F.substring(here, inner["at"] - state["at"] + 1, s["start"] - inner["at"]), F.element_at(names, s["kind"] + 1))
            return F.struct(F.greatest(inner["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(inner["out"], marks)).otherwise(inner["out"]).alias("out"))

        start = F.struct(state["at"].alias("at"), F.array().cast("array<string>").alias("out"))
        done = let(stretch, lambda here: F.aggregate(part, start, lambda inner, s: merge(inner, s, here)))
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(state["out"], F.array_join(d["out"], "")).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = let(by_slices(found, start, step), lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def summary(docs: DataFrame) -> DataFrame:
    found = find(docs)
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
                        F.array_join(F.transform("spans", lambda s: s["score"].cast("decimal(3, 2)").cast("string")), ",").alias("scores"))
