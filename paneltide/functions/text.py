"""Cleaning of scored text: labels, model responses, count texts, dates, prompts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from ..schema import required

# Accepted spellings of a label, and the text of each label.
LABEL_WORDS = {
    "-1": -1, "负面": -1, "negative": -1,
    "0": 0, "中性": 0, "neutral": 0,
    "1": 1, "+1": 1, "正面": 1, "positive": 1,
}
LABEL_TEXT = {-1: "负面", 0: "中性", 1: "正面"}
RESPONSE_PRIORITY = [("负面", -1), ("正面", 1), ("中性", 0)]

# Prompt wording and the chat template of the scored model.
DEFAULT_INSTRUCTION = "下面语句的情绪是什么？必须从括号内选项选择回答 {正面/中性/负面}，只回答正面、中性或负面。"
TITLE_PROMPT = "Instruction: 下面语句的情绪是什么? 必须从括号内选项选择回答 {正面/中性/负面},只回答是正面、中性或是负面\n"
SYSTEM_PROMPT = "You are a helpful assistant. 你是一个乐于助人的助手。"
SYSTEM_BLOCK = "<|start_header_id|>system<|end_header_id|>\n\n%s<|eot_id|>"
USER_BLOCK = (
    "<|start_header_id|>user<|end_header_id|>\n\n%s<|eot_id|>"
    "<|start_header_id|>assistant<|end_header_id|>\n\n"
)
ASSISTANT_BLOCK = "%s<|eot_id|>"
ANSWER_MARKER = "assistant\n\n"

# Units of abbreviated counts; the larger one is looked for first.
COUNT_UNITS = [("亿", 1e8), ("万", 1e4)]

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# The characters Unicode counts as white space, and the full-width digits.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
WIDE_DIGITS = "０１２３４５６７８９"


def stripped(column: Column | str) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.btrim(_col(column).cast("string"), F.lit(WHITE_SPACE))


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def lookup(column: Column | str, mapping: Mapping, default: str = "keep") -> Column:
    """Recode by a dictionary; an unmapped value is kept, becomes NULL, or stops the job (``raise``)."""
    key = _col(column)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    mapped = F.try_element_at(table, key)
    if default == "keep":
        return F.coalesce(mapped, key)
    if default == "null":
        return mapped
    return required(mapped, F.concat(F.lit("Unmapped value: "), F.coalesce(key.cast("string"), F.lit("NULL"))))


def normalize_label(column: Column | str, on_bad: str = "raise") -> Column:
    """Label text or number to -1, 0 or 1. Numbers are truncated towards zero before the domain check."""
    text = stripped(column)
    word = lookup(F.lower(text), LABEL_WORDS, default="null")
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    whole = F.when(F.abs(number) < 2, number).cast("int")
    label = F.coalesce(word, whole)
    if on_bad == "null":
        return label
    return required(label, F.concat(F.lit("not a label: "), F.coalesce(text, F.lit("NULL"))))


def parse_response(column: Column | str, default: int | None = None, on_bad: str = "raise") -> Column:
    """First label word by priority; without one, ``default`` or else the response read as a plain label."""
    text = F.coalesce(_col(column).cast("string"), F.lit(""))
    found = None
    for word, label in RESPONSE_PRIORITY:
        found = F.when(text.contains(word), label) if found is None else found.when(text.contains(word), label)
    return found.otherwise(F.lit(default) if default is not None else normalize_label(text, on_bad))


def parse_count(column: Column | str, numeric: bool = False) -> Column:
    """Abbreviated count text (1,234 / 1.13万 / 2亿 / 56+) to a whole number; anything unreadable is 0."""
    value = _col(column)
    if numeric:
        number = value.cast("double")
        return F.when(number.isNull() | F.isnan(number), F.lit(0)).otherwise(number.cast("bigint")).cast("bigint")
    scale = None
    for unit, factor in COUNT_UNITS:
        scale = F.when(value.contains(unit), factor) if scale is None else scale.when(value.contains(unit), factor)
    dropped = ",+" + "".join(unit for unit, _ in COUNT_UNITS)
    # The zero at the end is found when the text has no number, as in the words for "no count"; so no cast can fail.
    plain = F.concat(F.translate(value, WIDE_DIGITS + dropped, "0123456789"), F.lit(" 0"))
    number = F.regexp_extract(plain, r"-?\d+(?:\.\d+)?", 0).cast("double") * scale.otherwise(1.0)
    return F.coalesce(number.cast("bigint"), F.lit(0).cast("bigint"))


def to_day(column: Column | str) -> Column:
    """Calendar day of a date text; unreadable text is NULL."""
    dashed = F.translate(stripped(column), "/", "-")
    return F.regexp_replace(dashed, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("timestamp_ntz").cast("date")


def chat_source(instruction: Column) -> Column:
    return F.concat(F.lit(SYSTEM_BLOCK % SYSTEM_PROMPT), F.format_string(USER_BLOCK, instruction))


def with_input(instruction: Column, text: Column) -> Column:
    """Instruction, followed by its input on a new line when there is one."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(instruction, F.lit("\n"), text)).otherwise(instruction)


def chat_target(output: Column) -> Column:
    return F.format_string(ASSISTANT_BLOCK, output)


def title_prompt(title: Column) -> Column:
    """Missing titles appear as the text ``nan``, as the published prompts have it."""
    return F.concat(F.lit(TITLE_PROMPT), F.coalesce(title, F.lit("nan")))


def extract_answer(column: Column | str, part: str = "first") -> Column:
    """Text after the answer marker: the first answer (NULL without a marker) or the text after the last marker."""
    pieces = F.split(_col(column), ANSWER_MARKER)
    return stripped(F.try_element_at(pieces, F.lit(2 if part == "first" else -1)))
