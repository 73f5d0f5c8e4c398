"""Text normalisation and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence ends, and the code-point ranges of CJK ideographs.
SENTENCE_ENDS = ".!?。！？"
CJK = "[㐀-䶿一-鿿豈-﫿]"
_WS = r"[\s  -     　\u001c-\u001f\u0085]+"


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at either end."""
    return F.trim(F.regexp_replace(c, _WS, " "))


def spaced_name(c: Column) -> Column:
    """Underscores as spaces."""
    return F.translate(c, "_", " ")


def normalize_text(c: Column) -> Column:
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def normalize_entity_name(c: Column) -> Column:
    return squeeze(spaced_name(c))


def normalize_entity_text(c: Column) -> Column:
    return F.lower(normalize_entity_name(c))


def normalize_label(c: Column) -> Column:
    """Without enclosing angle brackets, underscores and repeated white space."""
    bare = F.regexp_replace(F.trim(c), "(?s)^<(.*)>$", "$1")
    return normalize_entity_name(bare)


def normalize_description(c: Column, max_chars: int, max_sentences: int = 4) -> Column:
    """The first sentences, ended by a full stop, cut with an ellipsis where too long."""
    parts = F.filter(F.split(squeeze(c), f"(?<=[{SENTENCE_ENDS}])\\s+"), lambda s: F.trim(s) != "")
    text = F.trim(F.concat_ws(" ", F.slice(parts, 1, max_sentences)))
    text = F.when((text != "") & ~text.rlike(f"[{SENTENCE_ENDS}]$"), F.concat(text, F.lit("."))).otherwise(text)
    cut = F.concat(F.rtrim(F.substring(text, 1, max_chars - 3)), F.lit("..."))
    return F.when(F.length(text) > max_chars, cut).otherwise(text)


def contains_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def fact_line(t: Column, s: Column, r: Column, o: Column) -> Column:
    """``t: [s<TAB>r<TAB>o]``; a question mark in place of the missing side makes a query line."""
    return F.concat(t.cast("string"), F.lit(": ["), s, F.lit("\t"), r, F.lit("\t"), o, F.lit("]"))


def code_token(level: Column, code: Column) -> Column:
    """Token of a code: the level counts from 1, the code has at least two digits."""
    return F.concat(F.lit("<z"), level.cast("string"), F.lit("_"), F.when(code < 10, F.concat(F.lit("0"), code.cast("string"))).otherwise(code.cast("string")), F.lit(">"))


def code_string(codes: Column) -> Column:
    """Codes joined by hyphens."""
    return F.array_join(F.transform(codes, lambda c: c.cast("string")), "-")


def parse_code_tokens(c: Column) -> Column:
    """Angle-bracket tokens of a text, or its words where it has none."""
    found = F.regexp_extract_all(c, F.lit("<[^>]+>"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.filter(F.split(squeeze(c), " "), lambda w: w != ""))


def looks_like_code(c: Column) -> Column:
    return F.trim(c).startswith("<") & F.trim(c).endswith(">")


def parenthesis_words(name: Column) -> Column:
    """Array of (rel, word) of a name: the words before (0) and inside (1) its first parentheses, else itself (2)."""
    begin, end = F.instr(name, "("), F.instr(name, ")")
    has = (begin > 0) & (end > 0)
    before = F.struct(F.lit(0).alias("rel"), F.trim(F.substring(name, F.lit(1), begin - 1)).alias("word"))
    inside = F.struct(F.lit(1).alias("rel"), F.substring(name, begin + 1, F.greatest(end - begin - 1, F.lit(0))).alias("word"))
    return F.when(has, F.array(before, inside)).otherwise(F.array(F.struct(F.lit(2).alias("rel"), name.alias("word"))))


def embedding_input(name: Column, description: Column, instruction: str = "") -> Column:
    """Text to be embedded: name and description, after the instruction where there is one."""
    text = F.trim(F.concat(name, F.lit(". "), description))
    return F.concat(F.lit(f"Instruct: {instruction.strip()}\nQuery: "), text) if instruction.strip() else text
