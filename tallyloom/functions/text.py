"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom import constants as C


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; of a text in ASCII by a class that Java tells without Unicode's tables."""
    low = F.lower(text)
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.when(plain, F.split(low, "[^a-z0-9]+")).otherwise(F.split(low, r"[^\p{IsAlphabetic}\p{N}]+")), "")


def normalize(text: Column) -> Column:
    return F.array_join(words(text), " ")


def shingles(tokens: Column, width: int = C.SHINGLE_WORDS) -> Column:
    """The distinct phrases of `width` words; none if there are fewer words."""
    n = F.size(tokens)
    made = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.array_join(F.slice(tokens, i, width), " "))
    return F.array_distinct(F.when(n >= width, made).otherwise(F.array().cast("array<string>")))


def shingle_hashes(tokens: Column, key: Column, width: int = C.SHINGLE_WORDS) -> Column:
    """64-bit hashes of key and each phrase of shingles(), distinct and sorted; no phrase is built as a string."""
    n = F.size(tokens)
    made = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(key, *(F.get(tokens, i + (k - 1)) for k in range(width))))
    return F.sort_array(F.array_distinct(F.when(n >= width, made).otherwise(F.array().cast("array<bigint>"))))


def snippet(text: Column, longest: int = C.MAX_SNIPPET_CHARS) -> Column:
    """White space collapsed, cut to `longest` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.char_length(t) > longest, F.concat(F.substring(t, 1, longest), F.lit("…"))).otherwise(t)


def clip(text: Column, longest: int = C.CLIP_CHARS) -> Column:
    return F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("…"))).otherwise(text)


def excerpt(line: Column, terms: list[str], longest: int = C.MAX_SNIPPET_CHARS, lead: int = C.EXCERPT_LEAD) -> Column:
    """A window that starts `lead` characters before the earliest term."""
    found = [F.nullif(F.instr(F.lower(line), t), F.lit(0)) for t in terms]
    first = F.least(*found) if len(found) > 1 else found[0]
    start = F.greatest(F.coalesce(first, F.lit(1)) - F.lit(lead), F.lit(1))
    body = F.substring(line, start, F.lit(longest))
    head = F.when(start > 1, F.lit("…")).otherwise(F.lit(""))
    tail = F.when(start + longest - 1 < F.char_length(line), F.lit("…")).otherwise(F.lit(""))
    return F.concat(head, body, tail)


def query_terms(question: str) -> list[str]:
    """Distinct terms of a question in order: runs of letters and digits of three characters or more, no stop words."""
    out: dict[str, None] = {}
    word = ""
    for c in question.lower() + " ":
        if c.isalnum():
            word += c
            continue
        if len(word) >= C.MIN_TERM_CHARS and word not in C.STOP_WORDS:
            out[word] = None
        word = ""
    return list(out)
