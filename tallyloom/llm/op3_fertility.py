"""Quality rules from tokeniser fertility, over base rules of words, lines and repetition."""

from __future__ import annotations

import base64
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.bpe import PATTERN, read_vocabulary
from tallyloom.llm.columns import BLANKS, as_id, in_small_batches, worker_value
from tallyloom.llm.shingles import in_groups

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, chars_per_token double, byte_share double, token_entropy double, band string"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Band:
    """Where a text of one language or script has to lie."""

    least_chars_per_token: float
    most_chars_per_token: float
    most_byte_share: float
    least_entropy: float
    #: For a text whose words come to many short tokens: least entropy of one token, and of each doubling of the tokens.
    broken_entropy: float = 0.0
    more_entropy: float = 0.0

    def holds(self, chars_per_token: float, byte_share: float, entropy: float, tokens: int) -> bool:
        least = self.least_entropy
        if chars_per_token < BROKEN:
            least = max(least, self.broken_entropy + self.more_entropy * min(math.log2(max(tokens, 1)), LONGEST))
        return self.least_chars_per_token <= chars_per_token <= self.most_chars_per_token and byte_share <= self.most_byte_share and entropy >= least


#: Characters per token below which words count as broken into many tokens, and doublings of a text's tokens after which
#: prose of such words has shown most of its pieces.
BROKEN, LONGEST = 3.5, 11

#: By language where it is known, else by the script of most letters. Characters per token are those of a vocabulary
#: made for many languages, so prose has at least the lower figure even where words are rare ones; text broken up by
#: symbols, digits or markup has less, and runs of one character have far more than the upper figure. Byte fallback
#: and entropy (bits per token) come from a vocabulary of pieces. Where words are broken into many pieces, entropy is
#: high and grows with the text: for the four languages that bound follows the lowest that labelled good texts have, 0.05
#: to 0.1 bits below it, which menus and lists of such words (one separator over and over) don't reach. Good texts have a
#: byte share of 0.044 at most.
BANDS = {
    "en": Band(2.2, 9.0, 0.10, 4.0, 3.8, 0.25),
    "de": Band(2.3, 9.0, 0.10, 4.0, 3.8, 0.25),
    "es": Band(2.1, 9.0, 0.10, 4.0, 3.8, 0.25),
    "fr": Band(2.0, 9.0, 0.10, 4.0, 3.65, 0.25),
    "LATIN": Band(1.7, 10.0, 0.20, 4.0),
    "CYRILLIC": Band(1.2, 10.0, 0.20, 4.0),
    "GREEK": Band(0.8, 10.0, 0.30, 4.0),
    "CJK": Band(0.4, 6.0, 0.75, 4.0),
    "HIRAGANA": Band(0.4, 6.0, 0.75, 4.0),
    "HANGUL": Band(0.4, 6.0, 0.85, 3.5),
    "OTHER": Band(0.25, 12.0, 0.95, 3.0),
}


def script_of(text: str) -> str:
    """The script of most of a text's letters, as in BANDS."""
    found: dict[str, int] = {}
    for c, n in Counter(text).items():
        if c.isalpha():
            name = "LATIN" if c.isascii() else unicodedata.name(c, "OTHER").split(" ")[0]
            found[name] = found.get(name, 0) + n
    best = max(sorted(found), key=found.get, default="OTHER")
    return best if best in BANDS else "OTHER"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that is found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == n:
        return 0
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    data = text.encode()
    words = data.split()  # bytes split at the six blanks of ASCII only
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


class Fertility:
    """Measures a text with two public vocabularies."""

    def __init__(self, many: bytes, pieces: bytes):
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in many.splitlines() if x)}
        self.many = tiktoken.Encoding("many", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def measure(self, text: str) -> tuple[float, float, float, int]:
        """(characters per token, share of byte-fallback tokens, entropy in bits per token, tokens of pieces); zeros without a token."""
        n = len(self.many.encode_ordinary(text))
        ids = np.array(self.pieces.encode(text), dtype=np.int64)
        if not n or not len(ids):
            return 0.0, 0.0, 0.0, 0
        p = np.unique(ids, return_counts=True)[1] / len(ids)
        return len(text) / n, float(self.is_byte[ids].mean()), float(-(p * np.log2(p)).sum()), len(ids)

    def judge(self, text: str | None, lang: str | None) -> tuple:
        """One row of SCHEMA after its doc_id."""
        text = text or ""
        words, chars, symbols, lines, repeated = base_counts(text)
        failed = words < 50 or 100 * repeated > 50 * words
        per_token, byte_share, entropy, tokens = self.measure(text)
        name = lang if lang in BANDS else script_of(text)
        inside = BANDS[name].holds(per_token, byte_share, entropy, tokens)
        return words, chars, symbols, lines, repeated, failed, not failed and inside, per_token, byte_share, entropy, name


def _vocabularies(docs: DataFrame, many_path: str, pieces_path: str):
    return docs.sparkSession.sparkContext.broadcast((read_vocabulary(many_path), read_vocabulary(pieces_path)))


def _fertility(data) -> Fertility:
    return worker_value(("Fertility", *map(hash, data.value)), lambda: Fertility(*data.value))


def judge_documents(docs: DataFrame, many_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per row of docs: base counts, measures, the band that was used and the verdict (see SCHEMA).

    many_path: a .tiktoken file; pieces_path: a .model file with byte fallback. Both are broadcast, their size is
    bounded. A narrow map without a shuffle.

    Nulls: a null text has no words, so base_failed; a null or unknown language is judged by script; a null id stays
    null. Empty text: as null. Very long text: read whole, memory in proportion to it. Ties and repeated rows: each
    row is judged for itself. Empty table: no rows. Other columns, whatever their names, are ignored.
    """
    from pyspark.sql import functions as F

    data = _vocabularies(docs, many_path, pieces_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _fertility(data)
        types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()]
        for b in in_groups(batches):
            ids, texts, langs = (c.to_pylist() for c in b.columns)
            rows = [(i, *f.judge(t, g)) for i, t, g in zip(ids, texts, langs, strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=NAMES)

    lang = docs[lang_col].cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    return in_small_batches(docs).select(as_id(docs, id_col), docs[text_col].alias("text"), lang.alias("lang")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, many_path: str, pieces_path: str, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of docs that judge_documents keeps, with all their columns, whatever their names.

    Nulls, empty and very long texts as there; without the column lang_col every text is judged by its script. Repeated
    rows: each is judged for itself. Empty table: no rows.
    """
    data = _vocabularies(docs, many_path, pieces_path)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _fertility(data)
        for b in in_groups(batches, text_at):
            texts = b.column(text_at).to_pylist()
            langs = [None] * len(texts) if lang_at is None else b.column(lang_at).to_pylist()
            yield b.filter(pa.array([f.judge(t, g)[6] for t, g in zip(texts, langs, strict=True)], pa.bool_()))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
