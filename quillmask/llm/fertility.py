"""Quality rules on tokeniser fertility: how well public vocabularies fit a text.

For each text a vocabulary gives the characters per token, the share of tokens that hold part of a character, so that it
falls back on bytes (byte fallback), and the entropy of its tokens in bits, over the most that so many tokens could have (up to
2^9 kinds). Texts are rejected outside the bands of their main script. Texts too short to measure keep the base verdict.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import GROUP, bpe, cut_column
from .stream import small_batches, tidy, together
from .textstats import TextStats
from .words import as_strings, offsets_of, pieces


@dataclass(frozen=True)
class Band:
    """What is kept: characters per token from low to high, at most so much byte fallback, at least so much entropy."""

    low: float
    high: float
    fallback: float
    entropy: float


#: Bands by vocabulary (file name) and main script; scripts that are not named have those of "other". The limits lie between
#: what clean texts measure (translated messages of programs, 38 to 1,500 texts a script) and what random letters of the
#: script or a few words over and over do. A vocabulary that hardly knows a script takes its clean texts and random letters
#: alike apart into bytes: there ("other") only texts that are nearly constant can be rejected, by entropy or by length.
BANDS = {
    "byte_bpe_multi_50k.tiktoken": {
        "latin": Band(1.9, 8.0, 0.25, 0.67),
        "greek": Band(1.05, 4.0, 0.4, 0.62),
        "cyrillic": Band(1.2, 6.0, 0.3, 0.62),
        "armenian": Band(0.72, 2.0, 0.88, 0.5),
        "hebrew": Band(1.34, 3.5, 0.35, 0.62),
        "arabic": Band(1.24, 4.0, 0.3, 0.61),
        "devanagari": Band(0.74, 2.0, 0.75, 0.52),
        "tamil": Band(0.95, 2.4, 0.4, 0.51),
        "thai": Band(0.95, 2.8, 0.35, 0.6),
        "hangul": Band(1.0, 3.2, 0.65, 0.65),
        "east_asian": Band(0.7, 2.6, 0.5, 0.7),
        "other": Band(0.25, 8.0, 1.0, 0.3),
    },
    "byte_bpe_50k.tiktoken": {
        "latin": Band(1.0, 8.0, 0.6, 0.66),
        "greek": Band(0.75, 3.0, 0.75, 0.5),
        "cyrillic": Band(0.73, 3.0, 0.8, 0.5),
        "hebrew": Band(0.78, 3.0, 0.78, 0.48),
        "arabic": Band(0.75, 3.0, 0.76, 0.52),
        "other": Band(0.25, 8.0, 1.0, 0.3),
    },
}
#: Code points by script. Letters and their marks count where they stand in these ranges, all other ones as "other".
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
    "east_asian": ((0x3005, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x323AF)),
    "unspaced": ((0xE80, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF)),
    "other": (),
}
_NAMES = list(SCRIPTS)
#: Scripts written without spaces between words (Han and kana, Thai; Lao, Burmese and Khmer): so many letters are likely a word.
_UNSPACED = [_NAMES.index(k) for k in ("east_asian", "thai", "unspaced")]
LETTERS_A_WORD = 3
#: Words that a text needs to be measured.
LEAST_WORDS = 20
_ENTROPY_BITS = 9.0


def fertility(coder, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, characters per token, byte-fallback share and relative entropy of each text of a column."""
    return fertility_of([coder], column)[0]


def fertility_of(coders: list, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same for several vocabularies, which share the pieces that texts are cut into."""
    made = [[tuple(np.zeros(0) for _ in range(4))] for _ in coders]
    for part in cut_column(column):
        points = np.diff(np.append(0, np.cumsum((part.data & 0xC0) != 0x80))[part.off])
        for each, coder in zip(made, coders, strict=True):
            each.append(_measures(points, *coder.encode(part), _partial_tokens(coder)))
    return [tuple(np.concatenate(x) for x in zip(*each, strict=True)) for each in made]


def _measures(points: np.ndarray, ids: np.ndarray, at: np.ndarray, partial_token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    count = np.diff(at)
    some = np.maximum(count, 1)
    share = np.diff(np.append(0, np.cumsum(partial_token[ids]))[at]) / some
    # tokens of each text in order, so that equal ones stand together
    same = np.sort(np.repeat(np.arange(len(count)) << 20, count) + ids)
    ends = np.append(np.flatnonzero(same[1:] != same[:-1]) + 1, len(same))[: len(same)]
    times = np.diff(np.append(0, ends))
    inner = np.bincount(same[ends - 1] >> 20, times * np.log2(times), minlength=len(count)) if len(same) else np.zeros(len(count))
    size = np.log2(some)
    entropy = np.maximum(size - inner / some, 0) / np.minimum(_ENTROPY_BITS, np.maximum(1.0, size))
    return count, points / some, share, entropy


@cache
def _partial_tokens(coder) -> np.ndarray:
    """Which tokens hold part of a character: bytes that are no UTF-8 by themselves. A comma or a letter is a whole one."""
    return np.array([_cut(t) for t in coder.tokens])


def _cut(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return True
    return False


@cache
def _script_table() -> np.ndarray:
    """The place in SCRIPTS of each code point, or -1 for one that is no letter and no mark."""
    out = np.array([len(_NAMES) - 1 if unicodedata.category(chr(i))[0] in "LM" else -1 for i in range(0x110000)], np.int8)
    for at, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            out[a : b + 1][out[a : b + 1] >= 0] = at
    return out


def letters_by_script(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Letters of each script (columns as in SCRIPTS) in each text of UTF-8 bytes and offsets."""
    n, k, table = len(off) - 1, len(_NAMES), _script_table()
    ascii_letters = np.append(0, np.cumsum((table[:128] >= 0)[data & 0x7F] & (data < 0x80), dtype=np.int64))
    head = np.flatnonzero(data >= 0xC0)
    b = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    first, second, third, fourth = (b[head + i] for i in range(4))
    two = (first & 0x1F) << 6 | second & 0x3F
    three = (first & 0x0F) << 12 | (second & 0x3F) << 6 | third & 0x3F
    four = (first & 0x07) << 18 | (second & 0x3F) << 12 | (third & 0x3F) << 6 | fourth & 0x3F
    script = table[np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))]
    doc = np.searchsorted(off, head, "right") - 1
    found = np.bincount((doc * k + script)[script >= 0], minlength=n * k).reshape(n, k)
    found[:, 0] += np.diff(ascii_letters[off])
    return found


def _rules(batches: Iterator[pa.RecordBatch], vocabularies: list[tuple[str, str]], bands: list[dict[str, Band]], text_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    coders = [bpe(*v) for v in vocabularies]
    limits = [np.array([astuple(b.get(k, b["other"])) for k in _NAMES]) for b in bands]
    for batch in together(batches, text_at, GROUP):
        text = as_strings(batch.column(text_at))
        measured = fertility_of(coders, text)  # over the whole batch: the more text, the more pieces repeat
        for a, b in pieces(text):
            s = TextStats(text.slice(a, b - a))
            letters = letters_by_script(s.words.data, s.words.off)
            failed = (s.n_words < LEAST_WORDS) | (100 * s.n_repeat_words > 30 * s.n_words)
            likely = np.maximum(s.n_words, letters[:, _UNSPACED].sum(axis=1) // LETTERS_A_WORD)
            script = np.where(letters.any(axis=1), letters.argmax(axis=1), len(_NAMES) - 1)
            kept = ~failed
            for values, band in zip(measured, limits, strict=True):
                chars, share, entropy = (v[a:b] for v in values[1:])
                low, high, fallback, least = band[script].T
                kept &= (chars >= low) & (chars <= high) & (share <= fallback) & (entropy >= least)
            made = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, kept, chars, share, entropy, likely]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for i, c in enumerate(batch.columns) if i != text_at), *map(pa.array, made)], names)


def fertility_rules(docs: DataFrame, vocabularies: list[tuple[str, str]], bands: list[dict[str, Band]] | None = None, text_col: str = "text") -> DataFrame:
    """docs, the text left out, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the
    measures chars_per_token, fallback_share and token_entropy of the last vocabulary, and likely_words. vocabularies are (rank file, split
    pattern); kept is false if the base rules fail or any vocabulary's measures leave its bands of the text's script. bands are one dict by script for each vocabulary, "other"
    among them; those of BANDS if not given, and a vocabulary that BANDS does not name is refused with a ValueError.

    The script of a text is the one that most of its letters belong to, by code point; a text without letters counts as
    "other". The base rules count what spaces set apart, whatever the script: a text fails them with fewer than LEAST_WORDS words, or if more than 30 % of
    its words repeat. Where words are not set apart by spaces, likely_words counts LETTERS_A_WORD letters as a word (elsewhere it is
    n_words); it is for those who want to judge such texts by it and changes no verdict.

    Null and empty texts have no words and fail the base rules. Texts are judged one by one, so ties and repeats are judged
    alike and an empty table gives an empty one. A column that has the name of a result is refused with a ValueError."""
    small_batches(docs.sparkSession)
    long, double, flag = T.LongType(), T.DoubleType(), T.BooleanType()
    added = [(n, long) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", flag), ("kept", flag)] + [(n, double) for n in ("chars_per_token", "fallback_share", "token_entropy")] + [("likely_words", long)]
    clash = {n for n, _ in added} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    unknown = [] if bands else [path for path, _ in vocabularies if os.path.basename(path) not in BANDS]
    if unknown:
        raise ValueError(f"no bands for {unknown}")
    schema = T.StructType([f for f in docs.schema.fields if f.name != text_col] + [T.StructField(n, t) for n, t in added])
    return docs.mapInArrow(tidy(_rules, vocabularies=vocabularies, bands=bands or [BANDS[os.path.basename(path)] for path, _ in vocabularies], text_at=docs.columns.index(text_col), names=schema.names), schema)
