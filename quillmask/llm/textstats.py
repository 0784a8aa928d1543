"""Counts over the whole of each text that several operators use, for pieces of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import Words, mix, range_hash


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS = _set(b"#*$%&|<>")
_UPPER, _LOWER, _DIGIT = (_set(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
_POINT = _set(b".,;:!?")
_FOLLOWS = _set(bytes(range(128, 192)))

#: What the quality model sees, in this order.
FEATURES = ("log_words", "word_length", "symbols_per_word", "repeated_lines", "repeated_windows", "upper", "digits",
            "points_per_word", "same_as_before", "distinct_words", "one_byte_words", "non_ascii", "log_words_per_line")


class TextStats:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a column."""

    def __init__(self, column: pa.Array):
        self.words = w = Words(column)
        self.n_words = np.diff(w.first)
        run = lambda mask: np.append(0, np.cumsum(mask, dtype=np.int64))
        whole = lambda mask: np.diff(run(mask)[w.off])
        head = run(~_FOLLOWS[w.data])
        self.points = np.diff(head[w.off])
        self.word_chars = self.by_doc(head[w.stop] - head[w.start])
        self.n_symbols = whole(_SYMBOLS[w.data])
        self.upper, self.lower, self.digits, self.stops = (whole(x[w.data]) for x in (_UPPER, _LOWER, _DIGIT, _POINT))
        self.hashes = w.hashes()
        self._lines()
        self.n_repeat_words = self._repeats(8)

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        total = np.append(0, np.cumsum(values, dtype=np.int64))
        return np.diff(total[self.words.first])

    def _lines(self) -> None:
        w = self.words
        feed = np.flatnonzero(w.data == 10)
        n_docs = len(w.off) - 1
        start = np.concatenate([w.off[:-1], feed + 1])
        owner = np.concatenate([np.arange(n_docs), np.searchsorted(w.off, feed, "right") - 1])
        order = np.lexsort((start, owner))
        start, owner = start[order], owner[order]
        stop = np.append(start[1:] - 1, 0)
        last = np.append(owner[1:] != owner[:-1], True)
        stop[last] = w.off[1:][owner[last]]
        full = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
        start, stop, owner = start[full], stop[full], owner[full]
        key = mix(range_hash(w.data, start, stop, 0) + mix(owner.astype(np.uint64)))
        first = np.unique(key, return_index=True)[1]
        self.n_lines = np.bincount(owner, minlength=n_docs)
        self.n_dup_lines = self.n_lines - np.bincount(owner[first], minlength=n_docs)

    def _repeats(self, k: int) -> np.ndarray:
        w = self.words
        at, h = w.windows(self.hashes, k)
        if not len(at):
            return np.zeros(w.n, np.int64)
        _, back, count = np.unique(mix(h + mix(w.doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
        twice = at[count[back] > 1]
        run = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(run, twice, 1)
        np.add.at(run, twice + k, -1)
        return self.by_doc(np.cumsum(run)[:-1] > 0)

    def features(self) -> np.ndarray:
        """One row of FEATURES a text; zeros for one without words."""
        w, n = self.words, np.maximum(self.n_words, 1)
        same = np.zeros(len(self.hashes), bool)
        same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
        first = np.unique(mix(self.hashes + mix(w.doc.astype(np.uint64))), return_index=True)[1]
        distinct = np.bincount(w.doc[first], minlength=w.n) if len(first) else np.zeros(w.n)
        size = np.maximum(np.diff(w.off), 1)
        columns = [
            np.log1p(self.n_words), self.word_chars / n, self.n_symbols / n, self.n_dup_lines / np.maximum(self.n_lines, 1), self.n_repeat_words / n,
            self.upper / np.maximum(self.upper + self.lower, 1), self.digits / size, self.stops / n, self.by_doc(same) / n, distinct / n,
            self.by_doc(w.stop - w.start == 1) / n, (np.diff(w.off) - self.points) / size, np.log1p(self.n_words / np.maximum(self.n_lines, 1)),
        ]
        return np.stack(columns, axis=1).astype(np.float64)
