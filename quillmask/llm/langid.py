"""Language ID with string kernels: blended-spectrum n-gram presence, Nyström landmarks, kernel ridge regression.

A text is the set of its byte n-grams of two to four bytes (A-Z lower-cased, white space as blanks), all lengths blended.
The kernel of two texts is the size of their sets' intersection over the geometric mean of their sizes; sets are exact,
so a text of any length is told apart from one that holds every n-gram. A few texts per language serve as landmarks; the
kernel between texts and landmarks, whitened by the landmarks' own kernel, stands for the whole kernel matrix. One ridge
regression per language against the rest is solved on it.

Scoring multiplies the sparse presence matrix of a batch with landmarks by weights. Since both are linear, the landmarks'
presence matrix (n-gram by landmark) and the weights (landmark by language) are multiplied once, after training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stream import few, small_batches, tidy
from .words import as_strings, mix, offsets_of, pieces

SIZES = (2, 3, 4)
#: Training texts of each language, those with the least hash of their id; every LANDMARK-th of them is a landmark.
PER_LANGUAGE, LANDMARK = 250, 8
UNKNOWN = "und"
LETTER = r"\p{L}"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
#: Places of the table in which n-grams are looked up; n-grams that share a place are told apart by themselves.
_TABLE = 1 << 20


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number (length and bytes) of the distinct n-grams of each text of a piece, by row and number."""
    data, off = offsets_of(column)
    data = _LOWER[data]
    doc = np.repeat(np.arange(len(column), dtype=np.uint64) << np.uint64(34), np.diff(off))
    keys, code = [np.zeros(0, np.uint64)], data.astype(np.uint64)
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            break
        code = (code[:-1] << np.uint64(8)) | data[n - 1 :]
        if n in SIZES:
            whole = doc[: len(code)] == doc[n - 1 :]
            keys.append((doc[: len(code)] + code + np.uint64((n - 2) << 32))[whole])
    key = np.sort(np.concatenate(keys))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key >> np.uint64(34)).astype(np.int64), key & np.uint64((1 << 34) - 1)


@dataclass
class KernelClassifier:
    """vocabulary: the n-grams of the landmarks in order; weights: one column of them per language."""

    languages: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(sets: list[np.ndarray], languages: list[str], ridge: float = 1e-2) -> KernelClassifier:
        """From sets of n-grams (sorted numbers) and the language of each."""
        known = sorted(set(languages))
        marks = sets[::LANDMARK] if len(sets) > LANDMARK else sets
        grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *marks]))
        if not known:
            return KernelClassifier(known, grams, np.zeros((len(grams), 0)))
        held = np.zeros((len(grams), len(marks)), np.float32)
        for j, s in enumerate(marks):
            held[np.searchsorted(grams, s), j] = 1
        held /= np.sqrt([max(len(s), 1) for s in marks]).astype(np.float32)

        def kernel(some: list[np.ndarray]) -> np.ndarray:
            made = []
            for a in range(0, len(some), 64):
                x = np.zeros((len(some[a : a + 64]), len(grams)), np.float32)
                for i, s in enumerate(some[a : a + 64]):
                    at = np.searchsorted(grams, s)
                    x[i, at[grams[np.minimum(at, len(grams) - 1)] == s]] = 1 / np.sqrt(max(len(s), 1))
                made.append(x @ held)
            return np.concatenate(made).astype(np.float64)

        value, vector = np.linalg.eigh(kernel(marks))
        white = vector / np.sqrt(np.maximum(value, 1e-6))
        z = kernel(sets) @ white
        target = np.array(languages)[:, None] == np.array(known)[None]
        solved = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ target.astype(np.float64))
        return KernelClassifier(known, grams, held.astype(np.float64) @ (white @ solved))

    def table(self) -> np.ndarray:
        """For each place the first n-gram of the vocabulary that hashes to it and how many do, packed."""
        place = mix(self.vocabulary) & np.uint64(_TABLE - 1)
        order = np.argsort(place, kind="stable")
        self.vocabulary, self.weights, place = self.vocabulary[order], self.weights[order], place[order].astype(np.int64)
        return np.searchsorted(place, np.arange(_TABLE + 1)).astype(np.int32)

    def score(self, row: np.ndarray, gram: np.ndarray, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each of n texts, by number, and what each language scores, times the root of the set size."""
        place = (mix(gram) & np.uint64(_TABLE - 1)).astype(np.int64)
        at, end = table[place], table[place + 1]
        y = np.zeros((n, len(self.languages)))
        while len(at):
            some = np.flatnonzero(at < end)
            at, end, row, gram = at[some], end[some], row[some], gram[some]
            hit = self.vocabulary[at] == gram
            for j in range(len(self.languages)):
                y[:, j] += np.bincount(row[hit], self.weights[at[hit], j], minlength=n)
            at, end, row, gram = at[~hit] + 1, end[~hit], row[~hit], gram[~hit]
        return y.argmax(axis=1), y


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = as_strings(batch.column(0))
        for a, b in pieces(text):
            row, gram = ngrams(text.slice(a, b - a))
            sets = [x.tobytes() for x in np.split(gram, np.searchsorted(row, np.arange(1, b - a)))]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sets, pa.binary())], ["id", "lang", "x"])


def _predict(batches: Iterator[pa.RecordBatch], model, text_at: int, letters_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    model = model.value
    table, known = model.table(), np.array([*model.languages, UNKNOWN])
    for batch in batches:
        text = as_strings(batch.column(text_at))
        for a, b in pieces(text):
            fine = np.array(batch.column(letters_at).slice(a, b - a).to_pylist(), dtype=object) == True  # noqa: E712  null: none
            best, score = np.zeros(b - a, np.int64), np.zeros(b - a)
            if model.languages:
                row, gram = ngrams(text.slice(a, b - a))
                best, y = model.score(row, gram, b - a, table)
                size = np.sqrt(np.maximum(np.bincount(row, minlength=b - a), 1))
                score = np.clip(y[np.arange(b - a), best] / size, 0, 1)
            else:
                fine[:] = False
            best, score = np.where(fine, best, len(known) - 1), np.where(fine, score, 0.0)
            rest = [c.slice(a, b - a) for i, c in enumerate(batch.columns) if i != letters_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(known[best].tolist(), pa.string()), pa.array(score)], names)


def train_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> KernelClassifier:
    """A classifier fitted on at most per_language texts of each non-null language of docs. Rows without id, language or
    text are left out; without any row the classifier knows no language and predicts UNKNOWN."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = rows.select("id", "lang").withColumn("nth", nth).where(F.col("nth") <= per_language).select("id", "lang").distinct()
    # a few hundred ids a language; only ids and languages are shuffled to find them
    got = rows.join(few(chosen), ["id", "lang"], "left_semi").select("text", "id", "lang").mapInArrow(tidy(_sets), "id long, lang string, x binary").toPandas()
    got = got.sort_values(["lang", "id", "x"], kind="stable")
    return KernelClassifier.fit([np.frombuffer(x, np.uint64) for x in got["x"]], got["lang"].tolist())


def predict_language(docs: DataFrame, model: KernelClassifier, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a language that the model learned; UNKNOWN if the text is null or has no letter) and
    lang_score from 0 to 1, which depend on the text alone. Repeated texts are judged alike; an empty table gives an empty
    one. A column that has the name of a result is refused with a ValueError."""
    small_batches(docs.sparkSession)
    clash = {"lang_pred", "lang_score", "_letters"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn("_letters", F.col(text_col).rlike(LETTER))
    return rows.mapInArrow(tidy(_predict, model=model, text_at=docs.columns.index(text_col), letters_at=len(docs.columns), names=schema.names), schema)
