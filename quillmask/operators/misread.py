"""Words that a scanner misread: words meet tokens by keys that both share if they are close, and only those pairs are compared.

A token of letters (five or more) may differ from a word by one change up to seven letters and by two beyond (close_words). Two strings that are n
changes apart share a string that up to n deletions leave of either, so the deletions of distinct words and tokens are an equi-join.
A long token would have too many of them: beyond LONG letters it is cut into three parts, one of which two changes leave
whole, at its place give or take two. Both are made of the vocabulary, once for each distinct word. Within documents, which hold few words
each, those of one document are compared with each other (misread_items).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rewrite import close_words, few_changes

#: Longest token whose deletions are keys: 16 letters have 137 of them.
LONG = 16


def _without(word: Column, at: Column) -> Column:
    return F.concat(F.substring(word, 1, at), F.substring(word, at + 2, F.length(word)))


def deletions(word: Column, n: int) -> Column:
    """The word itself and all that up to n (1 or 2) deletions leave of it, distinct."""
    one = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: _without(word, i))
    every = F.concat(F.array(word), one)
    if n == 2:
        two = F.flatten(F.transform(F.sequence(F.lit(0), F.length(word) - 2), lambda i: F.transform(F.sequence(i, F.length(word) - 2), lambda j: _without(_without(word, i), j))))
        every = F.concat(every, two)
    return F.array_distinct(every)


def _part(word: Column, i: Column, size: Column, shift: Column) -> Column:
    """Part i (0 to 2) of a token of so many letters, as a word shows it that is shifted."""
    start, stop = F.floor(i * size / 3).cast("int"), F.floor((i + 1) * size / 3).cast("int")
    at = start + shift
    return F.when((at >= 0) & (at + stop - start <= F.length(word)), F.concat_ws(":", F.lit("p"), size.cast("string"), i.cast("string"), F.substring(word, at + 1, stop - start)))


def token_keys(token: Column) -> Column:
    n = F.length(token)
    third = F.sequence(F.lit(0), F.lit(2))
    return F.when(n <= 7, F.transform(deletions(token, 1), lambda k: F.concat(F.lit("1:"), k))).when(n <= LONG, F.transform(deletions(token, 2), lambda k: F.concat(F.lit("2:"), k))).otherwise(F.transform(third, lambda i: _part(token, i, n, F.lit(0))))


def word_keys(word: Column) -> Column:
    """Keys under which any token that is close to the word is found: a word may stand for tokens of three kinds."""
    n = F.length(word)
    none = F.array().cast("array<string>")
    short = F.when((n >= 4) & (n <= 8), F.transform(deletions(word, 1), lambda k: F.concat(F.lit("1:"), k))).otherwise(none)
    middle = F.when((n >= 6) & (n <= LONG + 2), F.transform(deletions(word, 2), lambda k: F.concat(F.lit("2:"), k))).otherwise(none)
    sizes, places, moves = F.sequence(F.greatest(n - 2, F.lit(LONG + 1)), n + 2), F.sequence(F.lit(0), F.lit(2)), F.sequence(F.lit(-2), F.lit(2))
    parts = F.flatten(F.transform(sizes, lambda size: F.flatten(F.transform(places, lambda i: F.transform(moves, lambda m: _part(word, i, size, m))))))
    long = F.when(n >= LONG - 1, F.array_compact(parts)).otherwise(none)
    return F.array_distinct(F.concat(short, middle, long))


def near_words(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(word, token): all pairs of distinct words and tokens, both in lower case, that close_words accepts. Nulls are left out."""
    w = words.select("word").where("length(word) >= 4").distinct()
    t = tokens.select("token").where(F.col("token").rlike(r"^\p{L}{5,}$")).distinct()
    met = w.select("word", F.explode(word_keys(F.col("word"))).alias("_key")).join(t.select("token", F.explode(token_keys(F.col("token"))).alias("_key")), "_key")
    return met.select("word", "token").distinct().where(close_words(F.col("word"), F.col("token")))


def misread_items(words: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, token, word): which words (doc_id, word) of a document may stand for a word of an item (doc_id, text) of that document.
    Words are compared in lower case without punctuation, distinct words of a document with distinct words of its items: they are few beside
    those of all documents, whose pairs would be joined back to each document that holds one of the two."""
    read = words.select("doc_id", F.lower(F.regexp_replace("word", r"(?U)[^\w'’]", "")).alias("word")).where("length(word) >= 4").distinct()
    asked = items.select("doc_id", F.btrim("text").alias("text")).distinct()
    asked = asked.select("doc_id", "text", F.explode(F.filter(F.split(F.lower("text"), r"(?U)[^\p{L}]+"), lambda x: F.length(x) >= 5)).alias("token")).distinct()
    return asked.join(read, "doc_id").where(few_changes(F.col("word"), F.col("token"))).select("doc_id", "text", "token", "word")
