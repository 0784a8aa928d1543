"""Packing, whitening and alignment against the libraries and brute force, and on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmask.llm import alignment, bpe, coders, packing, queries, whitening
from quillmask.llm.scratch import Scratch
from quillmask.llm.words import as_strings
from tests.llm import cases
from tests.oracle import DATA

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = st.text(alphabet=st.sampled_from(list("ab 'sté.\n\t\r  　▁🙂1日<|endoftext>\x00")), max_size=60)


@pytest.fixture(scope="module")
def library():
    """Both tokenizers as their libraries load them; A with strings of special tokens as tokens, and as plain text."""
    special, plain = Tokenizer.from_file(A), Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    return special, plain, sentencepiece.SentencePieceProcessor(model_file=B)


@given(st.lists(st.one_of(ODD, st.sampled_from(["<|endoftext|>", "a <|endoftext|>b<|endoftext|>", ";\r {\r\n", "  x  "])), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_libraries(library, texts):
    special, plain, piece = library
    column = as_strings(pa.array(texts))
    got = [ids[at[d] : at[d + 1]].tolist() for a, b, ids, at in packing._encode(coders.file_bpe(A), column, 1) for d in range(b - a)]
    assert got == [[*special.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    spaced = as_strings(pa.array([" " + t for t in texts if t]))
    texts = [t for t in texts if t]
    for coder, want in ((coders.file_bpe(A), [plain.encode(" " + t, add_special_tokens=False).ids for t in texts]), (coders.piece_bpe(B), [piece.encode(t) for t in texts])):
        made = [ids[at[d] : at[d + 1]].tolist() for part in bpe.cut_column(spaced, bpe.BLANK) for ids, at in [coder.encode(part)] for d in range(part.b - part.a)]
        assert made == want


@given(st.lists(st.integers(1, 16), min_size=1, max_size=24), st.lists(st.integers(0, 9), min_size=24, max_size=24), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_cuts_are_the_cheapest(steps, charges, window):
    pos = np.append(0, np.cumsum(steps))
    cost = np.array([0, *charges[: len(steps)]])
    best = [0] + [10**9] * len(steps)
    for j in range(1, len(pos)):
        for i in range(j):
            n = int(pos[j] - pos[i])
            if n <= 16:
                best[j] = min(best[j], best[i] + int(cost[j]) + window + (0 if n & (n - 1) == 0 else 16 - n))
    cuts = packing.choose_cuts(pos, cost, 16, window)
    got, before = 0, 0
    for c in cuts:
        n = int(pos[c] - before)
        assert 0 < n <= 16
        got += int(cost[c]) + window + (0 if n & (n - 1) == 0 else 16 - n)
        before = pos[c]
    assert cuts[-1] == len(pos) - 1 and got == best[-1]


def check_packing(rows, ids_of, size):
    """rows (doc key, start, length, crc, doc_tokens, sequence, offset) hold each id of each document once, in gapless sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for key, start, length, crc, total, sequence, offset in rows:
        by_doc[key].append((start, length, crc, total))
        by_sequence[sequence].append((offset, length))
    assert set(by_doc) == set(ids_of)
    for key, pieces in by_doc.items():
        ids, at = np.array(ids_of[key], "<u4"), 0
        for start, length, crc, total in sorted(pieces):
            assert start == at and length > 0 and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_of_the_table(spark, library):
    got = queries.op11_packing(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: [*library[0].encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    padding = check_packing([tuple(r) for r in got], ids, 2048)
    assert padding < 0.01 * sum(map(len, ids.values()))
    report = packing.padding(spark.createDataFrame(got, queries.op11_packing(spark, DATA).schema)).first()
    assert report.padding == padding and report.tokens == sum(map(len, ids.values()))


@pytest.mark.parametrize("size,parts", [(2048, 1), (64, 3), (1, 2)])
def test_packing_of_odd_rows(spark, library, monkeypatch, size, parts):
    rows = [(n, t, *rest) for n, (_, t, *rest) in enumerate(cases.rows())] + [(99, "x <|endoftext|> y " * 40, None, None, None)]
    got = packing.pack_documents(cases.docs(spark, rows).repartition(parts), A, size=size, digest=True)
    ids = {r[0]: [*library[0].encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    check_packing([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in got.collect()], ids, size)
    whole = packing.pack_documents(cases.docs(spark, rows).repartition(parts), A, size=size)
    assert all(len(r.ids) == r.length and r.ids == ids[r.doc_id][r.start : r.start + r.length] for r in whole.collect())


def test_packing_ends_at_documents_and_sentences(spark):
    text = "A short sentence stands here. " * 30
    rows = [(i, text, None, None, None) for i in range(300)]
    got = packing.pack_documents(cases.docs(spark, rows).coalesce(1), A).collect()
    ends = [r for r in got if r.start + r.length < r.doc_tokens]
    dot = Tokenizer.from_file(A).encode(".", add_special_tokens=False).ids[0]
    assert ends and all(r.ids[-1] == dot for r in ends[:-12])  # at the end of a partition cuts are free


def test_empty_tables_and_clashing_names(spark):
    none = cases.empty(spark)
    assert packing.pack_documents(none, A).count() == 0
    made, counts = alignment.align_tokenizers(none, A, B, Scratch(spark, "t"))
    assert made.count() == 0 and counts.count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    for call in (lambda: packing.pack_documents(none.withColumn("start", F.lit(1)), A), lambda: alignment.align_tokenizers(none.withColumn("_at", F.lit(1)), A, B, Scratch(spark, "t")),
                 lambda: alignment.align_tokenizers(none.withColumn("n_best", F.lit(1)), A, B, Scratch(spark, "t")), lambda: whitening.whiten(spark.createDataFrame([], "n long, embedding array<float>"))):
        with pytest.raises(ValueError):
            call()


def aligned(texts, library):
    """Per text the numbers that alignment is to give, by sets of bytes and loops."""
    _, plain, piece = library
    chars = {c: b for b, c in enumerate(bpe.byte_characters())}
    made = []
    for t in texts:
        want = (" " + (t or "")).encode()
        a = [(i, bytes(chars[c] for c in plain.id_to_token(i))) for i in plain.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode()) for i in piece.encode(t)] if t else []
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a, b = [], []
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, left = [], [iter(side) for side in spans]
        for end in both:
            sides = []
            for side in left:
                own = []
                while not own or own[-1][2] < end:
                    own.append(next(side))
                sides.append(",".join(str(i) for i, _, _ in own))
            groups.append("|".join(sides))
        links, low = [], 0
        for i, s, e in spans[0]:
            while low < len(spans[1]) and spans[1][low][2] <= s:
                low += 1
            at = low
            while at < len(spans[1]) and spans[1][at][1] < e:
                links.append((i, spans[1][at][0]))
                at += 1
        made.append((len(a), len(b), len(both), links, ";".join(groups)))
    count = Counter(p for m in made for p in m[3])
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(na, nb, ng, len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls), text) for na, nb, ng, ls, text in made], count


def test_alignment_of_odd_rows(spark, library):
    texts = ["<|endoftext|> <s> <0x41> </s>", "a▁b", " lead", "\nline\r\nnext;\r end ", "日本。 ok 🙂🙂", "ﬁ Ａ ½", "\x00a", " ", "  ", "x"] * 2
    rows = [(i, t, None, None, None) for i, t in enumerate([r[1] for r in cases.rows()] + texts)]
    made, counts = alignment.align_tokenizers(cases.docs(spark, rows).repartition(3), A, B, Scratch(spark, "t"))
    want, count = aligned([r[1] for r in rows], library)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in made.collect()}
    assert got == dict(enumerate(want)) and {w[0] for w in want if w[0]} and any(t and not w[0] for (_, t, *_), w in zip(rows, want, strict=True))
    assert {(r.a, r.b): r["count"] for r in counts.collect()} == dict(count)


def test_alignment_of_the_table(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want, _ = aligned([r.text for r in docs], library)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in queries.op13_alignment(spark, DATA).collect()}
    assert got == {d.doc_id: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for d, w in zip(docs, want, strict=True)}


def brute(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    value, vector = np.linalg.eigh(y.T @ y / n)
    return x, n, s, y, value[::-1], vector[:, ::-1]


def held(rows, vectors, k):
    """Rows of whiten() against an eigenvalue decomposition; vectors by id."""
    x, n, s, y, value, vector = brute(list(vectors.values()))
    place = {v: i for i, v in enumerate(vectors)}
    got = np.full((n, k), np.nan)
    for r in rows:
        i = place[r.vec_id]
        got[i, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s, strict=True))
        assert r.explained == pytest.approx(value[r.component - 1] / value.sum(), rel=1e-9) and r.identity_error < 1e-9
    want = y @ vector[:, :k] / np.sqrt(value[:k])
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-6
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").where("embedding is not null").collect()
    vectors = {r.vec_id: r.embedding for r in rows if all(v is not None and np.isfinite(v) for v in r.embedding)}
    got = queries.op12_whitening(spark, DATA).collect()
    assert len(got) == 32 * len(vectors)
    held(got, vectors, 32)


@pytest.mark.parametrize("steep", [True, False])
def test_range_finder_stops_early_or_takes_all_dimensions(spark, monkeypatch, steep):
    rng = np.random.default_rng(5)
    scale = 0.5 ** np.arange(40) if steep else np.linspace(1.1, 1, 40)
    vectors = {i: [float(v) for v in row] for i, row in enumerate((rng.standard_normal((400, 40)) * scale * 4000) @ np.linalg.qr(rng.standard_normal((40, 40)))[0])}
    widths, before = [], whitening.summed
    monkeypatch.setattr(whitening, "summed", lambda rows, make, size: (widths.append(make.keywords["basis"].shape[1]), before(rows, make, size))[1])
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(5)
    held(whitening.whiten(df, k=4, oversample=8).collect(), vectors, 4)
    assert (max(widths[:-1]) == 12) if steep else (widths[-2] == 40 and 12 in widths)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [0.0, 0.0, 0.0]), (7, [3.0, -2.0, 1.0]), (7, [3.0, -2.0, 1.0]), (None, [-1.0, 5.0, 2.0]), (8, []), (9, [1.0, 2.0]), (10, [-0.01, 4.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("other", F.lit("x"))).collect()
    assert Counter(r.vec_id for r in got) == {1: 3, 6: 3, 7: 6, None: 3, 10: 3} and {r.other for r in got} == {"x"} and {r.n for r in got} == {6}
    assert max(r.identity_error for r in got) < 1e-12
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
    two = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert Counter(r.component for r in whitening.whiten(two).collect()) == {1: 9}


def test_sums_and_deviations_beyond_doubles(spark):
    big = 2**45
    x = np.array([[big, -big], [big + 64, 3], [0, big]], np.int64)
    centre = whitening.Centre(3, [int(v) for v in x.sum(axis=0)])
    with pytest.raises(OverflowError):
        centre.deviation(x)
    small = np.array([[10**6 + i, 10**6 - 3 * i] for i in range(7)], np.int64)
    centre = whitening.Centre(7, [int(v) for v in small.sum(axis=0)])
    assert centre.deviation(small).tolist() == [sum((7 * int(a) - s) ** 2 for a, s in zip(row, centre.total, strict=True)) for row in small]
    with pytest.raises(ValueError):
        whitening.whole(pa.array([[1e300]]), 64, 0)
