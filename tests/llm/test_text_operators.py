"""Operators that read one text at a time, and the ones that compare texts, against brute force and on odd rows."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmask.llm import bpe, fertility, graph, langid, mixing, ngram_join, quality, queries, stream, substring
from quillmask.llm.graph import connected_components
from quillmask.llm.scratch import Scratch
from quillmask.llm.textstats import TextStats
from quillmask.llm.words import Words, as_strings
from tests.llm import cases
from tests.oracle import DATA

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BOTH = [(public_tokenizers.path(f), public_tokenizers.PATTERN) for f in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]


@pytest.fixture(scope="module")
def coder():
    return bpe.bpe(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    w = Words(as_strings(pa.array(texts, pa.string())))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.first[d] : w.first[d + 1]], w.stop[w.first[d] : w.first[d + 1]])] for d in range(len(texts))]
    assert got == [cases.words(t) for t in texts]


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab 'sté\n\t  　🙂.1日")), max_size=60), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_tiktoken(coder, tiktoken_encoding, texts):
    got = [ids[at[d] : at[d + 1]].tolist() for a, b, ids, at in coder.encode_column(as_strings(pa.array(texts))) for d in range(b - a)]
    assert got == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    assert [coder.decode(np.array(x, np.int32)).decode() for x in got] == texts


def test_split_characters_come_out_whole(coder):
    text = "x🙂é日本"
    ids = [i for i, _, _ in coder.offsets(text)]
    assert "".join(coder.decode_steps(ids)) == text and "�" not in "".join(coder.decode_steps(ids))
    assert all(0 <= a <= b <= len(text) for _, a, b in coder.offsets(text))


def test_encode_and_decode_tables(spark, tiktoken_encoding):
    docs = cases.docs(spark)
    out = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert all(list(r.ids) == tiktoken_encoding.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "") for r in out)
    digests = bpe.bpe_digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = Counter((r.doc_id, len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == want
    assert bpe.bpe_digests(cases.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.bpe_encode(docs.withColumn("ids", F.lit(1)), RANKS, public_tokenizers.PATTERN)


def thue_morse(n=2048):
    """Two words that polynomial hashes modulo 2^64 cannot tell apart, whatever their base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_defeat_polynomial_hashes(spark, coder, tiktoken_encoding):
    one, two = thue_morse()
    w = Words(as_strings(pa.array([one, two, one])))
    for which in (0, 1):
        h = w.hashes(which).tolist()
        assert h[0] == h[2] != h[1]
    got = [ids[at[d] : at[d + 1]].tolist() for a, b, ids, at in coder.encode_column(as_strings(pa.array([one, two, one]))) for d in range(b - a)]
    assert got == [tiktoken_encoding.encode_ordinary(t) for t in (one, two, one)]
    # as words of a text: letters a and b become words
    rows = [(0, " ".join(one[:1024]), None, None, None), (1, " ".join(two[:1024]), None, None, None), (2, f"{one} {two} " * 30, None, None, None), (3, f"{one} {one} " * 30, None, None, None), (4, f"{one}\n{two}\n{one}", None, None, None)]
    texts = [r[1] for r in rows]
    cut = {r.doc_id: (r.n_removed, r.kept) for r in substring.remove_repeated_spans(cases.docs(spark, rows), Scratch(spark, "t")).collect()}
    assert cut == {i: (sum(gone), " ".join(x for x, g in zip(w, gone) if not g)) for i, (w, gone) in enumerate(cases.repeated(texts))}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_groups(cases.docs(spark, rows), Scratch(spark, "t")).collect()}
    assert got == cases.components([(i, t) for i, t, *_ in rows])
    s = TextStats(as_strings(pa.array(texts)))
    assert s.n_dup_lines.tolist() == [0, 0, 0, 0, 1] and s.n_repeat_words[2:4].tolist() == [60, 60]


def test_pieces_that_share_a_hash_are_compared_by_their_bytes(coder, tiktoken_encoding, monkeypatch):
    hashed = bpe.range_hash
    monkeypatch.setattr(bpe, "range_hash", lambda *x: hashed(*x) % np.uint64(5))
    texts = [f"some words of text {i} with ends {i * 7} and é{i}" for i in range(60)]
    got = [ids[at[d] : at[d + 1]].tolist() for a, b, ids, at in coder.encode_column(as_strings(pa.array(texts))) for d in range(b - a)]
    assert got == [tiktoken_encoding.encode_ordinary(t) for t in texts]


def _shares(sizes, p, levels, runs=400):
    """Which documents of one source are taken, over many seeds; levels is the number of groups at each level."""
    import pandas as pd

    taken = np.zeros((runs, len(sizes)))
    rng = np.random.default_rng(9)
    for i in range(runs):
        draw = rng.integers(-(2**63), 2**63 - 1, len(sizes))
        rows = pd.DataFrame({"rid": np.arange(len(sizes)), "draw64": draw, "size": sizes, "p": np.full(len(sizes), p), "g": draw % levels[0]})
        for level, groups in enumerate(levels):
            last = level == len(levels) - 1
            open_ = rows[(rows.p > 0) & (rows.p < 1)]
            made = pd.concat([mixing._group(part, level, last) for _, part in open_.groupby(open_.g % groups)])
            rows = pd.concat([rows[(rows.p <= 0) | (rows.p >= 1)], made])
        assert set(np.unique(rows.p)) <= {0.0, 1.0}
        taken[i, rows.rid[rows.p == 1]] = 1
    return taken


@pytest.mark.parametrize("levels", [(1,), (16, 4, 1)])
@pytest.mark.parametrize("tied", [True, False])
def test_each_document_is_taken_as_often_as_it_should_be(levels, tied):
    n, p, runs = 128, 0.3, 400
    sizes = np.repeat([5, 20, 80, 300], n // 4) if tied else np.arange(3, 3 + n)
    got = _shares(sizes, p, levels, runs)
    for part in np.array_split(np.argsort(sizes, kind="stable"), 4):  # small ones go together, so their mean varies more than that of independent ones
        each = got[:, part].mean(axis=1)
        assert abs(each.mean() - p) < 3 * each.std() / np.sqrt(runs) + 1e-3
    assert abs(got.mean(axis=0) - p).max() < 4.5 * np.sqrt(p * (1 - p) / runs)
    assert np.abs(got @ sizes - p * sizes.sum()).max() <= sizes.max()


def test_sizes_and_targets_of_the_mix_are_those_of_sql(spark):
    """The part of the query that SQL can state: sizes, sizes of sources and targets (here 20 rounds of sharing out again)."""
    from tests.oracle import connect

    sql = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
     s AS (SELECT source, sum(size)::DOUBLE AS n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
     r(step, source, n, w, shut) AS (SELECT 0, source, n, w, false FROM s UNION ALL
        SELECT step + 1, source, n, w, shut OR w * (1.5 * sum(n) OVER () - coalesce(sum(2 * n) FILTER (shut) OVER (), 0)) / nullif(sum(w) FILTER (NOT shut) OVER (), 0) > 2 * n FROM r WHERE step < 20),
     t AS (SELECT source, n, CASE WHEN shut THEN 2 * n ELSE w * (1.5 * sum(n) OVER () - coalesce(sum(2 * n) FILTER (shut) OVER (), 0)) / sum(w) FILTER (NOT shut) OVER () END AS target FROM r WHERE step = 20)
SELECT doc_id, size, n, target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""
    want = {r[0]: r[1:] for r in connect().execute(sql).fetchall()}
    got = queries.op1_mix_sources(spark, DATA).collect()
    assert len(got) == len(want) and all((r["size"], r.source_size) == want[r.doc_id][:2] and abs(r.target - want[r.doc_id][2]) < 1e-6 * max(1, r.target) and r.taken <= 2 * r["size"] for r in got)


def test_rows_that_repeat_share_out_their_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(1, "a b c", None, "x", None)] * 101 + [(2, "d e", None, "x", None), (None, "d e", None, "y", None), (None, "d e", None, "y", None)]
    got = mixing.mix_sources(cases.docs(spark, rows), Scratch(spark, "t")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for name in (305, 4):
        some = [r for r in got if r.source_size == name]
        assert abs(sum(r.taken for r in some) - some[0].target) <= 3 and len({r.copies for r in some}) <= 2


def test_digests_of_the_table_are_those_of_tiktoken(spark, tiktoken_encoding):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op2_byte_bpe(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_ids_stay_right_when_pieces_are_forgotten(tiktoken_encoding, monkeypatch):
    """Pieces known from earlier parts, and more of them than are kept."""
    monkeypatch.setattr(bpe, "KNOWN", 50)
    own = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    r = random.Random(3)
    for _ in range(6):
        texts = [" ".join(r.choice(("alpha", "beta é", "γ", f"n{r.randrange(60)}")) for _ in range(40)) for _ in range(3)] + [""]
        got = [ids[at[d] : at[d + 1]].tolist() for a, b, ids, at in own.encode_column(as_strings(pa.array(texts))) for d in range(b - a)]
        assert got == [tiktoken_encoding.encode_ordinary(t) for t in texts] and len(own._known.hashes) <= 50


def test_encoding_takes_memory_by_its_parts_and_not_by_the_batch(coder):
    """4 MB of text at once took 96 MB beside it; an executor has two such workers, and a JVM that has grown in earlier stages."""
    r = random.Random(7)
    texts = [" ".join(f"w{r.randrange(90_000)}" for _ in range(3000)) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    try:
        n = sum(x.num_rows for x in bpe._round_trip(iter([batch]), RANKS, public_tokenizers.PATTERN, 0, ["n_tokens", "ids_sha256", "decoded_sha256"]))
        assert n == 500 and tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


def test_clashing_names_are_refused_and_extra_columns_stay(spark):
    docs = cases.docs(spark).withColumn("extra", F.lit("kept"))
    model, scorer = langid.train_language(docs), quality.AdditiveModel().fit(np.zeros((0, 13)), np.zeros(0))
    pattern = public_tokenizers.PATTERN
    made = {
        "n_tokens": lambda d: bpe.bpe_digests(d, RANKS, pattern), "decoded": lambda d: bpe.bpe_decode(bpe.bpe_encode(d, RANKS, pattern), RANKS, pattern), "lang_score": lambda d: langid.predict_language(d, model),
        "score": lambda d: quality.score_quality(d, scorer), "kept": lambda d: fertility.fertility_rules(d, BOTH), "_marks": lambda d: substring.remove_repeated_spans(d, Scratch(spark, "t")),
    }
    for name, run in made.items():
        out = run(docs).collect()
        assert len(out) == len(cases.rows()) and all(r.extra == "kept" for r in out)
        with pytest.raises(ValueError):
            run(docs.withColumn(name, F.lit(1)))


def test_repeated_texts_are_judged_alike(spark):
    """Ties and repeats: the same text gets the same verdict wherever it stands, however long it is."""
    rows = [(i, (cases.BASE, cases.LONG, "x y", "")[i % 4], "en", "s", None) for i in range(40)]
    docs = cases.docs(spark, rows).repartition(5)
    model, scorer = langid.train_language(docs), quality.train_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    for out in (langid.predict_language(docs, model).select("doc_id", "lang_pred", "lang_score"), quality.score_quality(docs, scorer).select("doc_id", "score"), fertility.fertility_rules(docs, BOTH).drop("lang", "source", "n_chars")):
        by = {}
        for r in out.collect():
            by.setdefault(r.doc_id % 4, set()).add(tuple(r)[1:])
        assert len(by) == 4 and all(len(v) == 1 for v in by.values())


def test_mix_comes_near_its_targets_and_agrees_with_itself(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice((0, 1, 3, 40, 200, 900))), None, ("a", "b", None, "c")[min(3, int(r.random() * 6))], None) for i in range(900)]
    docs = cases.docs(spark, rows)
    got = mixing.mix_sources(docs, Scratch(spark, "t")).collect()
    size = {i: len(cases.words(t)) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    total = Counter()
    for i in size:
        total[source[i]] += size[i]
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    left, open_, target = 1.5 * sum(total.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * total[s]]
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2 * total[s]
            left -= target[s]
            open_.discard(s)
    taken = Counter()
    for x in got:
        assert x["size"] == size[x.doc_id] and x.source_size == total[source[x.doc_id]]
        assert abs(x.target - target[source[x.doc_id]]) < 1e-6 * max(1, x.target) and x.taken == x.copies * x["size"] <= 2 * x["size"]
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - target[s]) <= 5 + 0.002 * target[s] for s in order)
    again = mixing.mix_sources(docs.repartition(7), Scratch(spark, "t")).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_groups_of_a_mix_hand_on_and_end(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 16)
    rows = [(i, "w " * (1 + i % 60), None, "hot" if i % 3 else "b", None) for i in range(1500)]
    got = mixing.mix_sources(cases.docs(spark, rows), Scratch(spark, "t"), weights=(1, 1)).groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.count("*").alias("c")).collect()
    assert sum(r.c for r in got) == 1500 and all(abs(r.t - r.n) <= 3 for r in got)


def test_mix_on_odd_rows(spark):
    got = mixing.mix_sources(cases.docs(spark), Scratch(spark, "t")).collect()
    assert len(got) == len(cases.rows()) and all(r.taken == 0 for r in got if not r["size"])
    assert mixing.mix_sources(cases.empty(spark), Scratch(spark, "t")).count() == 0
    blank = cases.docs(spark, [(1, None, None, "a", None), (2, "", None, None, None)])
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix_sources(blank, Scratch(spark, "t")).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_spans_against_brute_force(spark):
    r = random.Random(1)
    vocabulary = [f"t{i}" for i in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(90)]
    texts = []
    for _ in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        if r.random() < 0.6:
            a = r.randint(0, 40)
            w[r.randint(0, len(w)) : 0] = passage[a : a + r.randint(20, 50)]
        texts.append(r.choice((" ", "\n", "  ")).join(w))
    texts += ["same same " * 40, "x y z " * 30, " ".join(passage)]
    every = [*cases.rows(), *[(100 + i, t, None, None, None) for i, t in enumerate(texts)]]
    docs = cases.docs(spark, every).withColumn("extra", F.lit("kept"))
    got = substring.remove_repeated_spans(docs, Scratch(spark, "t")).collect()
    want = Counter((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)) for (i, *_), (w, gone) in zip(every, cases.repeated([t for _, t, *_ in every])))
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got) == want and all(x.extra == "kept" for x in got)
    assert any(n for _, _, n, _ in want) and substring.remove_repeated_spans(cases.empty(spark), Scratch(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeated_spans(docs.withColumn("kept", F.lit(1)), Scratch(spark, "t"))


def test_long_repeats_are_compacted_to_few_spans(spark, monkeypatch):
    """A passage of 1,000 words in three texts is one path of the graph, a branch in it makes three."""
    r = random.Random(5)
    fill = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage = fill(1000)
    texts = [[*fill(60), *passage, *fill(60)], [*passage, *fill(100)], [*fill(20), *passage]]
    made, compact = [], substring._compact

    def compacted(vertices, scratch):
        chains = compact(vertices, scratch)
        made.append(sorted(r.total for r in chains.collect()))
        return chains

    monkeypatch.setattr(substring, "_compact", compacted)
    for texts, want in ((texts, [1000 - 34]), ([*texts, [*fill(50), *passage[300:400], *fill(50)]], [100 - 34, 300, 600])):
        rows = [(i, " ".join(t), None, None, None) for i, t in enumerate(texts)]
        got = {x.doc_id: (x.n_removed, x.kept) for x in substring.remove_repeated_spans(cases.docs(spark, rows), Scratch(spark, "t")).collect()}
        assert got == {i: (sum(gone), " ".join(x for x, g in zip(w, gone) if not g)) for i, (w, gone) in enumerate(cases.repeated([x[1] for x in rows]))}
        assert made.pop() == want


def test_spans_that_only_hashes_share_are_found_out(spark, monkeypatch):
    """With the first set of hashes cut to a few bits windows collide; the words at their coordinates do not, so others are used."""
    graphs, graph_of = [], substring._graph
    fake = lambda texts, scratch, k, anchor, seed: graphs.append(seed) or graph_of(texts, scratch, k, anchor, seed)
    monkeypatch.setattr(substring, "_graph", fake)
    prove = substring._prove
    monkeypatch.setattr(substring, "_prove", lambda batches, k: ((b if len(graphs) > 1 else _wrong(b)) for b in prove(batches, k)))
    rows = [(i, cases.BASE + f" {i}", None, None, None) for i in range(3)]
    got = substring.remove_repeated_spans(cases.docs(spark, rows), Scratch(spark, "t")).collect()
    assert graphs == [0, 1] and [x.n_removed for x in sorted(got)] == [len(cases.words(cases.BASE))] * 3


def _wrong(batch):
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(batch.num_rows), pa.int64()), batch.column(2)], ["chain", "d1", "d2"])


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # several blocks per column
    monkeypatch.setattr(stream, "FEW", 0)  # ids are joined, not broadcast
    r = random.Random(2)
    vocabulary = [f"t{i}" for i in range(500)]
    base = [r.choice(vocabulary) for _ in range(130)]
    rows = []
    for i in range(140):
        w = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3, 4, 6))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w), None, None, None))
    rows += [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60))), None, None, None) for i in range(60)]
    rows += [(2000 + i, t, a, b, c) for i, (_, t, a, b, c) in enumerate(cases.rows()) if i < 15]
    for k, num in ((3, 90), (5, 80)):
        got = ngram_join.ngram_jaccard_groups(cases.docs(spark, rows), Scratch(spark, "t"), k=k, num=num).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == cases.components([(i, t) for i, t, *_ in rows], k, num)


def test_groups_on_odd_rows(spark):
    got = ngram_join.ngram_jaccard_groups(cases.docs(spark), Scratch(spark, "t")).collect()
    assert len(got) == len(cases.rows())
    assert all(x.component_id == x.doc_id for x in got if x.n_shingles == 0)
    assert {x.component_id for x in got if x.doc_id in (0, 1, 12)} == {0}
    assert ngram_join.ngram_jaccard_groups(cases.empty(spark), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("small", [0, 200_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "x long, y long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "x long, y long"), Scratch(spark, "t")).count() == 0


def test_counts_against_brute_force():
    texts = [t or "" for _, t, *_ in cases.rows()] + ["a\n\na\n a\nb\nb ", "# $ | <b>\n# $ | <b>", "p q r s t u v w " * 3]
    s = TextStats(as_strings(pa.array(texts)))
    for i, t in enumerate(texts):
        w, seen, dup = cases.words(t), set(), 0
        for line in t.split("\n"):
            if cases.words(line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = [False] * len(w)
        for j in range(len(w) - 7):
            if count[tuple(w[j : j + 8])] > 1:
                hit[j : j + 8] = [True] * 8
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, sum(hit))
        assert (s.n_words[i], s.word_chars[i], s.n_symbols[i], s.n_dup_lines[i], s.n_repeat_words[i]) == want


def test_fertility_rules(spark):
    clean = [(i, cases.BASE + f" and number {i} goes on", None, None, None) for i in range(3)]
    junk = [(10, "aa### bb*** cc%%% dd$$$ " * 20, None, None, None), (11, " ".join("x" * 1 for _ in range(25)), None, None, None)]
    got = {r.doc_id: r for r in fertility.fertility_rules(cases.docs(spark, clean + junk), [(RANKS, public_tokenizers.PATTERN)]).collect()}
    assert all(got[i].kept and not got[i].base_failed for i in range(3)) and not got[10].kept and not got[11].kept
    odd = fertility.fertility_rules(cases.docs(spark), [(RANKS, public_tokenizers.PATTERN)]).collect()
    assert len(odd) == len(cases.rows()) and all(r.base_failed and not r.kept for r in odd if r.n_words < 20)
    assert fertility.fertility_rules(cases.empty(spark), [(RANKS, public_tokenizers.PATTERN)]).count() == 0


#: Clean texts of scripts of two and three bytes a letter, with and without spaces between words.
SCRIPT_TEXTS = {
    "cyrillic": "Утром мы вышли из дома и пошли к реке, где старый мельник уже ждал нас у воды. Он рассказал, что зимой лёд был очень толстым, а весной вода поднялась выше моста и долго не уходила с полей.",
    "greek": "Το πρωί βγήκαμε από το σπίτι και πήγαμε στο ποτάμι, όπου ο γέρος μυλωνάς μας περίμενε ήδη δίπλα στο νερό. Μας είπε ότι τον χειμώνα ο πάγος ήταν πολύ χοντρός και την άνοιξη το νερό ανέβηκε πάνω από τη γέφυρα.",
    "devanagari": "सुबह हम घर से निकले और नदी की ओर चले गए, जहाँ बूढ़ा किसान पानी के पास हमारा इंतज़ार कर रहा था। उसने बताया कि इस साल बारिश बहुत अच्छी हुई है और खेतों में फसल पहले से अधिक है, इसलिए गाँव के सब लोग खुश हैं।",
    "thai": "เช้านี้เราออกจากบ้านและเดินไปที่แม่น้ำ ซึ่งชายชราคนหนึ่งกำลังรอเราอยู่ใกล้น้ำ เขาเล่าว่าปีนี้ฝนตกดีมากและข้าวในนามีมากกว่าปีก่อน ทุกคนในหมู่บ้านจึงมีความสุข",
    "hangul": "아침에 우리는 집을 나와 강으로 걸어갔고 그곳에서 나이 많은 농부가 물가에서 우리를 기다리고 있었다. 그는 올해 비가 많이 와서 논의 벼가 작년보다 잘 자랐고 그래서 마을 사람들이 모두 기뻐한다고 말했다.",
    "chinese": "早上我们从家里出来,走到河边,那里有一位老人正在水边等着我们。他告诉我们,今年的雨水很好,田里的粮食比去年多,所以村里的人都很高兴。后来大家一起回到村子,吃了晚饭,又说了很久的话。",
    "japanese": "朝、私たちは家を出て川まで歩いて行きました。そこでは年を取った農家の人が水のそばで私たちを待っていました。今年は雨がよく降ったので、田んぼの米が去年より多く、村の人はみんな喜んでいると話してくれました。",
}


def test_letters_are_counted_by_code_point():
    texts = [*SCRIPT_TEXTS.values(), cases.BASE, "", "12 34", "é日a本ა", "𠀀 😀"]
    column = as_strings(pa.array(texts))
    got = fertility.letters_by_script(*fertility.offsets_of(column))
    names = list(fertility.SCRIPTS)
    assert [names[i] for i in got[:8].argmax(axis=1)] == ["cyrillic", "greek", "devanagari", "thai", "hangul", "east_asian", "east_asian", "latin"]
    assert got[7].sum() == sum(c.isalpha() for c in cases.BASE) and got[8:10].sum() == 0
    assert {names[i]: int(n) for i, n in enumerate(got[10]) if n} == {"latin": 2, "east_asian": 2, "other": 1}
    assert got[11].sum() == 1 and got[11][names.index("east_asian")] == 1


#: Scripts whose words are not set apart by spaces: the base rules count one or two words in such texts.
UNSPACED = ("thai", "chinese", "japanese")


def test_fertility_keeps_clean_texts_of_other_scripts(spark):
    rows = [(i, t, k, None, None) for i, (k, t) in enumerate(SCRIPT_TEXTS.items())]
    got = {r.lang: r for r in fertility.fertility_rules(cases.docs(spark, rows), [(RANKS, public_tokenizers.PATTERN)]).collect()}
    assert {k: (r.kept, r.base_failed) for k, r in got.items()} == {k: (k not in UNSPACED, k in UNSPACED) for k in SCRIPT_TEXTS}
    assert all(got[k].likely_words >= 20 > got[k].n_words for k in UNSPACED) and all(got[k].likely_words == got[k].n_words for k in SCRIPT_TEXTS if k not in UNSPACED)


def test_fertility_rejects_random_letters_of_scripts_that_are_known(spark):
    rng, texts = random.Random(4), {k: t for k, t in SCRIPT_TEXTS.items()}
    texts["arabic"] = "في الصباح خرجنا من البيت وذهبنا إلى النهر حيث كان الفلاح العجوز ينتظرنا قرب الماء وقال لنا إن المطر هذا العام كان كثيرا وإن القمح في الحقول أكثر من العام الماضي ولذلك فإن أهل القرية كلهم سعداء"
    texts["hebrew"] = "בבוקר יצאנו מהבית והלכנו אל הנהר, שם חיכה לנו האיכר הזקן ליד המים. הוא סיפר לנו שהשנה ירד הרבה גשם ושהחיטה בשדות גבוהה יותר מאשר בשנה שעברה, ולכן כל אנשי הכפר שמחים מאוד."
    texts["latin"] = cases.BASE
    texts["georgian"] = "დილით ჩვენ სახლიდან გამოვედით და მდინარისკენ წავედით, სადაც მოხუცი გლეხი წყალთან გველოდებოდა. მან გვითხრა, რომ წელს კარგი წვიმები იყო და მინდვრებში მოსავალი გაცილებით მეტია, ამიტომ სოფელში ყველა ძალიან გახარებულია და მადლობელი."
    rows, known = [], [k for k in texts if k != "georgian"]
    for k, t in texts.items():
        letters = [c for a, b in fertility.SCRIPTS.get(k, ((0x4E00, 0x9FA0),)) for c in map(chr, range(a, b + 1)) if c.isalpha()]
        noise = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(60)) if k in known else " ".join("ა" for _ in range(60))
        rows += [(len(rows), t, "clean", k, None), (len(rows) + 1, noise, "noise", k, None)]
    got = {(r.source, r.lang): r.kept for r in fertility.fertility_rules(cases.docs(spark, rows), BOTH).collect()}
    assert got == {(k, kind): kind == "clean" and k not in UNSPACED for k in texts for kind in ("clean", "noise")}


def test_fertility_holds_texts_to_the_bands_of_each_vocabulary(spark):
    rows = cases.docs(spark, [(0, SCRIPT_TEXTS["cyrillic"], None, None, None)])
    open_, shut = {"other": fertility.Band(0, 9, 1, 0)}, {"other": fertility.Band(0, 9, 1, 0), "cyrillic": fertility.Band(3, 9, 1, 0)}
    assert [fertility.fertility_rules(rows, BOTH, b).first().kept for b in ([open_, open_], [shut, open_], [open_, shut])] == [True, False, False]
    with pytest.raises(ValueError):
        fertility.fertility_rules(rows, [("unknown.tiktoken", public_tokenizers.PATTERN)])


def test_query_measures_two_vocabularies(spark, monkeypatch):
    used = []
    monkeypatch.setattr(queries, "fertility_rules", lambda docs, vocabularies: used.extend(vocabularies))
    queries.op10_fertility(spark, DATA)
    assert used == BOTH


def test_measures_and_verdict_against_brute_force(spark):
    """Characters per token, share of tokens that hold part of a character, entropy, and what the bands make of them."""
    import math

    import tiktoken

    texts = [cases.BASE + " , . I 日本 é", *SCRIPT_TEXTS.values(), "aa### bb*** cc%%% dd$$$ " * 20, cases.LONG, "🙂 " * 40]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fertility.fertility_rules(cases.docs(spark, rows), BOTH).collect()}
    kept = {i: not got[i].base_failed for i in range(len(texts))}
    for path, pattern in BOTH:
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
        bands = fertility.BANDS[path.rpartition("/")[2]]
        for i, t in enumerate(texts):
            ids = coder.encode_ordinary(t)
            parts = sum("\ufffd" in coder.decode_single_token_bytes(x).decode(errors="replace") for x in ids)
            entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values()) / min(9, max(1, math.log2(len(ids))))
            letters = fertility.letters_by_script(*fertility.offsets_of(as_strings(pa.array([t]))))[0]
            script = list(fertility.SCRIPTS)[letters.argmax()] if letters.any() else "other"
            band = bands.get(script, bands["other"])
            measured = (len(t) / len(ids), parts / len(ids), entropy)
            kept[i] &= band.low <= measured[0] <= band.high and measured[1] <= band.fallback and measured[2] >= band.entropy
            if path.endswith("multi_50k.tiktoken"):
                assert np.allclose(measured, (got[i].chars_per_token, got[i].fallback_share, got[i].token_entropy))
    assert {i: r.kept for i, r in got.items()} == kept and len(set(kept.values())) == 2


def test_a_comma_is_no_byte_fallback(coder):
    _, _, share, _ = fertility.fertility(coder, as_strings(pa.array([", . I a , . !"])))
    assert share[0] == 0


def test_rules_keep_clean_documents_of_the_table_and_reject_junk(spark):
    rows = queries.op10_fertility(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("not base_failed and quality is not null").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.5


BASE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS j FROM w),
     wide AS (SELECT doc_id, j, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM each WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
     again AS (SELECT doc_id, j FROM (SELECT doc_id, j, count(*) OVER (PARTITION BY doc_id, s) AS c FROM wide WHERE n = 8) WHERE c > 1),
     hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(j, j + 8)) AS k FROM again) GROUP BY doc_id),
     line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
     dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(ws), length(array_to_string(ws, '')), len(regexp_extract_all(t, '[#*$%&|<>]')), coalesce(dup.n, 0), coalesce(hit.n, 0), len(ws) < 20 OR 100 * coalesce(hit.n, 0) > 30 * len(ws)
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN dup USING (doc_id)"""


def base(rows):
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows.collect())


def test_base_counts_are_those_of_sql(spark):
    from tests.oracle import connect

    assert base(queries.op10_fertility(spark, DATA)) == Counter(connect().execute(BASE_SQL).fetchall())


def test_base_counts_of_texts_without_spaces_are_those_of_sql(spark):
    import duckdb

    texts = [*SCRIPT_TEXTS.values(), *(SCRIPT_TEXTS[k] * 5 for k in UNSPACED), " ".join([SCRIPT_TEXTS["thai"]] * 25), "\n".join(list(SCRIPT_TEXTS["chinese"]) * 2), cases.BASE, None, ""]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert base(fertility.fertility_rules(cases.docs(spark, rows), BOTH)) == Counter(con.execute(BASE_SQL).fetchall())


def test_language_of_texts_of_any_length(spark):
    """Held-out texts alone and many put together: sets are exact, so that a very long text is told apart as well."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null and text is not null")
    out = "pmod(crc32(cast(doc_id as string)), 5) = 0"
    model = langid.train_language(docs.where(f"not ({out})"))
    joined = docs.where(out).groupBy("lang").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).select(F.lit(1).alias("doc_id"), "text", "lang", F.lit(None).cast("string").alias("source"), F.lit(1).alias("n_chars"))
    assert joined.agg(F.min(F.size(F.split("text", " ")))).first()[0] > 5_000
    assert all(r.lang_pred == r.lang for r in langid.predict_language(joined, model).collect())
    with pytest.raises(ValueError):
        langid.predict_language(docs.withColumn("lang_pred", F.lit("")), model)


def test_kernel_scores_are_those_of_sets():
    """The collapsed product against kernels computed from Python sets, texts one by one."""
    texts = [cases.BASE, "der schnelle braune fuchs springt", "le renard brun saute", "", "ab", cases.BASE[:90], "die eule wacht am fluss", "le bateau rentre au moulin"]
    languages = ["en", "de", "fr", "fr", "en", "en", "de", "fr"]

    def grams(t):
        b = bytes(x + 32 if 65 <= x <= 90 else 32 if 9 <= x <= 13 else x for x in t.encode())
        return {b[i : i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1)}

    row, gram = langid.ngrams(as_strings(pa.array(texts)))
    sets = np.split(gram, np.searchsorted(row, np.arange(1, len(texts))))
    assert [len(s) for s in sets] == [len(grams(t)) for t in texts]
    model = langid.KernelClassifier.fit(sets, languages)
    marks = texts if len(texts) <= langid.LANDMARK else texts[:: langid.LANDMARK]
    kernel = lambda xs: np.array([[len(grams(x) & grams(m)) / np.sqrt(max(1, len(grams(x))) * max(1, len(grams(m)))) for m in marks] for x in xs])
    value, vector = np.linalg.eigh(kernel(marks))
    white = vector / np.sqrt(np.maximum(value, 1e-6))
    z, known = kernel(texts) @ white, sorted(set(languages))
    target = np.array([[x == k for k in known] for x in languages], float)
    want = z @ np.linalg.solve(z.T @ z + 1e-2 * np.eye(z.shape[1]), z.T @ target)
    new = ["der fuchs wacht", "the owl watches the river", cases.BASE * 50]
    row, gram = langid.ngrams(as_strings(pa.array(texts + new)))
    best, y = model.score(row, gram, len(texts + new), model.table())
    y = y / np.sqrt(np.maximum(np.bincount(row, minlength=len(texts + new)), 1))[:, None]
    assert np.allclose(y[: len(texts)], want, atol=1e-4) and [known[i] for i in best[-3:]] == ["de", "en", "en"]


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert np.allclose(quality.AdditiveModel().fit(x[:0], y[:0]).score(x), 0.5)


def test_scores_are_sums_of_table_entries(spark):
    """Features by plain counting, tables looked up one by one, against the scores of the operator."""
    import math

    texts = [t or "" for _, t, *_ in cases.rows() if t != cases.LONG] + ["Same line.\nSame line.\nOther; line! 42 #", "a b c d e f g h " * 3]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))

    def features(t):
        w, lines = cases.words(t), [x for x in t.split("\n") if cases.words(x)]
        n, size = max(1, len(w)), max(1, len(t.encode()))
        upper, lower = (sum(c.isascii() and f(c) for c in t) for f in (str.isupper, str.islower))
        count, hit = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7)), set()
        for j in range(len(w) - 7):
            if count[tuple(w[j : j + 8])] > 1:
                hit |= set(range(j, j + 8))
        return [math.log1p(len(w)), sum(map(len, w)) / n, sum(t.count(c) for c in "#*$%&|<>") / n, (len(lines) - len(set(lines))) / max(1, len(lines)), len(hit) / n, upper / max(1, upper + lower),
                sum(c in "0123456789" for c in t) / size, sum(t.count(c) for c in ".,;:!?") / n, sum(a == b for a, b in zip(w, w[1:])) / n, len(set(w)) / n, sum(len(x.encode()) == 1 for x in w) / n, (len(t.encode()) - len(t)) / size, math.log1p(len(w) / max(1, len(lines)))]

    def score(x):
        place = lambda cuts, v: sum(c <= v for c in cuts)
        total = model.base + sum(t[place(c, v)] for c, t, v in zip(model.cuts, model.tables, x))
        total += sum(t[place(model.coarse_cuts[i], x[i]), place(model.coarse_cuts[j], x[j])] for (i, j), t in model.pairs.items())
        return 1 / (1 + math.exp(-total))

    got = {r.doc_id: r.score for r in quality.score_quality(cases.docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), model).collect()}
    assert len(model.pairs) and all(abs(got[i] - score(features(t))) < 1e-9 for i, t in enumerate(texts))


def test_a_tree_over_two_features_splits_either():
    g = np.zeros((6, 5))
    g[2:, 3:] = 1
    got = quality._boxes(g, np.ones((6, 5)), 2, 0.0)
    assert np.allclose(got, g) and np.allclose(quality._boxes(g, np.ones((6, 5)), 0, 0.0), g.mean())


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = "pmod(crc32(cast(doc_id as string)), 5) = 0"
    model = quality.train_quality(docs, labels.where(f"not ({out})"))
    rows = quality.score_quality(docs, model).join(labels.where(out), "doc_id").where("quality is not null")
    assert rows.select(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).first()[0] > 0.95
    odd = quality.score_quality(cases.docs(spark), model).collect()
    assert len(odd) == len(cases.rows()) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_quality(cases.empty(spark), model).count() == 0


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train_language(docs.where("pmod(crc32(cast(doc_id as string)), 5) <> 0"))
    rows = [r for r in langid.predict_language(docs, model).where("lang is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    odd = langid.predict_language(cases.docs(spark), model).collect()
    assert all(r.lang_pred == "und" and r.lang_score == 0 for r in odd if not any(c.isalpha() for c in r.text or ""))
    assert all(r.lang_pred in model.languages for r in odd if any(c.isalpha() for c in r.text or ""))
    none = langid.train_language(cases.empty(spark))
    assert {r.lang_pred for r in langid.predict_language(cases.docs(spark), none).collect()} == {"und"}
    assert langid.predict_language(cases.empty(spark), model).count() == 0
