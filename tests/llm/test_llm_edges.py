"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns whose names clash with inner ones."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_near_copies import _components as jaccard_groups
from tiermark.llm import fingerprints, licenses, line_dedup, mixing, pieces, simhash, token_files, topk, toxicity, warc
from tiermark.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp bigint, at int, h bigint, size string, component_id string, path string"
SPACE = pieces.SPACE
LINE = "A line that is long enough to count as a passage of its own."


def _rows():
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    texts = [None, "", " ", "a", "a b", "A  B\tc", long, long + " end", LINE, LINE.upper() + "\n" + LINE, LINE + "\nmore", "x\n" + LINE + "\nx", "  " + LINE + " \n", LINE, LINE, "ÄÖ\nü é é ﬁ", "\n\n"]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, None, "x", 1, 2, 3, "4", "5", "p") for k, t in enumerate(texts)]
    return rows + [(None, "a b c d", None, None, None, None, None, None, None, None, None, None), rows[8], rows[8], (None, LINE, "en", "s1", 1, "x", 1, 2, 3, "4", "5", "p")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _pairs():
    return [(r[0], r[1]) for r in _rows()]


def test_simhash(odd, none):
    got = simhash.simhash_components(odd).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{brute.fingerprint(t):016x}") for i, t in _pairs())
    prints = {i: brute.fingerprint(t) for i, t in _pairs() if i is not None}
    want = brute.components(prints)
    assert all(want[r["doc_id"]] == r["component_id"] for r in got if r["doc_id"] is not None)
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({**{i: 1 for i in set(want.values())}, None: 2})
    assert simhash.drop_near_duplicates(none).count() == 0


def test_dense_buckets_lose_no_link(spark):
    """A family of fingerprints that all share blocks, linked by stars, against all pairs."""
    rng = np.random.default_rng(3)
    values = {0, -1, 1 << 62}
    for _ in range(400):
        bits = rng.choice(64, size=rng.integers(0, 5), replace=False)
        values.add(sum(1 << int(b) for b in bits) ^ (int(rng.integers(0, 3)) << 30))
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    mask = (1 << 64) - 1
    want = brute.components({v: v & mask for v in signed})
    for rows in (1, 4, 10_000):
        links = simhash.hamming_links(nodes, bucket_rows=rows)
        assert all(((r["a"] ^ r["b"]) & mask).bit_count() <= 2 for r in links.collect())
        roots = {r["node"]: r["root"] for r in simhash.connected(links).collect()}
        assert {v: roots.get(v, v) for v in signed} == want
    one = {(r["a"], r["b"]) for r in simhash.hamming_links(nodes, max_bits=1, bucket_rows=1).collect()}
    assert all(((a ^ b) & mask).bit_count() == 1 for a, b in one)
    assert simhash.hamming_links(nodes, max_bits=0).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in simhash.connected(links).collect()} == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_line_dedup(odd, none):
    got = Counter((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(odd).collect())
    want = Counter()
    for (i, t), row in zip(_pairs(), brute.line_dedup(_pairs())):
        want[row] += 1
    assert got == want
    assert sum(r[2] for r in want.elements()) > 5
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(odd, kept="text").columns == [*[c for c in odd.columns if c != "text"], "text", "__n_lines", "__n_dropped"]


def test_line_runs_in_any_number_of_batches(odd):
    one = sorted(map(str, line_dedup.dedup_lines(odd, batches=1).select("doc_id", "kept_text").collect()))
    assert sorted(map(str, line_dedup.dedup_lines(odd, batches=7, fan_out=3).select("doc_id", "kept_text").collect())) == one


def test_fingerprints(odd, none):
    got = fingerprints.edited_fingerprints(odd).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == Counter(brute.edits(_pairs()))
    assert fingerprints.edited_fingerprints(none).count() == 0
    lone = fingerprints.edited_fingerprints(odd.where("doc_id = 5")).first()
    assert lone["near_next"] == 1.0


def test_clashing_digests_are_told_apart(odd):
    """With one hexadecimal digit texts must share digests; the bytes decide."""
    got = fingerprints.exact_fingerprints(odd.where("doc_id IS NOT NULL"), hex_digits=1).collect()
    text = {i: brute.canonical(t) for i, t in _pairs()}
    by_print = {}
    for r in got:
        by_print.setdefault(r["fingerprint"], set()).add(text[r["doc_id"]])
    assert all(len(v) == 1 for v in by_print.values()) and len(by_print) == len({text[r["doc_id"]] for r in got})


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    assert Counter(map(tuple, token_files.token_offsets(odd, path).collect())) == Counter(brute.token_rows(_pairs(), Tokenizer.from_file(path)))
    assert token_files.token_offsets(none, path).count() == 0


def test_words_are_cut_as_the_library_would():
    path = tokenizer_path("word_bpe_49k.json")
    cache = token_files.WordCache(path)
    texts = ["", "  ", "a<|endoftext|>b <|STARTOFTEXT|> X", "ﬁ É́ é Σας ΣΑΣ İstanbul", "don't I'M we'll 'S x's", "a b c　d", "3.14, 1,000.5 a.b,c..d ... ?. !.", "́.x", "naïve.Ünïcode,ÀB", "\x0b\x0c\x1c\x85x", "日本語。テスト, test", "ªº.µ,ß×÷.a", "﻿x", "a‍b.", "x\r\ny"]
    assert cache.cuts
    for t in texts:
        assert np.frombuffer(cache.encode(t), dtype=cache.kind).tolist() == cache.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 2, 3, 1000, 1000, 5000], list(range(0, 90_000, 7)), [3] * 700 + [10**9]])
def test_elias_fano(values):
    ef = token_files.EliasFano.encode(np.array(values, dtype=np.int64), values[-1] if values else 0)
    assert ef.all().tolist() == values
    assert [ef[k] for k in range(len(values))] == values


def test_token_file_gives_single_documents():
    docs = [[1, 2, 3], [], [65_000], list(range(500))]
    data = token_files.pack_file(3, 1, [7, None, 9, 10], list(map(len, docs)), np.array(sum(docs, []), dtype="<u2").tobytes(), 2)
    f = token_files.TokenFile(data)
    assert (f.shard, f.chunk, f.doc_ids, data[-1]) == (3, 1, [7, None, 9, 10], 0)
    assert [f.document(k).tolist() for k in range(4)] == docs


def test_pieces(odd, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = odd.select("doc_id", "text", pieces.piece_digests(path).alias("p"), pieces.piece_ids(path).alias("ids")).collect()
    for r in got:
        ids = lib.encode(r["text"] or "", add_eos=True)
        assert r["ids"] == ids and r["p"]["n_tokens"] == len(ids) and r["p"]["differing"] == 0 and r["p"]["whole_agrees"] is not False
        assert r["p"]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert none.select(pieces.piece_digests(path)).count() == 0


def test_agenda_alone_agrees_with_the_library():
    enc = pieces.PieceEncoder(tokenizer_path("piece_bpe_32k.model"))
    texts = ["a.b.c, U.S. e.g. don't stop...", "  two  spaces ", "\n\nx\n y", "▁▁x ▁", "日本語 テスト\u0000 😀 é é", "<s>a</s> <0x0A> <unk>", "aaaaaaaaaaaaaaaaaaaaaaaa", "x,,y..z.,a", "."]
    for t in texts:
        assert sum((enc.merge(s) for s in enc.split(t)), []) == enc.library.encode(t), t
        assert enc.merge_all(enc.split(t))[0].tolist() == enc.library.encode(t), t


def test_side_by_side_agendas_equal_the_heap():
    """Random strings, a cache so small that it forgets all the time, and a text that is read in parts."""
    import random

    rng, enc = random.Random(5), pieces.PieceEncoder(tokenizer_path("piece_bpe_32k.model"), most=2000)
    bits = [" ", "  ", "\n", "\n\n", "a", "th", "ing", "Straße", "é", "日本", "😀", ".", ",", "...", SPACE, "<s>", "\t", "don't", "1234", "====", "x" * 60, "ab" * 40, "Ж", "ный", "//", "__", " .", "a.b"]
    for _ in range(60):
        texts = ["".join(rng.choices(bits, k=rng.choice([0, 1, 5, 200]))) for _ in range(rng.choice([1, 3, 40]))]
        got, differ = enc.encode_texts(texts)
        assert differ == 0 and [g.tolist() for g in got] == enc.library.encode(texts, add_eos=True)
        segments = [s for t in texts for s in enc.split(t)]
        ids, n = enc.merge_all(segments)
        assert [g.tolist() for g in np.split(ids, np.cumsum(n)[:-1])] == [enc.merge(s) for s in segments] or not segments
    long = " ".join("".join(rng.choices(bits, k=3)) for _ in range(120_000))
    assert len(long) > 1 << 20 and enc.encode_texts([long])[0][0].tolist() == enc.library.encode(long, add_eos=True)


def test_five_million_new_characters_at_once():
    """One text of more characters, in more segments, than a part of the agenda holds."""
    import random

    rng, enc = random.Random(6), pieces.PieceEncoder(tokenizer_path("piece_bpe_32k.model"))
    text = " ".join("".join(rng.choices("abcdefghijklmnop", k=29)) for _ in range(172_000))
    (got,), differ = enc.encode_texts([text])
    assert len(text) > 5_000_000 and differ == 0 and got.tolist() == enc.library.encode(text, add_eos=True)
    ids, n = enc.merge_all(enc.split(text))
    assert np.array_equal(ids, got[:-1]) and len(n) == 172_000


def test_a_difference_from_the_library_is_seen():
    """With one score made worse the agenda goes wrong; the library's ids are taken and the difference is counted."""
    enc = pieces.PieceEncoder(tokenizer_path("piece_bpe_32k.model"))
    enc.pair_place[:] = enc.pair_place.max() - enc.pair_place
    got, differ = enc.encode_texts(["The whole sentence would be merged the other way round."])
    assert differ > 0 and got[0].tolist() == enc.library.encode("The whole sentence would be merged the other way round.", add_eos=True)


def test_top_k(spark):
    nan = float("nan")
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).round(3).tolist(), 1) for k in range(200)]
    rows += [(k, [1.0] * 8, 1) for k in range(200, 260)]  # ties and one very common vector
    rows += [(300, None, 1), (320, [1.0, None], 1), (340, [nan], 1), (360, [float("inf")], 1), (None, [1.0] * 8, 1), (380, [], 1), (400, [2.0], 1), (20, rows[20][1], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int").repartition(3)
    got = [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=20, n_pivots=8, block_rows=16, group_queries=4).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute.top_k([(i, v) for i, v, _ in rows[:-1]])
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.exact_top_k(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.exact_top_k(df.where("vec_id < 5 OR vec_id = 20"), F.col("vec_id") % 20 == 0).collect()
    assert Counter(r["query_id"] for r in few) == {0: 5, 20: 5}


def test_top_k_of_any_finite_components(spark):
    """Components of 1e6 to 1e16: whole numbers beyond what floats hold, up to what a long holds."""
    rng = np.random.default_rng(9)
    rows = [(k, (rng.normal(size=4) * 10.0 ** int(rng.integers(-2, 7))).tolist()) for k in range(120)]
    rows += [(200, [1e6, 0.0, 0.0, 0.0]), (220, [0.0] * 6 + [1e14, 1.0]), (222, [0.0] * 6 + [8.0]), (221, [0.015625, 3.0]), (240, [0.0] * 4 + [1e16]), (241, [0.0] * 4 + [0.0625]), (242, [0.0] * 4 + [-0.03125]), (243, [0.0] * 5 + [1e16])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = set()
    for i in whole:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[i], v)), j) for j, v in whole.items() if j != i)
            assert all(abs(s) < 1 << 63 for s, _ in scores)
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])}
    got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=5, n_pivots=3, block_rows=16, group_queries=4)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want


def test_top_k_beyond_longs(spark):
    """Scores that no long holds are shown as the nearest, and ranked by what they are, on both sides."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(rng.integers(1, 1000)) * 1e300 * (1 if k % 3 else -1)] + rng.normal(size=2).tolist()) for k in range(80)]
    rows += [(100, [1.0]), (101, [-1.0]), (102, [2.0**57]), (120, [2.0**57, 0.0]), (121, [-(2.0**57)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = set()
    for i in (k for k in whole if k % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[i], v)), j) for j, v in whole.items() if j != i)[:70]
        want |= {(i, n + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, j) in enumerate(scores)}
    got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=70, n_pivots=2, block_rows=8, group_queries=2)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want


def test_pivots_eliminate_and_stop_exactly():
    """Vectors near a plane: places from distances bound products from above, and few candidates are evaluated."""
    rng = np.random.default_rng(3)
    x = np.floor(64 * np.concatenate((rng.normal(size=(3000, 6)), 0.05 * rng.normal(size=(3000, 26))), axis=1))
    table = topk.PivotTable(x[:500], 12)
    places = table.places(x, table.distances(x))
    q = x[:50]
    assert ((places[:50].astype(float) @ places.T) * table.unit**2 >= q @ x.T - 1e-3 * table.unit).all()
    ids = np.arange(3000)
    i, found, scores, evaluated = topk.search_block(q, ids[:50], places[:50], x, ids, places, 20, np.full(50, -np.inf), table.unit)
    for k in range(50):
        want = sorted((-float(s), j) for j, s in enumerate(q[k] @ x.T) if j != k)[:20]
        assert sorted((-s, j) for a, j, s in zip(i, found, scores) if a == k) == [(s, j) for s, j in want]
    assert evaluated < 0.2 * 50 * 3000


def test_warc(spark):
    rows = [(1, "http://a/b c", "x", 9), (2, None, "x", 9), (3, "http://a/ü", None, 9), (4, "http://a", "", 9), (5, "http://a", "É" * 100_000, 9), (None, "http://n", "x", 9), (None, "http://n", "alone", 9), (5, "http://a", "É" * 100_000, 9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, at int").repartition(3)
    got = warc.archive_pages(df).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len((h or "").encode()), warc.sha1_base32((h or "").encode())) for i, _, h, _ in rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter({(1, "response", None): 1, (2, "revisit", 1): 1, (3, "response", None): 1, (4, "revisit", 3): 1, (5, "response", None): 1, (5, "revisit", 5): 1, (None, "revisit", 1): 1, (None, "response", None): 1})
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_arc_versions_and_lengths():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nline one\n\nline two"
    for version in (1, 2):
        data = warc.member(warc.arc_header(version, "f.arc", "20200101000000")) + b"".join(warc.member(warc.arc_record(version, u, "1.2.3.4", "20211231235959", "text/html", 200, 0, "f.arc", b)) for u, b in (("http://a/x", body), ("http://b b/", b"raw"), ("dns:a", b"")))
        got = list(warc.parse_arc(data))
        assert [(h["URL"], d) for h, d in got] == [("http://a/x", body), ("http://b b/", b"raw"), ("dns:a", b"")]
        fields, top, payload, http = warc.synthesise(*got[0], "f:0")
        assert fields["WARC-Type"] == "response" and fields["WARC-Date"] == "2021-12-31T23:59:59Z" and payload == b"line one\n\nline two" and http == {"a": "b"}
        assert warc.synthesise(*got[1], "f:1")[0]["WARC-Type"] == "resource"
        whole = warc.member(warc.arc_header(version, "f.arc", "20200101000000") + warc.arc_record(version, "http://a", "0", "2020", "t", 200, 0, "f", b"x\ny"))
        assert [d for _, d in warc.parse_arc(whole)] == [b"x\ny"]


def test_mixing(odd, none):
    rows, plan = mixing.mix_sources(odd)
    got = rows.collect()
    assert len(got) == len(_rows())
    assert Counter((r["id"], r["size"]) for r in got) == Counter((i, len((t or "").encode().split())) for i, t in _pairs())
    assert all(0 <= r["copies"] <= 3 for r in got)
    assert sum(plan.targets.values()) == pytest.approx(sum(plan.sizes.values()))
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert Counter(r["doc_id"] for r in mixed.collect())[8] == sum(r["copies"] for r in got if r["id"] == 8)
    assert mixing.mix_sources(none)[0].count() == 0 and mixing.mixed_documents(none).count() == 0


def test_flow_over_overlapping_sources():
    """Shared documents go where a quota would else be missed, and nothing is repeated while something fresh is left."""
    plan = mixing.plan_mix({("a",): 100, ("a", "b"): 100, ("b",): 10, ("c",): 90}, weights=(1, 1, 1))
    got = Counter()
    for (_, s), words in plan.flow.items():
        got[s] += words
    assert {s: got[s] for s in "abc"} == {s: round(plan.targets[s]) for s in "abc"}
    used = Counter()
    for (k, _), words in plan.flow.items():
        used[plan.patterns[k]] += words
    assert all(used[p] <= 3 * n for p, n in zip(plan.patterns, plan.pattern_sizes))
    assert used["a", "b"] >= 90 and used["c",] > 90  # b needs the shared ones, c must repeat
    assert mixing.targets({"a": 1, "b": 1, "c": 100}) == {"a": 3.0, "b": 3.0, "c": 96.0}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_closest_sum():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes, goal = rng.integers(1, 30, size=rng.integers(0, 7)).tolist(), int(rng.integers(0, 60))
        got = mixing.closest(sizes, goal)
        sums = [sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n)]
        assert len(set(got)) == len(got) and abs(sum(sizes[k] for k in got) - goal) == min(abs(x - goal) for x in sums)


def test_min_cost_flow_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(30):
        arcs = [(0, 2, int(rng.integers(0, 3)), 0), (0, 2, int(rng.integers(0, 3)), 1), (0, 3, int(rng.integers(0, 3)), int(rng.integers(0, 3))), (2, 4, 2, 0), (2, 5, 2, 0), (3, 5, 2, 0), (4, 1, int(rng.integers(0, 3)), 0), (5, 1, int(rng.integers(0, 3)), 0)]
        best = (0, 0)
        for f in itertools.product(*[range(c + 1) for _, _, c, _ in arcs]):
            if all(sum(x for x, a in zip(f, arcs) if a[1] == v) == sum(x for x, a in zip(f, arcs) if a[0] == v) for v in (2, 3, 4, 5)):
                best = max(best, (sum(x for x, a in zip(f, arcs) if a[0] == 0), -sum(x * a[3] for x, a in zip(f, arcs))))
        got = mixing.min_cost_flow(arcs, 0, 1)
        assert (sum(x for x, a in zip(got, arcs) if a[0] == 0), -sum(x * a[3] for x, a in zip(got, arcs))) == best


def test_licenses(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0-only"][0]
    rows = [("a/LICENSE", mit, 1), ("a/x.py", "code", 1), ("a/b/y.py", None, 1), ("a/b/c/COPYING", gpl, 1), ("a/b/c/z.py", "", 1), ("a/own.py", "some code\n" + gpl + "\nmore", 1), ("q/w.py", "code", 1), (None, mit, 1), (None, None, 1), ("LICENSE", "nothing of the kind", 1), ("a/x.py", "code", 1)]
    df = spark.createDataFrame(rows, "path string, text string, depth int")
    got = Counter((r["path"], r["license"], r["origin"], r["from_dir"]) for r in licenses.license_scan(df, keep=("depth",)).collect())
    assert got == Counter({("a/LICENSE", "MIT", "own", None): 1, ("a/x.py", "MIT", "inherited", "a"): 2, ("a/b/y.py", "MIT", "inherited", "a"): 1, ("a/b/c/COPYING", "GPL-3.0-only", "own", None): 1, ("a/b/c/z.py", "GPL-3.0-only", "inherited", "a/b/c"): 1, ("a/own.py", "GPL-3.0-only", "own", None): 1, ("q/w.py", None, "none", None): 1, (None, "MIT", "own", None): 1, (None, None, "none", None): 1, ("LICENSE", None, "none", None): 1})
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_license_passages(spark):
    """A header with a holder's name, a wrapped notice with comment marks, a whole licence, an "or later" header, other prose."""
    mit, gpl = licenses.TEMPLATES["MIT"][3], licenses.TEMPLATES["GPL-3.0-or-later"][1]
    wrapped = "import os\n\n" + "\n".join("# " + " ".join(gpl.split()[i : i + 9]) for i in range(0, len(gpl.split()), 9)) + "\n\ndef main(arguments):\n    return os.path\n"
    header = "Copyright (c) 2021 Jane Doe. All rights reserved.\nvalue = 1\n"
    prose = "The committee read the paper and asked for more time.\nNothing in it was said about the public."
    rows = [(f"p{i}/a.txt", f"copyright c 20{i:02d} holder {i} text about the river and the sea") for i in range(40)]
    rows += [(f"r{i}/a.txt", f"some rights were reserved for member {i} of jane and doe 2021") for i in range(20)]
    rows += [("m/LICENSE", "MIT License\n\nCopyright (c) 2021 Jane Doe\n\n" + mit), ("m/x.py", "x = 1"), ("g/x.py", wrapped), ("h/x.py", header), ("o/x.py", prose)]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("mine")).withColumn("row", F.lit(7)).withColumn("hit", F.lit(1))
    got = {r["path"]: r for r in licenses.license_scan(df, keep=("license", "row", "hit")).collect()}
    assert {p: (got[p]["license"], got[p]["origin"]) for p in ("m/LICENSE", "m/x.py", "g/x.py", "h/x.py", "o/x.py")} == {"m/LICENSE": ("MIT", "own"), "m/x.py": ("MIT", "inherited"), "g/x.py": ("GPL-3.0-or-later", "own"), "h/x.py": ("LicenseRef-Proprietary", "own"), "o/x.py": (None, "none")}
    assert all(r["file_license"] == "mine" and r["row"] == 7 and r["hit"] == 1 for r in got.values()) and len(got) == len(rows)


def test_toxicity(spark, odd, none):
    texts = [("you stupid idiot go away " * 3 if k % 4 == 0 else f"a fine day for a walk number {k} in the park") for k in range(200)]
    rows = [(k, t, int(k % 4 == 0)) for k, t in enumerate(texts)] + [(None, None, 1), (500, None, 0), (501, "x", None)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit_toxicity(labelled, labelled)
    scores = {r["doc_id"]: r["s"] for r in odd.select("doc_id", toxicity.toxicity_score(odd, model).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[0] == scores[1] == scores[2]
    unseen = spark.createDataFrame([(1, "what an idiiot you are so stupidd"), (2, "a walk in the park today")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["s"] for r in unseen.select("doc_id", toxicity.toxicity_score(unseen, model).alias("s")).collect()}
    assert got[1] > 0.5 > got[2]
    assert none.select(toxicity.toxicity_score(none, model)).count() == 0
    empty = toxicity.fit_toxicity(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert {r["s"] < 0.5 for r in odd.select(toxicity.toxicity_score(odd, empty).alias("s")).collect()} == {True}
    assert toxicity.train(["a b"], [1]).bias > 0


def test_subwords_against_a_plain_hash():
    """Buckets and logits of words by the definition, one n-gram at a time in whole numbers."""
    mask, a, b = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

    def buckets(word):
        padded, out = f"<{word}>", []
        for n in (3, 4, 5):
            for at in range(len(padded) - n + 1):
                h = n * b & mask
                for c in padded[at : at + n]:
                    h = (h ^ ord(c)) * a & mask
                    h ^= h >> 29
                out.append(h >> 64 - toxicity.BUCKET_BITS)
        whole = sum(((w := (ord(c) + 1) * (k * b + a & mask) & mask) ^ w >> 31) * a & mask for k, c in enumerate(padded)) & mask
        return sorted([*out, ((whole ^ whole >> 29) * b & mask) >> 64 - toxicity.BUCKET_BITS])

    words = ["a", "idiot", "straße", "日本", "😀x", "stupid" * 9]
    ids, own = toxicity.subwords(words)
    assert [sorted(ids[own == k].tolist()) for k in range(len(words))] == [buckets(w) for w in words]
    rng = np.random.default_rng(0)
    model = toxicity.ToxicityModel(rng.normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32), 0.25, 100.0)
    want = [100 * sum(float(model.weight[k]) for k in buckets(w)) / len(buckets(w)) ** 0.5 for w in words]
    assert model.word_logits(words) == pytest.approx(want)


def test_rare_toxic_words_and_their_misspellings_are_learnt():
    """Three toxic words, each in few rows among many words without meaning; then misspelt."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randrange(3, 9)))
    lexicon = [word() for _ in range(600)]
    bad = ["wretchling", "filthmonger", "scoundrellish"]
    make = lambda k: " ".join(rng.choices(lexicon, k=40) + [bad[k % 3]] * (k % 8 == 0))
    texts = [make(k) for k in range(1200)]
    model = toxicity.train(texts, [int(k % 8 == 0) for k in range(1200)])
    score = lambda t: model.word_logits(toxicity.words_of(t)).mean() + model.bias
    assert np.mean([score(make(8 * k)) > 0 for k in range(100)]) > 0.9
    assert np.mean([score(make(1)) < 0 for _ in range(200)]) > 0.97
    misspelt = ["wretchhling", "wretchlin", "filthmonnger", "filthmnoger", "scoundrelish", "scoundrrellish"]
    assert np.mean([model.word_logits([w])[0] > 0.3 * model.word_logits([bad[k // 2]])[0] for k, w in enumerate(misspelt)]) > 0.8


def _near_targets(before, after):
    """What a mix takes: no document over three times, every source near its target."""
    size = {i: len((t or "").encode().split()) for i, (t, _) in before.items()}
    total, taken, copies = Counter(), Counter(), Counter(after)
    for i, (_, source) in before.items():
        total[source] += size[i]
        taken[source] += size[i] * copies[i]
    want = mixing.targets(total)
    assert max(copies.values()) <= 3 and set(copies) <= set(before)
    for source in total:
        longest = max(n for i, n in size.items() if before[i][1] == source)
        assert abs(taken[source] - want[source]) <= max(50, 0.02 * want[source], longest / 4)  # as test_op6 has it


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage against a plain version on its own input (toxicity: the scores of op1's operator, row by row)."""
    import sentencepiece

    import corpus_pipeline
    from tiermark.llm.queries import toxicity_model

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        rows = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "pieces":
            lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            ids = {i: lib.encode(t or "", add_eos=True) for i, t in before.items()}
            got = out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
            assert len(got) == docs.count()
            assert {tuple(r) for r in got} == {(i, len(x), sha(" ".join(map(str, x))), sha(lib.decode(x))) for i, x in ids.items()}
            break
        assert out.columns == columns
        after = out.select("doc_id", "text").collect()
        if name == "line dedup":
            assert Counter((r["doc_id"], r["text"]) for r in after) == Counter((i, k) for i, _, _, k in brute.line_dedup(list(before.items())))
        elif name == "near-dedup":
            assert sorted(r["doc_id"] for r in after) == sorted(set(jaccard_groups(before).values()))
        else:
            assert all(before[r["doc_id"]] == r["text"] for r in after)
            if name == "toxicity":
                scores = dict(docs.select("doc_id", toxicity.toxicity_score(docs, toxicity_model(spark, docs, sf))).collect())
                assert sorted(r["doc_id"] for r in after) == sorted(i for i, s in scores.items() if s < 0.5)
            else:
                _near_targets(rows, [r["doc_id"] for r in after])
        docs = out


def test_pipeline_stages_on_odd_rows(spark, sf, odd, none, tmp_path):
    """Nulls, repeats, and columns with the names that stages use inside; and an empty table."""
    import corpus_pipeline

    for frame in (odd, none):
        docs = frame.withColumns({c: F.lit("mine") for c in ("kept_text", "__n_lines", "__n_dropped", "score", "pattern", "copies")})
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{frame is odd}")
            stage(spark, docs, sf).write.parquet(path)
            out = spark.read.parquet(path)
            assert name == "pieces" or out.columns == columns
            if name != "pieces":
                assert out.where("kept_text <> 'mine' OR __n_lines <> 'mine' OR __n_dropped <> 'mine'").isEmpty()
            if name == "line dedup":
                want = Counter((i, k) for i, _, _, k in brute.line_dedup([tuple(r) for r in docs.select("doc_id", "text").collect()]))
                assert Counter(tuple(r) for r in out.select("doc_id", "text").collect()) == want
            assert frame is odd or out.isEmpty()
            docs = out
        assert frame is none or not docs.isEmpty()
