"""Every query of the subpackage on the smallest tables against a brute-force version."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm import brute
from tiermark.llm import mixing, queries


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_op1_is_better_than_chance_and_total(spark, docs):
    """Held-out accuracy on the larger tables, where there are labels enough to learn from."""
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    out = [(got[i]["predicted"], y) for i, y in labels.items() if i in got and got[i]["held_out"]]
    hits = Counter(out)
    assert sum(p == y for p, y in out) / len(out) > 0.95
    assert hits[1, 1] / (hits[1, 1] + hits[0, 1]) > 0.8
    assert hits[1, 1] / (hits[1, 1] + hits[1, 0]) > 0.8


def test_op2(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op2_simhash(spark, sf).collect()}
    prints = {i: brute.fingerprint(t) for i, t in docs.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute.components(prints)


def test_op3(spark, sf):
    import base64

    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first = {}
    for r in rows:
        first[r["html"]] = min(first.get(r["html"], r["page_id"]), r["page_id"])
    want = {(r["page_id"], len(r["html"].encode()), base64.b32encode(hashlib.sha1(r["html"].encode()).digest()).decode(), "response" if first[r["html"]] == r["page_id"] else "revisit", None if first[r["html"]] == r["page_id"] else first[r["html"]]) for r in rows}
    assert {tuple(r) for r in queries.op3_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == want


def _best_license(text, frequency, n, templates, lengths):
    """The rounded cosine and licence of the best of all passages of a text, and the cosine of the whole, word by word."""
    import math
    import re

    def vector(words):
        return {w: c * (math.log((1 + n) / (1 + frequency.get(w, 0))) + 1) for w, c in Counter(words).items()}

    def best(words):
        v = vector(words)
        norm = math.sqrt(sum(x * x for x in v.values()))
        found = (0.0, 0, None)
        for k, (name, template) in enumerate(templates):
            t = vector(template)
            dot = sum(x * v.get(w, 0.0) for w, x in t.items())
            if dot:
                found = max(found, (round(min(1.0, dot / norm / math.sqrt(sum(x * x for x in t.values()))), 12), -k, name))
        return found

    lines = [words for words in (re.findall("[a-z0-9]+", line.lower()) for line in text.split("\n")) if words]
    passages = {tuple(line) for line in lines}
    for length in lengths:
        for start in range(len(lines)):
            words, end = [], start
            while end < len(lines) and len(words) < length:
                words, end = words + lines[end], end + 1
            passages.add(tuple(words))
            if end == len(lines):
                break
    whole = best([w for line in lines for w in line])
    found = max([whole, *map(best, passages)])
    return found[0], found[2], whole[0]


def test_op4(spark, sf, docs):
    """Against a plain walk over the files: every passage, every template, every word's frequency."""
    import re

    from tiermark.llm import licenses

    files = {r["doc_id"]: (r["path"], r["text"] or "") for r in queries.document_paths(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    templates = [(name, re.findall("[a-z0-9]+", t.lower())) for name, texts in licenses.TEMPLATES.items() for t in texts]
    lengths = []
    for size in sorted({len(t) for _, t in templates}):
        if not lengths or size > 1.25 * lengths[-1]:
            lengths.append(size)
    frequency = Counter(w for _, t in files.values() for w in set(re.findall("[a-z0-9]+", t.lower())))
    own, dirs, cosine = {}, {}, {}
    for i, (path, text) in files.items():
        cosine[i], name, whole = _best_license(text, frequency, len(files), templates, lengths)
        own[i] = name if cosine[i] >= 0.6 else None
        if own[i] and (path.rsplit("/", 1)[1].startswith("LICENSE") or whole >= 0.6):
            folder = path.rsplit("/", 1)[0]
            dirs[folder] = min(dirs.get(folder, (9, "", "")), (-whole if whole >= 0.6 else 0.0, path, own[i]))
    want = {}
    for i, (path, _) in files.items():
        at = path.split("/")[:-1]
        near = next((dirs["/".join(at[:n])][2] for n in range(len(at), 0, -1) if "/".join(at[:n]) in dirs), None)
        want[i] = (own[i] or near, "own" if own[i] else "inherited" if near else "none", round(cosine[i], 5) if own[i] else 0.0)
    got = {r["doc_id"]: (r["license"], r["origin"], round(r["similarity"], 5)) for r in queries.op4_licenses(spark, sf).collect()}
    assert {i: w[:2] for i, w in got.items()} == {i: w[:2] for i, w in want.items()}
    assert all(abs(got[i][2] - want[i][2]) < 2e-5 for i in want)
    assert any(o == "own" for _, o, _ in got.values())


def test_op5(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {tuple(r) for r in queries.op5_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute.top_k(rows)


def test_op6(spark, sf, docs):
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {i: len((t or "").encode().split()) for i, t in docs.items()}
    total = defaultdict(int)
    for i, s in source.items():
        total[s] += size[i]
    want = mixing.targets(total)
    got = queries.op6_mixing(spark, sf).collect()
    again = queries.op6_mixing(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    taken = defaultdict(int)
    for r in got:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == total[source[i]] and r["target"] == pytest.approx(want[source[i]])
        assert 0 <= r["taken"] <= 3 * size[i]
        taken[source[i]] += r["taken"]
    assert len(got) == len(docs)
    assert sum(want.values()) == pytest.approx(sum(total.values()))
    for s in total:
        assert abs(taken[s] - want[s]) <= max(50, 0.02 * want[s], max(n for i, n in size.items() if source[i] == s) / 4)


def test_op7(spark, sf, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in docs.items():
        ids = lib.encode(t or "", add_eos=True)
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
    got = queries.op7_pieces(spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:4] for r in got} == want
    assert all(r["differing"] == 0 and r["whole_agrees"] is not False for r in got) and any(r["whole_agrees"] for r in got)


def test_op8(spark, sf, docs):
    want = {(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute.line_dedup(list(docs.items()))}
    assert {tuple(r) for r in queries.op8_line_dedup(spark, sf).collect()} == want


def test_op9(spark, sf, docs):
    from tokenizers import Tokenizer

    want = set(brute.token_rows(list(docs.items()), Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))))
    assert {tuple(r) for r in queries.op9_token_files(spark, sf).collect()} == want


def test_op10(spark, sf, docs):
    got = queries.op10_fingerprints(spark, sf).collect()
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got} == set(brute.edits(list(docs.items())))
    by_print = defaultdict(set)
    for r in got:
        by_print[r["fingerprint"]].add(brute.canonical(docs[r["doc_id"]]))
    assert len(by_print) == len({brute.canonical(t) for t in docs.values()}) and all(len(v) == 1 for v in by_print.values())
