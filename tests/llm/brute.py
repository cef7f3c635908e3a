"""Plain versions of the operators, one row at a time, for small inputs."""

import hashlib
import zlib

import numpy as np
import xxhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints, max_bits=2):
    """prints: {id: fingerprint}; the smallest id reachable for each."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= max_bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


_STRIP = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_dedup(docs, least_chars=40, least_docs=5):
    """docs: [(id, text)]; [(id, n_lines, n_dropped, kept)] in the same order.  A null id is below all others."""
    key = lambda line: line.strip(_STRIP).translate(_LOWER)
    held = {}
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                held.setdefault(k, []).append(i)
    owner = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in owner or owner[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def top_k(rows, k=20):
    """rows: [(id, vector)]."""
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in good), default=0)
    good = [(i, v + [0] * (dims - len(v))) for i, v in good]
    out = set()
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def canonical(text):
    import unicodedata

    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return " ".join(nfkc(nfkc(text or "").casefold()).split())


def edits(docs):
    """docs: [(id, text)]; (id, n_chars, sha of the edited text, near_edited, near_next), by ascending id."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    out = []
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(after))))
    return out


def token_rows(docs, tokenizer, end_id=2):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    out, start = [], 0
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def repeats(docs, length=50):
    """docs: [(id, text)]; (id, n_bytes, n_removed, n_spans, kept) in the same order.  A null id is above all others."""
    rank = lambda i: float("inf") if i is None else i
    first = {}
    for i, text in docs:
        b = (text or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for i, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < rank(i):
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for s in range(len(b)) if gone[s] and not (s and gone[s - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def audit(docs, labels):
    """docs: [(id, text, part)], labels: {id: (quality, toxic)}; the rows of the audit.  A null id is above all others."""
    import itertools
    import re

    rank = lambda i: float("inf") if i is None else i
    least = {}
    for i, text, _ in docs:
        least[text or ""] = min(least.get(text or "", float("inf")), rank(i))
    rows = {}
    for i, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": least[t] < rank(i)}
        quality, toxic = labels.get(i, (0, 0))
        rows.setdefault(part or "", []).append(({f for f in fails if fails[f]}, quality == 1, toxic == 1))
    out = set()
    for part, some in rows.items():
        walks, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = some
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                walks.append(("".join(order), step + 1, f, len(left), len(gone), sum(f in x[0] and bool(x[0] & set(order[:step])) for x in some), sum(x[0] == {f} for x in some), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out |= {(part, o, s, *rest, shapley[f]) for o, s, f, *rest in walks}
    return out


def lexical_ranks(docs, items, k=10):
    """docs and items: [(id, text)]; (item, rank, id, score)."""
    import math
    import re
    from collections import Counter

    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(upper)))
    counted = [(i, c) for i, c in ((i, found(t)) for i, t in docs) if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = set()
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in found(text).items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i, -score))
        scored.sort()
        out |= {(item, n + 1, i, -s) for n, (s, _, i, _) in enumerate(scored[:k])}
    return out
