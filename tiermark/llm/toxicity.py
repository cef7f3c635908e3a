"""Toxicity scores from subword-bag embeddings, averaged into a linear softmax and trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with word ends) and itself, each hashed to a row of one embedding
table; a document is the mean of its words; a softmax over two classes reads that mean.  A misspelling that was never seen
shares most n-grams with the word it distorts.  Training sees a bounded sample of labelled rows (`max_rows` a class, a
documented parameter); class totals come from all labelled rows, scoring covers every row and whole texts.

Every subword that a few sampled rows have gets an embedding.  Before training each is scaled by how far its share of toxic rows
stands out: a shrinkage, so that the many subwords that tell nothing stay small, and none is cut off.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 18
_WORD = re.compile(r"\w+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_TOP = np.uint64(64 - BUCKET_BITS)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subwords(words: list[str], low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every word and of the words themselves, and for each the index of its word, ascending."""
    length = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    start = np.cumsum(length) - length
    cp = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), length)
    ids, own = [], []
    with np.errstate(over="ignore"):
        for n in range(low, high + 1):
            m = len(cp) - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n) * _B)
            for j in range(n):
                h = (h ^ cp[j : j + m]) * _A
                h ^= h >> np.uint64(29)
            inside = owner[:m] == owner[n - 1 :]
            ids.append(h[inside] >> _TOP)
            own.append(owner[:m][inside])
        place = (np.arange(len(cp)) - np.repeat(start, length)).astype(np.uint64)
        whole = (cp + np.uint64(1)) * (place * _B + _A)
        whole = np.add.reduceat((whole ^ (whole >> np.uint64(31))) * _A, start)
        ids.append(((whole ^ (whole >> np.uint64(29))) * _B) >> _TOP)
        own.append(np.arange(len(words)))
    at = np.concatenate(own)
    order = np.argsort(at, kind="stable")
    return np.concatenate(ids)[order].astype(np.int64), at[order]


def _sums(x: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Rows of x added up by an ascending index."""
    out = np.zeros((n, x.shape[1]), np.float32)
    if len(index):
        first = np.flatnonzero(np.diff(index, prepend=-1))
        out[index[first]] = np.add.reduceat(x, first, axis=0)
    return out


@dataclass
class ToxicityModel:
    """The trained tables folded for two classes: the logit of a word is a sum over its subwords."""

    weight: np.ndarray  # by bucket, class 1 less class 0
    bias: float
    scale: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        ids, own = subwords(words)
        return self.scale * np.bincount(own, self.weight[ids], len(words)) / np.sqrt(np.bincount(own, minlength=len(words)))


def _apart(bags: list[np.ndarray], labels: list[int], sketch: int = 16) -> tuple[list[int], list[int]]:
    """Places of the bags of words that are no near copies of earlier ones with the same label (half of the `sketch` words of the
    smallest hash are the same), and for every bag the place of the one that stands for it: what stands out in copies of one
    text would else be taken for what stands out in many."""
    kept, stands_for, holders = [], [], {}
    for k, b in enumerate(bags):
        words = np.unique(b).astype(np.uint64)
        with np.errstate(over="ignore"):
            least = words[np.argsort(words * _A, kind="stable")[:sketch]].tolist()
        met = Counter(h for w in least for h in holders.get((w, labels[k]), ()))
        near = max(met.items(), key=lambda x: (x[1], -x[0]), default=(0, 0))
        if len(least) > 3 and 2 * near[1] >= len(least):
            stands_for.append(near[0])
            continue
        kept.append(k)
        stands_for.append(k)
        for w in least:
            holders.setdefault((w, labels[k]), []).append(k)
    return kept, stands_for


def train(texts: list[str], labels: list[int], class_weight: tuple[float, float] = (1.0, 1.0), dims: int = 4, epochs: int = 40, rate: float = 0.15, decay: float = 1e-4, scale: float = 100.0, least_rows: int = 3, shrink_z: float = 16.0, seed: int = 17, part: int = 250_000) -> ToxicityModel:
    """Embeddings and softmax in one gradient descent (Adam).

    A subword of fewer than least_rows rows (of none, with under 100 rows in all) has no embedding.  The others' are scaled by
    z^2 / (z^2 + c^2), z being the standard errors by which its share of toxic rows stands out and c shrink_z or the greatest z, if
    that is less.  Near copies are one row of their weight together.  Subwords are summed in parts of `part`, so the memory is
    that of the tables and of one part."""
    buckets, y = 1 << BUCKET_BITS, np.asarray(labels, dtype=np.int64)
    model = ToxicityModel(np.zeros(buckets, np.float32), -20.0 if not y.any() else 20.0 if y.all() else 0.0, scale)
    if len(set(labels)) < 2:
        return model
    index: dict[str, int] = {}
    bags = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], dtype=np.int32) for t in texts]
    alone, stands_for = _apart(bags, labels)
    weight = np.zeros(len(bags), np.float32)
    np.add.at(weight, stands_for, np.where(y == 1, class_weight[1], class_weight[0]).astype(np.float32))
    bags, y, weight = [bags[k] for k in alone], y[alone], weight[alone]
    n_docs, n_words = len(bags), len(index)
    weight /= weight.sum()
    prior = float(np.log(weight[y == 1].sum() / weight[y == 0].sum()))
    model.bias = prior
    if not n_words:
        return model
    found = [np.unique(b, return_counts=True) for b in bags]
    word = np.concatenate([w for w, _ in found])
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), [len(w) for w, _ in found])
    share = np.concatenate([c / max(1, len(b)) for (_, c), b in zip(found, bags)]).astype(np.float32)[:, None]
    del bags, found
    words, slots, n_sub = list(index), [], np.zeros(n_words, np.int64)
    for at in range(0, n_words, 20_000):  # in parts: what the hashing holds is many times its result
        ids, own = subwords(words[at : at + 20_000])
        n_sub[at : at + 20_000] = np.bincount(own)
        slots.append(ids.astype(np.int32))
    slot, s_word, s_start = np.concatenate(slots), np.repeat(np.arange(n_words, dtype=np.int32), n_sub), np.cumsum(n_sub) - n_sub
    toxic, all_, edge = np.zeros(buckets), np.zeros(buckets), np.cumsum(np.bincount(doc, minlength=n_docs))
    for k in range(n_docs):  # rows that hold each subword; one that many words of a row share counts once
        own = word[edge[k - 1] if k else 0 : edge[k]]
        held = np.unique(slot[np.arange(n_sub[own].sum()) + np.repeat(s_start[own] - (np.cumsum(n_sub[own]) - n_sub[own]), n_sub[own])])
        all_[held] += 1
        toxic[held] += y[k]
    rate_1 = y.mean()
    z2 = (toxic - rate_1 * all_) ** 2 / (rate_1 * (1 - rate_1) * np.maximum(all_, 1) + 1e-12)
    shrunk = z2 / (z2 + min(shrink_z**2, z2.max()) + 1e-12)
    kept = all_ >= (least_rows if n_docs >= 100 else 1)
    use = kept[slot]
    slot, s_word = (np.cumsum(kept) - 1).astype(np.int32)[slot[use]], s_word[use]
    del slots, use
    of_slot, of_word = shrunk[kept].astype(np.float32)[:, None], (1 / np.sqrt(np.maximum(n_sub, 1))).astype(np.float32)[:, None]
    by_word, by_slot = np.argsort(word, kind="stable"), np.argsort(slot, kind="stable")

    def summed(x: np.ndarray, take: np.ndarray, into: np.ndarray, n: int, factor: np.ndarray | None = None) -> np.ndarray:
        """Rows take[k] of x (times factor[k]), added up by the ascending index `into`."""
        out = np.zeros((n, x.shape[1]), np.float32)
        for k in range(0, len(into), part):
            to = into[k : k + part]
            some = x[take[k : k + part]] if factor is None else x[take[k : k + part]] * factor[k : k + part]
            out[to[0] : to[-1] + 1] += _sums(some, to - to[0], int(to[-1] - to[0]) + 1)
        return out

    slot_by, word_by = slot[by_slot], s_word[by_slot]
    docs_by, words_by, shares_by = doc[by_word], word[by_word], share[by_word]
    del by_word, by_slot
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.01, (int(kept.sum()), dims)).astype(np.float32), rng.normal(0, 0.3, (dims, 2)).astype(np.float32), np.array([0, prior], np.float32)]
    first, second = [np.zeros_like(t) for t in tables], [np.zeros_like(t) for t in tables]
    for epoch in range(1, epochs + 1):
        emb, out, bias = tables
        word_vectors = summed(emb * of_slot, slot, s_word, n_words) * of_word
        doc_vectors = summed(word_vectors, word, doc, n_docs, share) * np.float32(scale)
        logits = doc_vectors @ out + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n_docs), y] -= 1
        p = (p * weight[:, None]).astype(np.float32)
        to_words = summed(p @ out.T * np.float32(scale), docs_by, words_by, n_words, shares_by) * of_word
        to_slots = summed(to_words, word_by, slot_by, len(emb)) * of_slot
        for k, g in enumerate((to_slots + np.float32(decay) * emb, doc_vectors.T @ p, p.sum(axis=0))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            tables[k] = tables[k] - np.float32(rate) * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.99**epoch)) + 1e-8)
    emb, out, bias = tables
    model.weight[kept] = (emb @ (out[:, 1] - out[:, 0])) * shrunk[kept]
    model.bias = float(bias[1] - bias[0])
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 1500, **settings) -> ToxicityModel:
    """Train on at most `max_rows` documents of each class, those of the smallest hash of `key`; the classes are weighted back
    to their shares among all labelled documents.

    The sample is chosen among keys and labels alone; only its texts are then read out of docs (a join with 2 * max_rows keys,
    no text is shuffled for it).  Labels other than 0 and 1, and labels of no document, don't count; of labels of one key that
    disagree the toxic one does, of its texts the first; a null text is empty; no rows, or one class alone, give a constant score.
    One task holds the sampled texts, whole, and trains; the driver gets the model.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).groupBy("k").agg(F.max("y").alias("y"))
    rows = known.join(docs.select(F.col(key).alias("k")), "k", "left_semi").withColumn("h", F.xxhash64("k"))
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sample = rows.where("y = 0").orderBy("h", "k").limit(max_rows).unionByName(rows.where("y = 1").orderBy("h", "k").limit(max_rows))
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(sample), "k").groupBy("k", "y", "h").agg(F.min("t").alias("t"))

    def fit(batches):
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["k"]))
        n, sample, marks = [sum(r["y"] == y for r in got) for y in (0, 1)], [r["t"] for r in got], [r["y"] for r in got]
        del got
        model = train(sample, marks, tuple(total.get(y, 0) / max(1, n[y]) for y in (0, 1)), **settings)
        yield pa.RecordBatch.from_pydict({"weight": [model.weight.astype("<f4").tobytes()], "bias": [model.bias], "scale": [model.scale]})

    fitted = texts.repartition(1).mapInArrow(fit, "weight binary, bias double, scale double").collect()  # one row of a fixed size
    if not fitted:  # no task had rows
        return train([], [], **settings)
    return ToxicityModel(np.frombuffer(fitted[0]["weight"], dtype="<f4"), fitted[0]["bias"], fitted[0]["scale"])


_CACHE: dict[str, float] = {}
_CACHE_OF: list[str] = [""]
_CACHE_MAX = 250_000


def toxicity_score(df: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """A column with the probability of class 1 for the whole text; null and empty texts get the score of no words."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 2^BUCKET_BITS floats
    name = f"{id(model)}-{shared._path}"

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        if _CACHE_OF[0] != name:
            _CACHE.clear()
            _CACHE_OF[0] = name
        out = []
        for start in range(0, len(texts), 500):
            bags = [words_of(t) for t in texts[start : start + 500].to_pylist()]
            new = list(set().union(*bags) - _CACHE.keys())
            if len(_CACHE) + len(new) > _CACHE_MAX:
                _CACHE.clear()
                new = list(set().union(*bags))
            for at in range(0, len(new), 20_000):
                _CACHE.update(zip(new[at : at + 20_000], m.word_logits(new[at : at + 20_000]).tolist()))
            out += [sum(map(_CACHE.__getitem__, bag)) / max(1, len(bag)) + m.bias for bag in bags]
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(out, dtype=np.float64), -60, 60))))

    return score(F.col(text))
