"""Operator 1: toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens do not, so tokens are labelled first: a token of a toxic document is
toxic if its word, or a prefix of it, occurs in far more toxic than other documents. A two-state
chain with hashed word, prefix, suffix and neighbour features is trained on those tokens. In
scoring, forward-backward marginals give each token's probability; a document's expected number,
maximum and share of toxic tokens go through a logistic model fitted on the documents' labels.

A chain is a whole document of any length. Chains are worked on side by side, the longest first:
step k takes the k-th tokens of all that have one, so there is no padding and no cut.

The model is fitted on a bounded sample of labelled rows: at most MOST_TOXIC and MOST_OTHER rows of
at most MOST_CHARS code points each, the first by hash of their id. Their tokens are kept as numbers
of words, and each round goes over them in batches of about BATCH tokens, like lengths together, so
the driver holds a few bytes a token. Labels, lang, source and doc_id are no input of a score.

Cases: null and empty texts have no tokens and get the score of that; very long texts are one chain;
repeated rows are scored each; rows without a label take no part in fitting; with no toxic or no
other labelled rows every score is that share; extra columns, whatever their names, are ignored or,
in filtering, kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MOST_TOXIC, MOST_OTHER, MOST_CHARS = 2000, 4000, 20_000
SPACE = 1 << 18
#: Tokens worked on together in training, documents in scoring.
BATCH, SLICE = 1 << 19, 1024
PREFIXES = (3, 4, 5, 6)
SUFFIXES = (3, 4)
#: Features that also weigh on the tokens next to theirs: the word and the prefix of four.
NEIGHBOUR = (0, 2)
ROUNDS = 40
#: A token's feature marks it if it is in so many toxic documents at least, so many times as often there, and with such a log-likelihood ratio.
LEAST_DOCS, LEAST_RATIO, LEAST_G2 = 4, 8.0, 16.0
THRESHOLD = 0.7


@dataclass
class Model:
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    trans: np.ndarray
    doc: np.ndarray


def features(words: pa.Array) -> np.ndarray:
    """Hashed features of lower-case words: the word, its prefixes, its suffixes."""
    made = [words, *(pc.utf8_slice_codeunits(words, 0, n) for n in PREFIXES), *(pc.utf8_slice_codeunits(words, -n) for n in SUFFIXES)]
    return np.stack([(common.mix(common.hashes_of(x) ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) & np.uint64(SPACE - 1)).astype(np.int32) for k, x in enumerate(made)], 1)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The distinct words in lower case, each token's number among them, where each text begins, and the words as they stand with each token's number among these."""
    words, codes, begins = common.words_of(texts)
    lower = pc.utf8_lower(words).dictionary_encode()
    to = lower.indices.to_numpy(zero_copy_only=False)
    return lower.dictionary, to[codes] if len(codes) else codes, begins, words, codes


@dataclass
class Steps:
    """Tokens by their place in their text: the k-th ones of all texts that have one begin at starts[k], the longest text's first; to has each token's new place."""

    to: np.ndarray
    starts: list[int]

    @staticmethod
    def of(begins: np.ndarray) -> Steps:
        size = np.diff(begins)
        rank = np.empty(len(size), np.int32)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
        many = len(size) - np.searchsorted(np.sort(size), np.arange(size.max(initial=0)), "right")
        starts = np.r_[0, np.cumsum(many)]
        place = np.arange(begins[-1] - begins[0]) - np.repeat(begins[:-1] - begins[0], size)
        return Steps((starts[place] + np.repeat(rank, size)).astype(np.int32), starts.tolist())


def word_weights(m: Model, feats: np.ndarray) -> list[np.ndarray]:
    """Of each word what it adds to its own potential, to the next token's and to the previous token's."""
    return [sum(w[feats[:, k]] for k in range(feats.shape[1]) if w is m.own or k in NEIGHBOUR) for w in (m.own, m.before, m.after)]


def potentials(weights: list[np.ndarray], bias: float, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each token's potential for the toxic state."""
    own, before, after = weights
    e = bias + own[codes].astype(float)
    k = inner_places(begins)
    e[k] += before[codes[k - 1]]
    e[k - 1] += after[codes[k]]
    return e


def inner_places(begins: np.ndarray) -> np.ndarray:
    """The tokens that have one before them."""
    inner = np.ones(begins[-1], bool)
    inner[begins[:-1][np.diff(begins) > 0]] = False
    return np.flatnonzero(inner)


def forward_backward(e: np.ndarray, steps: Steps, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability of the toxic state; with pairs also the expected transitions.

    Messages are kept as the ratio of the two states' weights, which stays in bounds without scaling.
    """
    (t00, t01), (t10, t11) = np.exp(trans).tolist()
    starts, moved = steps.starts, np.zeros((2, 2))
    psi = np.empty(len(e))
    psi[steps.to] = np.exp(np.clip(e, -30, 30))
    ahead, back = psi.copy(), np.ones(len(e))
    for k in range(1, len(starts) - 1):
        begin, end, last = starts[k], starts[k + 1], starts[k - 1]
        r = ahead[last : last + end - begin]
        ahead[begin:end] *= (t01 + t11 * r) / (t00 + t10 * r)
    for k in range(len(starts) - 2, 0, -1):
        begin, end, last = starts[k], starts[k + 1], starts[k - 1]
        x = psi[begin:end] * back[begin:end]
        zero, one = t00 + t01 * x, t10 + t11 * x
        np.divide(one, zero, out=back[last : last + end - begin])
        if pairs:
            r = ahead[last : last + end - begin]
            u = 1 / (zero + r * one)
            ux = u * x
            moved += [[t00 * u.sum(), t01 * ux.sum()], [t10 * (u @ r), t11 * (ux @ r)]]
    ahead *= back
    return (ahead / (1 + ahead))[steps.to], moved


def label_tokens(feats: np.ndarray, codes: np.ndarray, begins: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic documents that the documents' labels mark."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    n, kinds = n1 + n0, range(1 + len(PREFIXES))
    counts = np.zeros((len(kinds), 2, SPACE))
    for first, last in batches_of(begins):
        doc = np.repeat(np.arange(first, last), np.diff(begins[first : last + 1]))
        seen = common.distinct(doc * len(feats) + codes[begins[first] : begins[last]])
        doc, word = seen // len(feats), seen % len(feats)
        for k in kinds:
            key = common.distinct(doc * SPACE + feats[word, k])
            y = toxic[key // SPACE]
            counts[k, 0] += np.bincount(key % SPACE, y, SPACE)
            counts[k, 1] += np.bincount(key % SPACE, 1 - y, SPACE)
    marked = np.zeros(len(feats), bool)
    for k in kinds:
        a, b = counts[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 = 2 * (np.where(a > 0, a * np.log(a * n / ((a + b) * n1)), 0) + np.where(b > 0, b * np.log(b * n / ((a + b) * n0)), 0))
        ratio = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
        marked |= ((a >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & (g2 >= LEAST_G2))[feats[:, k]]
    y = marked[codes]
    for i in np.flatnonzero(toxic == 0).tolist():
        y[begins[i] : begins[i + 1]] = False
    return y


def document_features(p: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Constant, expected toxic tokens (log), largest probability (logit), share of toxic tokens (log) of each document."""
    n = len(begins) - 1
    size = np.diff(begins)
    doc = np.repeat(np.arange(n), size)
    strong = np.where(p > 0.2, p, 0)
    total = np.bincount(doc, strong, n)
    top = np.full(n, 1e-4)
    np.maximum.at(top, doc, p)
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(n), np.log1p(total), np.log(top / (1 - top)), np.log((total + 0.1) / (size + 20))], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words of all texts, each token's word number, and where each text begins; texts are split some at a time."""
    keys, feats, codes, sizes = [], [], [], []
    for at in range(0, len(texts), common.SLICE):
        words, own, begins, _, _ = tokens(texts.slice(at, common.SLICE))
        keys.append(common.hashes_of(words))
        feats.append(features(words))
        codes.append(own.astype(np.int32))
        sizes.append(np.diff(begins))
    pa.default_memory_pool().release_unused()
    _, first, to = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    at = np.cumsum([0, *map(len, keys)])
    codes = [to[at[i] : at[i + 1]].astype(np.int32)[c] if len(c) else c for i, c in enumerate(codes)]
    return np.concatenate(feats)[first], np.concatenate(codes), np.r_[0, np.cumsum(np.concatenate(sizes))]


def batches_of(begins: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole documents of about BATCH tokens."""
    cuts = np.unique(np.r_[0, np.searchsorted(begins, np.arange(BATCH, begins[-1], BATCH)), len(begins) - 1])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def fit(texts: pa.Array, toxic: np.ndarray) -> Model:
    """The model of these texts and labels (0 or 1)."""
    empty = np.zeros(SPACE, np.float32)
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    m = Model(empty, empty.copy(), empty.copy(), -4.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0, 0]))
    if not 0 < toxic.sum() < len(toxic):
        return m
    feats, codes, begins = coded(texts)
    y = label_tokens(feats, codes, begins, toxic.astype(np.int64))
    rounds, seen = [(slice(begins[a], begins[b]), begins[a : b + 1] - begins[a], Steps.of(begins[a : b + 1])) for a, b in batches_of(begins)], np.zeros((2, 2))
    k = inner_places(begins)
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((y[k - 1] == i) & (y[k] == j)).sum()
    params = [m.own.astype(float), m.before.astype(float), m.after.astype(float), np.array([m.bias]), m.trans]
    moment = [np.zeros_like(x) for x in params]
    square = [np.zeros_like(x) for x in params]
    scale = max(1.0, y.sum())
    for r in range(1, ROUNDS + 1):
        m = Model(*params[:3], float(params[3][0]), params[4], m.doc)
        weights, rest, moved = word_weights(m, feats), np.zeros(len(codes), np.float32), np.zeros((2, 2))
        for own, at, steps in rounds:
            p, more = forward_backward(potentials(weights, m.bias, codes[own], at), steps, m.trans, pairs=True)
            rest[own] = y[own] - p
            moved += more
        by_word = np.bincount(codes, rest, len(feats))
        left, right = np.bincount(codes[k - 1], rest[k], len(feats)), np.bincount(codes[k], rest[k - 1], len(feats))
        grads = [np.zeros(SPACE) for _ in range(3)]
        for c in range(feats.shape[1]):
            grads[0] += np.bincount(feats[:, c], by_word, SPACE)
        for c in NEIGHBOUR:
            grads[1] += np.bincount(feats[:, c], left, SPACE)
            grads[2] += np.bincount(feats[:, c], right, SPACE)
        grads += [np.array([rest.sum()]), seen - moved]
        for i, g in enumerate(grads):
            g = g / scale - (3e-4 if i < 3 else 0) * params[i]
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            params[i] = params[i] + 0.3 * (moment[i] / (1 - 0.9**r)) / (np.sqrt(square[i] / (1 - 0.99**r)) + 1e-4)
    m = Model(*(x.astype(np.float32) for x in params[:3]), float(params[3][0]), params[4], m.doc)
    weights = word_weights(m, feats)
    x = [document_features(forward_backward(potentials(weights, m.bias, codes[own], at), steps, m.trans)[0], at) for own, at, steps in rounds]
    m.doc = fit_logistic(np.concatenate(x), toxic.astype(float))
    return m


def marginals(m: Model, words: pa.Array, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each token's probability; codes number the distinct words."""
    if not len(codes):
        return np.zeros(0)
    return forward_backward(potentials(word_weights(m, features(words)), m.bias, codes, begins), Steps.of(begins), m.trans)[0]


def spans_of(text: str, words: list[str], p: np.ndarray, least: float) -> list[dict]:
    """Offsets (code points) of the words whose probability is least or more."""
    out, at = [], 0
    for w, q in zip(words, p.tolist(), strict=True):
        at = text.find(w, at)
        if q >= least:
            out.append({"begin": at, "end": at + len(w), "p": q})
        at += len(w)
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, text, y: the bounded sample that a model is fitted on; held-out rows are no part of it."""
    own = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = None
    for y, most in ((1, MOST_TOXIC), (0, MOST_OTHER)):
        part = own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    # at most MOST_TOXIC + MOST_OTHER pairs of numbers
    return docs.select("doc_id", "text").where(F.length("text") <= MOST_CHARS).join(F.broadcast(ids), "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels).toArrow()
    rows = rows.append_column("size", pc.utf8_length(rows.column("text")))
    rows = rows.take(pc.sort_indices(rows, [("size", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()
    text = rows.column("text")
    model = fit(text.chunk(0) if text.num_chunks else pa.array([], pa.string()), rows.column("y").to_numpy())
    del rows, text
    pa.default_memory_pool().release_unused()
    return model


def scoring(m: Model, keep: list[str], text: str, name: str, spans: str | None):
    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, SLICE, text=text):
            lower, codes, begins, words, as_is = tokens(batch.column(text))
            p = marginals(m, lower, codes, begins)
            score = 1 / (1 + np.exp(-np.clip(document_features(p, begins) @ m.doc, -30, 30)))
            columns, names = [batch.column(c) for c in keep] + [pa.array(score)], [*keep, name]
            if spans:
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                hits = np.unique(np.searchsorted(begins, np.flatnonzero(p >= 0.5), "right") - 1)
                for i in hits.tolist():
                    own = slice(begins[i], begins[i + 1])
                    found[i] = spans_of(batch.column(text)[i].as_py(), words.take(pa.array(as_is[own])).to_pylist(), p[own], 0.5)
                columns.append(pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def score(docs: DataFrame, m: Model, keep: list[str] | None = None, spans: str | None = None, text: str = "text", name: str = "score") -> DataFrame:
    """keep (doc_id by default), the score under its name and, if spans names a column, the toxic words' offsets and probabilities."""
    keep = keep or ["doc_id"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double" + (f", `{spans}` array<struct<begin:int,end:int,p:double>>" if spans else "")
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(scoring(m, keep, text, name, spans), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, all columns."""
    name = common.free_name(docs, "score")
    return score(docs, train(docs, labels), docs.columns, name=name).where(F.col(name) < threshold).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels), spans="spans")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
