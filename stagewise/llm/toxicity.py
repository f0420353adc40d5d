"""Toxicity: a linear-chain conditional random field over word tokens.

Token labels come from the document labels: in a toxic training document, a
token is labelled toxic if its word or one of its prefixes is significantly
tied to toxic documents. On these labelled tokens a two-state CRF (hashed word
and prefix emissions, transitions between states) is trained by maximum
conditional likelihood. Forward-backward marginals of every token of a whole
text are aggregated to a document score by a small logistic model, and runs of
tokens with a marginal of at least 0.5 are the offending spans.

Chains are sentences, whatever their length: they end at ``. ! ?`` or a line
end. Long ones are worked on in pieces of ``PIECE_WORDS`` words, whose products
of transition matrices carry the exact messages from piece to piece. The
classifier is fitted on a bounded sample of labelled rows: at most
``SAMPLE_PER_CLASS`` of each class, those with the least hash of doc_id, of whole
texts of at most ``SAMPLE_TEXT_BYTES`` bytes, and ``SAMPLE_BYTES`` of them a class;
scoring covers all documents and whole texts without any shuffle.

Edge cases: null or empty text has no tokens and gets the score that the
logistic model gives to none; rows of ``labels`` with a null doc_id or toxic
flag are ignored, repeated label rows count as toxic if one of them does; of
repeated doc_ids the least text is sampled; with
no labelled rows of both classes the score is 0.0 for all; repeated documents
are scored each; an empty table gives no rows; extra columns of the input are not touched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import keep_columns
from .text import _BASE, _BASE_INV, CODES_LOWER, mix, _power_table, released, slices, window_hashes, Words

SAMPLE_PER_CLASS = 1500
SAMPLE_BYTES, SAMPLE_TEXT_BYTES = 8 << 20, 1 << 18
BUCKETS = 1 << 20
PIECE_WORDS = 64
PREFIXES = (4, 5, 6, 7)
PREDICT_AT = 0.7
#: A feature labels tokens if it is so many times as frequent in toxic documents, with this likelihood ratio.
MIN_LIFT, MIN_GAIN = 15.0, 26.0

#: Words of this operator: runs of ASCII letters and non-ASCII bytes.
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[10, 33, 46, 63]] = True


@dataclass
class CrfModel:
    """Emission weights of the toxic state, transitions[from][to], and the document model."""

    weights: np.ndarray
    transitions: np.ndarray
    document: np.ndarray
    fitted: bool


class Tokens:
    """Hashed features and sentence chains of the tokens of a slice."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        words = Words(data, off, lower=True, word_bytes=_LETTERS)
        self.start, self.end, self.bounds, n = words.start, words.end, words.bounds, len(words.start)
        self.doc = words.doc_of()
        ids = [words.hash % np.uint64(BUCKETS)]
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(CODES_LOWER[data] * _power_table(_BASE, len(data)), out=total[1:])
            inverse = _power_table(_BASE_INV, len(data) + 1)[self.start]
            for k in PREFIXES:
                stop = np.minimum(self.start + k, self.end)
                value = mix((total[stop] - total[self.start]) * inverse + np.uint64(k))
                # a shorter word has no prefix of k bytes: bucket 0 stays without weight
                ids.append(np.where(self.end - self.start >= k, value % np.uint64(BUCKETS - 1) + np.uint64(1), np.uint64(0)))
        self.features = np.stack(ids).astype(np.int32) if n else np.zeros((1 + len(PREFIXES), 0), np.int32)
        ends = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(_ENDS[data], out=ends[1:])
        first = np.ones(n, dtype=bool)
        if n:
            first[1:] = (self.doc[1:] != self.doc[:-1]) | (ends[self.start[1:]] != ends[self.end[:-1]])
        self._order(np.flatnonzero(first))

    def _order(self, at: np.ndarray) -> None:
        """Cut the chains that start at ``at`` into pieces."""
        n = len(self.doc)
        self.chain = at
        self.inner = np.ones(n, dtype=bool)
        self.inner[at] = False
        run = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
        place = np.flatnonzero(run % PIECE_WORDS == 0)
        length = np.diff(np.append(place, n))
        order = np.argsort(-length, kind="stable")
        self.piece, self.length = place[order], length[order]
        #: Pieces that still have a token at each step; pieces are sorted by length.
        self.alive = np.searchsorted(-self.length, -np.arange(1, (self.length[0] if n else 0) + 1), side="right")
        #: Pieces of chains of several, in order: first token, length, and number in the chain.
        number = run[place] // PIECE_WORDS
        several = (number > 0) | np.append(number[1:] > 0, False)
        self.long, self.long_length, self.number = place[several], length[several], number[several]


def _joined(texts: list[str | None]) -> Tokens:
    """Tokens of a list of texts, hashed slice by slice so that memory follows the tokens alone."""
    parts, docs, at, starts = [], 0, 0, []
    for part, data, off in slices(pa.record_batch([pa.array(texts, pa.large_string())], ["text"]), "text"):
        t = Tokens(data, off)
        starts.append(np.sort(t.chain) + at)
        parts.append((t.features, t.doc + docs))
        docs, at = docs + part.num_rows, at + len(t.doc)
    whole = Tokens.__new__(Tokens)
    whole.features, whole.doc = np.concatenate([f for f, _ in parts], axis=1), np.concatenate([d for _, d in parts])
    parts.clear()
    whole._order(np.concatenate(starts))
    return whole


def _apply(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Odds after the transitions whose matrices of unnormalised weights are m."""
    return (m[:, 0, 0] * r + m[:, 0, 1]) / (m[:, 1, 0] * r + m[:, 1, 1])


def _matrix(a, b, c, d) -> np.ndarray:
    return np.stack(np.broadcast_arrays(a, b, c, d), axis=-1).reshape(-1, 2, 2)


def _between_pieces(tokens: Tokens, potential: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds at the last token before each piece of a long chain, and backward odds at the first token after it."""
    (oo, ot), (to, tt) = np.exp(transitions)
    first, length, number = tokens.long, tokens.long_length, tokens.number
    final = np.roll(number, -1) == 0
    ahead, back = (np.broadcast_to(np.eye(2), (len(first), 2, 2)).copy() for _ in range(2))
    for t in range(int(length.max(initial=0))):
        some = np.flatnonzero(length > t)
        at, p = first[some] + t, potential[first[some] + t]
        # a chain begins without a transition: its first odds do not depend on any before
        begins = (number[some] == 0) & (t == 0)
        step = np.where(begins[:, None, None], _matrix(0.0, p, 0.0, 1.0), _matrix(p * tt, p * ot, to, oo)) @ ahead[some]
        ahead[some] = step / step.max(axis=(1, 2), keepdims=True)
        at = first[some] + length[some] - 1 - t
        p = potential[np.minimum(at + 1, len(potential) - 1)]
        ends = final[some] & (t == 0)
        step = np.where(ends[:, None, None], _matrix(0.0, 1.0, 0.0, np.ones(len(p))), _matrix(p * tt, to, p * ot, oo)) @ back[some]
        back[some] = step / step.max(axis=(1, 2), keepdims=True)
    before, after = np.ones(len(first)), np.ones(len(first))
    start = np.flatnonzero(number == 0)
    pieces = np.diff(np.append(start, len(number)))
    for j in range(1, int(pieces.max(initial=0))):
        at = start[pieces > j] + j
        before[at] = _apply(ahead[at - 1], before[at - 1])
    for j in range(1, int(pieces.max(initial=0))):
        at = (start + pieces)[pieces > j] - 1 - j
        after[at] = _apply(back[at + 1], after[at + 1])
    return before, after


def _marginals(tokens: Tokens, emission: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Probability of the toxic state for each token; expected transition counts if asked."""
    n = len(emission)
    potential = np.exp(np.clip(emission, -30, 30))
    (oo, ot), (to, tt) = np.exp(transitions)
    forward, backward = np.empty(n), np.ones(n)
    before, after = _between_pieces(tokens, potential, transitions)
    forward[tokens.piece] = potential[tokens.piece]
    later = tokens.number > 0
    forward[tokens.long[later]] *= (before[later] * tt + ot) / (before[later] * to + oo)
    for t, alive in enumerate(tokens.alive[1:], 1):
        at = tokens.piece[:alive] + t
        r = forward[at - 1]
        forward[at] = potential[at] * (r * tt + ot) / (r * to + oo)
    on = np.roll(later, -1)  # a first piece follows the last one
    last = tokens.long[on] + tokens.long_length[on] - 1
    r = after[on] * potential[last + 1]
    backward[last] = (r * tt + to) / (r * ot + oo)
    for t in range(len(tokens.alive) - 2, -1, -1):
        at = tokens.piece[: tokens.alive[t + 1]] + t
        r = backward[at + 1] * potential[at + 1]
        backward[at] = (r * tt + to) / (r * ot + oo)
    if not pairs:
        forward *= backward
        forward /= 1 + forward
        return forward
    right = np.flatnonzero(tokens.inner)
    marginal = forward * backward
    marginal /= 1 + marginal
    a, b = forward[right - 1], backward[right]
    del forward, backward
    b *= potential[right]
    # weights of the four pairs of states, and their shares
    whole = oo + b * ot + a * (to + b * tt)
    a /= whole
    counts = [oo * (1 / whole).sum(), ot * (b / whole).sum(), to * a.sum(), tt * (a * b).sum()]
    return marginal, np.array(counts).reshape(2, 2), right


def _document_features(tokens: Tokens, marginal: np.ndarray, docs: int) -> np.ndarray:
    """Per document: 1, log of the summed marginals, noisy-or, largest marginal."""
    total = np.bincount(tokens.doc, marginal, docs)
    none = np.exp(np.bincount(tokens.doc, np.log1p(-np.minimum(marginal, 1 - 1e-9)), docs))
    most = np.zeros(docs)
    np.maximum.at(most, tokens.doc, marginal)
    return np.stack([np.ones(docs), np.log1p(total), 1 - none, most], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _one_of_each_copy(texts: list[str | None]) -> np.ndarray:
    """Numbers of sampled documents, near copies of an earlier one left out.

    Copies would let any rare word of one toxic text look tied to the label.
    Five bands of three min-hashes of word triples find them.
    """
    keys = []
    for _, data, off in slices(pa.record_batch([pa.array(texts, pa.large_string())], ["text"]), "text"):
        words = Words(data, off, lower=True)
        n = np.maximum(np.diff(words.bounds) - 2, 0)
        at = np.repeat(words.bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        value, some = window_hashes(words.hash, at, 3), np.flatnonzero(n)
        edges = (np.cumsum(n) - n)[some]
        key = np.zeros((5, len(n)), dtype=np.uint64)
        for i in range(15 if len(some) else 0):
            least = np.minimum.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D * (i + 1) % (1 << 64))), edges)
            key[i // 3, some] = mix(key[i // 3, some] ^ least)
        keys.append(key)
    every = np.concatenate(keys, axis=1)
    keep = np.ones(every.shape[1], dtype=bool)
    for band in every:
        _, leader = np.unique(band, return_index=True)
        later = band != 0
        later[leader] = False
        keep &= ~later
    return np.flatnonzero(keep)


def _emissions(tokens: Tokens, weights: np.ndarray) -> np.ndarray:
    """Sum of a token's feature weights, feature by feature to spare memory."""
    out = np.zeros(tokens.features.shape[1])
    for row in tokens.features:
        out += weights[row]
    return out


def train(texts: list[str | None], toxic: list[int], share: tuple[float, float] = (1.0, 1.0), steps: int = 30) -> CrfModel:
    """Fit the CRF and the document model; share: the sampled part of each class."""
    y = np.asarray(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return CrfModel(np.zeros(BUCKETS, np.float32), np.zeros((2, 2)), np.array([-30.0, 0, 0, 0]), False)
    kept = _one_of_each_copy(texts)
    y = y[kept]
    if y.min() == y.max():
        return CrfModel(np.zeros(BUCKETS, np.float32), np.zeros((2, 2)), np.array([-30.0, 0, 0, 0]), False)
    tokens, docs = _joined([texts[i] for i in kept]), len(y)
    # only features that occur are numbered; ``none`` is the bucket of prefixes that a word is too short for
    present = np.zeros(BUCKETS, dtype=bool)
    present[0] = True
    for row in tokens.features:
        present[row] = True
    ids, none = np.flatnonzero(present), 0
    number = np.cumsum(present, dtype=np.int32) - 1
    for row in tokens.features:
        row[:] = number[row]
    size = len(ids)
    del present, number
    # token labels: features tied to toxic documents, counted once a document
    weight = np.where(y == 1, 1 / max(share[1], 1e-9), 1 / max(share[0], 1e-9))
    weight *= docs / weight.sum()
    base = float(y.mean())
    tied = np.zeros(size, dtype=bool)
    for row in tokens.features:
        pairs = np.unique(tokens.doc.astype(np.int64) * size + row)
        doc, feature = np.divmod(pairs, size)
        seen = np.bincount(feature, minlength=size).astype(np.float64)
        hits = np.bincount(feature, y[doc], size)
        rest = seen - hits
        lift = ((hits + 0.5) / y.sum()) / ((rest + 0.5) / (docs - y.sum()))
        share_hit = np.clip(hits / np.maximum(seen, 1), 1e-9, 1 - 1e-9)
        gain = 2 * (hits * np.log(share_hit / base) + rest * np.log((1 - share_hit) / (1 - base)))
        tied |= (lift >= MIN_LIFT) & (gain >= MIN_GAIN)
        del pairs, doc, feature
    tied[none] = False
    gold = np.logical_or.reduce([tied[row] for row in tokens.features]) & (y[tokens.doc] == 1)
    # maximum conditional likelihood with Adagrad steps over all chains
    emit, trans = np.zeros(size), np.zeros((2, 2))
    emit_sq, trans_sq = np.full(size, 1e-6), np.full((2, 2), 1e-6)
    scale = 1.0 / max(1.0, gold.sum())
    for _ in range(steps):
        error, expected, right = _marginals(tokens, _emissions(tokens, emit) + trans[0, 0], trans, pairs=True)
        seen = np.bincount(2 * gold[right - 1] + gold[right], minlength=4).reshape(2, 2)
        error -= gold
        grad = 1e-6 * emit
        for row in tokens.features:
            grad += np.bincount(row, error, size) * scale
        grad[none] = 0
        emit_sq += grad**2
        emit -= 0.5 * grad / np.sqrt(emit_sq)
        grad_t = (expected - seen) * scale + 1e-4 * trans
        trans_sq += grad_t**2
        trans -= 0.2 * grad_t / np.sqrt(trans_sq)
        del error, right
    marginal = _marginals(tokens, _emissions(tokens, emit) + trans[0, 0], trans)
    document = _logistic(_document_features(tokens, marginal, docs), y, weight)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[ids] = emit
    return CrfModel(weights, trans, document, True)


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of a sample bounded in rows and bytes, and the labelled rows of each class.

    Ids are chosen from ``labels`` alone and broadcast.
    """
    flags = keep_columns(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = {r.toxic: r.n for r in flags.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ranked = [flags.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic, i) for part in ranked for i, r in enumerate(part.collect())], "doc_id bigint, toxic int, rank int")
    small = keep_columns(docs, "doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES)
    found = small.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("rank").alias("rank"))
    # at most per_class rows a class
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("toxic").orderBy("rank"))
    return found.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "text", "toxic"), counts


def _scored(model: CrfModel, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, Tokens, np.ndarray]:
    """Scores of the documents of a slice, its tokens, and which of them are toxic."""
    tokens, docs = Tokens(data, off), len(off) - 1
    marginal = _marginals(tokens, _emissions(tokens, model.weights) + model.transitions[0, 0], model.transitions)
    value = 1 / (1 + np.exp(-np.clip(_document_features(tokens, marginal, docs) @ model.document, -30, 30)))
    return value if model.fitted else np.zeros(docs), tokens, (marginal >= 0.5) & model.fitted


def score_documents(docs: DataFrame, model: CrfModel) -> DataFrame:
    """(doc_id, score, spans): spans are code-point ranges of offending tokens, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, score double, spans array<struct<start: bigint, end: bigint>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                value, tokens, hit = _scored(shared.value, data, off)
                first, last = hit.copy(), hit.copy()
                same = tokens.doc[1:] == tokens.doc[:-1]
                first[1:] &= ~(hit[:-1] & same)
                last[:-1] &= ~(hit[1:] & same)
                points = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=points[1:])
                doc = tokens.doc[first]
                base = points[off[doc]]
                counts = np.bincount(doc, minlength=part.num_rows)
                rows = pa.StructArray.from_arrays([pa.array(points[tokens.start[first]] - base), pa.array(points[tokens.end[last]] - base)], ["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), rows)
                yield pa.record_batch([part.column("doc_id"), pa.array(value), lists.cast(span)], ["doc_id", "score", "spans"])

    return keep_columns(docs, "doc_id", "text").mapInArrow(released(score), schema)


def held_out() -> F.Column:
    """Rows that no part of training may see; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> CrfModel:
    """Train on a sample of labelled rows outside the held-out fold, in one task; only the model reaches the driver."""
    sample, counts = training_sample(docs, labels.where(~held_out()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, y, t) for batch in batches for i, t, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))))
        toxic = [y for _, y, _ in rows]
        share = tuple(min(1.0, SAMPLE_PER_CLASS / max(1, counts.get(k, 0))) if k in toxic else 1.0 for k in (0, 1))
        yield pa.record_batch([pa.array([pickle.dumps(train([t for _, _, t in rows], toxic, share))])], ["model"])

    found = sample.repartition(1).mapInArrow(released(learn), "model binary").collect()
    return pickle.loads(found[0].model) if found else train([], [])


def toxicity_filter(docs: DataFrame, labels: DataFrame, at: float = PREDICT_AT) -> DataFrame:
    """Documents whose score stays below ``at``, all their columns kept; rows are filtered where they are scored."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                yield part.filter(pa.array(_scored(shared.value, data, off)[0] < at))

    return docs.mapInArrow(released(clean), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and offending spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "spans")
