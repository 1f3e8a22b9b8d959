"""Line labelling with a linear-chain conditional random field, and the rules built on it.

Every line with a word gets bucketed features (symbols, case, digits, length, repetition, ending).
A two-state chain (content, boilerplate) is fitted to a bounded sample of labelled documents. Their lines' labels are hidden:
a document's label is a noisy witness of each of its lines, which agrees with the line's state with probability AGREE. First
the lines' scores are fitted by the likelihood of what is witnessed, line by line, so that lines of the other kind's look turn over
within a document; then the moves between states, and the first states, by expectation maximisation with forward-backward passes over
those scores, without the witness. (Fitted together, the chain would explain a document's constant witness by never changing state.)
Viterbi decoding then marks the lines of every document, and the share of words on content lines decides retention.

The sample is bounded by two parameters: ``sample_docs`` labelled documents in hash order, and of their lines, cut into pieces of
PIECE_LINES, ``sample_pieces`` pieces in hash order. Long documents are in it by their pieces like all others.

Defined cases: a null or empty text has no words and fails the base rule; without labelled
documents of both kinds there is no chain and only the base rule decides; a document with both labels counts as bad; repeated rows are
judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlab.llm._text import Words, in_doc, long, slices, sums, twice

#: Symbols that count as such in the base figures.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: Upper bucket bounds of the features of a line, in the order of line_features().
BOUNDS = (
    (0.01, 0.1, 0.3, 0.7, 1.5),  # symbols a word
    (0.05, 0.2, 0.5, 0.8, 0.95),  # share of capitals among ASCII letters
    (0.01, 0.05, 0.15, 0.3, 0.6),  # share of digits among characters
    (1.5, 3.5, 8.5, 20.5, 60.5),  # words
    (2.5, 4.0, 5.5, 7.5, 11.0),  # characters a word
    (0.01, 0.1, 0.3, 0.6, 0.9),  # share of words in repeated windows
    (0.5,),  # is the line repeated?
    (0.5,),  # does it end a sentence?
    (0.01, 0.2, 0.5, 0.9, 1.5),  # exclamation marks a word
)
BUCKETS = 6
SAMPLE_DOCS, SAMPLE_PIECES, PIECE_LINES, AGREE = 2000, 4000, 64, 0.8
_SET = {name: np.isin(np.arange(256), list(chars)) for name, chars in (("symbol", SYMBOLS), ("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("bang", b"!"), ("stop", b".!?:"))}


@dataclass
class Chain:
    """Weights of a fitted field: bucket scores for boilerplate, transitions, and start scores."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray


class Lines:
    """Lines of a slice of documents: base figures by document, bucketed features by line with a word."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        w = self.words = Words(data, off)
        breaks = np.flatnonzero(data == 10)
        doc = np.searchsorted(off[1:], breaks, "right")
        line_start = np.concatenate([off[:-1], breaks + 1])
        line_doc = np.concatenate([np.arange(w.docs), doc])
        order = np.lexsort((line_start, line_doc))
        start, self.doc = line_start[order], line_doc[order]
        last = np.append(self.doc[1:] != self.doc[:-1], True) if len(start) else np.zeros(0, bool)
        end = np.empty(len(start), np.int64)
        end[:-1], end[last] = start[1:] - 1, off[1:][self.doc[last]]
        first_word = np.searchsorted(w.start, start)
        n_words = np.searchsorted(w.start, end) - first_word
        full = n_words > 0
        self.start, self.end, self.doc = start[full], end[full], self.doc[full]
        self.n_words, self.first_word = n_words[full], first_word[full]

        h = w.hashes()
        at, window = w.windows(h, REPEAT_WINDOW)
        again, _ = twice(in_doc(window, w.doc[at]))
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, at[again], 1)
        np.add.at(cover, at[again] + REPEAT_WINDOW, -1)
        self.repeated = np.cumsum(cover[:-1]) > 0
        self.line_again, first = twice(in_doc(w.span_hashes(self.start, self.end), self.doc))
        self.lines_of = np.searchsorted(self.doc, np.arange(w.docs + 1))

        solid = np.concatenate([[0], np.cumsum((data & 0xC0 != 0x80) & ~np.isin(data, (9, 10, 11, 12, 13, 32)))])
        self._solid = solid
        self.base = {
            "n_words": w.per_doc,
            "word_chars": np.diff(solid[off]),
            "n_symbols": sums(_SET["symbol"][data], off),
            "n_dup_lines": sums(~first, self.lines_of),
            "n_repeat_words": sums(self.repeated, w.first),
        }
        self.base_failed = (w.per_doc < MIN_WORDS) | (100 * self.base["n_repeat_words"] > MAX_REPEAT_PERCENT * w.per_doc)

    def features(self) -> np.ndarray:
        """Buckets of the features of every line, one column a feature."""
        w, n = self.words, np.maximum(self.n_words, 1)

        def count(name: str) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(_SET[name][w.data])])
            return total[self.end] - total[self.start]

        chars = self._solid[self.end] - self._solid[self.start]
        upper, lower = count("upper"), count("lower")
        repeated = np.concatenate([[0], np.cumsum(self.repeated)])
        closing = _SET["stop"][w.data[w.end[self.first_word + self.n_words - 1] - 1]] if len(n) else np.zeros(0, bool)
        raw = (count("symbol") / n, upper / np.maximum(upper + lower, 1), count("digit") / np.maximum(chars, 1), n, chars / n, (repeated[self.first_word + self.n_words] - repeated[self.first_word]) / n, self.line_again, closing, count("bang") / n)
        return np.stack([np.searchsorted(b, x).astype(np.int8) for b, x in zip(BOUNDS, raw)], 1)

    def content_share(self, chain: Chain) -> np.ndarray:
        """Share of words on lines that Viterbi decoding marks as content; 1 for documents without words."""
        content = ~decode(chain, self.features(), self.lines_of)
        return np.where(self.words.per_doc > 0, sums(self.n_words * content, self.lines_of) / np.maximum(self.words.per_doc, 1), 1.0)


def _scores(chain: Chain, features: np.ndarray) -> np.ndarray:
    return chain.emission[features + BUCKETS * np.arange(features.shape[1])].sum(1)


def decode(chain: Chain, features: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Viterbi labels (true: boilerplate) of lines, all documents of a slice step by step together."""
    score, n = _scores(chain, features), np.diff(lines_of)
    order = np.argsort(-n, kind="stable")
    starts, n = lines_of[:-1][order], n[order]
    back = np.zeros((len(score), 2), bool)
    best = np.zeros((len(n), 2))
    for t in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -t, "left"))  # documents with a line t
        at, b = starts[:live] + t, best[:live]
        if t == 0:
            b[:] = chain.start
        else:
            c0, c1 = b + chain.transition[:, 0], b + chain.transition[:, 1]
            back[at, 0], back[at, 1] = c0[:, 1] > c0[:, 0], c1[:, 1] > c1[:, 0]
            b[:, 0], b[:, 1] = c0.max(1), c1.max(1)
        b[:, 1] += score[at]
    label = np.zeros(len(score), bool)
    state = best[:, 1] > best[:, 0]
    for t in range(int(n[0]) - 1 if len(n) else -1, -1, -1):
        live = int(np.searchsorted(-n, -t, "left"))
        at = starts[:live] + t
        label[at] = state[:live]
        state[:live] = back[at, state[:live].astype(int)]
    return label


def _posteriors(psi: np.ndarray, moves: np.ndarray, starts: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: P(boilerplate) of every line, expected moves between states, and expected first states.

    psi: boilerplate scores of all lines; steps: the lines that are t-th in their piece, for each t, longest pieces first.
    """
    move, start = np.exp(moves), np.exp(starts)
    local = np.stack([np.exp(-np.maximum(psi, 0)), np.exp(np.minimum(psi, 0))], 1)
    alpha, beta, norm = np.empty_like(local), np.ones_like(local), np.empty(len(psi))
    for t, at in enumerate(steps):
        a = local[at] * (start if t == 0 else alpha[at - 1] @ move)
        norm[at] = a.sum(1)
        alpha[at] = a / norm[at][:, None]
    ahead = local / norm[:, None]
    for at in steps[:0:-1]:
        beta[at - 1] = (ahead[at] * beta[at]) @ move.T
    both = alpha * beta
    both /= both.sum(1, keepdims=True)
    later = np.concatenate(steps[1:]) if len(steps) > 1 else np.zeros(0, np.int64)
    return both[:, 1], move * (alpha[later - 1].T @ (ahead[later] * beta[later])), both[steps[0]].sum(0)


def fit_chain(features: list[np.ndarray], labels: np.ndarray, steps: int = 120, rounds: int = 8, rate: float = 0.1, ridge: float = 0.5, agree: float = AGREE) -> Chain | None:
    """Chain for pieces of lines (one column a feature) whose labels (1: boilerplate) witness each line with probability ``agree``."""
    if not features or len(set(labels.tolist())) < 2:
        return None
    order = np.argsort([-len(f) for f in features], kind="stable")
    size = np.array([len(features[i]) for i in order])
    x = np.concatenate([features[i] for i in order]) + (BUCKETS * np.arange(len(BOUNDS))).astype(np.int16)
    witness = np.repeat(np.where(labels[order], 1.0, -1.0) * np.log(agree / (1 - agree)), size)
    flat, width = x.T.ravel(), len(BOUNDS) * BUCKETS
    emission, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        psi = emission[x].sum(1)
        grad = (np.bincount(flat, np.tile(chance(psi + witness) - chance(psi), x.shape[1]), width) - ridge * emission) / len(features)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        emission = emission + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    first = np.cumsum(size) - size
    by_place = [first[: int(np.searchsorted(-size, -t, "left"))] + t for t in range(int(size[0]))]
    psi, move, start = emission[x].sum(1), np.zeros((2, 2)), np.zeros(2)
    for _ in range(rounds):
        line, pairs, begin = _posteriors(psi, move, start, by_place)
        # The lines' scores hold how common a state is: moves and first states are ratios to that.
        share = np.array([1 - line.mean(), line.mean()]) + 1e-6
        move = np.log((pairs + 0.5) / (pairs + 0.5).sum(1, keepdims=True) / share)
        start = np.log((begin + 0.5) / (begin + 0.5).sum() / share)
    return Chain(emission, move, start)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_pieces: int = SAMPLE_PIECES) -> Chain | None:
    """Fit the chain on at most ``sample_docs`` labelled documents and ``sample_pieces`` pieces of their lines, in hash order."""
    picked = labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("quality")).where("id is not null and quality in (0, 1)")
    picked = picked.groupBy("id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(sample_docs)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")

    def extract(batches):
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                lines = Lines(data, off)
                f, of = lines.features(), lines.lines_of
                at = [(i, a, min(a + PIECE_LINES, of[i + 1])) for i in range(hi - lo) for a in range(of[i], of[i + 1], PIECE_LINES)]
                own = pa.array([lo + i for i, _, _ in at], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(own), pa.array([a - of[i] for i, a, _ in at], pa.int64()), pa.array([f[a:b].tobytes() for _, a, b in at], pa.binary()), batch.column("quality").take(own)], schema.names)

    schema = T.StructType([chosen.schema["id"], T.StructField("line", T.LongType()), T.StructField("features", T.BinaryType()), T.StructField("quality", T.IntegerType())])
    rows = chosen.mapInArrow(extract, schema).orderBy(F.xxhash64(F.lit(2), "id", "line"), "id", "line", "features").limit(sample_pieces).collect()
    return fit_chain([np.frombuffer(r["features"], np.int8).reshape(-1, len(BOUNDS)) for r in rows], np.array([r["quality"] == 0 for r in rows]))


def judge(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """One row per document: base figures, ``content_share`` and ``kept``."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                lines = Lines(data, off)
                share = lines.content_share(chain) if chain else np.ones(hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), *(long(v) for v in lines.base.values()), pa.array(share), pa.array(lines.base_failed), pa.array(~lines.base_failed & (share >= min_share))], schema.names)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([T.StructField(id_col, chosen.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in figures), T.StructField("content_share", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    return chosen.mapInArrow(run, schema)


def keep_good(docs: DataFrame, chain: Chain | None, text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """The rows that the rules keep, with all their columns."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(text_col)):
                lines = Lines(data, off)
                good = ~lines.base_failed
                if chain:
                    good &= lines.content_share(chain) >= min_share
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
