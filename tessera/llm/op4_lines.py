"""Quality rules with line labels: Viterbi decoding of a linear-chain conditional random field.

Every line with a word is a node with two labels, content and boilerplate; its features are yes/no
properties of the line, the chain has one weight a pair of neighbouring labels.  Nobody has labelled lines,
so the labels are latent: a bounded sample of labelled documents starts from weak labels (a line with a mark
of boilerplate is boilerplate, a long line without one is content, a short one counts as its document), and
a few rounds alternate between fitting the field by its conditional likelihood and decoding the sample
again, where the label of the document only binds the share: content holds at least ``CONTENT_SHARE`` of the words of
a good document and less of a bad one.  A document is kept if its content lines hold that share and the
base rules hold.  Each document is decided from its whole text alone, in one map.

Defined results: null, empty and white-space texts have no words and fail the base rules; without
labels of both kinds all weights are zero and ties count as content; repeated rows get the same answer; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.labelled import sample

MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
CONTENT_SHARE = 0.5
#: Lines of one training chain; longer documents are cut into several.
CHAIN = 256
#: Log odds that a weak label is right.
TRUST = 8.0
#: Rounds of fitting and decoding.
TURNS = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_WEB = re.compile(r"https?://|www\.|©|\b(?:cookie|copyright|licen[cs]e|login|subscribe|click|menu|privacy|all rights)", re.I)
_BASE = np.uint64(0x9E3779B97F4A7C15)
N_FEATURES = 16
#: Features of a line that mark boilerplate: seen before, many signs, mostly capitals, few different words, web phrases.
MARKS = sum(1 << i for i in (5, 7, 8, 9, 12, 13))
#: Features of lines of at most seven words.
SHORT = 1 << 1 | 1 << 2


def line_features(line: str, words: list[str], seen: bool) -> int:
    """Bit set of the line's properties."""
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(line.count, _SYMBOLS)) + line.count("!")
    upper, different = sum(map(str.isupper, words)), len(set(words))
    last = words[-1][-1]
    tests = (
        True, n <= 2, 3 <= n <= 7, 8 <= n <= 30, n > 30, seen, last in ".!?…:\"'", 20 * symbols > chars, 5 * symbols > chars, 2 * upper > n,
        4 * upper > n, 10 * different < 7 * n, 10 * different < 4 * n, _WEB.search(line) is not None, chars > 15 * n, 2 * chars < 5 * n,
    )
    return sum(1 << i for i, t in enumerate(tests) if t)


def lines_of(text: str | None) -> tuple[list[int], list[int], int, list[str]]:
    """Features and words of each line with a word; lines equal to an earlier one; all words."""
    features, sizes, again, seen, every = [], [], 0, set(), []
    for line in (text or "").split("\n"):
        words = _WORD.findall(line)
        if words:
            known = line in seen
            again += known
            seen.add(line)
            features.append(line_features(line, words, known))
            sizes.append(len(words))
            every += words
    return features, sizes, again, every


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which the text has at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for i in range(window):
        rolled = rolled * _BASE + own[i : i + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


# ---------------------------------------------------------------- the field


def _dense(masks: np.ndarray) -> np.ndarray:
    return (masks[..., None] >> np.arange(N_FEATURES) & 1).astype(float)


def log_likelihood(weights: np.ndarray, pairs: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray):
    """Sum over the chains, and its gradients.  x: chains x lines x features, y: 1 content."""
    n, steps = y.shape
    emit = np.stack([np.zeros((n, steps)), x @ weights], axis=2)
    live = np.arange(steps) < length[:, None]
    ahead, back = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
    ahead[:, 0] = emit[:, 0]
    for t in range(1, steps):
        ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + pairs, axis=1) + emit[:, t]
    for t in range(steps - 2, -1, -1):
        step = np.logaddexp.reduce(pairs + (emit[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
        back[:, t] = np.where(live[:, t + 1, None], step, 0.0)
    rows = np.arange(n)
    total = np.logaddexp.reduce(ahead[rows, length - 1], axis=1)
    content = np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None]) * live
    joined = ahead[:, :-1, :, None] + pairs + (emit + back)[:, 1:, None, :] - total[:, None, None, None]
    both = live[:, 1:]
    expected = (np.exp(np.where(both[..., None, None], joined, -np.inf))).sum(axis=(0, 1))
    found = np.zeros((2, 2))
    np.add.at(found, (y[:, :-1][both], y[:, 1:][both]), 1.0)
    value = (emit[..., 1] * y * live).sum() + (pairs * found).sum() - total.sum()
    return value, np.einsum("nt,ntf->f", (y * live) - content, x), found - expected


def fit(chains: list[tuple[list[int], list[int]]], theta: np.ndarray | None = None, rounds: int = 80, penalty: float = 2e-5) -> np.ndarray:
    """Weights and pair weights in one row, from (line features, line labels) chains, by Adam on the mean
    conditional log-likelihood, from ``theta`` on."""
    theta = np.zeros(N_FEATURES + 4) if theta is None else theta.copy()
    chains = [(c[a : a + CHAIN], y[a : a + CHAIN]) for c, y in chains for a in range(0, len(c), CHAIN)]
    chains.sort(key=lambda c: len(c[0]))
    batches = []
    for at in range(0, len(chains), 500):  # chains of like length share a padded block
        part = chains[at : at + 500]
        length = np.array([len(c) for c, _ in part])
        masks, labels = np.zeros((2, len(part), length.max()), np.int64)
        for i, (c, y) in enumerate(part):
            masks[i, : len(c)], labels[i, : len(c)] = c, y
        batches.append((_dense(masks), labels, length))
    lines = sum(int(b[2].sum()) for b in batches)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        grad = np.zeros_like(theta)
        for x, y, length in batches:
            _, a, b = log_likelihood(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2), x, y, length)
            grad += np.concatenate([a, b.ravel()])
        grad = grad / lines - penalty * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta += 0.2 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return theta


def weak_labels(features: list[int], good: bool) -> list[int]:
    return [0 if f & MARKS else int(good) if f & SHORT else 1 for f in features]


def prior(features: list[int]) -> list[float]:
    """Log odds of content that the weak rules give a line: none to short lines without a mark."""
    return [-TRUST if f & MARKS else 0.0 if f & SHORT else TRUST for f in features]


def within_share(emit: list[float], pairs: list[list[float]], sizes: list[int], good: bool, share: float = CONTENT_SHARE) -> list[int]:
    """Best labels of a document among those whose share of content agrees with its label: every line's score
    is moved by the least of a rising row of steps that makes it so."""
    for step in (0.0, *(0.25 * 1.5**i for i in range(16))):
        labels = viterbi([e + (step if good else -step) for e in emit], pairs)
        if (sum(s for s, y in zip(sizes, labels) if y) >= share * sum(sizes)) == good:
            return labels
    return [int(good)] * len(emit)


def fit_latent(documents: list[tuple[list[int], list[int], bool]], turns: int = TURNS) -> tuple[list[float], list[list[float]]]:
    """Weights from (line features, line sizes, whether good) of documents."""
    if len({good for _, _, good in documents}) < 2:
        return [0.0] * N_FEATURES, [[0.0] * 2] * 2
    labels, theta = [weak_labels(f, good) for f, _, good in documents], None
    for turn in range(turns):
        theta = fit([(f, y) for (f, _, _), y in zip(documents, labels)], theta, 25 if turn else 80)
        weights, pairs = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2).tolist()
        new = [within_share((_dense(np.array(f)) @ weights + prior(f)).tolist(), pairs, sizes, good) for f, sizes, good in documents]
        if new == labels:
            break
        labels = new
    return weights.tolist(), pairs


def viterbi(emit: list[float], pairs: list[list[float]]) -> list[int]:
    """Best labels of one chain, 1 content; ``emit`` is the score of content over boilerplate."""
    if not emit:
        return []
    (p00, p01), (p10, p11) = pairs
    s0, s1, came = 0.0, emit[0], []
    for e in emit[1:]:
        a, b, c, d = s0 + p00, s1 + p10, s0 + p01, s1 + p11
        came.append((b >= a, d >= c))
        s0, s1 = max(a, b), max(c, d) + e
    label = int(s1 >= s0)
    out = [label]
    for step in reversed(came):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[float], list[list[float]]]:
    """Fit on the sample; what comes to the driver is a number a line of at most SAMPLE_ROWS documents."""
    chosen = sample(labels)
    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), F.expr("doc_id = label_id")).select("doc_id", "text", "quality")

    # repeated ids: one row a sampled id, the one of smallest text
    known = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(t.as_py())[:2] for t in batch.column(1)]
            columns = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2).cast(pa.int32())], names=["doc_id", "masks", "sizes", "quality"])

    rows = known.mapInArrow(run, "doc_id long, masks array<int>, sizes array<int>, quality int").collect()
    return fit_latent([(r.masks, r.sizes, r.quality > 0) for r in sorted(rows) if r.masks])


def line_labels(features: list[int], model: tuple[list[float], list[list[float]]]) -> list[int]:
    """1 for content, 0 for boilerplate, for each line with a word."""
    return viterbi((_dense(np.array(features)) @ np.array(model[0])).tolist(), model[1]) if features else []


def labelled_lines(docs: DataFrame, model: tuple[list[float], list[list[float]]]) -> DataFrame:
    """doc_id, line (place among all lines of the text, from 0), content: one row a line with a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                places = [k for k, line in enumerate((text or "").split("\n")) if _WORD.search(line)]
                found = pa.array(line_labels(lines_of(text)[0], model), pa.int32()).cast(pa.bool_())
                ids = pa.array([batch.column(0)[i].as_py()] * len(places), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(places, pa.int32()), found], names=["doc_id", "line", "content"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, line int, content boolean")


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")


def judge(docs: DataFrame, model: tuple[list[float], list[list[float]]], share: float = CONTENT_SHARE) -> DataFrame:
    def decide(text: str | None) -> tuple:
        features, sizes, again, words = lines_of(text)
        n, symbols = len(words), sum(map(text.count, _SYMBOLS)) if text else 0
        repeats = repeated_words(words)
        failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
        content = 0
        if words:
            content = sum(s for s, label in zip(sizes, line_labels(features, model)) if label)
        return n, sum(map(len, words)), symbols, again, repeats, failed, not failed and content >= share * n, content

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
        for batch in batches:
            rows = [decide(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=list(COLUMNS))

    schema = ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in COLUMNS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
