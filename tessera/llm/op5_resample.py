"""Quality classification by importance resampling.

Two generative models over hashed word n-grams (one and two words) give each n-gram the logarithm of
its probability in target text over that in raw text.  Raw counts cover all documents; the target is
the good half of a bounded labelled sample (fold 0).  A document's log weight is the log-likelihood ratio
of the models over its n-grams, at the temperature n-grams / ``PASSAGE``: what a passage of ``PASSAGE`` n-grams
of it would have, so that length alone neither chooses nor rejects, and shrunk towards 0 where it has few.
Good documents differ by about as much as the Gumbel noise that the key adds (a hash of doc_id), bad ones lie
far below.  The k documents of largest key are a sample without replacement whose draws follow the weights.
k is a parameter; left open it is the number of documents whose weight reaches the ``REJECT`` quantile of good
documents that the target model has not seen (fold 1).

A toxic passage hardly moves the mean, so the worst ``WINDOW`` words decide as well: n-grams weigh what the
lower end of their log odds between toxic and other labelled documents is above 0, and a document whose
worst window reaches the cut has weight 0 (log weight -inf) and is never taken.  The cut is the larger of
those with the fewest mistakes on clean and toxic documents of the sample when each is scored by the weights of the
other fold and by the weights of both, which are used.

Defined results: without toxic and clean labels in both folds no window is too bad; null, empty and white-space texts have weight 0; without good labels in both folds
all are kept; rows of equal key at the cut are kept together (repeated rows share their fate); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, stored, table
from tessera.llm.labelled import sample
from tessera.llm.wordhash import WORD, hashes

#: Buckets up to GROWN documents; beyond, they grow with the square root, as vocabularies do.
BUCKETS = 1 << 14
GROWN = 10_000
PASSAGE = 100.0
PRIOR = 30
SMOOTHING = 1.0
REJECT = 0.005
WINDOW = 25
#: Standard errors that an n-gram's log odds must be above 0.
SURE = 3.0
SEED = "resample-1"
_MIX, _PUT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def buckets(docs: int) -> int:
    return BUCKETS << max(0, math.ceil(math.log2(max(docs, 1) / GROWN) / 2))


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's words and of its word pairs."""
    own = np.frombuffer(hashes(WORD.findall(text or "")), np.uint64)
    return own, (own[:-1] * _MIX + own[1:]) * _PUT


def grams(text: str | None, size: int = BUCKETS) -> np.ndarray:
    """Buckets of the text's words and word pairs."""
    return _places(*hashed(text), size)


def _places(own: np.ndarray, pairs: np.ndarray, size: int) -> np.ndarray:
    return (np.concatenate([own, pairs]) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def counts(docs: DataFrame, chosen: DataFrame, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of all documents and of the target; at most 2 x ``size`` rows reach the driver."""
    marks = chosen.where("quality > 0 AND toxic = 0 AND fold = 0").select("label_id", F.lit(True).alias("_target"))
    marked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(marks), F.expr("doc_id = label_id"), "left").select("text", "_target")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist()):
                found, n = np.unique(grams(text.as_py(), size), return_counts=True)
                sums[0, found] += n
                if target:
                    sums[1, found] += n
        which, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[which, bucket])], names=["model", "bucket", "n"])

    out = np.zeros((2, size))
    got = marked.mapInArrow(run, "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out[got["model"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out[0], out[1]


class Passages:
    """Weights of n-grams (sorted hashes) of toxic passages."""

    def __init__(self, known: np.ndarray, toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int):
        odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
        sure = odds - SURE * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
        use = (toxic >= 2) & (sure > 0)
        self.known, self.weight, self.cut = known[use], sure[use], math.inf

    def _of(self, found: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        return np.where(self.known[at] == found, self.weight[at], 0.0)

    def worst(self, own: np.ndarray, pairs: np.ndarray) -> float:
        """The largest sum of weights of ``WINDOW`` neighbouring words over the whole text."""
        if not len(own) or not len(self.known):
            return 0.0
        at = self._of(own)
        at[1:] += self._of(pairs)
        sums, width = np.concatenate([[0.0], np.cumsum(at)]), min(WINDOW, len(own))
        return float((sums[width:] - sums[:-width]).max())


def fewest_mistakes(clean: np.ndarray, toxic: np.ndarray) -> float:
    """Half way between the last score below and the first from the cut that errs least on both."""
    scores = np.unique(np.concatenate([clean, toxic]))
    cuts = np.append((scores[1:] + scores[:-1]) / 2, math.inf)
    wrong = np.searchsorted(np.sort(toxic), cuts) + len(clean) - np.searchsorted(np.sort(clean), cuts)
    return float(cuts[np.flatnonzero(wrong == wrong.min())[-1]])


def toxic_passages(docs: DataFrame, chosen: DataFrame) -> Passages | None:
    """Fitted on the sample; n-grams of fewer than two toxic documents stay where they are counted."""
    n = {(r[0], r[1]): r[2] for r in chosen.groupBy("fold", F.expr("toxic > 0")).count().collect()}
    if any(not n.get((fold, kind)) for fold in (0, 1) for kind in (True, False)):
        return None
    marks = chosen.select("label_id", "fold", F.expr("toxic > 0").alias("_toxic"), F.expr("quality > 0").alias("_good"))
    texts = cut(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(marks), F.expr("doc_id = label_id")).dropDuplicates(["doc_id"]).select("text", "fold", "_toxic", "_good"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = np.unique(np.concatenate(hashed(batch.column(0)[i].as_py()))).view(np.int64)
                kind = 2 * batch.column(1)[i].as_py() + batch.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), kind, np.int32))], names=["gram", "kind"])

    sums = [F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(4)]
    got = texts.mapInArrow(count, "gram long, kind int").groupBy("gram").agg(*sums).where("n1 + n3 >= 2").toArrow()
    known, by = got["gram"].to_numpy().view(np.uint64), np.array([got[f"n{k}"].to_numpy() for k in range(4)], float)
    order = np.argsort(known)
    known, by = known[order], by[:, order]
    halves = [Passages(known, by[2 * f + 1], by[2 * f], n[f, True], n[f, False]) for f in (0, 1)]
    whole = Passages(known, by[1] + by[3], by[0] + by[2], n[0, True] + n[1, True], n[0, False] + n[1, False])

    @F.pandas_udf("array<double>")
    def both(text, fold):  # type: ignore[no-untyped-def]
        """By the weights of the other fold, and by the weights of both."""
        found = [hashed(t if isinstance(t, str) else None) for t in text]
        return pd.Series([[halves[1 - f].worst(*h), whole.worst(*h)] for h, f in zip(found, fold)])

    scores = texts.where("_toxic OR _good").select("_toxic", both("text", "fold").alias("score")).toArrow()
    score, is_toxic = np.array(scores["score"].to_pylist(), float).reshape(-1, 2), np.array(scores["_toxic"].to_pylist(), bool)
    # weights from both folds are larger than those of one, and so must the cut be
    whole.cut = max(fewest_mistakes(score[~is_toxic, k], score[is_toxic, k]) for k in (0, 1))
    return whole


def ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    log = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)))
    return log(target) - log(raw)


def log_weight(text: str | None, ratio: np.ndarray, passages: Passages | None = None) -> float:
    own, pairs = hashed(text)
    if passages and passages.worst(own, pairs) >= passages.cut:
        return -math.inf
    found = _places(own, pairs, len(ratio))
    return PASSAGE * float(ratio[found].sum()) / (len(found) + PRIOR)


def weight_column(text: Column, ratio: np.ndarray, passages: Passages | None = None) -> Column:
    @F.pandas_udf("double")
    def weigh(texts):  # type: ignore[no-untyped-def]
        return texts.map(lambda t: log_weight(t if isinstance(t, str) else None, ratio, passages)).astype("float64")

    return weigh(text)


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return -F.log(-F.log((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)))


def kth_largest(keys: DataFrame, k: int, at_once: int = 50_000) -> float:
    """The k-th largest ``key`` (checkpointed, 1 <= k <= rows): counts by interval narrow the range down
    until few rows are left in it; only those come to the driver."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    left = k
    while True:
        inside = keys.where(F.col("key").between(low, high))
        width = (high - low) / 1024
        if not width or inside.count() <= at_once:
            break
        slot = F.least(F.floor((F.col("key") - low) / width), F.lit(1023)).alias("slot")
        found = inside.groupBy(slot).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("slot")).collect()
        for r in found:
            if left <= r.n:
                break
            left -= r.n
        low, high = r.low, r.high
    if low == high:
        return low
    rest = np.sort([r[0] for r in inside.select("key").collect()])
    return float(rest[-left])


def _scored(docs: DataFrame, chosen: DataFrame, whole: bool, seed: str) -> tuple[DataFrame, np.ndarray]:
    """doc_id, log_weight and key of every document, each text weighed once; with ``whole`` its row too (_doc).
    Also the ratios."""
    ratio = ratios(*counts(docs, chosen, buckets(docs.count())))
    passages = toxic_passages(docs, chosen)
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("_doc")] if whole else []
    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), weight_column(docs["text"], ratio, passages).alias("log_weight"), *row)
    scored = scored.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    return stored(scored, "weighed", []) if whole else cut(scored), ratio


def _cut_key(scored: DataFrame, chosen: DataFrame, ratio: np.ndarray, k: int | None) -> float:
    """The k-th largest key; -inf if all are kept."""
    likely = scored.where(F.col("log_weight") > -math.inf).select("doc_id", "log_weight", "key")
    if k is None:
        unseen = chosen.where("quality > 0 AND toxic = 0 AND fold = 1")
        good = likely.join(F.broadcast(unseen), F.expr("doc_id = label_id")).groupBy("doc_id").agg(F.min("log_weight")).collect()  # of the sample
        if not good or not ratio.any():
            return -math.inf
        k = likely.where(F.col("log_weight") >= float(np.quantile([r[1] for r in good], REJECT))).count()
    n = min(k, likely.count())
    return kth_largest(likely, n) if n else math.inf


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: str = SEED) -> tuple[DataFrame, np.ndarray, float]:
    """doc_id, log_weight, key and kept of every document; the ratios and the key at the cut."""
    chosen = sample(labels)
    scored, ratio = _scored(docs, chosen, False, seed)
    at = _cut_key(scored, chosen, ratio, k)
    return scored.withColumn("kept", (F.col("key") >= at) & (F.col("key") > -math.inf)), ratio, at


def kept_documents(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: str = SEED) -> DataFrame:
    """The sampled documents with their own columns, from a table in the shared folder."""
    chosen = sample(labels)
    scored, ratio = _scored(docs, chosen, True, seed)
    at = _cut_key(scored, chosen, ratio, k)
    return scored.where((F.col("key") >= at) & (F.col("key") > -math.inf)).select("_doc.*")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]
