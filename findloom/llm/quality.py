"""Quality classifier by importance resampling.

Target text is what labelled good rows (quality 1, toxic 0) look like, raw text is the whole corpus. Each is a
generative model of hashed n-grams: shares of words and word pairs in 2**PAIR_BITS slots, repeats counted. A document's
log weight is log p(target) - log p(raw), the mean over its n-grams, so that long documents do not weigh more for their
length. Documents are drawn by Gumbel top-k: key = log weight + Gumbel noise (hashed from doc_id, so reruns agree), and
the k largest keys are `drawn`, k being DRAW_SHARE of all documents. A document's chance to be drawn next is thus
proportional to its weight.

A draw leaves out good documents by chance and takes bad ones, which is its purpose, but no way to reject documents; the
mean of a long text hides a few bad words as well. So a filter stands beside it, on the same kind of ratios: presence of
words, byte trigrams (which see case and symbols) and immediate repeats, target : raw, and besides target : labelled
rejects, so that a text that merely has many copies in the corpus is not taken for junk. `filter_weight` is the sum of a
document's ratios below -DELTA, and `selected` says that it reaches the weight that best separates held-out labelled rows.

drawn() does both, for the pipeline: Gumbel top-k by the generative log weight and the filter's weight together, their sum
being the log of a product of two likelihood ratios, with k the number of documents that the filter selects.

Counts and weights cover all documents; only the labelled rows for fitting are a sample, of at most FIT_ROWS rows in
hash order.

Defined cases: a null or empty text has no n-grams and weights 0; without labelled rows of both kinds all weights of the
filter are 0 and every document is selected; a document with several labels counts as good only if all are; documents
with equal keys are drawn or left together; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.llm import words as W
from findloom.llm.common import written

WORD_BITS, GRAM_BITS = 18, 16
#: A text has repeat feature n if 2**-(n+1) or more of its words are the word before them again.
REPEATS = 6
FEATURES = (1 << WORD_BITS) + (1 << GRAM_BITS) + REPEATS
FIT_ROWS = 8000
#: Input splits that a counting task reads.
SPLITS = 8
#: Words and word pairs of the generative models.
PAIR_BITS = 14
DRAW_SHARE = 0.5
SMOOTHING, DELTA, SEED = 2.0, 1.0, 7
_PUNCTUATION = np.ones(256, bool)
_PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(texts: pa.Array):
    """(the filter's feature numbers, each once; the slots of the words and word pairs, repeats included) of each text."""
    for _, data, offsets in W.chunks(texts):
        spaced = np.where(_PUNCTUATION[data], np.uint8(32), data)
        hashes, bounds = W.word_hashes(spaced, offsets)
        slots = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        words = (hashes >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        pairs = (W.mixed(hashes[:-1] * W.BASE + hashes[1:]) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        wide = data.astype(np.uint64)
        padded = np.concatenate((np.full(1, 32, np.uint64), wide, np.full(1, 32, np.uint64)))
        grams = padded[:-2] | (padded[1:-1] << np.uint64(8)) | (padded[2:] << np.uint64(16))
        grams = ((grams * W.BASE) >> np.uint64(64 - GRAM_BITS)).astype(np.int64) + (1 << WORD_BITS)
        for k in range(len(offsets) - 1):
            # The first and last byte's trigrams reach over a row's edge and would depend on its neighbours.
            inner = grams[offsets[k] + 1 : max(offsets[k] + 1, offsets[k + 1] - 1)]
            a, b = bounds[k], bounds[k + 1]
            own = hashes[a:b]
            again = np.count_nonzero(own[1:] == own[:-1]) if len(own) > 1 else 0
            levels = [FEATURES - REPEATS + n for n in range(REPEATS) if again and again << n + 1 >= len(own)]
            yield np.unique(np.concatenate((slots[a:b], inner, np.array(levels, np.int64)))), np.concatenate((words[a:b], pairs[a : max(a, b - 1)]))


def labelled_sample(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most `rows` labelled documents, half of them good as far as there are: doc_id, good, held_out (a quarter)."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        ((F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("good")
    )
    order = F.xxhash64("doc_id", F.lit(SEED))
    good, bad = (one.where(F.col("good") == kind).orderBy(order, "doc_id").limit(rows // 2) for kind in (True, False))
    return good.unionByName(bad).withColumn("held_out", F.xxhash64("doc_id", F.lit(SEED + 1)).bitwiseAND(3) == 0)


#: Places of the counts: the filter's features, the number of documents, the slots of words and pairs.
PLACES = FEATURES + 1 + (1 << PAIR_BITS)


def _counts(docs: DataFrame, splits: int) -> np.ndarray:
    """docs(text, kind) -> counts by kind (0 all, 1 fitted good, 2 fitted bad) in PLACES: documents with each feature, documents, uses of each slot."""

    def run(batches):
        held = np.zeros((3, PLACES), np.int64)
        for batch in batches:
            kinds = batch.column(1).to_pylist()
            for (found, used), kind in zip(features(batch.column(0)), kinds):
                for row in {0, kind}:
                    held[row, found] += 1
                    held[row, FEATURES] += 1
                    np.add.at(held[row], FEATURES + 1 + used, 1)
        kind, at = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(held[kind, at])], ["kind", "at", "n"])

    # Each task gives up to 3 * PLACES rows, so larger tasks shuffle less: SPLITS of the input's splits each, where there are
    # enough of them for every core. Their number follows the input, and a lost task repeats no more than its splits.
    few = docs.coalesce(max(1, math.ceil(splits / SPLITS), min(splits, 3 * docs.sparkSession.sparkContext.defaultParallelism)))
    rows = few.select("text", "kind").mapInArrow(run, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n"))
    # At most 3 * PLACES rows, whatever the corpus.
    rows = rows.toArrow()
    out = np.zeros((3, PLACES), np.int64)
    out[rows.column("kind").to_numpy(), rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out


def generative_ratios(counts: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) of each slot, both models with one use added to every slot."""
    raw, target = counts[0, FEATURES + 1 :] + 1.0, counts[1, FEATURES + 1 :] + 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """For each feature of the filter the log ratio target : raw or, if it is larger, target : rejects, where that is telling, else 0."""
    raw, good, bad = counts[:, :FEATURES].astype(float)
    n_raw, n_good, n_bad = np.maximum(counts[:, FEATURES], 1)
    if not counts[1, FEATURES] or not counts[2, FEATURES]:
        return np.zeros(FEATURES, np.float32)
    # Words and trigrams are many, so chance makes some of them rare among good rows; the few repeat features need less caution.
    smooth = np.full(FEATURES, float(SMOOTHING))
    smooth[-REPEATS:] = SMOOTHING / 4
    against_raw = np.log((good + smooth) / (raw * n_good / n_raw + smooth))
    against_bad = np.log((good + smooth) / (bad * n_good / n_bad + smooth))
    ratio = np.maximum(against_raw, against_bad)
    return np.where(ratio < -DELTA, ratio, 0).astype(np.float32)


def weights(text: Column, slots: np.ndarray, ratios: np.ndarray) -> Column:
    """struct(log_weight, filter_weight) of a text."""

    def weigh(texts: pa.Array) -> pa.Array:
        found = [(float(slots[used].mean()) if len(used) else 0.0, float(ratios[f].sum(dtype=np.float64))) for f, used in features(texts)]
        return pa.StructArray.from_arrays([pa.array([round(x[k], 6) for x in found], pa.float64()) for k in (0, 1)], ["log_weight", "filter_weight"])

    # The type hints are objects here, not the strings that the module's annotations are.
    weigh.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(weigh, "log_weight double, filter_weight double")(F.coalesce(text, F.lit("")))


def gumbel_key(weight: Column, doc_id: Column, seed: Column | int = SEED) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed) if isinstance(seed, int) else seed), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return weight - F.ln(-F.ln(u))


def separating_weight(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight that best keeps good and rejects bad rows, a good row lost counting as two bad ones kept."""
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(np.concatenate((good, bad, [0.0])))
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    caught = np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[np.argmax(caught - 2 * lost)])


def kth_largest(scored: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value, by counting in ever narrower bins: a row a bin comes to the driver, never the values."""
    low, high = scored.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return np.inf
    above = 0
    while low < high:
        step = (high - low) / bins
        if step == 0 or low + step == low:
            break
        bin_of = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(step)))
        inside = scored.where(F.col(column).between(low, high))
        rows = inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for row in sorted(rows, key=lambda r: -r["b"]):
            if above + row["n"] >= k:
                low, high = row["lo"], row["hi"]
                break
            above += row["n"]
        if row["n"] == 1:
            break
    return high if low == high else low


class Fitted:
    """Ratios, the weights of all documents by them, and the filter's cut."""

    def __init__(self, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
        sample = written(labelled_sample(labels, fit_rows), "sample")
        kind = F.when(F.col("held_out"), 0).otherwise(F.when(F.col("good"), 1).otherwise(2))
        # fit_rows rows at most, so the broadcast is bounded.
        marks = F.broadcast(sample.select(F.col("doc_id").alias("id"), kind.alias("kind"), "good", "held_out"))
        joined = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("id"), "left")
        counts = _counts(joined.select("text", F.coalesce("kind", F.lit(0)).alias("kind")), docs.select("doc_id", "text").rdd.getNumPartitions())
        self.slots, self.ratios = generative_ratios(counts), log_ratios(counts)
        tested = docs.select("doc_id", "text").join(marks.where("held_out"), F.col("doc_id") == F.col("id"))
        # At most fit_rows rows come to the driver.
        tested = tested.select("good", self.weights().alias("w")).select("good", "w.filter_weight").toArrow()
        good, weight = tested.column("good").to_numpy(zero_copy_only=False).astype(bool), tested.column("filter_weight").to_numpy()
        self.cut = separating_weight(weight[good], weight[~good])

    def weights(self) -> Column:
        return weights(F.col("text"), self.slots, self.ratios)


def importance(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, share: float = DRAW_SHARE) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality, toxic) -> doc_id, log_weight, key, drawn, filter_weight, selected, a row for each of docs."""
    fitted = Fitted(docs, labels, fit_rows)
    weighed = docs.select("doc_id", fitted.weights().alias("w")).select("doc_id", "w.log_weight", "w.filter_weight")
    scored = written(weighed.withColumn("key", gumbel_key(F.col("log_weight"), F.col("doc_id"))), "scored")
    least = float(kth_largest(scored, "key", math.ceil(share * scored.count())))
    return scored.select("doc_id", "log_weight", "key", (F.col("key") >= F.lit(least)).alias("drawn"), "filter_weight", (F.col("filter_weight") >= F.lit(fitted.cut)).alias("selected"))


def drawn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that a Gumbel top-k by log_weight + filter_weight draws, as many as the filter selects; all columns of docs stay.

    The keys are written beside the documents, so texts are weighed once and never move.
    """
    fitted = Fitted(docs, labels, fit_rows)
    # A document's own columns lie in a struct, so that none of them clashes with those made here.
    weighed = docs.select(F.struct(*docs.columns).alias("row"), fitted.weights().alias("w"))
    key = gumbel_key(F.col("w.log_weight") + F.col("w.filter_weight"), F.col("row.doc_id"))
    keyed = written(weighed.select("row", (F.col("w.filter_weight") >= F.lit(fitted.cut)).alias("fits"), key.alias("key")), "keyed")
    least = float(kth_largest(keyed, "key", keyed.where("fits").count()))
    return keyed.where(F.col("key") >= F.lit(least)).select("row.*")


def selected(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that the filter selects; all columns of docs stay. Texts are weighed where they are read, so they never move."""
    fitted = Fitted(docs, labels, fit_rows)
    return docs.where(fitted.weights()["filter_weight"] >= F.lit(fitted.cut))
