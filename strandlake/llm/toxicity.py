"""Toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence has a probability from the hashed words and word beginnings it holds; the
text's probability is their noisy-or, 1 minus the product of (1 - p). The weights are fitted to document labels alone
by sparse gradient descent on the noisy-or likelihood, so the sentences that carry the label stand out, and scoring a
text also locates them.

Fitting takes at most max_documents labelled training rows of at most max_bytes in all, a third of either toxic if there
are enough (of each label those with the smallest hash of their id), of any size of input; scoring reads every whole
text. Only words are inputs: never labels, language, source or id.

Edge cases: null, empty and wordless texts score the rate of toxic among such training texts; a word counts once a
sentence; repeated rows get equal scores; with no labelled rows, or labels of one class, all scores follow that class;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import textkernel as tk
from strandlake.llm.common import documents, materialise, named

#: The bounds on labelled rows, and on the bytes of their texts, that fitting takes and the driver holds.
MAX_DOCUMENTS, MAX_BYTES = 6_000, 64 << 20
BUCKETS = 1 << 20
#: Bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
#: A feature must occur in this many training texts.
LEAST_TEXTS = 4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: A score is kept inside (0, 1) by this margin.
MARGIN = 1e-6

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: The score of a text without words.
    empty: float


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket, sentence) of every feature and (text, start, end) of every sentence that has words.

    Words are runs of letters and digits, A-Z taken as a-z; sentences end at . ! ? or a newline.
    """
    none = np.zeros(0, np.int64)
    solid = _LETTERS[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    start = np.flatnonzero(solid & (~np.append(False, solid[:-1]) | fresh[:-1])) if len(data) else none
    if not len(start):
        return none, none, none, none, none
    end = np.flatnonzero(solid & (~np.append(solid[1:], False) | fresh[1:])) + 1
    power, inverse = tk.powers(len(data))
    sums = np.append(tk.U(0), np.cumsum(tk.LETTER[tk.LOWER[data]] * power[: len(data)], dtype=tk.U))
    stops = np.cumsum(_STOPS[data])
    text = np.searchsorted(offsets, start, side="right") - 1
    place = text * (int(stops[-1]) + 1) + stops[start]
    new = np.append(True, place[1:] != place[:-1])
    sentence = np.cumsum(new) - 1
    buckets, owners = [], []
    for k in (0, *BEGINNINGS):
        use = np.flatnonzero(end - start > k) if k else np.arange(len(start))
        a = start[use]
        h = tk.mix((sums[a + k if k else end] - sums[a]) * inverse[a] + tk.U(k))
        buckets.append((h >> tk.U(40)).astype(np.int64) & (BUCKETS - 1))
        owners.append(sentence[use])
    first = np.flatnonzero(new)
    stop = np.minimum(np.append(start[first][1:], len(data)), offsets[text[first] + 1])
    return np.concatenate(buckets), np.concatenate(owners), text[first], start[first], stop


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _once(bucket: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(sentence * BUCKETS + bucket)
    return pair % BUCKETS, pair // BUCKETS


def _score(model: Model, bucket, sentence, text, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each text, probability of each sentence)."""
    said = model.weights[bucket] != 0
    bucket, sentence = _once(bucket[said], sentence[said])
    p = _sigmoid(np.bincount(sentence, model.weights[bucket], len(text)) + model.bias)
    p = np.minimum(p, 1 - MARGIN)
    scores = -np.expm1(np.bincount(text, np.log1p(-p), n))
    scores[np.bincount(text, minlength=n) == 0] = model.empty
    return np.clip(scores, MARGIN, 1 - MARGIN), p


def _slope(w: np.ndarray, bias: float, bucket, sentence, text, y: np.ndarray) -> np.ndarray:
    """The gradient of the mean negative noisy-or log likelihood by every weight, and by the bias at the end."""
    p = np.minimum(_sigmoid(np.bincount(sentence, w[bucket], len(text)) + bias), 1 - MARGIN)
    clean = np.clip(np.exp(np.bincount(text, np.log1p(-p), len(y))), MARGIN, 1 - MARGIN)  # no sentence toxic
    pull = np.where(y > 0, -clean / (1 - clean), 1.0) / len(y)
    slope = p * pull[text]
    return np.append(np.bincount(bucket, slope[sentence], len(w)), slope.sum())


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 60, rate: float = 0.2, sparse: float = 4.0) -> Model:
    """Weights by Adam on the noisy-or log likelihood of the labels.

    In the first half a feature must pull for more than sparse texts to get a weight; the second half fits the weights
    of those features, and the bias, without that toll.
    """
    y = np.asarray(labels, np.float64)
    n, positive = len(y), float(np.mean(labels)) if len(labels) else 0.0
    model = Model(np.zeros(BUCKETS), -6.0, min(max(positive, MARGIN), 1 - MARGIN))
    if not n or positive in (0.0, 1.0):
        model.bias = -30.0 if positive < 0.5 else 30.0
        return model
    seen = np.zeros(BUCKETS, np.int32)  # texts that have the feature
    for _, data, offsets in tk.runs(texts):
        bucket, sentence, text, _, _ = sentences(data, offsets)
        seen += np.bincount(_once(bucket, text[sentence])[0], minlength=BUCKETS).astype(np.int32)
    used = np.flatnonzero(seen >= LEAST_TEXTS)
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    parts, base = [], 0
    for first, data, offsets in tk.runs(texts):
        bucket, sentence, text, _, _ = sentences(data, offsets)
        known = number[bucket] >= 0
        bucket, sentence = _once(bucket[known], sentence[known])
        parts.append((number[bucket], (sentence + base).astype(np.int32), text + first))
        base += len(text)
    bucket, sentence, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    wordless = np.bincount(text, minlength=n) == 0
    if wordless.any():
        model.empty = float(np.clip((y[wordless].sum() + positive) / (wordless.sum() + 1), MARGIN, 1 - MARGIN))
    w, bias = np.zeros(len(used)), model.bias
    for toll in (sparse / n, 0.0):
        if not toll:
            kept = np.flatnonzero(w)
            used, w = used[kept], w[kept]
            number = np.full(len(number), -1, np.int32)
            number[kept] = np.arange(len(kept))
            bucket = number[bucket]
            bucket, sentence = bucket[bucket >= 0], sentence[bucket >= 0]
        m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        for step in range(1, rounds + 1):
            grad = _slope(w, bias, bucket, sentence, text, y)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            scale = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            move = scale * (m / (1 - 0.9**step))
            w, bias = w - move[:-1], bias - move[-1]
            w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(toll * scale[:-1], 0.5 * rate), 0)
    model.weights[used], model.bias = w, bias
    return model


def held_out(key: str) -> F.Column:
    return F.crc32(named(key).cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_documents: int = MAX_DOCUMENTS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on labelled rows outside the held-out fold: at most max_documents rows of max_bytes in all reach the driver.

    Texts of more than a third of max_bytes are never taken; of ids that stand on several texts all count, as far as
    rows and bytes go.
    """
    marked = labels.where(~held_out(key)).select(named(key).alias("k"), named(label).alias("y")).dropna().groupBy("k").agg(F.max("y").alias("y"))
    order = [F.xxhash64("k"), F.col("k")]
    toxic = marked.where("y = 1").orderBy(*order).limit(max_documents // 3)
    chosen = toxic.unionByName(marked.where("y = 0").orderBy(*order).limit(max_documents - max_documents // 3))
    rows = docs.select(named(key).alias("k"), named(text).alias("t")).join(F.broadcast(chosen), "k").withColumn("n", F.coalesce(F.octet_length("t"), F.lit(0)).cast("long"))
    # One id may stand on any number of rows, of no bytes even: rows are bounded again before one task orders them.
    order += ["n", F.xxhash64("t")]
    taken = lambda y, most: rows.where((F.col("y") == y) & (F.col("n") <= max_bytes // 3)).orderBy(*order).limit(most)
    rows = materialise(taken(1, max_documents // 3).unionByName(taken(0, max_documents - max_documents // 3)), "labelled")
    room = F.when(F.col("y") == 1, max_bytes // 3).otherwise(max_bytes - max_bytes // 3)
    before = Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("n").over(before)).where(F.col("upto") <= room).orderBy("k", "n", F.xxhash64("t")).select("t", "y").toArrow()
    return fit(rows.column("t").combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows.column("y").to_numpy())


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and offending (byte spans and probabilities of sentences at or above THRESHOLD) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights, whatever the input
    rows = docs.select(named(key).alias("k"), named(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches):
        for batch in batches:
            scores, spans = [], [[] for _ in range(batch.num_rows)]
            for first, data, offsets in tk.runs(batch.column("t")):
                bucket, sentence, owner, start, end = sentences(data, offsets)
                s, p = _score(shared.value, bucket, sentence, owner, len(offsets) - 1)
                scores.append(s)
                for i in np.flatnonzero(p >= THRESHOLD).tolist():
                    spans[first + owner[i]].append({"start": int(start[i] - offsets[owner[i]]), "end": int(end[i] - offsets[owner[i]]), "p": float(p[i])})
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(s), pa.array(spans, pa.list_(span))], ["k", "score", "offending"])

    return rows.mapInArrow(run, f"k {kind}, score double, offending array<struct<start:long,end:long,p:double>>").withColumnRenamed("k", key)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
