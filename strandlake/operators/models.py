"""Pluggable language-model and embedding stages with deterministic offline stand-ins."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import kept, shared_path

Model = Callable[[list[str]], list[str]]
_models: dict[str, Callable[[], Model]] = {}


def register(name: str, factory: Callable[[], Model]) -> None:
    """A model by name; the factory runs once per worker and task."""
    _models[name] = factory


def stub() -> Model:
    """Answers with the size of the prompt and a score made from its digest."""
    return lambda prompts: [f"{len(p)} characters. score: {int(hashlib.sha256(p.encode()).hexdigest(), 16) % 10 + 1}" for p in prompts]


register("stub", stub)


def ask(df: DataFrame, prompt: str, model: str = "stub", out: str = "answer") -> DataFrame:
    """df with the model's answer to each prompt; put every cheap filter before it."""
    factory = _models[model]

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = factory()
        for prompts in batches:
            yield pd.Series(answer(prompts.fillna("").tolist()))

    return df.withColumn(out, call.asNondeterministic()(F.col(prompt)))


ANSWER_SCHEMA = "model string, digest binary, answer string"


def _tried(answer: Model, prompts: list[str], attempts: int, pause: float) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt: all together, then after longer and longer pauses, then one by one."""
    for attempt in range(attempts):
        try:
            said = answer(prompts)
            if len(said) != len(prompts):
                raise ValueError(f"{len(said)} answers to {len(prompts)} prompts")
            return [(a, None if a is not None else "no answer") for a in said]
        except Exception as e:  # a model may fail in any way, and what it says is kept with the prompt
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < attempts:
                time.sleep(pause * 2**attempt)
    if len(prompts) == 1:
        return [(None, error)]
    return [x for p in prompts for x in _tried(answer, [p], attempts, pause)]


def ask_once(df: DataFrame, prompt: str, model: str = "stub", cache: str | None = None, out: str = "answer", attempts: int = 3, pause: float = 0.5, batch: int = 32, least_seconds: float = 0.0) -> DataFrame:
    """df with the answer to each prompt and, in <out>_error, why there is none.

    Each distinct prompt is asked once, whatever the number of rows that hold it, and only if the table of answers at
    cache (Parquet in the shared folder, one part a model) does not have it: answers outlive a run, and a run that is
    repeated asks only what failed. A call takes up to batch prompts; a failing call is tried again after pause, twice
    that and so on, and then prompt by prompt, so one bad prompt is one row with an error. least_seconds lie between
    the starts of two calls of a task; a cluster's rate is that times the number of tasks at work. A null prompt is the
    empty one. Without cache the table is a new one that goes with the session.
    """
    spark, factory = df.sparkSession, _models[model]
    cache = cache or shared_path(spark, "answers")
    spark.createDataFrame([], ANSWER_SCHEMA).write.mode("append").partitionBy("model").parquet(cache)
    digest = F.unhex(F.sha2(F.coalesce(F.col(prompt), F.lit("")).cast("binary"), 256))

    def known() -> DataFrame:
        rows = spark.read.schema(ANSWER_SCHEMA).parquet(cache).where(F.col("model") == model)
        return rows.groupBy("digest").agg(F.first("answer").alias("_answer"))  # runs side by side may both have asked

    wanted = df.select(digest.alias("digest"), F.coalesce(F.col(prompt), F.lit("")).alias("prompt")).join(known(), "digest", "left_anti")
    wanted = wanted.groupBy("digest").agg(F.first("prompt").alias("prompt"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer, due = factory(), 0.0
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + least_seconds
                said = _tried(answer, part["prompt"].tolist(), attempts, pause)
                yield pd.DataFrame({"digest": part["digest"].to_numpy(), "answer": [x for x, _ in said], "error": [x for _, x in said]})

    # Written before anything reads it: no later stage asks again.
    asked = kept(wanted.mapInPandas(call, "digest binary, answer string, error string"))
    asked.where("error is null").select(F.lit(model).alias("model"), "digest", "answer").write.mode("append").partitionBy("model").parquet(cache)
    failed = asked.where("error is not null").select("digest", F.col("error").alias("_error"))
    rows = df.withColumn("_digest", digest).join(known().withColumnRenamed("digest", "_digest"), "_digest", "left").join(failed.withColumnRenamed("digest", "_digest"), "_digest", "left")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_answer").alias(out), F.col("_error").alias(f"{out}_error"))


#: Of a word's MD5 in hex: so many digits name its place, and the next one its sign.
_PLACE = 8


def hashed_vector(text: str, dim: int = 64) -> np.ndarray:
    """Signed counts of hashed words at unit length; embed() gives the same."""
    v = np.zeros(dim)
    for word in text.lower().split():
        h = hashlib.md5(word.encode()).hexdigest()
        v[int(h[:_PLACE], 16) % dim] += 1.0 if int(h[_PLACE], 16) >= 8 else -1.0
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).astype(np.float32)


#: A worker remembers the place and sign of so many words.
_WORDS = 1 << 18


def embed(df: DataFrame, text: str, out: str = "embedding", dim: int = 64) -> DataFrame:
    """df with a vector of each text; a null or empty text has zeros.

    A word is hashed once a worker and the words of many texts are counted together, so the work is that of reading them.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[bytes, int] = {}

        def code(word: bytes) -> int:
            h = hashlib.md5(word).digest()
            known[word] = out = int.from_bytes(h[: _PLACE // 2], "big") % dim * 2 + (h[_PLACE // 2] >> 7)
            return out

        for texts in batches:
            made = []
            for a in range(0, len(texts), 1024):
                if len(known) > _WORDS:
                    known.clear()
                words = [t.encode().split() for t in texts.iloc[a : a + 1024]]  # at ASCII blanks
                codes = np.array([c if (c := known.get(w)) is not None else code(w) for ws in words for w in ws], np.int64)
                at = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
                n = np.bincount(at * (2 * dim) + codes, minlength=2 * dim * len(words)).reshape(len(words), dim, 2)
                v = (n[:, :, 1] - n[:, :, 0]).astype(np.float64)
                length = np.sqrt((v * v).sum(1, keepdims=True))
                made.extend((v / np.where(length > 0, length, 1.0)).astype(np.float32))
            yield pd.Series(made, dtype=object)

    return df.withColumn(out, vectors(F.lower(F.coalesce(F.col(text), F.lit("")))))
