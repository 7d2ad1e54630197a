"""Models over frames: loaded once in each Python worker, called on batches; stages composed of such scorers.

A scorer is a function DataFrame -> DataFrame that adds columns. Models themselves stay outside the library.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinark.operators import pseudo, spans

Scorer = Callable[[DataFrame], DataFrame]
#: Models of this Python worker by name: a model is loaded when the first batch comes, and kept.
_loaded: dict[str, Any] = {}


def model(name: str, load: Callable[[], Any]) -> Any:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def model_scorer(name: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], inputs: Sequence[str], outputs: T.StructType, batch_rows: int = 256) -> Scorer:
    """A scorer that adds `outputs`, which the model makes of `inputs`, batch_rows rows at a time.

    load() gives the model: inputs of some rows to outputs of the same rows, in order. Parsers, gates, taggers and
    sentiment models all fit. Rows keep their columns; an empty frame loads no model.
    """

    def score(df: DataFrame) -> DataFrame:
        kept = df.columns
        schema = T.StructType([*df.schema.fields, *outputs.fields])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                own = model(name, load)
                made = [own(pdf[list(inputs)].iloc[at : at + batch_rows].reset_index(drop=True)) for at in range(0, len(pdf), batch_rows)]
                made = pd.concat(made, ignore_index=True)
                if len(made) != len(pdf):
                    raise ValueError(f"{name} gave {len(made)} rows for {len(pdf)}")
                yield pd.concat([pdf[kept].reset_index(drop=True), made[[f.name for f in outputs.fields]]], axis=1)

        return df.mapInPandas(run, schema)

    return score


def predict_aspects(df: DataFrame, gate: Scorer, tagger: Scorer, gate_high: float = 0.90, span_min: float = 0.85) -> DataFrame:
    """df with gate and aspects (array<struct<aspect,confidence,start,end>>), in two stages.

    gate adds the column gate; only rows that reach gate_high go on to tagger, which adds tokens, labels and
    token_confidences. Their spans are decoded, the best of each aspect kept, and those below span_min left out.
    All other rows have no aspects; a null score is below every threshold.
    """
    scored = gate(df)
    passing = F.coalesce(F.col("gate") >= gate_high, F.lit(False))
    found = tagger(scored.where(passing))
    best = spans.best_spans(spans.decode_spans("tokens", "labels", "token_confidences"))
    found = found.withColumn("aspects", pseudo.kept_spans(best, "gate", gate_high, span_min)).drop("tokens", "labels", "token_confidences")
    none = F.array().cast(found.schema["aspects"].dataType)
    return found.unionByName(scored.where(~passing).withColumn("aspects", none))


def predict_sentiments(df: DataFrame, key: str, aspects: str, scorer: Scorer, into: str = "sentiments") -> DataFrame:
    """df with the probabilities of each aspect in order; scorer sees one row per aspect and adds `probabilities`.

    Rows without aspects have an empty array; key must be unique.
    """
    scored = scorer(pseudo.pairs(df, aspects))
    listed = pseudo.regroup(scored, key, "probabilities", into)
    empty = F.array().cast(listed.schema[into].dataType)
    return df.join(listed, key, "left").withColumn(into, F.coalesce(into, empty))


class Busy(Exception):
    """The service asks to be called later."""


def call_with_retries(call: Callable[[str], str], prompt: str, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The answer, or None after `tries` failures; after Busy it waits 4, 8, 16 ... seconds."""
    for attempt in range(tries):
        try:
            return call(prompt)
        except Busy:
            if attempt + 1 < tries:
                sleep(2.0 ** (attempt + 2))
        except Exception:  # an answer that can't be had is no error of the job
            pass
    return None


def ask(df: DataFrame, prompt: str, name: str, load: Callable[[], Callable[[str], str]], into: str = "answer", tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """df with the answers of a service to the prompts; null where it failed or the prompt is null."""

    def load_batch() -> Callable[[pd.DataFrame], pd.DataFrame]:
        call = load()
        return lambda pdf: pd.DataFrame({into: pd.Series([None if p is None else call_with_retries(call, p, tries, sleep) for p in pdf[prompt]], dtype=object)})

    return model_scorer(name, load_batch, [prompt], T.StructType([T.StructField(into, T.StringType())]))(df)
