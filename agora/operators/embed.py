"""Text embedding (V1, V2) behind one plug point.

Default encoder: Spark ML only (regex tokens -> HashingTF -> IDF -> L2
Normalizer), fully distributed.  A neural encoder is a user callable
``list[str] -> ndarray (n, d)`` run in ``mapInPandas`` Arrow batches; the
model is loaded once per Python worker by the callable itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list], np.ndarray]


def fit_hashing_encoder(corpus: DataFrame, text_col: str, dim: int = 256) -> PipelineModel:
    """Fit the default encoder (IDF weights) on a corpus; reuse it for documents and queries alike."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_n", p=2.0),
    ])
    return pipe.fit(corpus.select(F.coalesce(F.col(text_col), F.lit("")).alias(text_col)))


def embed_with(model: PipelineModel, df: DataFrame, text_col: str, id_col: str = "thread_id") -> DataFrame:
    """V1/V2 with a fitted encoder: (id, embedding ARRAY<DOUBLE>), unit length."""
    in_col = model.stages[0].getInputCol()  # the encoder reads the column it was fitted on
    src = df.select(F.col(id_col).cast("string").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(in_col))
    return model.transform(src).select(id_col, vector_to_array("_n").alias("embedding"))


def hashing_embed(df: DataFrame, text_col: str, id_col: str = "thread_id", dim: int = 256,
                  fit_on: DataFrame | None = None) -> DataFrame:
    """(id, embedding ARRAY<DOUBLE>) with unit-length TF-IDF hashing vectors."""
    model = fit_hashing_encoder(df if fit_on is None else fit_on, text_col, dim)
    return embed_with(model, df, text_col, id_col)


def embed(df: DataFrame, text_col: str, encoder: Encoder | None = None, id_col: str = "thread_id",
          dim: int = 256, batch_size: int = 64) -> DataFrame:
    """V1/V2: one L2-normalised vector per row of ``df``."""
    if encoder is None:
        return hashing_embed(df, text_col, id_col, dim)

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                m = np.asarray(encoder(part[text_col].fillna("").astype(str).tolist()), dtype=np.float64)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(n > 0, n, 1.0)
                yield pd.DataFrame({id_col: part[id_col].astype(str).to_numpy(), "embedding": list(m)})

    return df.select(F.col(id_col).cast("string").alias(id_col), text_col).mapInPandas(
        run, f"{id_col} string, embedding array<double>")
