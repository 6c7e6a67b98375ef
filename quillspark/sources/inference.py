"""Batched model inference with a predictor that is passed in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def predict(df: DataFrame, predictor: Callable[[list[str]], pd.DataFrame], labels: list[str], id_col: str = "sentence_id", text: str = "text", batch: int = 32) -> DataFrame:
    """id and one probability column p_<label> for each label, 5 digits; the predictor sees at most `batch` texts at a time."""

    def run(batches):
        for pdf in batches:
            parts = [predictor(pdf[text].iloc[i : i + batch].tolist())[labels] for i in range(0, len(pdf), batch)]
            probs = pd.concat(parts, ignore_index=True).round(5) if parts else pd.DataFrame(columns=labels)
            probs.columns = [f"p_{v}" for v in labels]
            yield pd.concat([pdf[[id_col]].reset_index(drop=True), probs], axis=1)

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text).mapInPandas(run, f"{id_col} {kind}, " + ", ".join(f"p_{v} double" for v in labels))
