"""Batched scoring of many checkpoints.

A checkpoint here is a row of a coefficient table ``(model, fold, target,
intercept, slope, feature)``; the table is small (families x folds x targets)
and shipped to every task once. Each Arrow batch of documents is scored by
every checkpoint with NumPy, so documents are read once for all models.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def score_checkpoints(docs: DataFrame, coef_rows: list[dict], feature_cols: list[str],
                      id_col: str = "text_id") -> DataFrame:
    """``(id, model, fold, target, pred)`` for every document x checkpoint
    (reduce='none'; average with a groupBy for reduce='mean')."""
    table = pd.DataFrame(coef_rows)

    def fn(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            outs = []
            for feat, grp in table.groupby("feature"):
                x = pdf[feat].to_numpy(dtype=np.float64)
                preds = np.outer(x, grp["slope"].to_numpy()) + grp["intercept"].to_numpy()
                n, m = preds.shape
                outs.append(pd.DataFrame({
                    id_col: np.repeat(pdf[id_col].to_numpy(), m),
                    "model": np.tile(grp["model"].to_numpy(), n),
                    "fold": np.tile(grp["fold"].to_numpy().astype(np.int32), n),
                    "target": np.tile(grp["target"].to_numpy(), n),
                    "pred": preds.ravel()}))
            yield pd.concat(outs, ignore_index=True)

    return docs.select(id_col, *feature_cols).mapInPandas(
        fn, f"{id_col} long, model string, fold int, target string, pred double")
