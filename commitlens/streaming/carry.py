"""Carry-forward of slice labels over a stream, with a state per slice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.labels import ALIASES, SAME, STATES

OUT = "repo_name string, slice_id string, commit_num int, commit string, code_slice string, _row_id long, resolved string, is_open boolean"


def carried(stream: DataFrame, label_col: str) -> DataFrame:
    """Rows of a stream of slice labels with their resolved label, as the batch form gives where each slice's rows arrive in order of commits.

    The state of a slice is its last valid label. Rows of one micro-batch are put in order first.
    """
    from pyspark.sql import functions as F

    from ..functions.labels import slice_id

    own = stream.select("repo_name", slice_id("code_slice").alias("slice_id"), "commit_num", "commit", "code_slice", "_row_id", F.col(label_col).alias("label"))

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["commit_num", "commit", "code_slice", "_row_id"])
        resolved, is_open = [], []
        for raw in rows["label"]:
            x = (raw or "").strip()
            x = ALIASES.get(x, x)
            if x in STATES:
                last = x
            resolved.append(last if x == SAME else x if x in STATES else None)
            is_open.append(x == SAME and last is None)
        state.update((last,))
        yield rows.drop(columns="label").assign(resolved=resolved, is_open=is_open)[["repo_name", "slice_id", "commit_num", "commit", "code_slice", "_row_id", "resolved", "is_open"]]

    return own.groupBy("repo_name", "slice_id").applyInPandasWithState(step, OUT, "last string", "append", GroupStateTimeout.NoTimeout)
