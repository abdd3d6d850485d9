"""The online matcher as a stateful stream: one state per scope, carried between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.operators import kernels
from loomline.plans.resolve import DECISION, fold


def match_stream(rows: DataFrame, matcher: kernels.Matcher | None = None) -> DataFrame:
    """Decisions for a stream of tracks (the columns of ``match_rows``). Tracks of one micro-batch are taken in order of ``t0``,
    then ``seq``; across batches the order is that of arrival, as the log's step shows."""
    fresh = pickle.dumps(matcher or kernels.Matcher())

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else pickle.loads(fresh)
        out = fold(pd.concat(list(batches)), now)
        state.update((pickle.dumps(now),))
        yield out

    return rows.groupBy("scope").applyInPandasWithState(step, DECISION, "matcher binary", "append", GroupStateTimeout.NoTimeout)
