"""A workspace in streaming state, whose identities leave when they have been quiet for long enough."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "identity_id long, event string, last_activation timestamp, n long"
STATE = "last_us long, n long"


def active_identities(events: DataFrame, quiet: str, lateness: str = "7 days") -> DataFrame:
    """Updates and evictions of identities from a stream of (identity_id, activation timestamp).

    State is one row for each active identity: its latest activation, whatever the order of arrival,
    and how many events it had.  An identity leaves when the watermark is ``quiet`` past its latest
    activation.  Events later than ``lateness`` would be dropped by the watermark, so that is the time
    for which state is kept; the ledger, not this cache, holds the truth, and a restart can rebuild it.
    """
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"identity_id": [key[0]], "event": ["evicted"], "last_activation": [pd.Timestamp(last, unit="us")], "n": [n]})
            return
        for b in batches:
            newest = int(b["activation"].max().value // 1000)
            last, n = newest if last is None else max(last, newest), n + len(b)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"identity_id": [key[0]], "event": ["active"], "last_activation": [pd.Timestamp(last, unit="us")], "n": [n]})

    timed = events.withWatermark("activation", lateness)
    return timed.groupBy("identity_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
