"""Adjacent pairs and keyed upserts over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relations import keep_last, upsert
from ..session import drop_table, materialize


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], keys: Sequence[str], order: Sequence[str]) -> DataStreamWriter:
    """Each batch's last row of each key replaces the table's rows of that key.

    ``read`` gives the table (none before the first batch), ``write`` takes the
    whole of the new one.  That is written apart first, so that ``write`` may
    replace the very files that ``read`` reads; a batch that is repeated after a
    failure gives the same table again.
    """

    def one(batch: DataFrame, _: int) -> None:
        new, old = keep_last(batch, keys, order), read()
        table = materialize(new if old is None else upsert(old, new, keys), "table")
        write(table)
        drop_table(table)

    return stream.writeStream.foreachBatch(one)


def transition_counts(stream: DataFrame, key: str, at: str, kind: str, late: str = "10 minutes") -> DataFrame:
    """(from_kind, to_kind, seconds) of each key's neighbours in a stream, by state for each key.

    Rows of a key go by time within each batch; a row that is older than the last
    one of an earlier batch gives no pair.  The state is one row for each key, and
    it goes when the watermark has passed it.
    """
    key_type, kind_type = (stream.schema[c].dataType.simpleString() for c in (key, kind))

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([at, kind], kind="stable")
        last = state.get if state.exists else None
        out = []
        for when, what in zip(rows[at], rows[kind], strict=True):
            micros = int(when.value // 1000)
            if last is not None and micros < last[0]:
                continue
            if last is not None:
                out.append((name[0], last[1], what, (micros - last[0]) / 1e6))
            last = (micros, what)
        if last is not None:
            state.update(last)
            state.setTimeoutTimestamp(max(last[0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "from_kind", "to_kind", "seconds"])

    rows = stream.select(key, at, kind).withWatermark(at, late).groupBy(key)
    return rows.applyInPandasWithState(run, f"{key} {key_type}, from_kind {kind_type}, to_kind {kind_type}, seconds double", f"micros long, kind {kind_type}", "append", GroupStateTimeout.EventTimeTimeout)


def rating_counts(stream: DataFrame, score: str, at: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of the scores' bands in windows of event time."""
    from ..functions.values import rating

    return stream.withWatermark(at, late).groupBy(F.window(at, window), rating(F.col(score)).alias("band")).count()
