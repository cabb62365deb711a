"""Sinks for people: an alert for each opportunity. Off unless a sender is given."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Send = Callable[[dict], None]


def alert_rows(opportunities: DataFrame) -> DataFrame:
    """What an alert says: the edge in percent, both tickers and the smaller volume."""
    return opportunities.select(F.col("a.ticker").alias("a_ticker"), F.col("b.ticker").alias("b_ticker"), F.round(F.col("arbitrage.net_edge") * 100, 2).alias("profit_percent"), F.least("a.volume", "b.volume").alias("min_liquidity"))


def alert_sink(send: Send | None, at_most: int = 100) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends the largest edges of a batch; failures are logged and don't stop the stream."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        if send is None:
            return
        for row in alert_rows(batch).orderBy(F.desc("profit_percent")).limit(at_most).collect():  # people read no more
            try:
                send(row.asDict())
            except Exception:
                logging.getLogger(__name__).exception("alert of batch %s failed", batch_id)

    return sink
