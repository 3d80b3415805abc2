"""Signed delivery of alerts, for foreachBatch."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row

from ledgerlight.functions.crypto import sign, valid_webhook


def deliver(body: dict, secret: str, send: Callable[[bytes, dict], int], tries: int = 5, wait: Callable[[float], None] = time.sleep) -> bool:
    """Posts a signed body until the receiver accepts it, waiting twice as long after each failure."""
    data = json.dumps(body, sort_keys=True).encode()
    for i in range(tries):
        try:
            if 200 <= send(data, {"X-Signature": sign(data, secret)}) < 300:
                return True
        except OSError:
            pass  # counts as a failed try
        if i + 1 < tries:
            wait(2.0**i)
    return False


def sink(url: str, secret: str, send: Callable[[bytes, dict], int], event: str = "alert") -> Callable[[DataFrame, int], None]:
    """Rows go out from the tasks that hold them, one after another; send is carried there. A row that isn't accepted fails its task, which Spark tries again."""
    if not valid_webhook(url):
        raise ValueError("not a public https address")

    def step(batch: DataFrame, number: int) -> None:
        def hand_on(rows: Iterator[Row]) -> None:
            for row in rows:
                if not deliver({"event": event, "batch": number, "data": row.asDict(True)}, secret, send):
                    raise OSError(f"{url} accepts nothing; the batch will be run again")

        batch.foreachPartition(hand_on)

    return step
