"""Documents that arrive unit by unit, in two tiers: written in flushes, and sent on in batches that overlap.

A document's units (pages, sheets, turns) may arrive in any order and in any number of micro-batches. Each tier keeps
what waits for its turn in state: batch ``b`` leaves once its units are there, while later units are still to come, and
takes the last units of the batch before along. The last batch, and batches with units missing, leave when the document
ends: when as many units were seen as it is said to have, or when others come ``patience`` seconds after its last.

Defined results: a unit that comes again is left out. Null texts stay. Rows without a document or a unit number are
left out. A document that ends by ``patience`` and goes on later begins anew. What is held of a document that arrives in
order is one batch; of one that arrives in reverse, all its units.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.mapping import BATCH_UNITS, FLUSH_UNITS, OVERLAP_UNITS

#: What is held of a document: its next batch (-1: ended), units seen, units it has, and those that wait.
HELD = "next long, seen long, units long, numbers array<long>, texts array<string>"
SENT = "doc_id string, batch long, numbers array<long>, texts array<string>"


class Batches:
    """The batches of one document, from its units as they come."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, seen, units, numbers, texts = state.get if state.exists else (0, 0, None, [], [])
        held = dict(zip(numbers, texts, strict=True))
        if state.hasTimedOut:
            state.remove()
            yield self.sent(key[0], self.rest(at, held))
            return
        for part in parts:
            if at < 0:
                continue
            for number, text, of in zip(part["unit_no"].tolist(), part["text"].tolist(), part["units"].tolist(), strict=True):
                if number > at * self.size and number not in held:
                    held[number] = None if pd.isna(text) else text
                    seen += 1
                units = units if pd.isna(of) else int(of)
            out = []
            while all(at * self.size + i in held for i in range(1, self.size + 1)):
                out.append(self.batch(at, held))
                at += 1
                held = {n: x for n, x in held.items() if n > at * self.size - self.overlap}
            if units is not None and seen >= units:
                out += self.rest(at, held)
                at, held = -1, {}
            yield self.sent(key[0], out)
        state.update((at, seen, units, list(held), list(held.values())))
        # the watermark is behind arrivals by the patience
        state.setTimeoutTimestamp(max(state.getCurrentProcessingTimeMs(), state.getCurrentWatermarkMs()) + 1)

    def batch(self, at: int, held: dict[int, str | None]) -> tuple[int, list[int], list[str | None]]:
        numbers = sorted(n for n in held if at * self.size - self.overlap < n <= (at + 1) * self.size)
        return at, numbers, [held[n] for n in numbers]

    def rest(self, at: int, held: dict[int, str | None]) -> list[tuple[int, list[int], list[str | None]]]:
        """The batches of all that is held and wasn't sent."""
        return [self.batch(b, held) for b in sorted({(n - 1) // self.size for n in held if n > at * self.size})] if at >= 0 else []

    def sent(self, doc: str, out: list) -> pd.DataFrame:
        return pd.DataFrame([(doc, *x) for x in out], columns=["doc_id", "batch", "numbers", "texts"])


def batches(units: DataFrame, size: int = BATCH_UNITS, overlap: int = OVERLAP_UNITS, patience: int = 3600) -> DataFrame:
    """(doc_id, batch, numbers, texts) of a stream (doc_id, unit_no from 1, text, units); ``units`` is null where unknown."""
    if not 0 <= overlap <= size:
        raise ValueError("units of an overlap must be among a batch's")
    rows = units.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("unit_no").cast("long").alias("unit_no"), "text", F.col("units").cast("long").alias("units"))
    # timers go by time of arrival as a watermark: by the clock alone, a query over all there is would never end
    rows = rows.where("doc_id is not null and unit_no >= 1").withColumn("arrived", F.current_timestamp()).withWatermark("arrived", f"{patience} seconds")
    return rows.groupBy("doc_id").applyInPandasWithState(Batches(size, overlap), SENT, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def written(out: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A query that writes what leaves in each micro-batch to a folder of its own, so that a retried one comes once; ends when all is read."""

    def put(part: DataFrame, number: int) -> None:
        part.write.mode("overwrite").parquet(f"{folder}/run={number}")

    return out.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def two_tiers(units: DataFrame, folder: str) -> list[StreamingQuery]:
    """The flushes (of five, without overlap) and the batches (of three, each with one unit of the last) of a stream of units.

    Both go on from the checkpoints in ``folder`` when called again.
    """
    tiers = {"flushes": batches(units, FLUSH_UNITS, 0), "batches": batches(units)}
    return [written(out, f"{folder}/{name}", f"{folder}/{name}-checkpoint") for name, out in tiers.items()]


def tier(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(doc_id, batch, numbers, texts) of all that :func:`two_tiers` wrote so far."""
    return spark.read.schema(f"{SENT}, run int").parquet(f"{folder}/{name}").drop("run")
