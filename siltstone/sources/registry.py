"""Registry of datasets and runs as a log of events; the state is each key's last event."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.catalog import last_wins
from siltstone.sources.log import Log

EVENTS = "kind string, key string, state string, root string, seq long, at timestamp, detail string"
#: Which states may follow which.
NEXT = {None: {"begun"}, "begun": {"committed", "rolled_back", "failed"}, "committed": {"begun"}, "rolled_back": {"begun"}, "failed": {"begun"}}


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Log(spark, path)

    def events(self) -> DataFrame:
        rows = [(e["kind"], e["key"], e["state"], e["root"], e["seq"], datetime.datetime.fromisoformat(e["at"]), e["detail"]) for e in self.log.entries()]
        return self.spark.createDataFrame(rows, EVENTS)

    def state(self) -> DataFrame:
        return last_wins(self.events(), ["kind", "key"], "seq")

    def record(self, kind: str, key: str, state: str, root: str = "", detail: str = "") -> None:
        """Adds an event, if it may follow the key's state; of two writers that begin one key, the second is refused."""

        def event(known: list[dict]) -> dict:
            old = next((e for e in reversed(known) if (e["kind"], e["key"]) == (kind, key)), None)
            if state not in NEXT[old["state"] if old else None]:
                raise ValueError(f"{kind} {key}: {state} can't follow {old['state'] if old else 'nothing'}")
            now = datetime.datetime.now(datetime.UTC).isoformat()
            return {"kind": kind, "key": key, "state": state, "root": root or (old["root"] if old else ""), "seq": old["seq"] + 1 if old else 1, "at": now, "detail": detail}

        self.log.append(event)

    def committed(self, kind: str) -> DataFrame:
        """The roots that readers may use."""
        return self.state().where((F.col("kind") == kind) & (F.col("state") == "committed")).select("key", "root", "at")
