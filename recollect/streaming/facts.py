"""Versioned relations over a stream of assertions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.facts import SlotFold

OUTCOMES = "subject string, type string, seq long, object string, subtype string, outcome string, closed string"


class _Fold(StatefulProcessor):
    """Keeps a slot group's live edges as state; closed edges leave it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("live", "edges string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        fold = SlotFold()
        if self.state.exists():
            kept = json.loads(self.state.get()[0])
            fold.live, fold.versions = kept["live"], kept["versions"]
        frame = pd.concat(list(rows)).sort_values("seq").astype(object)
        out = []
        for row in frame.where(frame.notna(), None).to_dict("records"):
            outcome, closed = fold.apply({"object": row["object"], "subtype": row["subtype"], "confidence": row["confidence"], "ts": str(row["ts"])})
            out.append((key[0], key[1], int(row["seq"]), row["object"], row["subtype"], outcome, closed and closed["object"]))
        self.state.update((json.dumps({"live": fold.live, "versions": fold.versions}),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    def close(self) -> None:
        pass


def fold_stream(assertions: DataFrame) -> DataFrame:
    """What each of a stream of subtype-keyed assertions ``(seq, ts, subject, type, object, subtype, confidence)`` did, in the order of each micro-batch.

    Needs the RocksDB state store. Within a batch assertions are taken by seq; batches must come in order.
    """
    return assertions.groupBy("subject", "type").transformWithStateInPandas(_Fold(), OUTCOMES, "Append", "None")
