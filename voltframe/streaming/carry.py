"""Carry between the pages of a document that arrive in several deliveries, as keyed state.

A page's first chunk begins with the last tokens of the page before it. In a stream that
page may have come with an earlier micro-batch. A stateful operator (``transformWithState``,
RocksDB state store) therefore keeps, for each document, the numbers of the pages seen and the
tail of each (at most ``OVERLAP_TOKENS`` tokens), and tells for every page of a micro-batch
the tail of the nearest page before it, whether that came now or long ago. Page texts do not
pass through it.

The answer for a page depends on the pages that arrived with it or before it. Pages that arrive
in order, in however many deliveries, are carried into as in one batch, and a page that is
delivered again is carried into as the first time, so its chunks are found stored. A page that
arrives after its successor is carried into correctly itself; the successor, stored by then,
keeps the carry it had. If one page comes in different texts, the latest delivery counts from
then on, and of different texts in one micro-batch the one whose tail is least.

State is versioned with the query's checkpoint: a replayed micro-batch sees what its first run
saw. A task holds a document's page numbers (8 bytes each) and the tails of its pages in this
micro-batch up to ``HELD_TAILS``; further tails are read back from the state store.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from voltframe.operators.chunks import page_tails

HELD_TAILS = 4096
OUT_ROWS = 2048
CARRIES = "source_pdf string, page_number int, carry string"


class CarryProcessor(StatefulProcessor):
    """Per document: page numbers seen, and the tail of each page."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getValueState("pages", "numbers array<int>")
        self.tails = handle.getMapState("tails", "page int", "tail string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[int, str | None] = {}
        held = 0
        for frame in rows:
            for page, tail in zip(frame["page_number"].tolist(), frame["tail"].tolist()):
                if page in arrived:
                    old = arrived[page] if arrived[page] is not None else self.tails.getValue((page,))[0]
                    if old <= tail:
                        continue
                self.tails.updateValue((page,), (tail,))
                held += page not in arrived
                arrived[page] = tail if held <= HELD_TAILS else None
        seen = list(self.pages.get()[0]) if self.pages.exists() else []
        known = sorted({*seen, *arrived})
        self.pages.update((known,))
        out: list[tuple] = []
        for page in sorted(arrived):
            at = bisect_left(known, page)
            if at == 0:
                continue
            before = known[at - 1]
            tail = arrived.get(before)
            out.append((key[0], page, tail if tail is not None else self.tails.getValue((before,))[0]))
            if len(out) >= OUT_ROWS:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source_pdf", "page_number", "carry"])


def carries(pages: DataFrame) -> DataFrame:
    """``source_pdf, page_number, carry`` for every page of a stream of pages that follows another page of
    its document."""
    keyed = page_tails(pages).groupBy("source_pdf")
    return keyed.transformWithStateInPandas(CarryProcessor(), CARRIES, "Append", "None")
