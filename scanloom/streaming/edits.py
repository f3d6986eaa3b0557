"""Live edit log: what each ``apply`` writes, with discarded work dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "document_id long, page_id long, applied_ts timestamp, applied_seq long, turns long, filter_name string"
COLUMNS = ["document_id", "page_id", "applied_ts", "applied_seq", "turns", "filter_name"]


class EditLog(StatefulProcessor):
    """Pending edits per page of one document; emitted on apply, cleared on discard.

    A row without page id sets the filter of every page of the document; page rows of the same apply
    carry a filter only when it was chosen after the document-wide one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._pages = handle.getMapState("pending", "page_id long", "turns long, filter_name string")
        self._all = handle.getValueState("pending_all", "filter_name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for command in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples(index=False):
            page = (int(command.page_id),)
            if command.command == "rotate":
                turns, chosen = self._of(page)
                self._pages.updateValue(page, (turns + 1, chosen))
            elif command.command == "select_filter":
                self._pages.updateValue(page, (self._of(page)[0], command.filter_name))
            elif command.command == "apply_all":
                self._all.update((command.filter_name,))
                for known, (turns, _) in list(self._pages.iterator()):
                    self._pages.updateValue(known, (turns, None))
            else:
                if command.command == "apply":
                    if self._all.exists():
                        out.append((key[0], None, command.ts, command.seq, 0, self._all.get()[0]))
                    for known, (turns, chosen) in self._pages.iterator():
                        out.append((key[0], known[0], command.ts, command.seq, turns, chosen))
                self._pages.clear()
                self._all.clear()
        # Object columns first: ids beside NULLs would pass through floats and lose digits.
        frame = pd.DataFrame(out, columns=COLUMNS, dtype=object)
        yield frame.astype({c: "Int64" for c in ("document_id", "page_id", "applied_seq", "turns")}).astype(
            {"applied_ts": "datetime64[ns]"}
        )

    def _of(self, page) -> tuple[int, str | None]:
        return tuple(self._pages.getValue(page)) if self._pages.containsKey(page) else (0, None)

    def close(self) -> None:
        pass


def applied_edits_stream(commands: DataFrame) -> DataFrame:
    """``commands`` as for ``fold_edits`` with ``ts`` as a timestamp."""
    return commands.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=EditLog(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
