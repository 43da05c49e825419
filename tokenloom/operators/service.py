"""Calls of an outside service for each row, many at once, with errors kept as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of an error's text that are kept, and calls that a task has open at once.
ERROR_LENGTH, CALLS_AT_ONCE = 200, 32


def call_each(rows: DataFrame, request: str, make_client: Callable[[], Callable[[str], str]], calls_at_once: int = CALLS_AT_ONCE, tries: int = 1) -> DataFrame:
    """rows with ``success``, ``response``, ``error`` and ``calls`` (how often the client was asked).

    make_client runs once in each task and gives what is called with a row's request, a
    string column; so connections and keys are made where they are used, and tests pass
    a client of their own.  A call that raises is tried again up to ``tries`` times, and
    then is a row with its error's text; the other rows go on.  A null request isn't
    called and is an error.  Only a window of calls is open, so a batch of any size takes
    the memory of its rows.  A task that is run again calls its rows again: keep results
    in a table and take ``registry.to_do`` of the inputs to go on after a stop.
    """
    taken = {"success", "response", "error", "calls"}
    carried = [c for c in rows.columns if c not in taken or c == request]
    rows = rows.select(*carried)
    at = carried.index(request)
    kept = [c for c in carried if c not in taken]
    schema = T.StructType([rows.schema[c] for c in kept] + T._parse_datatype_string("success boolean, response string, error string, calls int").fields)

    def ask(client: Callable[[str], str], text: str | None) -> tuple[bool, str | None, str | None, int]:
        if text is None:
            return False, None, "no request", 0
        for n in range(1, max(1, tries) + 1):
            try:
                return True, client(text), None, n
            except Exception as e:  # whatever the client raises belongs to its row
                problem = str(e)[:ERROR_LENGTH] or type(e).__name__
        return False, None, problem, n

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        with ThreadPoolExecutor(calls_at_once) as pool:
            for batch in batches:
                texts, got = batch.column(at), []
                for lo in range(0, len(texts), 4 * calls_at_once):
                    got += pool.map(lambda x: ask(client, x), texts.slice(lo, 4 * calls_at_once).to_pylist())
                kinds = (pa.bool_(), pa.string(), pa.string(), pa.int32())
                results = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*[batch.column(carried.index(c)) for c in kept], *results], names=schema.fieldNames())

    return rows.mapInArrow(call, schema)
