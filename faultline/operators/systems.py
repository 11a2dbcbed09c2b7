"""Systems that diagnose cases one by one, as Arrow tasks over what they may see of a case."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.functions import patterns as P
from faultline.sources.records import PREDICTIONS

DIAGNOSIS = pa.struct([("failure_type", pa.string()), ("root_cause", pa.string()), ("confidence", pa.float64()), ("affected_files", pa.list_(pa.string()))])
ROWS = pa.schema([("case_id", pa.string()), ("system", pa.string()), ("diagnosis", DIAGNOSIS), ("error", pa.string()), ("latency_ms", pa.float64()), ("tool_calls", pa.int32()), ("llm_calls", pa.int32())])

System = Callable[[dict], dict]


def predictions(visible: DataFrame, name: str, build: Callable[[], System]) -> DataFrame:
    """A prediction for each case of visible: case_id and whatever else a system may see.

    build makes the system once a task. A diagnosis may bring tool_calls and llm_calls (else 0). A case on which the system
    fails keeps its row: no diagnosis, and the error's type and text, 500 characters at most.
    """

    def run(batches):
        system = build()
        for batch in batches:
            rows = []
            for case in batch.to_pylist():
                start, found, error = time.perf_counter(), {}, None
                try:
                    found = dict(system(case))
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"[: P.MAX_ERROR]
                calls = {"tool_calls": found.pop("tool_calls", 0), "llm_calls": found.pop("llm_calls", 0)}
                rows.append({"case_id": str(case["case_id"]), "system": name, "diagnosis": None if error else found, "error": error, "latency_ms": (time.perf_counter() - start) * 1000, **calls})
            yield pa.RecordBatch.from_pylist(rows, schema=ROWS)

    return visible.mapInArrow(run, PREDICTIONS)
