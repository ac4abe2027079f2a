"""Plug-ins as programs: rows go to a process a task by newline-delimited JSON calls, answers come back as columns.

A call is ``{"id": n, "method": "execute", "params": {"action": ..., "input": {...}}}`` and its answer ``{"id": n, "result": {...}}`` or
``{"id": n, "error": ...}``; ``info`` is asked once at the start. A program that does not answer in time is ended and the row
fails with an error; the next row starts it anew.
"""

from __future__ import annotations

import json
import queue
import subprocess
import threading
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sidecar:
    """One running program."""

    def __init__(self, command: Sequence[str], timeout_s: float):
        self.timeout, self.calls = timeout_s, 0
        self.process = subprocess.Popen(list(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
        self.answers: queue.Queue = queue.Queue()
        threading.Thread(target=self._read, daemon=True).start()
        self.info = self.call("info", {})

    def _read(self) -> None:
        for line in self.process.stdout:
            self.answers.put(line)
        self.answers.put(None)

    def call(self, method: str, params: dict):
        self.calls += 1
        self.process.stdin.write(json.dumps({"id": self.calls, "method": method, "params": params}) + "\n")
        self.process.stdin.flush()
        while True:
            line = self.answers.get(timeout=self.timeout)
            if line is None:
                raise OSError("the program ended")
            answer = json.loads(line)
            if answer.get("id") == self.calls:
                if answer.get("error"):
                    raise ValueError(str(answer["error"]))
                return answer.get("result")

    def close(self) -> None:
        self.process.kill()
        self.process.wait()


def run_sidecar(rows: DataFrame, key: str, inputs: Sequence[str], command: Sequence[str], action: str, timeout_s: float = 30.0) -> DataFrame:
    """(key, result, error): the program's answer to each row as JSON text, or why there is none; the program must be on every executor."""

    def run(batches):
        program = None
        try:
            for b in batches:
                out = []
                for k, *values in zip(*(b.column(c).to_pylist() for c in ("key", *inputs))):
                    try:
                        program = program or Sidecar(command, timeout_s)
                        out.append((k, json.dumps(program.call("execute", {"action": action, "input": dict(zip(inputs, values))})), None))
                    except ValueError as e:
                        out.append((k, None, str(e)))
                    except (OSError, queue.Empty) as e:
                        out.append((k, None, str(e) or "no answer in time"))
                        if program is not None:
                            program.close()
                            program = None
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field("key").type), *[pa.array([x[i] for x in out], pa.string()) for i in (1, 2)]], names=["key", "result", "error"])
        finally:
            if program is not None:
                program.close()

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), *inputs).mapInArrow(run, f"key {kind}, result string, error string").withColumnRenamed("key", key)
