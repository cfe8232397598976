"""Stages run in order over a shared context; the first failure ends the run, and a report tells."""

from __future__ import annotations

import json
import time
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Context:
    spark: SparkSession
    root: str
    values: dict[str, Any] = field(default_factory=dict)

    def resolve(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def put(self, key: str, value: Any) -> None:
        self.values[key] = value

    def get(self, key: str, default: Any = None) -> Any:
        return self.values.get(key, default)


@dataclass
class Result:
    stage: str
    status: str
    seconds: float
    metrics: dict[str, Any] = field(default_factory=dict)
    error: str = ""

    @property
    def succeeded(self) -> bool:
        return self.status == "success"


class Stage(ABC):
    name = "stage"

    @abstractmethod
    def run(self, context: Context) -> dict[str, Any]:
        """Does the work; gives metrics."""

    def execute(self, context: Context) -> Result:
        began = time.time()
        try:
            return Result(self.name, "success", round(time.time() - began, 3), self.run(context))
        except Exception as e:  # a failed stage is a result, not a crash
            return Result(self.name, "failed", round(time.time() - began, 3), {}, f"{type(e).__name__}: {e}")


class TableStage(Stage):
    """A stage that makes one table from the context and writes it under the root."""

    def __init__(self, name: str, make, out: str | None = None):
        self.name, self.make, self.out = name, make, out

    def run(self, context: Context) -> dict[str, Any]:
        df: DataFrame = self.make(context)
        if self.out:
            df.write.mode("overwrite").parquet(context.resolve(self.out))
            df = context.spark.read.parquet(context.resolve(self.out))
        context.put(self.name, df)
        return {"rows": df.count()}


def run_all(stages: list[Stage], context: Context) -> list[Result]:
    out = []
    for s in stages:
        out.append(s.execute(context))
        if not out[-1].succeeded:
            break
    return out


def report(results: list[Result]) -> str:
    return json.dumps({"succeeded": all(r.succeeded for r in results), "stages": [asdict(r) for r in results]}, indent=2)
