"""Caller-supplied processing: handlers per document type and callbacks on new or classified documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Handler = Callable[[DataFrame], DataFrame]


class TaskHandlers:
    """A DataFrame function per document type; all other rows, those without a type among them, go through the default."""

    def __init__(self, default: Handler = lambda df: df):
        self.default = default
        self.by_type: dict[str, Handler] = {}

    def register(self, document_type: str, handler: Handler) -> None:
        self.by_type[document_type] = handler

    def process(self, tasks: DataFrame) -> DataFrame:
        kind = F.coalesce(F.col("document_type"), F.lit(""))
        parts = [h(tasks.where(kind == t)) for t, h in self.by_type.items()]
        out = self.default(tasks.where(~kind.isin(*self.by_type)) if self.by_type else tasks)
        for p in parts:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


def on_batch(*callbacks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each micro-batch to all callbacks, e.g. on new or classified documents."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for fn in callbacks:
                fn(batch, batch_id)
        finally:
            batch.unpersist()

    return run
