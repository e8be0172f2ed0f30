"""Models asked over a table of prompts: a client for each task, bounded concurrency, retries.

A client is any object with ``ask(prompt) -> str``; a factory makes one in each task, so that no connection travels. Rows
whose prompt fails to the last try have a null reply and the error's text; they can be asked again by ``not_done``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Client(Protocol):
    def ask(self, prompt: str) -> str: ...


class Stub:
    """Answers by the prompt alone: the first rule whose part the prompt holds, else a fixed reply."""

    def __init__(self, rules: dict[str, str] | None = None, otherwise: str = "unclear"):
        self.rules, self.otherwise = rules or {}, otherwise

    def ask(self, prompt: str) -> str:
        return next((r for part, r in self.rules.items() if part in prompt), self.otherwise)


def ask(df: DataFrame, key: str, prompt: str, factory: Callable[[], Client], *, workers: int = 8, tries: int = 3, wait: float = 0.5, least_gap: float = 0.0) -> DataFrame:
    """(key, reply, error) of every row. Null prompts aren't asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()
        last = [0.0]

        def one(text: str | None) -> tuple[str | None, str | None]:
            if text is None:
                return None, "no prompt"
            for k in range(tries):
                try:
                    if least_gap:
                        time.sleep(max(0.0, last[0] + least_gap - time.monotonic()))
                        last[0] = time.monotonic()
                    return client.ask(text), None
                except Exception as e:  # a client may raise anything; the row tells what
                    error = f"{type(e).__name__}: {e}"
                    time.sleep(wait * 2**k)
            return None, error

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                got = list(pool.map(one, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], [key, "reply", "error"])

    return df.select(F.col(key).cast("string").alias(key), F.col(prompt).cast("string")).mapInArrow(run, f"`{key}` string, reply string, error string")


def label_prompt(text: Column, names: list[str], before: Column | None = None) -> Column:
    """A prompt that asks for the operator of a sentence, by number."""
    listed = F.lit("\n".join(f"{i}. {n}" for i, n in enumerate(names, 1)))
    context = F.lit("") if before is None else F.concat(F.lit("\nSentence before: "), F.coalesce(before, F.lit("-")))
    return F.concat(F.lit("Which of these operators is the sentence? Give the numbers of the best and the second best.\n"), listed, context, F.lit("\nSentence: "), text)
