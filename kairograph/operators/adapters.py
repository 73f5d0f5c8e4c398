"""Outside models as table functions: embedding encoders and chat services, injected by the caller."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed(rows: DataFrame, text_col: str, make_encoder: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], *, id_col: str = "id", batch: int = 256) -> DataFrame:
    """(id, v): vectors of texts. ``make_encoder`` is called once in each task and returns a
    function from texts to vectors; null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                v = encode([t if isinstance(t, str) else "" for t in part["text"]])
                yield pd.DataFrame({"id": part["id"], "v": [list(map(float, x)) for x in v]})

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, v array<float>")


def complete(rows: DataFrame, make_client: Callable[[], Callable[[list[dict]], str]], *, tries: int = 3, backoff: float = 1.0, accept: Callable[[str], bool] = bool) -> DataFrame:
    """(kind, id, answer, tries_used, error): one answer for each row's ``messages``.

    A call that raises, or whose answer ``accept`` refuses, is tried again after ``backoff``
    times a power of two seconds; after ``tries`` the answer is null and the error is kept, so
    that a later run asks for the missing ones only (``context.pending``)."""

    def ask(client, messages) -> tuple[str | None, int, str | None]:
        error = None
        for k in range(tries):
            if k:
                time.sleep(backoff * 2 ** (k - 1))
            try:
                answer = client(messages)
                if accept(answer):
                    return answer, k + 1, None
                error = "refused answer"
            except Exception as e:  # a service's failures are data here
                error = f"{type(e).__name__}: {e}"
        return None, tries, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            found = [ask(client, [dict(m) for m in messages]) for messages in pdf["messages"]]
            yield pd.DataFrame({"kind": pdf["kind"], "id": pdf["id"], "answer": [x[0] for x in found], "tries_used": [x[1] for x in found], "error": [x[2] for x in found]})

    return rows.select("kind", "id", "messages").mapInPandas(run, "kind string, id long, answer string, tries_used int, error string")


def chat_text(messages: Column, *, start: str = "<|{role}|>\n", end: str = "\n", answer: str = "<|assistant|>\n") -> Column:
    """Messages rendered by a template, ready for the answer."""
    before, after = start.split("{role}")
    turn = F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["content"], F.lit(end)))
    return F.concat(F.array_join(turn, ""), F.lit(answer))
