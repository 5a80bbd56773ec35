"""Retrieval for question answering: context, sources and prompt of ranked hits; generation is any callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview

NOTHING = "No relevant documents found."
PROMPT = "Answer the question from the context below.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:"


def context(hits: DataFrame, style: str = "library") -> DataFrame:
    """One row: the hits' texts in order of rank. hits: rank, file_name, chunk_text, at most top_k rows."""
    head, close, gap = ("[File: ", "]\n", "\n---\n") if style == "library" else ("[From ", "]:\n", "\n\n---\n\n")
    part = F.concat(F.lit(head), F.col("file_name"), F.lit(close), F.col("chunk_text"))
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("t"))))
    return hits.agg(F.array_join(F.transform(rows, lambda r: r["t"]), gap).alias("context"), F.count("*").alias("n_hits"))


def sources(hits: DataFrame) -> DataFrame:
    """The first hit of each file, in order of rank."""
    first = Window.partitionBy("file_path").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("preview", preview(F.col("chunk_text"), 200, ""))


def prompt(question: str, context_text: str) -> str:
    return PROMPT.format(context=context_text, question=question)


def ask(hits: DataFrame, question: str, generate: Callable[[str], Iterator[str]], style: str = "library") -> Iterator[dict]:
    """Token events, then one with the sources, then done. A generator's failure becomes a token."""
    top = hits.cache()
    row = context(top, style).first()
    if not row["n_hits"]:
        yield {"event": "token", "data": NOTHING}
    else:
        try:
            for token in generate(prompt(question, row["context"])):
                yield {"event": "token", "data": token}
        except ConnectionError as e:
            yield {"event": "token", "data": f"The model cannot be reached: {e}"}
    yield {"event": "sources", "data": [r.asDict() for r in sources(top).orderBy("rank").collect()]}  # at most top_k rows
    top.unpersist()
    yield {"event": "done", "data": None}
