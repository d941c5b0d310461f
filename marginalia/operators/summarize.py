"""Summaries by a pluggable chat model, in Arrow batches, and the wire format of such models."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.functions.embedding import Embedder, embedded

#: Answers to a list of prompts; called in the tasks. None stands for a failed call.
Chat = Callable[[list[str]], "list[str | None]"]
#: Code points of a page that a model is shown, prompts given to it at once.
PAGE_CHARS, BATCH = 8000, 16


def prompt(title: Column, page: Column) -> Column:
    """What a model is asked about a page."""
    ask = "Summarize the page below in one to three concrete sentences. Answer with the summary only.\n\nPage title: "
    return F.concat(F.lit(ask), F.coalesce(title, F.lit("")), F.lit("\nContent:\n"), text.clipped(page, PAGE_CHARS), F.lit("\nSummary:"))


def answered(prompts: Column, chat: Chat) -> Column:
    """Answers of ``chat`` to a prompt column; null for null prompts and failed calls."""

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for asked in batches:
            out: list[str | None] = [None] * len(asked)
            rows = [i for i, p in enumerate(asked) if p is not None]
            for a in range(0, len(rows), BATCH):
                part = rows[a : a + BATCH]
                for i, answer in zip(part, chat([asked.iloc[i] for i in part])):
                    out[i] = answer
            yield pd.Series(out, dtype=object)

    return answers(prompts)


def summarized(pages: DataFrame, chat: Chat, embed: Embedder) -> DataFrame:
    """Outcome for each of ``pages`` (note_id, title, content, outline): note_id, outcome, summary, vector.

    skipped: too little prose. failed: no answer, or one that says nothing. ok: summary and its vector. Null contents are skipped.
    """
    plain = F.coalesce(F.when(F.col("outline"), text.outline_text(F.col("content"))).otherwise(text.prose_text(F.col("content"))), F.lit(""))
    worth = F.coalesce(text.narrative_chars(F.col("content"), F.col("outline")), F.lit(0)) >= text.SUMMARY_CHARS
    asked = pages.select("note_id", F.when(worth, prompt(F.col("title"), plain)).alias("prompt"))
    told = asked.withColumn("answer", text.trimmed(text.without_thinking(answered(F.col("prompt"), chat))))
    junk = F.col("answer").isNull() | text.is_junk_summary(F.col("answer"))
    outcome = F.when(F.col("prompt").isNull(), "skipped").when(junk, "failed").otherwise("ok")
    kept = told.select("note_id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("answer")).alias("summary"))
    return kept.withColumn("vector", F.when(F.col("outcome") == "ok", embedded(F.col("summary"), embed)))


def stream_text(body: Column) -> Column:
    """Text of a streamed chat answer: the deltas of its ``data:`` lines up to ``[DONE]``; lines that aren't JSON are left out."""
    rows = F.filter(F.split(body, "\n", -1), lambda x: x.startswith("data:"))
    payload = F.transform(rows, lambda x: F.trim(F.substring(x, 6, F.length(x))))
    end = F.array_position(payload, F.lit("[DONE]"))
    read = F.when(end > 0, F.slice(payload, 1, end.cast("int") - 1)).otherwise(payload)
    return F.array_join(F.transform(read, lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.lit(""))), "")


def http_chat(url: str, model: str, key: str | None = None, timeout: int = 600) -> Chat:
    """A chat model behind ``url`` (…/v1/chat/completions)."""

    def ask(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            body = json.dumps({"model": model, "messages": [{"role": "user", "content": p}]}).encode()
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as reply:
                    out.append(json.load(reply)["choices"][0]["message"]["content"])
            except (OSError, ValueError, LookupError):
                out.append(None)
        return out

    return ask
