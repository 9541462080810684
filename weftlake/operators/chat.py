"""Chat turns: messages by provider, guarded generation, and answers with their sources named."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.functions.guard import injection_reason, sanitize
from weftlake.operators.embed import Breaker, with_retry
from weftlake.operators.rag import EMPTY_CONTEXT, MAX_TOKENS, TEMPERATURE, fill_prompt, replace_references

Message = tuple[str, str]


def messages(kind: str, system: str, history: list[dict], question: str) -> list[Message]:
    """(role, text) of a request: an internal model gets the prompt, the complete turns and the question, others the prompt and the question.

    ``history`` has turns with role, text and status, in order; incomplete ones are left out.
    """
    if not question.strip():
        raise ValueError("the question is blank")
    turns = [(h["role"], h["text"]) for h in history if h.get("status", "complete") == "complete"] if kind == "internal" else []
    return [("system", system), *turns, ("user", question)]


def check_options(temperature: float = TEMPERATURE, top_p: float = 1.0, max_tokens: int = MAX_TOKENS) -> dict:
    """Options of a generation, refused if out of range."""
    if not 0 <= temperature <= 2 or not 0 < top_p <= 1 or max_tokens < 1:
        raise ValueError("temperature must be 0 to 2, top_p above 0 to 1 and max_tokens positive")
    return {"temperature": temperature, "top_p": top_p, "max_tokens": max_tokens}


def extractive(conversation: list[Message], **options) -> str:
    """A model without a model: names the first chunk of the prompt, or says that there is none."""
    system = next((t for r, t in conversation if r == "system"), "")
    return "According to Chunk 1." if "[Chunk 1]" in system else "I don't know."


def generate(df: DataFrame, provider: Callable[..., str], system: str = "prompt", question: str = "question", out: str = "answer", tries: int = 3, **options) -> DataFrame:
    """Every row with the provider's answer; a row whose call fails gets the failure's text and fails no other."""
    options = check_options(**options)

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        breaker = Breaker()

        def one(s: str, q: str) -> str:
            try:
                return with_retry(lambda: breaker.call(lambda: provider(messages("openai", s or "", [], q or ""), **options)), tries)
            except Exception as e:
                return f"Error: {e}"

        for s, q in batches:
            yield pd.Series([one(a, b) for a, b in zip(s, q)], index=s.index, dtype=object)

    return df.withColumn(out, run(F.col(system), F.col(question)))


def answer(questions: DataFrame, contexts: DataFrame, titles: DataFrame, template: str, provider: Callable[..., str], key: str = "conv_id") -> DataFrame:
    """(key, answer, rejected) of questions (key, question): guarded, put before their context, generated, and chunk numbers replaced by titles.

    ``contexts`` has (key, context), ``titles`` (key, titles as an array by rank); questions without either get the empty context.
    """
    q = questions.withColumn("rejected", injection_reason(F.col("question"))).withColumn("question", sanitize(F.col("question")))
    q = q.join(contexts, key, "left").join(titles, key, "left").withColumn("prompt", fill_prompt(F.lit(template), F.coalesce("context", F.lit(EMPTY_CONTEXT))))
    good = generate(q.filter("rejected IS NULL"), provider)
    named = good.withColumn("answer", replace_references(F.col("answer"), F.coalesce("titles", F.array().cast("array<string>"))))
    refused = q.filter("rejected IS NOT NULL").withColumn("answer", F.lit(None).cast("string"))
    return named.select(key, "answer", "rejected").unionByName(refused.select(key, "answer", "rejected"))


def _event(name: str, data: dict) -> str:
    return f"event: {name}\ndata: {json.dumps(data, separators=(',', ':'))}\n\n"


def token_events(message_id: int, documents: list[dict], tokens: Iterable[str], finish: Callable[[str, str], None] = lambda text, status: None) -> Iterator[str]:
    """Server-sent events of an answer that is being generated: connected, retrieval_complete, content for each token, then complete or error.

    ``finish`` gets the whole text and its status (complete, error, or incomplete if the reader left) exactly once.
    """
    parts: list[str] = []
    status = "incomplete"
    try:
        yield _event("connected", {"status": "connected"})
        yield _event("retrieval_complete", {"message_id": message_id, "documents": documents})
        try:
            for t in tokens:
                parts.append(t)
                yield _event("content", {"content": t})
            status = "complete"
        except Exception as e:
            status = "error"
            yield _event("error", {"error": str(e)})
        else:
            yield _event("complete", {"message_id": message_id, "content": "".join(parts)})
    finally:
        finish("".join(parts), status)


def check_search(datasets: list, query: str, limit: int = 10) -> None:
    """Refuse a search without data sets or with a blank query."""
    if not datasets:
        raise ValueError("at least one data set is needed")
    if not query.strip():
        raise ValueError("the query is blank")
    if limit < 1:
        raise ValueError("limit must be positive")


