"""Prompts, contexts and request bodies for a language model, and a pluggable call."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevier.functions.text import column, either

CONTEXT_FIELDS = ["title", "category", "date", "source", "brand", "summary"]


def context_json(articles: DataFrame, position: str, n: int = 30, fields: list[str] | None = None) -> DataFrame:
    """One row: a JSON array of the first n articles' fields, nulls kept."""
    kept = fields or CONTEXT_FIELDS
    top = articles.orderBy(position).limit(n)
    listed = F.sort_array(F.collect_list(F.struct(F.col(position).alias("__at"), F.struct(*kept).alias("__row"))))
    return top.agg(F.to_json(F.transform(listed, lambda x: x["__row"]), {"ignoreNullFields": "false"}).alias("context"))


def chat_prompt(context: DataFrame, question: str, instruction: str) -> DataFrame:
    return context.select(F.concat(F.lit(instruction), F.lit("\n"), F.col("context"), F.lit("\n"), F.lit(question)).alias("prompt"))


def bullet(general: str = "一般") -> Column:
    """- [date] (category/brand) title：summary"""
    return F.concat(
        F.lit("- ["), F.col("date"), F.lit("] ("), either("categoryName", "category"), F.lit("/"), either("brand", F.lit(general)), F.lit(") "),
        F.col("title"), F.lit("："), F.col("summary"),
    )


def report_bullets(articles: DataFrame, position: str, n: int = 30, empty: str = "") -> DataFrame:
    """One row: a line for each of the first n articles, or the given text without any."""
    top = articles.orderBy(position).limit(n).select(F.col(position).alias("__at"), bullet().alias("__line"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("__at", "__line"))), lambda x: x["__line"])
    return top.agg(F.when(F.count("*") > 0, F.array_join(lines, "\n")).otherwise(empty).alias("bullets"))


def summary_prompt(instruction: str) -> Column:
    """The prompt for one article's summary."""
    parts = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name).cast("string"), F.lit(""))) for name in ("title", "source", "date", "summary")]
    return F.concat_ws("\n", F.lit(instruction), *parts)


def request_body(prompt: Column | str, system: Column | str | None = None, temperature: float = 0.7) -> Column:
    """JSON of a content-generation request."""
    text = lambda c: F.array(F.struct(column(c).alias("text")))
    fields = [
        F.array(F.struct(F.lit("user").alias("role"), text(prompt).alias("parts"))).alias("contents"),
        F.struct(F.lit(temperature).alias("temperature")).alias("generationConfig"),
    ]
    if system is not None:
        fields.append(F.when(column(system) != "", F.struct(text(system).alias("parts"))).alias("systemInstruction"))
    return F.to_json(F.struct(*fields))


REPLY = "candidates array<struct<content: struct<parts: array<struct<text: string>>>>>"


def reply_text(body: Column | str) -> Column:
    """Text parts of the first candidate, joined; empty where there is none."""
    first = F.get(F.from_json(column(body), REPLY)["candidates"], F.lit(0))
    parts = F.transform(first["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit("")))
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


class Busy(Exception):
    """What a callable raises for an answer with an HTTP status."""

    def __init__(self, status: int):
        super().__init__(status)
        self.status = status


def patient(
    call: Callable[[str], str], tries: int = 3, first_s: float = 0.8, sleep: Callable[[float], None] = time.sleep
) -> Callable[[str], str]:
    """A callable asked again, after first_s, twice that, ..., while it is busy (429 or 5xx); other errors rise at once."""

    def ask(value: str) -> str:
        for k in range(tries):
            try:
                return call(value)
            except Busy as e:
                if k + 1 == tries or not (e.status == 429 or 500 <= e.status < 600):
                    raise
                sleep(first_s * 2**k)
        raise ValueError("tries must be positive")

    return ask


def complete(prompt: Column | str, call: Callable[[str], str], workers: int = 1) -> Column:
    """The answers of a callable, a batch at a time, of which up to `workers` prompts are asked at once.

    patient(call) asks again where a service is busy; a callable times out as it sees fit.
    """

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        one = lambda p: None if p is None else call(p)
        with ThreadPoolExecutor(workers) as pool:
            return pd.Series(list(pool.map(one, prompts)), dtype=object)

    return ask(column(prompt))


def translate(
    rows: DataFrame, text: str, call: Callable[[str], str] = lambda s: s, fallback: Callable[[str], str] | None = None, workers: int = 5
) -> DataFrame:
    """A memo (text, translated) of the distinct texts of a column, each asked for once.

    Where a call fails or says nothing the fallback is asked, and where that fails, too, a text stays as it is.
    """

    def safe(value: str) -> str:
        for ask in (call, fallback):
            try:
                if ask is not None and (found := ask(value)):
                    return found
            except Exception:  # a translation service may fail in any way, and the original will do
                continue
        return value

    distinct = rows.select(F.col(text).alias("text")).where("text is not null").distinct()
    return distinct.withColumn("translated", complete("text", safe, workers))
