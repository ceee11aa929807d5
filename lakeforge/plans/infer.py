"""Model calls as a batch stage, in rounds of raw answers that are decoded as columns."""

from __future__ import annotations

import hashlib
import json
import logging
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import EXTERNAL, allow_repeated_keys, reply
from ..session import cut_lineage
from ..sources.replies import ReplyLog

MAX_TOKENS, TIMEOUT, RETRIES, TEMPERATURE = 2048, 120, 3, 0.1
RETRY_NOTE = "\nYour last reply could not be read. Send one JSON object and nothing else."


class Model(Protocol):
    def call(self, prompt: str, json_format: bool, max_tokens: int) -> str: ...


def request_of(model: str, prompt: str, json_format: bool, max_tokens: int) -> str:
    body = {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": TEMPERATURE, "num_predict": max_tokens}}
    return json.dumps(body | ({"format": "json"} if json_format else {}))


def request_column(model: str, prompt: Column, json_format: bool, max_tokens: int = MAX_TOKENS) -> Column:
    """The same request as a column; to_json leaves out a null format."""
    options = F.struct(F.lit(TEMPERATURE).alias("temperature"), F.lit(max_tokens).alias("num_predict"))
    return F.to_json(F.struct(F.lit(model).alias("model"), prompt.alias("prompt"), F.lit(False).alias("stream"), F.lit("json" if json_format else None).cast("string").alias("format"), options.alias("options")))


def envelope_text(body: str) -> str:
    """response of the first JSON value of a body; '' if it has none."""
    value, _ = json.JSONDecoder().raw_decode(body.lstrip())
    if value is None:
        return ""
    if not isinstance(value, dict):
        raise ValueError("the envelope isn't an object")
    text = next((v for k, v in reversed(value.items()) if k.lower() == "response"), "")
    if text is not None and not isinstance(text, str):
        raise ValueError("response isn't a string")
    return text or ""


@dataclass
class HttpModel:
    """A server that takes one prompt per request. A status other than 200 is only logged; what its body holds counts."""

    endpoint: str
    model: str

    def call(self, prompt: str, json_format: bool, max_tokens: int) -> str:
        data = request_of(self.model, prompt, json_format, max_tokens).encode()
        req = urllib.request.Request(self.endpoint, data, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(req, timeout=TIMEOUT) as r:
                body = r.read()
        except urllib.error.HTTPError as e:
            logging.getLogger(__name__).warning("model status %s", e.code)
            body = e.read()
        return envelope_text(body.decode("utf-8", "replace"))


@dataclass
class StubModel:
    """Offline and deterministic: names called in the code become dependencies, and a hash of the prompt the verdict."""

    fail_on: str = ""

    def call(self, prompt: str, json_format: bool, max_tokens: int) -> str:
        if self.fail_on and self.fail_on in prompt:
            raise OSError("stub failure")
        mark = hashlib.sha256(prompt.encode()).hexdigest()[:8]
        if not json_format:
            return "OK" if int(mark, 16) % 3 else f"Check the error path ({mark})."
        code = prompt.rpartition("CODE:")[2]
        own = re.search(r"func\s*(?:\([^)]*\)\s*)?(\w+)", code)
        names = dict.fromkeys(re.findall(r"([\w.]+)\(", code.partition("{")[2]))
        return json.dumps({"summary": f"summary {mark}", "external": [{"name": n, "type": "function"} for n in names if not own or n != own[1]]})


def _caller(model: Model, json_format: bool):
    def call(prompt: str) -> str | None:
        try:
            return model.call(prompt, json_format, MAX_TOKENS)
        except (OSError, ValueError):
            return None

    return call


def ask(prompts: DataFrame, model: Model, workers: int, json_format: bool = False, log: ReplyLog | None = None, stage: str = "") -> DataFrame:
    """prompts (id, prompt): id, raw, seconds; raw is null where the call failed. With a log, answers are put away as they come,
    and those that it has aren't asked for again."""
    call = _caller(model, json_format)
    if log is not None:
        return log.answered(prompts, stage, call, workers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, seconds = [], []
            for prompt in batch["prompt"]:
                start = time.monotonic()
                out.append(call(prompt))
                seconds.append(time.monotonic() - start)
            yield pd.DataFrame({"id": batch["id"], "raw": pd.Series(out, dtype=object), "seconds": seconds})

    return prompts.select("id", "prompt").repartition(workers).mapInPandas(run, "id string, raw string, seconds double")


def discover(prompts: DataFrame, model: Model, workers: int, retries: int = RETRIES, log: ReplyLog | None = None, stage: str = "first") -> DataFrame:
    """prompts (id, prompt, has_code): id, ok, summary, external, attempts, seconds. One round asks for all; those whose reply can't be
    had or read go into the next, with a note. What has no code isn't asked about, and fails as if it had been each time."""
    allow_repeated_keys(prompts.sparkSession)
    todo = prompts.where("has_code").select("id", "prompt", F.lit(0.0).alias("before"))
    out = prompts.where(~F.col("has_code")).select("id", F.lit(False).alias("ok"), F.lit("").alias("summary"), F.array().cast(EXTERNAL).alias("external"), F.lit(retries + 1).alias("attempts"), F.lit(0.0).alias("seconds"))
    for attempt in range(1, retries + 2):
        asked = todo.select("id", F.concat("prompt", F.lit(RETRY_NOTE if attempt > 1 else "")).alias("prompt"))
        raw = ask(asked, model, workers, True, log, f"{stage} {attempt}")
        if attempt > 1:
            raw = raw.join(todo.select("id", "before"), "id").withColumn("seconds", F.col("seconds") + F.col("before"))
        replies = cut_lineage(raw.select("id", reply(F.coalesce("raw", F.lit(""))).alias("r"), "seconds"), "replies").select("id", "r.*", F.lit(attempt).alias("attempts"), "seconds")
        bad = replies.where(~F.col("ok"))
        if attempt > retries or not bad.limit(1).count():
            return out.unionByName(replies)
        out = out.unionByName(replies.where("ok"))
        todo = cut_lineage(todo.select("id", "prompt").join(bad.select("id", F.col("seconds").alias("before")), "id"), "again")
    return out


def reply_dependencies(replies: DataFrame) -> DataFrame:
    """function_id, dep_name, dep_type, pos of the dependencies in replies, in their order."""
    rows = replies.where("ok").select(F.col("id").alias("function_id"), F.posexplode("external").alias("pos", "e"))
    return rows.select("function_id", F.col("e.name").alias("dep_name"), F.col("e.type").alias("dep_type"), "pos")
