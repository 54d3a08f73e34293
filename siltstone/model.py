"""Calls of a language model, as a function that the caller gives; offline there is a stub."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from siltstone.config import Model
from siltstone.session import ship

RESPONSE = "content string, model string, input_tokens bigint, output_tokens bigint, finish_reason string, latency_ms double"


@dataclass(frozen=True)
class Response:
    content: str
    model: str = "stub"
    input_tokens: int = 0
    output_tokens: int = 0
    finish_reason: str = "stop"
    latency_ms: float = 0.0


Call = Callable[[str, str, Model], Response]


def stub(system: str, user: str, model: Model) -> Response:
    """A text with the sections that the prompt asks for; always the same for the same prompt."""
    names = [x.split("**")[1] for x in user.split("\n") if x[:1].isdigit() and x.count("**") >= 2] or ["Documentation"]
    text = "\n\n".join(f"## {n}\n\nNothing to report in this section; the payload has {len(user)} characters." for n in names)
    return Response(text, model.model_name, (len(system) + len(user)) // 4, len(text) // 4)


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310 - the caller's own address
            return json.loads(r.read())
    except urllib.error.HTTPError:
        raise
    except urllib.error.URLError as e:
        raise ConnectionError(f"no answer from {url}: {e.reason}") from e


def _key(model: Model) -> str:
    key = os.environ.get(model.api_key_env or "", "")
    if not key:
        raise OSError(f"the environment has no {model.api_key_env or 'name of a key'}")
    return key


def chat_call(url: str, timeout: float = 300.0) -> Call:
    """A call of a chat service with a key: roles and choices."""

    def call(system: str, user: str, model: Model) -> Response:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        r = _post(url, {"model": model.model_name, "max_tokens": model.max_output_tokens, "messages": messages}, {"authorization": f"Bearer {_key(model)}"}, timeout)
        first, used = r["choices"][0], r.get("usage") or {}
        return Response(first["message"]["content"] or "", model.model_name, used.get("prompt_tokens", 0), used.get("completion_tokens", 0), first.get("finish_reason") or "")

    return call


def messages_call(url: str, version: str, timeout: float = 300.0) -> Call:
    """A call of a message service with a key: the system text apart, blocks of content back."""

    def call(system: str, user: str, model: Model) -> Response:
        body = {"model": model.model_name, "max_tokens": model.max_output_tokens, "system": system, "messages": [{"role": "user", "content": user}]}
        r = _post(url, body, {"x-api-key": _key(model), "version": version}, timeout)
        used = r.get("usage") or {}
        return Response("".join(x.get("text", "") for x in r["content"]), model.model_name, used.get("input_tokens", 0), used.get("output_tokens", 0), r.get("stop_reason") or "")

    return call


def local_call(url: str, timeout: float = 300.0) -> Call:
    """A call of a model server on this machine, without streaming; no answer is a ConnectionError."""

    def call(system: str, user: str, model: Model) -> Response:
        r = _post(url, {"model": model.model_name, "system": system, "prompt": user, "stream": False, "options": {"num_predict": model.max_output_tokens}}, {}, timeout)
        return Response(r.get("response", ""), model.model_name, r.get("prompt_eval_count", 0), r.get("eval_count", 0), r.get("done_reason") or "stop")

    return call


#: The calls by tier and provider; programs with a network put theirs here, made by chat_call, messages_call or local_call.
CALLS: dict[tuple[str, str], Call] = {("local", "stub"): stub}


def generate(system: str, user: str, model: Model, call: Call | None = None) -> Response:
    """One call, with its time; a pair of tier and provider without a call is an error."""
    call = call or CALLS.get((model.tier, model.provider))
    if call is None:
        raise ValueError(f"no model call for tier {model.tier!r} and provider {model.provider!r}")
    began = time.monotonic()
    r = call(system, user, model)
    return Response(r.content, r.model, r.input_tokens, r.output_tokens, r.finish_reason, r.latency_ms or (time.monotonic() - began) * 1000)


def generate_all(prompts: DataFrame, model: Model, call: Call | None = None) -> DataFrame:
    """prompts (with system_prompt and user_prompt) with the fields of RESPONSE: calls run where the prompts are."""
    ship(prompts.sparkSession)
    own = call or CALLS.get((model.tier, model.provider))
    if own is None:
        raise ValueError(f"no model call for tier {model.tier!r} and provider {model.provider!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [generate(s, u, model, own) for s, u in zip(b["system_prompt"], b["user_prompt"])]
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame([vars(r) for r in rows])], axis=1)

    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{have}, {RESPONSE}")
