"""Structured data from text by a language model that the caller names; nothing here is called unless asked for."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resumelake.functions import text
from resumelake.operators import cvjson, redaction
from resumelake.schema import CV

Call = Callable[[str], str]
AGAIN = "\n\nReturn one JSON object that follows the schema, and nothing else."


def json_of(reply: str):
    """The JSON value of a reply, or that of its widest {...}; None if there is neither."""
    widest = re.search(r"\{.*\}", reply, re.DOTALL)
    for candidate in (reply, widest and widest.group()):
        try:
            return json.loads(candidate) if candidate else None
        except json.JSONDecodeError:
            continue
    return None


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}


def violation(value, schema: dict, path: str = "$") -> str | None:
    """The first place where a JSON value breaks a JSON schema (type, enum, required, properties, additionalProperties false, items, pattern); None if it doesn't."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in kinds):
        return f"{path} is not of type {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path} is none of {schema['enum']}"
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        return f"{path} does not match {schema['pattern']}"
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        return next((v for k, x in enumerate(value) if (v := violation(x, schema["items"], f"{path}[{k}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if missing := [k for k in schema.get("required", ()) if k not in value]:
            return f"{path} lacks {missing[0]}"
        if schema.get("additionalProperties") is False and (extra := [k for k in value if k not in known]):
            return f"{path} has {extra[0]}, which the schema doesn't name"
        return next((v for k, s in known.items() if k in value and (v := violation(value[k], s, f"{path}.{k}"))), None)
    return None


def answered(call: Call, prompt: str, attempts: int = 3, wait: float = 0.5, schema: dict | None = None) -> str:
    """JSON text of the first reply that holds any (and fits a JSON schema, if one is given). A reply without makes the next prompt plainer, one that doesn't fit names the
    place; a RuntimeError (no connection, a refusal) isn't tried again."""
    problem = None
    for k in range(1, attempts + 1):
        try:
            value = json_of(call(prompt))
        except RuntimeError:
            raise
        except Exception as e:
            problem = e
        else:
            broken = violation(value, schema) if schema is not None and value is not None else None
            if broken:
                prompt, problem = f"{prompt}\n\nThe JSON before did not fit the schema: {broken}. Return a corrected JSON object, and nothing else.", ValueError(broken)
            elif value is not None:
                return json.dumps(value, ensure_ascii=False)
            else:
                prompt, problem = prompt + AGAIN, ValueError("no JSON in the reply")
        if k < attempts:
            time.sleep(wait * k)
    raise RuntimeError(f"no answer after {attempts} attempts: {problem}") from problem


def _post(url: str, body: dict, timeout: int, headers: dict[str, str]) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except (urllib.error.URLError, TimeoutError, json.JSONDecodeError) as e:
        raise RuntimeError(f"{url}: {e}") from e


@dataclass(frozen=True)
class Ollama:
    """A local model server."""

    model: str = "llama2"
    url: str = "http://127.0.0.1:11434"
    system: str = ""
    most: int = 4096
    timeout: int = 60

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model.removeprefix("ollama/"), "prompt": prompt, "system": self.system, "stream": False, "format": "json", "num_predict": self.most, "options": {"temperature": 0, "top_p": 1.0, "seed": 1234, "num_ctx": 8192}}
        return _post(f"{self.url}/api/generate", body, self.timeout, {})["response"]


@dataclass(frozen=True)
class OpenAI:
    """A chat completion service."""

    key: str
    model: str = "gpt-4o-mini"
    url: str = "https://api.openai.com/v1"
    system: str = ""
    most: int = 4096
    timeout: int = 60

    def __call__(self, prompt: str) -> str:
        messages = [{"role": r, "content": c} for r, c in (("system", self.system), ("user", prompt)) if c]
        body = {"model": self.model, "messages": messages, "temperature": 0, "max_tokens": self.most}
        return _post(f"{self.url}/chat/completions", body, self.timeout, {"Authorization": f"Bearer {self.key}"})["choices"][0]["message"]["content"]


KINDS: dict[str, type] = {"ollama": Ollama, "openai": OpenAI}


def client(kind: str = "ollama", **settings) -> Call:
    if kind.lower() not in KINDS:
        raise ValueError(f"no such kind of client: {kind}")
    return KINDS[kind.lower()](**settings)


def structured(docs: DataFrame, call: Call, prompt: str, schema: str = CV, column: str = "text", attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """docs with structured (JSON text, empty after an error) and llm_error (null if there was none).

    prompt holds {DOCUMENT_TEXT} and {SCHEMA_TEXT}. A row's failure doesn't stop the others; null and blank texts aren't sent and have an error.
    """
    names = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf[column]:
                try:
                    if not isinstance(t, str) or not t.strip():
                        raise RuntimeError("no text")
                    out.append((answered(call, prompt.replace("{SCHEMA_TEXT}", schema).replace("{DOCUMENT_TEXT}", t), attempts, wait), None))
                except RuntimeError as e:
                    out.append(("", str(e)))
            yield pdf.assign(structured=[a for a, _ in out], llm_error=pd.Series([b for _, b in out], index=pdf.index, dtype=object))[[*names, "structured", "llm_error"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInPandas(run, f"{fields}, structured string, llm_error string")


def documents_to_cvs(docs: DataFrame, call: Call, prompt: str, redact: bool = False, pii_limit: int | None = None, **settings) -> DataFrame:
    """doc_id, cv, llm_error, plain_txt, mapping of docs (doc_id, text): clean text, redacted if asked (over the first pii_limit characters, or all), to a polished CV.

    plain_txt is null if the text was redacted, mapping if it wasn't.
    """
    clean = docs.select("doc_id", text.layout_text(F.col("text")).alias("text"))
    hidden = redact or pii_limit is not None
    if pii_limit is not None:
        sent = redaction.redacted_values(clean, pii_limit).select("doc_id", F.col("redacted").alias("text"), F.to_json("mapping").alias("mapping"))
    elif redact:
        sent = redaction.redacted(clean).select("doc_id", F.col("redacted").alias("text"), F.to_json("mapping").alias("mapping"))
    else:
        sent = clean.withColumn("mapping", F.lit(None).cast("string"))
    got = structured(sent, call, prompt, **settings)
    cv = cvjson.polished(F.from_json(F.nullif("structured", F.lit("")), CV))
    return got.select("doc_id", cv.alias("cv"), "llm_error", F.when(F.lit(not hidden), F.col("text")).alias("plain_txt"), "mapping")
