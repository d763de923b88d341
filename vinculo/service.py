"""What a server would offer: health, status, and a question answered and logged."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import answers, questions
from .catalog import Graph
from .sources import querylog

MIN_QUESTION = 5


class MissingSetting(RuntimeError):
    """A required setting that is nowhere."""


def setting(spark: SparkSession, name: str, default: str | None = None, *, required: bool = False) -> str | None:
    """A setting from the session (``vinculo.<name>``), else from the environment, else the default."""
    value = spark.conf.get(f"vinculo.{name}", None) or os.environ.get(name) or default
    if required and not value:
        raise MissingSetting(f"{name} is not set")
    return value


def health() -> dict:
    return {"status": "ok"}


def status(graph: Graph) -> dict:
    """The number of nodes by label; a graph that can't be read is told in a note."""
    try:
        counts = {r["type"]: r["count"] for r in graph.label_histogram().collect()}  # one row per label
        return {"status": "ok", "nodes": counts, "total": sum(counts.values())}
    except Exception as e:  # noqa: BLE001
        return {"status": "ok", "nodes": {}, "total": 0, "note": str(e)}


def ask(graph: Graph, question: str, *, api_key: str | None = None, expected_key: str | None = None, log_path: str | None = None, ip_address: str = "", generate: Callable | None = None, write: Callable | None = None) -> dict:
    """Answer a question: ``code`` is 200, 400 (too short), 401 (wrong key) or 500; successes and errors are logged."""
    if expected_key is not None and api_key != expected_key:
        return {"code": 401, "error": "invalid API key"}
    if len(question.strip()) < MIN_QUESTION:
        return {"code": 400, "error": "the question is too short"}
    began = time.time()
    out: dict = {"question": question}
    try:
        out["method"] = questions.classify(question, graph)
        result, text = questions.ask(graph, question, generate)
        rows = [r.asDict(recursive=True) for r in result.collect()]  # capped
        out |= {"code": 200, "cypher": text, "result_count": len(rows), "answer": answers.compose(question, rows, text, write), "rows": rows}
    except Exception as e:  # noqa: BLE001
        out |= {"code": 500, "error": str(e)}
    out["duration"] = round(time.time() - began, 2)
    if log_path:
        logged = {k: out.get(k) for k in ("question", "method", "cypher", "answer", "result_count", "duration")}
        querylog.append(graph.spark, log_path, ip_address=ip_address, status="success" if out["code"] == 200 else "error", error=out.get("error", ""), cypher_result=str(out.get("rows", "")), **logged)
    return out
