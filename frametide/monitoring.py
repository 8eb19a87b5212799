"""Metrics of answers as observations of a DataFrame, a stream's progress, error columns, and log lines in JSON."""

from __future__ import annotations

import json
import logging
import threading
import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .functions.columns import request_id

# Upper edges of the buckets of latencies in milliseconds.
LATENCY_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def below(x: Column, edges: tuple[float, ...], name: str) -> list[Column]:
    """Counts of x up to each edge, as in a cumulative histogram."""
    return [F.count(F.when(x <= e, 1)).alias(f"{name}_le_{e:g}") for e in edges]


def observed(answers: DataFrame, name: str = "answers") -> tuple[DataFrame, Observation]:
    """answers (status, confidence, and total_ms where there is one), and what is counted while they are computed for whatever use."""
    seen = Observation(name)
    made = [F.count("*").alias("n"), F.count(F.when(F.col("status") == "match", 1)).alias("n_match"), F.sum("confidence").alias("confidence_sum"), *below(F.col("confidence"), tuple(i / 20 for i in range(1, 21)), "confidence")]
    if "total_ms" in answers.columns:
        made += [F.sum("total_ms").alias("total_ms_sum"), *below(F.col("total_ms"), LATENCY_MS, "total_ms")]
    return answers.observe(seen, *made), seen


def exposition(values: dict, prefix: str = "frametide") -> str:
    """Text lines of an observation's values, one a metric."""
    return "".join(f"{prefix}_{k.replace('.', '_').replace('-', 'm')} {v if v is not None else 0}\n" for k, v in sorted(values.items()))


class Progress(StreamingQueryListener):
    """Counts batches, rows and failures of all streams of a session."""

    def __init__(self):
        self._lock, self.batches, self.rows, self.failures = threading.Lock(), 0, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            self.batches += 1
            self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.failures += event.exception is not None


# Codes of errors by their status.
CODES = {413: "too_large", 415: "unsupported_type", 422: "unprocessable", 503: "busy"}


def error_column(status: Column, message: Column, request: Column) -> Column:
    """struct(error struct(code, message), request_id); null where status is null. Bad request ids are replaced."""
    code = F.coalesce(*[F.when(status == k, v) for k, v in CODES.items()], F.lit("error"))
    return F.when(status.isNotNull(), F.struct(F.struct(code.alias("code"), message.alias("message")).alias("error"), request_id(request).alias("request_id")))


def total_ms(timings: Column) -> Column:
    """The sum of a map of stages' times."""
    return F.aggregate(F.map_values(timings), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


class JsonLines(logging.Formatter):
    """One JSON object a line, with what was given as extra."""

    _OWN = frozenset(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        line = {"ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record.created)) + f".{int(record.msecs):03d}Z", "level": record.levelname.lower(), "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k, v in record.__dict__.items() if k not in self._OWN}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def configure_logging(level: str = "INFO", as_json: bool = True) -> None:
    """Driver log lines to standard error; a second call replaces the first."""
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    logger = logging.getLogger("frametide")
    logger.handlers, logger.propagate = [handler], False
    logger.setLevel(level)
