"""Pluggable scoring models, run on partitions with one instance a Python worker.

A model has `check(message) -> (score, reason)` and may raise `CheckError`. A factory
makes it on the executor; what it can't make or what `detect` refuses is unavailable.
"""

from __future__ import annotations

import math
import queue
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reply
from .schema import ATTEMPTS, RUN_FAILED, RUN_INVALID


#: Calls of a task that are under way at a time.
POOL = 8


class CheckError(Exception):
    """A message that couldn't be scored; its text may be shown."""


class Model(Protocol):
    def detect(self) -> bool: ...
    def check(self, message: str) -> tuple[float, str]: ...


class Template:
    """Scores everything 50 and is never available: a pattern for own models."""

    def detect(self) -> bool:
        return False

    def check(self, message: str) -> tuple[float, str]:
        return 50.0, "template"


class Chat:
    """A model behind a chat client: `client(messages, options) -> reply text`."""

    def __init__(self, client: Callable[[list[dict], dict], str], template: str = "{message}", system: str = "", temperature: float = 0.5, timeout: float = 60):
        self.client, self.template, self.system = client, template, system
        self.options = {"temperature": temperature, "timeout": timeout}

    def detect(self) -> bool:
        return True

    def ask(self, message: str) -> str:
        head = [{"role": "system", "content": self.system}] if self.system else []
        return self.client([*head, {"role": "user", "content": self.template.replace("{message}", message)}], self.options)


#: The parameters of known chat models by id: temperature and seconds of an attempt.
CHAT_PARAMETERS = {"deepseek": {"temperature": 0.6, "timeout": 120}, "glm4": {"temperature": 0, "timeout": 60}, "qwen25": {"temperature": 0, "timeout": 60}}


def chat(family: str, client: Callable[[list[dict], dict], str], **more) -> Chat:
    """A chat model of a known family with its parameters."""
    return Chat(client, **(CHAT_PARAMETERS[family] | more))


class Registry:
    """Model factories by id, with display name and description."""

    def __init__(self):
        self.entries: dict[str, tuple[Callable[[], Model], str, str]] = {}
        self._made: dict[str, Model | None] = {}

    def register(self, model_id: str, factory: Callable[[], Model], display_name: str = "", description: str = "") -> None:
        self.entries[model_id] = (factory, display_name or model_id, description)
        self._made.pop(model_id, None)

    def _model(self, model_id: str) -> Model | None:
        """The model, made and detected once; none if it's unavailable."""
        if model_id not in self._made:
            try:
                model = self.entries[model_id][0]()
                self._made[model_id] = model if model.detect() else None
            except Exception:  # a model that can't start is unavailable, never fatal
                self._made[model_id] = None
        return self._made[model_id]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, name, text, self._model(k) is not None) for k, (_, name, text) in self.entries.items()]
        return spark.createDataFrame(rows, "model_id string, display_name string, description string, available boolean")

    def available(self, spark: SparkSession) -> DataFrame:
        return self.table(spark).where("available")

    def get(self, model_id: str) -> Model:
        model = self._model(model_id) if model_id in self.entries else None
        if model is None:
            raise KeyError(model_id)
        return model


_made: dict[int, Model | None] = {}


def _model(key: int, factory: Callable[[], Model]) -> Model | None:
    if key not in _made:
        try:
            model = factory()
            _made[key] = model if model.detect() else None
        except Exception:
            _made[key] = None
    return _made[key]


def run(messages: DataFrame, factory: Callable[[], Model], column: str = "content", key: int = 0) -> DataFrame:
    """Add available, score, reason and error. Details of unexpected errors aren't passed on."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in messages.schema)}, available boolean, score double, reason string, error string"

    def one(model: Model | None, text) -> tuple:
        if model is None:
            return False, None, None, "unavailable"
        try:
            score, reason = model.check(text or "")
            if isinstance(score, bool) or not math.isfinite(score := float(score)) or not 0 <= score <= 100:
                raise CheckError(RUN_INVALID)
            return True, score, reason, None
        except CheckError as e:
            return True, None, None, str(e).strip() or RUN_FAILED
        except Exception:
            return True, None, None, RUN_FAILED

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(key, factory)
        for frame in frames:
            out = [one(model, t) for t in frame[column]]
            yield frame.assign(**{c: pd.Series([o[k] for o in out], index=frame.index, dtype=t) for k, (c, t) in enumerate((("available", object), ("score", float), ("reason", object), ("error", object)))})

    return messages.mapInPandas(part, schema)


class Late(Exception):
    """A call that took longer than its deadline."""


def within(seconds: float, call: Callable[[], str]) -> str:
    """The result of a call that ends in time, else Late. A late call goes on in a thread nobody waits for."""
    done: queue.SimpleQueue = queue.SimpleQueue()

    def work() -> None:
        try:
            done.put((True, call()))
        except BaseException as e:
            done.put((False, e))

    threading.Thread(target=work, daemon=True).start()
    try:
        good, value = done.get(timeout=seconds)
    except queue.Empty:
        raise Late from None
    if not good:
        raise value
    return value


def asked(chat: Chat, text: str | None, attempts: int, deadline: float) -> str:
    """The first acceptable reply within `attempts` calls, else the last reply there was."""
    found = ""
    for _ in range(attempts):
        try:
            found = within(deadline, lambda: chat.ask(text or "")) or ""
        except Exception:  # failed or late: the details aren't passed on
            continue
        if reply.acceptable(found):
            break
    return found


def run_chat(messages: DataFrame, make: Callable[[], Chat], column: str = "content", attempts: int = ATTEMPTS, pool: int = POOL, deadline: float | None = None) -> DataFrame:
    """Ask a chat model about each message and check the replies: adds reply, ok, score, reason.

    Each task has up to `pool` calls under way at a time, so a client must bear calls from
    several threads; rows keep their order. A message whose call fails, takes longer than
    `deadline` seconds (the model's own timeout) or whose reply isn't valid is asked again, up
    to `attempts` times in all; details of a failed call aren't passed on.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in messages.schema)}, reply string"

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = make()
        seconds = chat.options["timeout"] if deadline is None else deadline
        with ThreadPoolExecutor(pool) as workers:
            for frame in frames:
                yield frame.assign(reply=list(workers.map(lambda t: asked(chat, t, attempts, seconds), frame[column])))

    return reply.checked(messages.mapInPandas(part, schema))
