"""Where a user's own counters, rules, comparators, adapters, stores, sinks and generators go in.

Each kind is a registry by name; operators look names up when a plan is made, so that what is registered reaches the
tasks with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame

from .bpe import heuristic


class Registry[T](dict[str, T]):
    """Things of one kind by name; a name is given once."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def register(self, name: str, thing: T) -> T:
        if name in self:
            raise ValueError(f"{self.kind} {name!r} is there already")
        self[name] = thing
        return thing

    def __missing__(self, name: str) -> T:
        raise KeyError(f"no {self.kind} {name!r}; there are: {', '.join(sorted(self))}")


class TokenCounter(Protocol):
    def __call__(self, text: str) -> int: ...


class Rule(Protocol):
    """Messages of what a tool call with schema-valid arguments breaks."""

    def __call__(self, call: dict, args: object, context: dict) -> Iterator[str]: ...


class Authorizer(Protocol):
    """Why a call is denied, or None."""

    def __call__(self, call: dict, args: object, contract: dict, context: dict) -> str | None: ...


class Comparator(Protocol):
    """rows with the columns of two responses (prefixes a and b): adds `agreement`."""

    def __call__(self, rows: DataFrame, a: str, b: str) -> DataFrame: ...


class Adapter(Protocol):
    """A provider's wire format."""

    def blocks(self, body: str) -> Iterator[dict]: ...

    def with_result(self, body: str, msg: int, part: int, text: str, primer: str) -> str: ...

    def response(self, body: str) -> dict: ...

    def assemble(self, stream: str) -> dict: ...


class Store(Protocol):
    """Where samples are kept: rows are added, and read back as a table."""

    def add(self, rows: DataFrame) -> None: ...

    def read(self, spark) -> DataFrame: ...


COUNTERS: Registry[TokenCounter] = Registry("token counter")
RULES: Registry[Rule] = Registry("rule")
AUTHORIZERS: Registry[Authorizer] = Registry("authorizer")
COMPARATORS: Registry[Comparator] = Registry("comparator")
ADAPTERS: Registry[Adapter] = Registry("adapter")
#: A sink takes a stream's batch and its number, as foreachBatch gives them.
SINKS: Registry[Callable[[DataFrame, int], None]] = Registry("sink")
#: A generator gives the columns of a synthetic table's row from the columns rows, seed and id.
GENERATORS: Registry[Callable[[], dict]] = Registry("generator")

COUNTERS.register("heuristic", heuristic)
