"""Named queries: a key template, a method and a pipeline kind, checked once and called by name."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..functions.keys import template_fields
from .query import Reader

METHODS = ("get_all_time", "get_many", "get_window", "get_window_many", "get_range")
#: Types that request fields may have.
TYPES = ("string", "int64", "repeated string")


@dataclass(frozen=True)
class NamedQuery:
    """One method.

    ``fields`` are the request's names and types.  ``key`` is a template over
    them.  ``many`` names the repeated field of methods that ask for many,
    ``duration`` the seconds of a window, ``start`` and ``end`` the Unix seconds
    of a range.
    """

    name: str
    method: str
    key: str
    fields: dict[str, str]
    many: str | None = None
    duration: str | None = None
    start: str | None = None
    end: str | None = None

    def __post_init__(self):
        def need(ok: bool, what: str):
            if not ok:
                raise ValueError(f"named query {self.name!r}: {what}")

        need(bool(self.name) and self.name[0].isupper(), "a name begins with a capital letter")
        need(self.method in METHODS, f"unknown method {self.method!r}")
        need(bool(self.key), "no key template")
        for f, kind in self.fields.items():
            need(kind in TYPES, f"field {f!r} has unknown type {kind!r}")
        for f in template_fields(self.key):
            need(f in self.fields, f"the key template names {f!r}, which is no field")
        asks_many = self.method in ("get_many", "get_window_many")
        for given, kind, needed, what in (
            (self.many, "repeated string", asks_many, "many"), (self.duration, "int64", self.method in ("get_window", "get_window_many"), "duration"),
            (self.start, "int64", self.method == "get_range", "start"), (self.end, "int64", self.method == "get_range", "end"),
        ):
            need(not needed or given is not None, f"{self.method} needs a {what} field")
            need(given is None or self.fields.get(given) == kind, f"the {what} field must be {kind}")

    def keys(self, request: dict[str, Any]) -> list[str]:
        if self.many is None:
            return [self.key.format(**request)]
        return [self.key.format(**{**request, self.many: x}) for x in request[self.many]]

    def run(self, reader: Reader, request: dict[str, Any], now: dt.datetime) -> DataFrame:
        """``ord, entity, v, present``, in the order asked."""
        asked = reader.state.sparkSession.createDataFrame(list(enumerate(self.keys(request))), "ord bigint, entity string")
        if self.method in ("get_all_time", "get_many"):
            return reader.get_many(asked)
        if self.method == "get_range":
            return reader.range_many(asked, *(dt.datetime.fromtimestamp(request[f], dt.timezone.utc) for f in (self.start, self.end)))
        return reader.window_many(asked, dt.timedelta(seconds=request[self.duration]), now)


class Registry:
    """Named queries by name."""

    def __init__(self, *queries: NamedQuery):
        self._queries: dict[str, NamedQuery] = {}
        for q in queries:
            if q.name in self._queries:
                raise ValueError(f"two named queries are called {q.name!r}")
            self._queries[q.name] = q

    def run(self, name: str, reader: Reader, request: dict[str, Any], now: dt.datetime) -> DataFrame:
        return self._queries[name].run(reader, request, now)
