"""Flat string properties with typed access, durations in milliseconds, and sub-maps by dotted prefix."""

from __future__ import annotations

from datetime import timedelta

SCOPES = ("source", "window", "reduce", "filter", "sink", "custom")


class Properties:
    def __init__(self, values: dict[str, str] | None = None):
        self.values = dict(values or {})

    def set(self, key: str, value: object) -> Properties:
        if isinstance(value, timedelta):
            value = round(value.total_seconds() * 1000)
        self.values[key] = ("true" if value else "false") if isinstance(value, bool) else str(value)
        return self

    def get(self, key: str) -> str:
        if key not in self.values:
            raise KeyError(f"property {key!r} is not set")
        return self.values[key]

    def get_int(self, key: str) -> int:
        return int(self.get(key))

    def get_float(self, key: str) -> float:
        return float(self.get(key))

    def get_bool(self, key: str) -> bool:
        value = self.get(key).lower()
        if value not in ("true", "false"):
            raise ValueError(f"property {key!r} is no truth value: {value!r}")
        return value == "true"

    def get_duration(self, key: str) -> timedelta:
        return timedelta(milliseconds=self.get_int(key))

    def sub(self, prefix: str) -> Properties:
        """What stands below ``prefix``, without it: of a.b.c the prefix a.b leaves c."""
        at = prefix.rstrip(".") + "."
        return Properties({k[len(at) :]: v for k, v in self.values.items() if k.startswith(at)})

    def extend(self, prefix: str, other: Properties) -> Properties:
        self.values |= {f"{prefix.rstrip('.')}.{k}": v for k, v in other.values.items()}
        return self

    def scope(self, kind: str, name: str) -> Properties:
        """The properties of one function: kind is one of source, window, reduce, filter, sink and custom."""
        return self.sub(_scoped(kind, name))

    def extend_scope(self, kind: str, name: str, other: Properties) -> Properties:
        return self.extend(_scoped(kind, name), other)

    # application

    @property
    def application_name(self) -> str:
        return self.get("application.name")

    @application_name.setter
    def application_name(self, name: str) -> None:
        if self.values.get("application.name", name) != name:
            raise ValueError("the application name may be set once")
        self.values["application.name"] = name

    def spark_conf(self) -> dict[str, str]:
        """What of these a session takes: everything below ``spark``, and the checkpoint folder."""
        conf = {f"spark.{k}": v for k, v in self.sub("spark").values.items()}
        if "checkpoint.location" in self.values:
            conf["spark.sql.streaming.checkpointLocation"] = self.get("checkpoint.location")
        return conf


def _scoped(kind: str, name: str) -> str:
    if kind not in SCOPES:
        raise ValueError(f"no such scope: {kind}")
    return f"function.{kind}.{name}"
