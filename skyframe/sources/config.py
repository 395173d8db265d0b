"""Configuration files: key = value lines, # comments, quotes stripped; a later value replaces an earlier one."""

from __future__ import annotations

import re
from collections.abc import Iterable


def parse(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        key, eq, value = line.partition("=")
        if eq and key.strip():
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            out[key.strip()] = value
    return out


def read(path: str, *overrides: str) -> dict[str, str]:
    with open(path) as f:
        out = parse(f.read())
    for line in overrides:
        out |= parse(line)
    return out


def write(path: str, config: dict[str, str]) -> None:
    with open(path, "w") as f:
        f.writelines(f"{k} = {v}\n" for k, v in config.items())


def sub(config: dict[str, str], prefix: str) -> dict[str, str]:
    """The entries whose keys begin with prefix, without it."""
    return {k[len(prefix) :]: v for k, v in config.items() if k.startswith(prefix)}


def array(config: dict[str, str], key: str, kind: type = float) -> list:
    return [kind(x) for x in re.split(r"[\s,]+", config[key]) if x]


def choice(config: dict[str, str], key: str, options: Iterable[str], default: str | None = None) -> str:
    value = config.get(key, default)
    if value not in set(options):
        raise KeyError(f"{key} = {value!r} is not one of {', '.join(options)}")
    return value


def require(config: dict[str, str], *keys: str) -> None:
    missing = [k for k in keys if k not in config]
    if missing:
        raise KeyError(f"missing: {', '.join(missing)}")
