"""Settings from the environment."""

from __future__ import annotations

import base64
import binascii
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import urlsplit

# Names of the variables (after the prefix) and their defaults; None: not set.
PREFIX = "PII_"
DEFAULTS = {
    "API_LISTEN_ADDRESS": "127.0.0.1:8080", "METRICS_LISTEN_ADDRESS": "127.0.0.1:9464", "MODEL_WORKER_URL": "http://127.0.0.1:8000", "VAULT_TTL": "15m", "MODEL_MODE": "full", "VAULT_KEY": None,
    "MODEL_CLIENT_TIMEOUT": "30s", "LLM_URL": "", "LLM_MODEL": "", "LLM_API_KEY": "", "LLM_TIMEOUT": "60s", "LOG_LEVEL": "info",
}
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_SPAN = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)")


def seconds(text: str) -> float:
    """A duration such as 1h30m, 1.5s or -20ms in seconds."""
    sign, body = (-1.0, text[1:]) if text[:1] == "-" else (1.0, text.removeprefix("+"))
    if body == "0":
        return 0.0
    parts = _SPAN.findall(body)
    if not parts or "".join(a + b for a, b in parts) != body:
        raise ValueError(f"invalid duration {text!r}")
    return sign * sum(float(a) * _UNITS[b] for a, b in parts)


@dataclass(frozen=True)
class Settings:
    """What a run of the engine is told from outside; the key is never shown."""

    api_listen_address: str
    metrics_listen_address: str
    model_worker_url: str
    vault_ttl: float
    model_mode: str
    model_client_timeout: float
    llm_url: str
    llm_model: str
    llm_timeout: float
    log_level: str
    vault_key: bytes = field(repr=False)
    llm_api_key: str = field(default="", repr=False)


def _web(value: str, name: str) -> None:
    url = urlsplit(value)
    if url.scheme not in ("http", "https") or not url.hostname or url.username is not None:
        raise ValueError(f"{name}: an http or https URL with a host and no user is needed")


def load(env: Mapping[str, str] | None = None) -> Settings:
    """The settings of an environment (the process's own by default); a ValueError names the variable that is wrong, never its value."""
    env = os.environ if env is None else env
    raw = {n: env.get(PREFIX + n, d) for n, d in DEFAULTS.items()}
    spans = {}
    for n in ("VAULT_TTL", "MODEL_CLIENT_TIMEOUT", "LLM_TIMEOUT"):
        try:
            spans[n] = seconds(raw[n])
        except ValueError:
            raise ValueError(f"{PREFIX}{n}: invalid duration") from None
        if spans[n] <= 0 and (n != "LLM_TIMEOUT" or raw["LLM_URL"]):
            raise ValueError(f"{PREFIX}{n}: must be greater than zero")
    if raw["VAULT_KEY"] is None:
        raise ValueError(f"{PREFIX}VAULT_KEY: required")
    try:
        key = base64.b64decode(raw["VAULT_KEY"], validate=True)
    except (binascii.Error, ValueError):
        raise ValueError(f"{PREFIX}VAULT_KEY: invalid base64") from None
    tests = {
        "VAULT_KEY": len(key) == 32, "API_LISTEN_ADDRESS": raw["API_LISTEN_ADDRESS"] != "", "METRICS_LISTEN_ADDRESS": raw["METRICS_LISTEN_ADDRESS"] not in ("", raw["API_LISTEN_ADDRESS"]),
        "MODEL_MODE": raw["MODEL_MODE"] in ("full", "fast"), "LOG_LEVEL": raw["LOG_LEVEL"].lower() in ("info", "debug"), "LLM_MODEL": bool(raw["LLM_URL"]) == bool(raw["LLM_MODEL"]),
        "LLM_API_KEY": bool(raw["LLM_URL"]) or not raw["LLM_API_KEY"],
    }
    for name, good in tests.items():
        if not good:
            raise ValueError(f"{PREFIX}{name}: not allowed")
    _web(raw["MODEL_WORKER_URL"], f"{PREFIX}MODEL_WORKER_URL")
    if raw["LLM_URL"]:
        _web(raw["LLM_URL"], f"{PREFIX}LLM_URL")
    return Settings(
        raw["API_LISTEN_ADDRESS"], raw["METRICS_LISTEN_ADDRESS"], raw["MODEL_WORKER_URL"], spans["VAULT_TTL"], raw["MODEL_MODE"], spans["MODEL_CLIENT_TIMEOUT"], raw["LLM_URL"], raw["LLM_MODEL"], spans["LLM_TIMEOUT"],
        raw["LOG_LEVEL"].lower(), key, raw["LLM_API_KEY"],
    )
