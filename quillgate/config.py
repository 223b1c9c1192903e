"""Settings from the environment. A blank value counts as unset; a value of the wrong kind or range is an error."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    threshold: float = 0.9
    questions_per_section: int = 3
    most_calls: int = 300
    most_tokens: int = 30_000
    model: str | None = None
    key: str | None = None

    def __repr__(self) -> str:  # a key never shows
        return f"Config(threshold={self.threshold}, questions_per_section={self.questions_per_section}, most_calls={self.most_calls}, most_tokens={self.most_tokens}, model={self.model!r})"


def _number(env: Mapping[str, str], name: str, default, least, most, kind=int):
    raw = env.get(name, "").strip()
    if not raw:
        return default
    try:
        value = kind(raw)
    except ValueError:
        raise ConfigError(f"{name}={raw!r} is no number") from None
    if not least <= value <= most:
        raise ConfigError(f"{name}={raw} is not between {least} and {most}")
    return value


def read_env_file(path: str) -> dict[str, str]:
    """NAME=value lines of a .env file; blank lines and those with # in front count for nothing, quotes around a value are dropped."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and not name.startswith("#"):
                value = value.strip()
                out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def load(env: Mapping[str, str] | None = None, env_file: str | None = None) -> Config:
    """Settings of the environment, or, where it has none of a name, of a .env file."""
    env = os.environ if env is None else env
    if env_file and os.path.exists(env_file):
        env = read_env_file(env_file) | {k: v for k, v in env.items() if v.strip()}
    plain = Config()
    text = lambda name: env.get(name, "").strip() or None
    return Config(
        _number(env, "GATE_THRESHOLD", plain.threshold, 0.5, 1, float), _number(env, "QA_PER_SECTION", plain.questions_per_section, 1, 1000), _number(env, "MAX_LLM_CALLS", plain.most_calls, 1, 10**9),
        model=text("MODEL"), key=text("ANTHROPIC_API_KEY"),
    )
