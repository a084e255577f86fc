"""Settings: defaults, then a dict, then the environment, then keyword arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from tidemark.errors import InvalidArgument

ENGINES = ("parquet", "jdbc")


@dataclass(frozen=True)
class CacheConfig:
    enabled: bool = True
    max_duration_secs: int = 3600


@dataclass(frozen=True)
class Settings:
    engine: str = "parquet"
    connection: str = "tidemark-data"
    options: dict = field(default_factory=dict)
    username: str | None = None
    password: str | None = None
    ttl_secs: int | None = None
    cache: CacheConfig = field(default_factory=CacheConfig)

    @property
    def credentials(self) -> dict:
        """Both parts or none."""
        if self.username is not None and self.password is not None:
            return {"user": self.username, "password": self.password}
        return {}


def key_value(option: str) -> tuple[str, str]:
    """Splits at the first =, so that a value may hold more of them."""
    key, sep, value = option.partition("=")
    if not sep or not key:
        raise InvalidArgument(f"not key=value: {option!r}")
    return key, value


#: Environment variable -> (field, conversion).
ENVIRONMENT = {
    "TIDEMARK_ENGINE": ("engine", str),
    "TIDEMARK_CONNECTION": ("connection", str),
    "TIDEMARK_USERNAME": ("username", str),
    "TIDEMARK_PASSWORD": ("password", str),
    "TIDEMARK_TTL_SECS": ("ttl_secs", int),
    "TIDEMARK_CACHE_ENABLED": ("cache.enabled", lambda x: x.strip().lower() in ("1", "true", "yes")),
    "TIDEMARK_CACHE_MAX_DURATION_SECS": ("cache.max_duration_secs", int),
}


def load(values: dict | None = None, environ: dict | None = None, **kwargs) -> Settings:
    """values and kwargs take the field names; cache settings are written cache.enabled or cache_enabled."""
    found: dict = dict(values or {})
    for name, (key, convert) in ENVIRONMENT.items():
        if (text := (os.environ if environ is None else environ).get(name)) is not None:
            found[key] = convert(text)
    found |= {k.replace("cache_", "cache.", 1): v for k, v in kwargs.items()}
    if isinstance(found.get("options"), (list, tuple)):
        found["options"] = dict(map(key_value, found["options"]))
    cache = CacheConfig(**{k.split(".", 1)[1]: found.pop(k) for k in [k for k in found if k.startswith("cache.")]})
    try:
        out = replace(Settings(), **found, cache=cache)
    except TypeError as e:
        raise InvalidArgument(str(e)) from None
    if out.engine not in ENGINES:
        raise InvalidArgument(f"engine {out.engine!r} is none of {', '.join(ENGINES)}")
    return out
