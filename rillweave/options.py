"""What can be set for a crawl, with defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


@dataclass(frozen=True)
class Options:
    # The defaults that users of such crawls rely on.
    max_tokens: int = 5
    refill_rate: float = 0.5
    min_delay: float = 2.0
    max_delay: float = 5.0
    strict_min_delay: float = 10.0
    strict_max_delay: float = 30.0
    halt_on_403: float = 60.0
    halt_on_429: float = 60.0
    halt_on_captcha: float = 120.0
    halt_otherwise: float = 60.0
    queue_size: int = 10_000
    workers: int = 3
    respect_robots: bool = True
    export_folder: str = "exports"

    def __post_init__(self):
        if self.max_tokens < 1 or self.refill_rate <= 0 or self.workers < 1 or self.queue_size < 0:
            raise ValueError("max_tokens and workers must be 1 or more, refill_rate positive, queue_size not negative")
        if not (0 <= self.min_delay <= self.max_delay and 0 <= self.strict_min_delay <= self.strict_max_delay):
            raise ValueError("delays must be bounds in order")



def from_environment(environment: Mapping[str, str], prefix: str = "RILLWEAVE_") -> Options:
    """Options with what the environment sets: the prefix and a field's name in capitals. What is no value of the field's type is an error."""
    set_to = {}
    for f in fields(Options):
        text = environment.get(f"{prefix}{f.name.upper()}")
        if text is None:
            continue
        kind = type(f.default)
        if kind is bool and text.strip().lower() not in _TRUE | _FALSE:
            raise ValueError(f"{prefix}{f.name.upper()} must be true or false: {text}")
        try:
            set_to[f.name] = text.strip().lower() in _TRUE if kind is bool else kind(text)
        except ValueError as e:
            raise ValueError(f"{prefix}{f.name.upper()}: {e}") from None
    return Options(**set_to)


OPTIONS = from_environment(os.environ)
