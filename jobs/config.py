"""Settings of a job: a flat JSON file over the job's own defaults."""

from __future__ import annotations

import json
import logging
from pathlib import Path


def load(path: str | None, defaults: dict) -> dict:
    """defaults, replaced by the file's values; unknown names are an error."""
    given = json.loads(Path(path).read_text()) if path else {}
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def logger(name: str) -> logging.Logger:
    if not logging.getLogger().handlers:
        logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    return log
