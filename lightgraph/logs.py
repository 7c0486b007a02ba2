"""Logging of the library."""

from __future__ import annotations

import logging
import sys


def setup_logging(level: int = logging.INFO, path: str | None = None) -> None:
    """Messages to standard error, and to a file if given."""
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr), *([logging.FileHandler(path)] if path else [])]
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", handlers=handlers, force=True)


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(name)
