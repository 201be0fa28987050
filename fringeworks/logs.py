from __future__ import annotations

import logging

NAME = "fringeworks"


def setup_logging(level: str = "INFO") -> logging.Logger:
    """The package's logger at ``level`` (any case; an unknown one means INFO), with
    one handler however often this is called."""
    log = logging.getLogger(NAME)
    found = logging.getLevelName(level.upper())
    log.setLevel(found if isinstance(found, int) else logging.INFO)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    return log
