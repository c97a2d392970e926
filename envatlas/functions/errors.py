"""Failures that are told and then passed over, as where one bad file must not end a job."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
LOG = logging.getLogger("envatlas")


def ok_logged(call: Callable[[], T], what: str, level: int = logging.ERROR) -> T | None:
    """What the call gives, or null after its failure has been logged."""
    try:
        return call()
    except Exception:  # noqa: BLE001  the point is to go on
        LOG.log(level, "%s failed", what, exc_info=True)
        return None


def ok_warn(call: Callable[[], T], what: str) -> T | None:
    """ok_logged() for failures that are to be expected."""
    return ok_logged(call, what, logging.WARNING)
