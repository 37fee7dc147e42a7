"""Things a Python worker makes once and holds for all its later tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

_HOME = "_claimloom_worker"


def held(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gave when this worker process first asked for ``kind`` and ``key``.

    The operators travel by value, so their own globals are new in every task; a
    module of the worker process is not.
    """
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME)).__dict__
    if (kind, key) not in home:
        home[kind, key] = make()
    return home[kind, key]
