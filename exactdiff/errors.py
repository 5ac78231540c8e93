"""Failures that end a job, and refusals that leave a session as it is."""

from __future__ import annotations


class HardFail(Exception):
    """The job can't go on: bad options, unreadable sources, broken keys. The command line exits with 2."""


class ActionError(Exception):
    """A session refuses an action; nothing has changed."""


def key_text(key: tuple[str, ...]) -> str:
    """A key as it stands in messages."""
    return repr(tuple(key))
