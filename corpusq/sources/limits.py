"""A time limit for each call of a function that may hang: it runs in a child process, which is killed when its time is up."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable
from multiprocessing.connection import Connection
from typing import Any


class OutOfTime(TimeoutError):
    """A call that took longer than it may."""


class CallFailed(RuntimeError):
    """What a call raised, as text."""


class ChildDied(RuntimeError):
    """A call that ended its process."""


class Limited:
    """``function`` with a limit in seconds for each call.

    One child, a fork of the process, serves call after call; after one that
    hangs or ends it the next call gets a new one.  What a call raises is raised
    here as ``CallFailed``.
    """

    def __init__(self, function: Callable[..., Any]):
        self.function = function
        self.child: multiprocessing.Process | None = None
        self.pipe: Connection | None = None

    def _start(self) -> None:
        fork = multiprocessing.get_context("fork")
        self.pipe, theirs = fork.Pipe()
        self.child = fork.Process(target=_serve, args=(self.function, theirs, self.pipe), daemon=True)
        self.child.start()
        theirs.close()

    def __call__(self, seconds: float, *args: Any) -> Any:
        if self.child is None:
            self._start()
        try:
            self.pipe.send(args)
            if not self.pipe.poll(seconds):
                self.close()
                raise OutOfTime(f"over {seconds:g} s")
            done, got = self.pipe.recv()
        except (EOFError, BrokenPipeError, ConnectionResetError):
            self.close()
            raise ChildDied("the process of the call ended") from None
        if not done:
            raise CallFailed(got)
        return got

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = self.pipe = None


def _serve(function: Callable[..., Any], pipe: Connection, parents: Connection) -> None:
    parents.close()  # so that the end of the parent is seen
    while True:
        try:
            args = pipe.recv()
        except EOFError:
            return
        try:
            answer = True, function(*args)
        except Exception as e:  # whatever the function raises is told to the caller
            answer = False, f"{type(e).__name__}: {e}"
        try:
            pipe.send(answer)
        except BrokenPipeError:
            return
        except Exception as e:  # a result that cannot be sent
            pipe.send((False, f"{type(e).__name__}: {e}"))
