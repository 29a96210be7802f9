"""What runs beside the user: embedding the backlog, and syncing now and then. Loops over an Engine, to be run in a thread."""

from __future__ import annotations

import threading
from collections.abc import Callable

BATCH, PAUSE_S, IDLE_S, AFTER_ERROR_S = 50, 0.5, 60.0, 30.0
EVERY_S = 300.0


def embed_backlog(engine, stop: threading.Event, *, wait: Callable[[float], object] | None = None) -> int:
    """Embeds batches of the backlog until stop is set: a short pause between batches, a longer one when there is nothing to do or the embedder failed. How many chunks."""
    wait, done = wait or stop.wait, 0
    while not stop.is_set():
        try:
            got = engine.embed_pending(BATCH, stop_on_error=True)
        except Exception:  # noqa: BLE001  the loop outlives whatever an embedder or a store raises
            got = {"embedded": 0, "failed": 1}
        done += got["embedded"]
        wait(AFTER_ERROR_S if got["failed"] else PAUSE_S if got["embedded"] else IDLE_S)
    return done


def auto_sync(engine, account: str, feed_path: str, stop: threading.Event, *, wait: Callable[[float], object] | None = None) -> int:
    """Syncs an account every EVERY_S seconds until stop is set, but not while it is busy or cools down. How many syncs ended well."""
    wait, done = wait or stop.wait, 0
    while not stop.is_set():
        if engine.can_sync(account):
            try:
                engine.sync(account, feed_path)
                done += 1
            except Exception:  # noqa: BLE001  the sync has stored its error and its cooldown
                pass
        wait(EVERY_S)
    return done


def start(loop: Callable, *args) -> tuple[threading.Thread, threading.Event]:
    """Runs a loop in a thread of its own; set the event to end it."""
    stop = threading.Event()
    thread = threading.Thread(target=loop, args=(*args, stop), daemon=True)
    thread.start()
    return thread, stop
