"""Fetching over HTTP: conditional requests, retries with back-off, pacing by host, and the guard on destinations.

A plain function for drivers and mapInPandas; opener is whatever takes a Request, so tests need no network.
"""

from __future__ import annotations

import random
import socket
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from ipaddress import ip_address
from urllib.parse import urlsplit

from loamline.functions.text import retry_after

ATTEMPTS, BASE, MOST = 3, 0.5, 30.0


@dataclass(frozen=True)
class Fetched:
    """outcome is Fetched, Unchanged, Gone, Blocked, RateLimited or FetchError."""

    outcome: str
    body: bytes | None = None
    etag: str | None = None
    modified: str | None = None
    reason: str | None = None


class Pacer:
    """A token bucket for each host."""

    def __init__(self, per_second: float = 1.0, burst: int = 2, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.state: dict[str, tuple[float, float]] = {}
        self.lock = threading.Lock()

    def wait(self, host: str) -> float:
        with self.lock:
            tokens, at = self.state.get(host, (float(self.burst), self.clock()))
            now = self.clock()
            tokens = min(self.burst, tokens + (now - at) * self.rate) - 1
            self.state[host] = (tokens, now)
        pause = max(0.0, -tokens / self.rate)
        if pause:
            self.sleep(pause)
        return pause


def routable_host(host: str, resolve=socket.getaddrinfo) -> bool:
    """Whether every address of a host is globally routable."""
    try:
        found = {x[4][0] for x in resolve(host, None)}
        return bool(found) and all(ip_address(a).is_global for a in found)
    except (OSError, ValueError):
        return False


def fetch(url: str, etag: str | None = None, modified: str | None = None, opener=urllib.request.urlopen, pacer: Pacer | None = None, guard: Callable[[str], bool] | None = None, sleep=time.sleep, attempts: int = ATTEMPTS) -> Fetched:
    """One URL. 304 is Unchanged, 404 and 410 Gone, 401 and 403 Blocked; 429 and server errors are tried again, by Retry-After or with jittered doubling."""
    host = urlsplit(url).hostname or ""
    if guard and not guard(host):
        return Fetched("Blocked", reason="the destination isn't globally routable")
    headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
    last = Fetched("FetchError", reason="no attempt")
    for k in range(attempts):
        if pacer:
            pacer.wait(host)
        wait = None
        try:
            with opener(urllib.request.Request(url, headers=headers)) as answer:
                return Fetched("Fetched", answer.read(), answer.headers.get("ETag"), answer.headers.get("Last-Modified"))
        except urllib.error.HTTPError as e:
            if e.code == 304:
                return Fetched("Unchanged", etag=etag, modified=modified)
            if e.code in (404, 410):
                return Fetched("Gone", reason=str(e.code))
            if e.code in (401, 403):
                return Fetched("Blocked", reason=str(e.code))
            last = Fetched("RateLimited" if e.code == 429 else "FetchError", reason=str(e.code))
            if e.code != 429 and e.code < 500:
                return last
            wait = retry_after(e.headers.get("Retry-After") or "", datetime.now(timezone.utc)) if e.headers else None
        except (OSError, ValueError) as e:
            last = Fetched("FetchError", reason=str(e)[:200])
        if k + 1 < attempts:
            sleep(min(MOST, wait if wait is not None else BASE * 2**k * random.uniform(0.5, 1.5)))
    return last
