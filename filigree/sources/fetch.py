"""A polite HTTP source: rate-limited, retried, cached byte for byte.

Runs on the driver, one request at a time: the limit holds per address, so
fetching from many executors would only break it. Transport, clock and sleep
are injected.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import threading
import time
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple

# Fixed values.
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})
RATE_PER_SECOND, MAX_RATE = 8.0, 10.0


class Response(NamedTuple):
    body: bytes
    status: int
    headers: dict[str, str]


class FetchError(RuntimeError):
    pass


def valid_user_agent(ua: str) -> bool:
    """A name and an e-mail address with a dotted domain, neither a placeholder."""
    m = re.fullmatch(r"\s*(\S.*?)\s+<?([^\s@<>]+@[^\s@<>]+\.[^\s@<>.]+)>?\s*", ua or "")
    return bool(m) and not re.search(r"example\.(com|org)|your[ ._-]?(name|e?mail)", ua, re.IGNORECASE)


class RateLimiter:
    """Requests at least ``1 / rate`` seconds apart, over all threads."""

    def __init__(self, rate: float = RATE_PER_SECOND, clock=time.monotonic, sleep=time.sleep) -> None:
        if not 0 < rate <= MAX_RATE:
            raise ValueError(f"the rate is above 0 and at most {MAX_RATE}")
        self._gap, self._clock, self._sleep = 1.0 / rate, clock, sleep
        self._lock, self._free = threading.Lock(), float("-inf")

    def acquire(self) -> None:
        with self._lock:
            now = self._clock()
            at = max(now, self._free)
            self._free = at + self._gap
        if at > now:
            self._sleep(at - now)


def write_atomically(path: Path, data: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(name, path)
    finally:
        Path(name).unlink(missing_ok=True)


class ByteCache:
    """Responses under ``<first two hex>/<key>``, key = SHA-256 of method and URL."""

    def __init__(self, root: Path | str) -> None:
        self.root = Path(root)

    def _paths(self, url: str, method: str) -> tuple[Path, Path]:
        key = hashlib.sha256(f"{method} {url}".encode()).hexdigest()
        return self.root / key[:2] / f"{key}.body", self.root / key[:2] / f"{key}.json"

    def get(self, url: str, method: str = "GET") -> Response | None:
        body, meta = self._paths(url, method)
        if not (body.exists() and meta.exists()):
            return None
        m = json.loads(meta.read_text("utf-8"))
        return Response(body.read_bytes(), m["status"], m["headers"])

    def set(self, url: str, response: Response, method: str = "GET") -> None:
        body, meta = self._paths(url, method)
        write_atomically(body, response.body)
        described = {"url": url, "method": method, "status": response.status, "headers": response.headers}
        write_atomically(meta, json.dumps(described, ensure_ascii=False).encode())


class Client:
    """``get`` asks the cache first, then the transport until it answers or the retries run out."""

    def __init__(
        self,
        transport: Callable[[str, dict[str, str]], Response],
        user_agent: str,
        cache: ByteCache | None = None,
        limiter: RateLimiter | None = None,
        retries: int = 3,
        base_delay: float = 0.5,
        sleep: Callable[[float], None] = time.sleep,
    ) -> None:
        if not valid_user_agent(user_agent):
            raise ValueError("a user agent needs a name and an e-mail address")
        self._send, self._headers = transport, {"User-Agent": user_agent}
        self._cache, self._limiter = cache, limiter or RateLimiter()
        self._retries, self._base, self._sleep = retries, base_delay, sleep

    def _delay(self, attempt: int, response: Response | None) -> float:
        asked = (response.headers if response else {}).get("Retry-After", "")
        stated = float(asked) if re.fullmatch(r"\d+(\.\d+)?", asked) else 0.0
        return stated or self._base * 2**attempt

    def get(self, url: str, use_cache: bool = True) -> Response:
        if use_cache and self._cache and (kept := self._cache.get(url)):
            return kept
        for attempt in range(self._retries + 1):
            self._limiter.acquire()
            try:
                got = self._send(url, self._headers)
            except OSError as e:
                got, why = None, str(e)
            else:
                if got.status < 400:
                    if self._cache:
                        self._cache.set(url, got)
                    return got
                why = f"status {got.status}"
                if got.status not in RETRY_STATUS:
                    break
            if attempt < self._retries:
                self._sleep(self._delay(attempt, got))
        raise FetchError(f"{url}: {why}")

    def get_json(self, url: str, use_cache: bool = True):
        return json.loads(self.get(url, use_cache).body.decode("utf-8"))


def urllib_transport(timeout: float = 30.0) -> Callable[[str, dict[str, str]], Response]:
    """A transport over the standard library; statuses are answers, not exceptions."""
    import urllib.error
    import urllib.request

    def send(url: str, headers: dict[str, str]) -> Response:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as got:
                return Response(got.read(), got.status, dict(got.headers))
        except urllib.error.HTTPError as e:
            return Response(e.read(), e.code, dict(e.headers))

    return send
