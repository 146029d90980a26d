"""Clients of language models: retries with an injected clock and transport, and what one call used."""

from __future__ import annotations

import json
import os
import random
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlsplit

# Statuses that are worth another try, and the longest waits in seconds.
AGAIN = (429, 500, 502, 503, 504)
MOST_HINTED, MOST_WAIT = 120, 60
KEY_VARIABLE = "PAPER_GRADER_API_KEY"

#: (url, body, headers, timeout) -> (status, headers, body)
Transport = Callable[[str, bytes, dict[str, str], float], tuple[int, dict[str, str], bytes]]


class ModelError(Exception):
    """A call that did not lead to a reply."""


@dataclass(frozen=True)
class Endpoint:
    """Where and how a model is asked. Defaults hold where a configuration leaves a field out."""

    base_url: str
    model: str
    api_key: str = ""
    temperature: float = 0.2
    max_tokens: int = 4096
    timeout: float = 300.0
    max_retries: int = 3

    @classmethod
    def of(cls, fields: dict, environ: dict[str, str] | None = None) -> Endpoint:
        """From a configuration's section; the environment's key goes before the section's."""
        own = os.environ if environ is None else environ
        cast = {"temperature": float, "max_tokens": int, "timeout": float, "max_retries": int}
        given = {k: f(fields[k]) for k, f in cast.items() if k in fields}
        return cls(fields["base_url"], fields["model"], own.get(KEY_VARIABLE) or fields.get("api_key") or "", **given)

    @property
    def is_local(self) -> bool:
        try:
            return (urlsplit(self.base_url).hostname or "") in ("localhost", "127.0.0.1", "::1")
        except ValueError:
            return False

    @property
    def enabled(self) -> bool:
        return bool(self.api_key) or self.is_local


def over_http(url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes]:
    request = urllib.request.Request(url, body, headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


class Client:
    """Answers prompts; made once in each task. ``usage`` is what the last call used."""

    def __init__(self, endpoint: Endpoint, system: str, *, send: Transport = over_http, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> None:
        self.endpoint, self.system, self.send, self.sleep, self.jitter = endpoint, system, send, sleep, jitter
        self.usage = {"prompt_tokens": 0, "completion_tokens": 0, "requests": 0}

    def __call__(self, prompt: str) -> str:
        e = self.endpoint
        self.usage = dict.fromkeys(self.usage, 0)
        if not e.enabled:
            raise ModelError(f"no key for {e.base_url}: set {KEY_VARIABLE} or api_key")
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {e.api_key}"} if e.api_key else {})
        said = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        body = json.dumps({"model": e.model, "messages": said, "temperature": e.temperature, "max_tokens": e.max_tokens}).encode()
        url, trouble = e.base_url.rstrip("/") + "/chat/completions", "no try was allowed"
        for k in range(1, e.max_retries + 1):
            hint = ""
            try:
                status, told, reply = self.send(url, body, headers, e.timeout)
            except OSError as x:  # time-outs and connections
                trouble = str(x) or type(x).__name__
            else:
                if status == 200:
                    return self._read(reply)
                trouble = f"HTTP {status}: {reply[:300].decode('utf-8', 'replace')}"
                if status not in AGAIN:
                    raise ModelError(trouble)
                hint = next((v for n, v in told.items() if n.lower() == "retry-after"), "").strip()
            if k < e.max_retries:
                self.sleep(min(int(hint), MOST_HINTED) if hint.isdigit() else min(2**k, MOST_WAIT) + self.jitter())
        raise ModelError(f"no reply after {e.max_retries} tries: {trouble}")

    def _read(self, reply: bytes) -> str:
        try:
            data = json.loads(reply)
            used = data.get("usage") or {}
            self.usage = {"prompt_tokens": int(used.get("prompt_tokens", 0)), "completion_tokens": int(used.get("completion_tokens", 0)), "requests": 1}
            return data["choices"][0]["message"]["content"]
        except (ValueError, KeyError, IndexError, TypeError, AttributeError) as x:
            raise ModelError(f"reply not understood: {type(x).__name__}") from None


class Pace:
    """At most one start every ``gap`` seconds, for all that share it; clock and sleep can be injected."""

    def __init__(self, gap: float, *, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep = gap, clock, sleep
        self.lock, self.next = threading.Lock(), 0.0

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


@dataclass(frozen=True)
class Answer:
    """What came of a prompt: a reply or an error of at most 300 characters, and what the call used."""

    reply: str | None = None
    error: str | None = None
    usage: dict | None = None


def answers(prompts: Iterable[str | None], client: Callable[[], Callable[[str], str]], *, open_calls: int = 1, pace: Pace | None = None) -> Iterator[Answer]:
    """The answers in the prompts' order, with at most ``open_calls`` calls open and as many answers waiting for an earlier
    one. Each of the open calls has a client of its own, so a client need not be safe for threads. A null prompt is not
    asked; a call that fails is its answer's error."""
    local = threading.local()

    def one(prompt: str | None) -> Answer:
        if prompt is None:
            return Answer()
        if not hasattr(local, "client"):
            local.client = client()
        if pace:
            pace.wait()
        try:
            reply, error = local.client(prompt), None
        except Exception as e:  # one call's failure is its answer
            reply, error = None, (str(e) or type(e).__name__)[:300]
        return Answer(reply, error, getattr(local.client, "usage", None))

    if open_calls <= 1:
        yield from map(one, prompts)
        return
    with ThreadPoolExecutor(open_calls) as pool:
        waiting: deque[Future] = deque()
        for p in prompts:
            if len(waiting) >= open_calls:
                yield waiting.popleft().result()
            waiting.append(pool.submit(one, p))
        while waiting:
            yield waiting.popleft().result()
