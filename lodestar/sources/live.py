"""Live reading: a Python data source with one partition and one rate limit per host, a guard against private addresses and
retries. Rows carry errors instead of raising, so one source does not stop the others."""

from __future__ import annotations

import http.client
import ipaddress
import random
import re
import socket
import ssl
import threading
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = (429, 500, 502, 503, 504)
#: Texts of more bytes are refused; files of any size are known by their headers.
MOST_BYTES = 200_000_000


def is_public_url(url: str, resolve=socket.getaddrinfo) -> bool:
    """http or https, not a local name, and every address of the host is public."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".").lower()
        if parts.scheme not in ("http", "https") or not host or host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
            return False
        try:
            found = [ipaddress.ip_address(host)]
        except ValueError:
            found = [ipaddress.ip_address(a[4][0].split("%")[0]) for a in resolve(host, parts.port or 443)]
        return bool(found) and all(map(_is_public, map(str, found)))
    except (ValueError, OSError):
        return False


def _is_public(address: str) -> bool:
    a = ipaddress.ip_address(address.split("%")[0])
    return a.is_global and not a.is_multicast


class Bucket:
    """So many requests a second, so many at once."""

    def __init__(self, rate: float = 5.0, burst: int = 10, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.left, self.at, self.lock = float(burst), clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            self._take()

    def _take(self) -> None:
        now = self.clock()
        self.left, self.at = min(self.burst, self.left + (now - self.at) * self.rate), now
        if self.left < 1:
            wait = (1 - self.left) / self.rate
            self.sleep(wait)
            self.left, self.at = 1.0, self.clock()
        self.left -= 1


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *a, **k):
        return None


def _connected(self) -> None:
    """Connect to the first address of the host, if it is public: what is checked is what is used."""
    found = [a[4] for a in socket.getaddrinfo(self.host, self.port, type=socket.SOCK_STREAM)]
    if not found or not all(_is_public(a[0]) for a in found):
        raise OSError(f"address not allowed: {self.host}")
    self.sock = socket.create_connection(found[0][:2], self.timeout)


class _Plain(http.client.HTTPConnection):
    connect = _connected


class _Secure(http.client.HTTPSConnection):
    def connect(self) -> None:
        _connected(self)
        self.sock = self._context.wrap_socket(self.sock, server_hostname=self.host)


class _PlainHandler(urllib.request.HTTPHandler):
    def http_open(self, request):
        return self.do_open(_Plain, request)


class _SecureHandler(urllib.request.HTTPSHandler):
    def https_open(self, request):
        return self.do_open(_Secure, request, context=ssl.create_default_context())


def is_text(content_type: str | None) -> bool:
    """Is an answer of this type read? Without a type it is taken for a page."""
    kind = (content_type or "text/html").split(";")[0].strip().lower()
    return kind.startswith("text/") or kind.endswith(("json", "xml", "javascript"))


def open_url(url: str, timeout: float, body: bytes | None = None, headers: dict | None = None) -> tuple[int, dict, bytes]:
    """Status, headers and, of answers of text, content: files are not read."""
    request = urllib.request.Request(url, data=body, headers={"User-Agent": "lodestar", **(headers or {})})
    try:
        with urllib.request.build_opener(_Stay, _PlainHandler, _SecureHandler).open(request, timeout=timeout) as r:
            return r.status, dict(r.headers), _read(r) if is_text(r.headers.get("Content-Type")) else b""
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), _read(e)


def _read(response) -> bytes:
    data = response.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError("the answer is too long")
    return data


@dataclass(frozen=True)
class Answer:
    status: int
    url: str
    content_type: str | None
    content: bytes

    def text(self) -> str:
        found = re.search(r"charset=[\"']?([\w-]+)", self.content_type or "", re.I)
        try:
            return self.content.decode(found[1] if found else "utf-8", "replace")
        except LookupError:
            return self.content.decode("utf-8", "replace")


def ask(url: str, timeout: float = 12.0, retries: int = 3, safe: bool = True, opener=open_url, bucket: Bucket | None = None, sleep=time.sleep, guard=is_public_url, body: bytes | None = None, headers: dict | None = None, until: float | None = None) -> Answer:
    """What an address answers. Overload, server errors and broken connections are tried again, after Retry-After or a
    growing pause; up to five redirects are followed, each checked anew. body: sent by POST. until: seconds since 1970
    after which nothing is sent any more, and to which waiting is cut."""
    sent = {k: v for k, v in (("body", body), ("headers", headers)) if v}

    def left() -> float:
        rest = float("inf") if until is None else until - time.time()
        if rest <= 0:
            raise TimeoutError("no time is left")
        return rest

    for _ in range(6):
        if safe and not guard(url):
            raise ValueError(f"address not allowed: {url}")
        for attempt in range(retries + 1):
            if bucket is not None:
                bucket.take()
            try:
                status, answered, content = opener(url, min(timeout, left()), **sent)
            except TimeoutError:
                left()
                if attempt == retries:
                    raise
                status, answered, content = 0, {}, b""
            except OSError:
                if attempt == retries:
                    raise
                status, answered, content = 0, {}, b""
            if status and status not in RETRIED or attempt == retries:
                break
            after = {k.lower(): v for k, v in answered.items()}.get("retry-after", "")
            sleep(min(left(), float(after) if after.isdigit() else 0.5 * 2**attempt + random.uniform(0, 0.1)))
        answered = {k.lower(): v for k, v in answered.items()}
        if status in (301, 302, 303, 307, 308) and answered.get("location"):
            url, sent = urljoin(url, answered["location"]), {}
            continue
        return Answer(status, url, answered.get("content-type"), content)
    raise ValueError("too many redirects")


def fetch(url: str, *args, **options) -> tuple[int, bytes]:
    """Status and content."""
    found = ask(url, *args, **options)
    return found.status, found.content


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.timeout, self.safe = float(options.get("timeout", 12)), options.get("safe", "true") != "false"

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).netloc.lower(), []).append(u)
        return [_Host(us) for us in hosts.values()] or [_Host([])]

    def read(self, partition):
        bucket = Bucket()
        for url in partition.urls:
            try:
                status, body = fetch(url, self.timeout, safe=self.safe, bucket=bucket)
                yield url, status, body.decode("utf-8", "replace"), None
            except Exception as e:  # noqa: BLE001
                yield url, None, None, str(e)[:300]


class WebSource(DataSource):
    """spark.read.format("lodestar_web").option("urls", one per line): url, status, payload, error."""

    @classmethod
    def name(cls):
        return "lodestar_web"

    def schema(self):
        return "url string, status int, payload string, error string"

    def reader(self, schema):
        return _Reader(self.options)
