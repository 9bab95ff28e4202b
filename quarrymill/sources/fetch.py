"""One page over HTTP behind the guards, connected to the very address that they saw. Tables of pages: ``pages``."""

from __future__ import annotations

import http.client
import ipaddress
import socket
import ssl
import time
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

from quarrymill.functions.errors import SourceError
from quarrymill.functions.guards import ALLOWED_TYPES, BLOCKED_HOSTS

MAX_BYTES, TIMEOUT_S = 5 * 1024 * 1024, 15.0


@dataclass
class Page:
    text: str
    content_type: str
    bytes: int
    format: str


def check_host(host: str, resolve=socket.getaddrinfo) -> list[str]:
    """The host's addresses, resolved once; raises if the host is blocked or any of them isn't public."""
    h = host.lower().strip().rstrip(".")
    if not h or h in BLOCKED_HOSTS or h.endswith((".localhost", ".local", ".internal")):
        raise SourceError("BLOCKED_HOST", host=host)
    try:
        found = list(dict.fromkeys(address[0] for *_, address in resolve(h, None)))
    except OSError as e:
        raise SourceError("DNS_FAILED", str(e), host=host) from e
    if not found:
        raise SourceError("DNS_FAILED", host=host)
    for address in found:
        if not ipaddress.ip_address(address).is_global:
            raise SourceError("PRIVATE_ADDRESS", host=host)
    return found


class Connection(http.client.HTTPConnection):
    """A connection to an address that was checked; the host's name is for the request and its certificate only."""

    def __init__(self, host: str, port: int, address: str, secure: bool, timeout: float, dial):
        super().__init__(host, port, timeout=timeout)
        self.address, self.secure, self.dial = address, secure, dial
        self.default_port = 443 if secure else 80

    def connect(self) -> None:
        self.sock = self.dial((self.address, self.port), self.timeout)
        if self.secure:
            self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=self.host)


# Parts of the content types that the service takes.
SERVICE_TYPES = ("text/", "json", "csv", "javascript", "xml")


def allowed(kind: str, profile: str = "library") -> bool:
    """Whether a content type is read: of a list or text for the library, anything that sounds like data for the service."""
    return any(x in kind for x in SERVICE_TYPES) if profile == "service" else kind in ALLOWED_TYPES or kind.startswith("text/")


def fetch(url: str, most: int = MAX_BYTES, timeout: float = TIMEOUT_S, resolve=socket.getaddrinfo, profile: str = "library", dial=socket.create_connection) -> Page:
    """The page at ``url``, or an error with a code.

    The host is resolved once and the connection goes to the first of the addresses that were checked, so a name that
    points elsewhere a moment later changes nothing. Redirects aren't followed, ``most`` bytes are read, and
    ``timeout`` is for the whole page, however slowly it comes.
    """
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError as e:
        raise SourceError("INVALID_URL", str(e)) from e
    if parts.scheme not in ("http", "https"):
        raise SourceError("UNSUPPORTED_PROTOCOL")
    if parts.username or parts.password:
        raise SourceError("URL_CREDENTIALS_NOT_ALLOWED")
    address = check_host(parts.hostname or "", resolve)[0]
    most, timeout = min(max(most, 1024), MAX_BYTES), max(timeout, 1.0)
    end, secure = time.monotonic() + timeout, parts.scheme == "https"
    target = quote(parts.path or "/", safe="%/:=&~+!$,;'@()*") + ("?" + quote(parts.query, safe="%/:=&~+!$,;'@()*?") if parts.query else "")
    connection = Connection(parts.hostname, port or (443 if secure else 80), address, secure, timeout, dial)
    try:
        connection.request("GET", target, headers={"Accept": "*/*", "User-Agent": "quarrymill"})
        answer = connection.getresponse()
        if 300 <= answer.status < 400:
            raise SourceError("REDIRECT_NOT_ALLOWED", status=answer.status)
        if not 200 <= answer.status < 300:
            raise SourceError("HTTP_ERROR", status=answer.status)
        kind = answer.headers.get_content_type() if answer.headers.get("Content-Type") else ""
        if not allowed(kind, profile):
            raise SourceError("UNSUPPORTED_CONTENT_TYPE", content_type=kind)
        length = answer.headers.get("Content-Length", "")
        if length.isdigit() and int(length) > most:
            raise SourceError("RESPONSE_TOO_LARGE", bytes=int(length))
        body = bytearray()
        while piece := answer.read1(1 << 16):
            body += piece
            if len(body) > most:
                raise SourceError("RESPONSE_TOO_LARGE")
            if time.monotonic() > end:
                raise SourceError("TIMEOUT")
        charset = answer.headers.get_content_charset() or "utf-8"
    except TimeoutError as e:
        raise SourceError("TIMEOUT", str(e)) from e
    except (OSError, http.client.HTTPException) as e:
        raise SourceError("FETCH_FAILED", str(e)) from e
    finally:
        connection.close()
    try:
        text = body.decode(charset, "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    start, path = text.lstrip()[:1], parts.path.lower()
    order = (("json", "json" in kind or start in ("{", "[") or path.endswith(".json")), ("csv", "csv" in kind or path.endswith(".csv")), ("html", "html" in kind or path.endswith((".html", ".htm"))), ("xml", "xml" in kind or path.endswith(".xml")), ("text", kind.startswith("text/")))
    return Page(text, kind, len(body), next((f for f, yes in order if yes), "unknown"))
