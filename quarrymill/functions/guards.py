"""Guards before data is taken in: hosts, addresses, URLs, content types, formats, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that are never read, and content types that are.
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal", "instance-data")
ALLOWED_TYPES = (
    "text/plain", "text/html", "text/csv", "application/json", "application/xml", "text/xml", "application/javascript",
    "text/javascript", "application/ld+json",
)


def blocked_host(host: Column, profile: str = "library") -> Column:
    h = F.lower(F.btrim(F.coalesce(host, F.lit(""))))
    blocked = h.isin(*BLOCKED_HOSTS) | h.endswith(".localhost") | h.endswith(".local")
    return blocked | h.endswith(".internal") | (h == "") if profile == "library" else blocked


def private_ipv4(ip: Column, profile: str = "library") -> Column:
    """Private, loopback, link-local and reserved ranges; null if it isn't an address."""
    p = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    a, b, c = (F.get(p, F.lit(i)) for i in range(3))
    valid = (F.size(p) == 4) & F.forall(p, lambda x: x.isNotNull() & x.between(0, 255))
    found = a.isin(0, 10, 127) | (a == 169) & (b == 254) | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168)
    if profile == "library":
        found = found | (a == 100) & b.between(64, 127) | (a == 192) & (b == 0) | (a == 198) & b.isin(18, 19)
        found = found | (a == 198) & (b == 51) & (c == 100) | (a == 203) & (b == 0) & (c == 113) | (a >= 224)
    return F.when(valid, found)


def private_ipv6(ip: Column, profile: str = "library") -> Column:
    t = F.lower(ip)
    found = t.isin("::1") | t.rlike("^f[cd]")
    return found | t.isin("::") | t.rlike("^fe[89ab]") if profile == "library" else found | t.startswith("fe80:")


def url_problem(url: Column, most: int = 4000) -> Column:
    """A code for what keeps a URL from being read, or null."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    return (
        F.when(url.isNull() | (F.btrim(url) == ""), "EMPTY_URL")
        .when(F.length(url) > most, "URL_TOO_LONG")
        .when(part("PROTOCOL").isNull() | part("HOST").isNull(), "INVALID_URL")
        .when(~F.lower(part("PROTOCOL")).isin("http", "https"), "UNSUPPORTED_PROTOCOL")
        .when(part("USERINFO").isNotNull(), "URL_CREDENTIALS_NOT_ALLOWED")
        .when(blocked_host(part("HOST")), "BLOCKED_HOST")
        .when(F.coalesce(private_ipv4(part("HOST")), F.lit(False)), "PRIVATE_ADDRESS")
    )


def content_type(header: Column) -> Column:
    return F.lower(F.btrim(F.split(F.coalesce(header, F.lit("")), ";").getItem(0)))


def allowed_type(header: Column) -> Column:
    return content_type(header).isin(*ALLOWED_TYPES) | content_type(header).startswith("text/")


def detect_format(header: Column, text: Column, path: Column) -> Column:
    """json, csv, html, xml, text or unknown, by content type, first character and path, in that order of formats."""
    kind, start, p = content_type(header), F.ltrim(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(kind.contains("json") | start.startswith("{") | start.startswith("[") | p.endswith(".json"), "json")
        .when(kind.contains("csv") | p.endswith(".csv"), "csv")
        .when(kind.contains("html") | p.endswith(".html") | p.endswith(".htm"), "html")
        .when(kind.contains("xml") | p.endswith(".xml"), "xml")
        .when(kind.startswith("text/"), "text")
        .otherwise("unknown")
    )
