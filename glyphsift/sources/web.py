"""Pages over HTTP, fetched where the URLs are: public addresses alone, one site, few redirects, bounded sizes."""

from __future__ import annotations

import http.client
import ipaddress
import socket
import ssl
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_CAP, REDIRECTS, TIMEOUT = 4 << 20, 5, 20
PAGE = "url string, final_url string, content_type string, content binary, error string"
STANDARD = ("/sitemap.xml", "/sitemap_index.xml")


class Site(NamedTuple):
    scheme: str
    host: str
    port: int


def site_of(url: str) -> Site:
    """Scheme, host and port of a URL; a ValueError for other schemes, credentials, a missing host or a bad port."""
    parts = urlsplit(url)
    ports = {"http": 80, "https": 443}
    if parts.scheme.lower() not in ports:
        raise ValueError(f"scheme isn't allowed: {parts.scheme or 'none'}")
    if "@" in parts.netloc:
        raise ValueError("credentials aren't allowed")
    if not parts.hostname:
        raise ValueError("no host")
    return Site(parts.scheme.lower(), parts.hostname.lower().rstrip("."), parts.port or ports[parts.scheme.lower()])


def same_site(found: Site, wanted: Site) -> bool:
    """The same site, or the step from plain HTTP to HTTPS at the usual ports."""
    return found == wanted or (wanted[::2], found[::2], found.host) == (("http", 80), ("https", 443), wanted.host)


def is_public(address: str) -> bool:
    own = ipaddress.ip_address(address.split("%", 1)[0])
    return (getattr(own, "ipv4_mapped", None) or own).is_global


def addresses_of(site: Site, public: Callable[[str], bool] = is_public) -> list[str]:
    """The numeric addresses of a site's host. One that isn't public refuses the host as a whole."""
    try:
        found = [str(ipaddress.ip_address(site.host))]
    except ValueError:
        found = sorted({str(x[4][0]) for x in socket.getaddrinfo(site.host, site.port, type=socket.SOCK_STREAM)})
    if not found or not all(map(public, found)):
        raise ValueError(f"no public address: {site.host}")
    return found


def _connect(site: Site, address: str, timeout: float) -> http.client.HTTPConnection:
    """A connection to the address that was looked at, and to no other that the name may have by now."""
    kind = http.client.HTTPSConnection if site.scheme == "https" else http.client.HTTPConnection
    connection = kind(site.host, site.port, timeout=timeout)
    raw = socket.create_connection((address, site.port), timeout)
    connection.sock = ssl.create_default_context().wrap_socket(raw, server_hostname=site.host) if site.scheme == "https" else raw
    return connection


def fetch(url: str, cap: int = PAGE_CAP, timeout: float = TIMEOUT, public: Callable[[str], bool] = is_public) -> tuple[str, str | None, bytes]:
    """(last URL, content type, content) of a page; redirects stay on the site. Raises OSError or ValueError."""
    start = site_of(url)
    for _ in range(REDIRECTS + 1):
        site = site_of(url)
        if not same_site(site, start):
            raise ValueError(f"leaves the site: {site.host}")
        connection = _connect(site, addresses_of(site, public)[0], timeout)
        try:
            parts = urlsplit(url)
            connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": "glyphsift", "Connection": "close"})
            answer = connection.getresponse()
            target = answer.getheader("Location")
            if answer.status in (301, 302, 303, 307, 308) and target:
                url = urljoin(url, target)
                continue
            if answer.status != 200:
                raise ValueError(f"status {answer.status}")
            body = answer.read(cap + 1)
            if len(body) > cap:
                raise ValueError("too large")
            return url, answer.getheader("Content-Type"), body
        finally:
            connection.close()
    raise ValueError("too many redirects")


def fetch_pages(urls: DataFrame, url_col: str = "url", cap: int = PAGE_CAP, timeout: float = TIMEOUT, public: Callable[[str], bool] = is_public) -> DataFrame:
    """(url, final_url, content_type, content, error) of each distinct URL; a page that can't be had is a row with an error.

    The URLs are spread over the cluster by their site, so that one task at a time asks a site.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url in pdf["url"]:
                row: dict = {"url": url}
                try:
                    row["final_url"], row["content_type"], row["content"] = fetch(url, cap, timeout, public)
                except (OSError, ValueError, http.client.HTTPException) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([row], columns=[c.split(" ")[0] for c in PAGE.split(", ")]).astype(object)

    rows = urls.select(F.col(url_col).cast("string").alias("url")).where("url is not null").distinct()
    return rows.repartition(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)).mapInPandas(run, PAGE)


def discover_sitemap(base: str, get: Callable[[str], bytes]) -> str | None:
    """The sitemap of a site: at the usual places, else as robots.txt names it; None without one."""
    site, base = site_of(base), base.rstrip("/")
    for place in STANDARD:
        try:
            if b"<loc" in get(base + place):
                return base + place
        except (OSError, ValueError):
            continue
    try:
        robots = get(f"{base}/robots.txt").decode("utf-8", "replace")
    except (OSError, ValueError):
        return None
    for line in robots.splitlines():
        name, _, value = line.partition(":")
        if name.strip().lower() == "sitemap":
            return value.strip() if same_site(site_of(value.strip()), site) else None
    return None
