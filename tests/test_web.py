import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from glyphsift.sources import web


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        moved = {"/moved": "/page", "/away": "http://other.example/", "/round": "/round"}.get(self.path)
        self.send_response(302 if moved else 404 if self.path == "/none" else 200)
        if moved:
            self.send_header("Location", moved)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(b"x" * 5000 if self.path == "/big" else b"<p>hello</p>")

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_urls_and_addresses():
    assert web.site_of("HTTPS://Host.Example./a") == ("https", "host.example", 443)
    for bad in ("ftp://a/b", "http://u:p@a/", "http:///x", "javascript:1", "http://a:99999/"):
        with pytest.raises(ValueError):
            web.site_of(bad)
    plain, safe = web.site_of("http://a.example/"), web.site_of("https://a.example/")
    assert web.same_site(safe, plain) and not web.same_site(plain, safe) and not web.same_site(web.site_of("https://b.example"), plain)
    assert web.is_public("8.8.8.8") and not any(map(web.is_public, ("10.1.1.1", "127.0.0.1", "::1", "fe80::1%eth0", "::ffff:192.168.1.1", "169.254.169.254")))
    with pytest.raises(ValueError):
        web.addresses_of(web.site_of("http://localhost/"))


def test_fetching(spark, site):
    names = ["/page", "/moved", "/away", "/round", "/none", "/big"]
    rows = spark.createDataFrame([(site + n,) for n in names] * 2 + [(None,), ("ftp://x/",)], "url string")
    got = {r.url.removeprefix(site): r for r in web.fetch_pages(rows, cap=1000, public=lambda a: True).collect()}
    assert len(got) == 7 and bytes(got["/page"].content) == b"<p>hello</p>" and got["/page"].content_type.startswith("text/html")
    assert got["/moved"].final_url == f"{site}/page" and got["/moved"].error is None
    errors = {n: got[n].error.split(": ", 1)[1] for n in ("/away", "/round", "/none", "/big", "ftp://x/")}
    assert errors == {"/away": "leaves the site: other.example", "/round": "too many redirects", "/none": "status 404", "/big": "too large", "ftp://x/": "scheme isn't allowed: ftp"}
    refused = web.fetch_pages(rows.limit(1)).first()
    assert refused.content is None and "no public address" in refused.error


def test_sitemap_discovery():
    def get(pages):
        def one(url):
            if url not in pages:
                raise ValueError("status 404")
            return pages[url]

        return one

    base = "https://a.example"
    assert web.discover_sitemap(base + "/", get({f"{base}/sitemap_index.xml": b"<sitemapindex><loc>x</loc>"})) == f"{base}/sitemap_index.xml"
    robots = {f"{base}/robots.txt": b"User-agent: *\nSitemap: https://a.example/s.xml\n"}
    assert web.discover_sitemap(base, get(robots)) == f"{base}/s.xml"
    assert web.discover_sitemap(base, get({f"{base}/robots.txt": b"sitemap: https://b.example/s.xml"})) is None
    assert web.discover_sitemap(base, get({})) is None
