import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from textquarry.sources import api


@pytest.fixture(scope="module")
def service():
    """A small service on this machine that answers like the public ones."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            u = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(u.query).items()}
            asked.append((time.monotonic(), u.path, q))
            answers = {
                "/w/api.php": {"query": {"search": [{"title": "Old Mill"}, {"title": "Ferry/2"}]}},
                "/api/rest_v1/page/summary/Old_Mill": {"title": "Old Mill", "extract": "A mill.", "content_urls": {"desktop": {"page": "u1"}}, "timestamp": "t"},
                "/api/rest_v1/page/summary/Ferry%2F2": {"title": "Ferry/2", "extract": "A ferry.", "content_urls": {"desktop": {"page": "u2"}}, "timestamp": "t"},
                "/news": {"hits": [{"objectID": "1", "title": "T", "story_text": "S", "points": 3}]},
                "/r/mills/hot.json": {"data": {"children": [{"data": {"id": "h", "title": "Hot", "selftext": "x", "created_utc": 0.0}}]}},
                "/r/mills/search.json": {"data": {"children": [{"data": {"id": "s", "title": "Sought", "selftext": "x", "created_utc": 0.0}}]}},
            }
            texts = {
                "/preprints": "<feed><entry><title>P</title><summary>Abs</summary><author><name>A</name></author><published>d</published><id>i</id></entry></feed>",
                "/crawl": '{"url": "a", "status": "200"}\nno json\n{"url": "b", "status": "404"}',
                "/feed1": "<rss><item><title>F1</title></item></rss>", "/feed2": "<rss><item><title>F2</title></item></rss>",
            }
            body = json.dumps(answers[u.path]) if u.path in answers else texts.get(u.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_searches(spark, service):
    base, asked = service
    assert {(r.title, r.extract) for r in api.search_encyclopedia(spark, "mill & ferry", 5, 0.0, base).collect()} == {("Old Mill", "A mill."), ("Ferry/2", "A ferry.")}
    assert asked[0][1:] == ("/w/api.php", {"action": "query", "format": "json", "list": "search", "srsearch": "mill & ferry", "srlimit": "5"})
    assert [(r.title, r.abstract, r.authors) for r in api.search_preprints(spark, "tides", 7, "x.y", base=f"{base}/preprints").collect()] == [("P", "Abs", ["A"])]
    assert asked[-1][2]["search_query"] == "all:tides AND cat:x.y" and asked[-1][2]["max_results"] == "7"
    assert [r.url for r in api.search_crawls(spark, "a.example", base=f"{base}/crawl").collect()] == ["a", "b"] and asked[-1][2]["url"] == "a.example/*"
    assert [r.text for r in api.search_news(spark, "q", hits=5000, base=f"{base}/news").collect()] == ["S"] and asked[-1][2]["hitsPerPage"] == "1000"
    assert [r.title for r in api.search_forum(spark, "mills", base=base).collect()] == ["Hot"]
    assert [r.title for r in api.search_forum(spark, "mills", "old", base=base).collect()] == ["Sought"] and asked[-1][2] == {"q": "old", "limit": "100", "sort": "relevance"}


def test_rate_limit_and_errors(spark, service):
    base, asked = service
    feeds = api.fetch_feeds(spark, [f"{base}/feed1", f"{base}/feed2", f"{base}/none"], delay=0.4).collect()
    assert {(r.title, r.feed_url) for r in feeds} == {("F1", f"{base}/feed1"), ("F2", f"{base}/feed2")}
    at = [t for t, path, _ in asked if path in ("/feed1", "/feed2", "/none")]
    assert len(at) == 3 and all(b - a >= 0.39 for a, b in zip(at, at[1:], strict=False))
    failed = api.fetch(spark, [f"{base}/none", "http://127.0.0.1:9/x"], delay=0).collect()
    assert all(r.payload is None and r.error for r in failed) and len(failed) == 2
    assert api.news_board(api.fetch(spark, [f"{base}/none"])).count() == 0
