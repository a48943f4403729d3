"""A web client for the fetch seam: who asks, how long, and where it may be sent on.

It says who it is and how to reach them, follows MOST_REDIRECTS redirects at
most, to http and https addresses only, and gives every status as an answer.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.error import HTTPError
from urllib.parse import urlparse
from urllib.request import HTTPRedirectHandler, Request, build_opener

from . import seams

AGENT, MOST_REDIRECTS = "marginalia/1.0 (citation audit; mailto:{0})", 5


class _Redirects(HTTPRedirectHandler):
    max_redirections = max_repeats = MOST_REDIRECTS

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if urlparse(newurl).scheme not in ("http", "https"):
            raise HTTPError(newurl, code, "redirected to another scheme", headers, fp)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def client(contact: str, seconds: float = seams.HTTP_TIMEOUT_S) -> Callable[[str], tuple[int, bytes]]:
    """Address to (status, body); contact: the mail address that services can write to."""
    agent = AGENT.replace("{0}", contact)

    def get(url: str) -> tuple[int, bytes]:
        if urlparse(url).scheme not in ("http", "https"):
            raise ValueError("neither http nor https")
        try:
            with build_opener(_Redirects).open(Request(url, headers={"User-Agent": agent}), timeout=seconds) as answer:
                return answer.status, answer.read()
        except HTTPError as e:
            return e.code, e.read() if e.fp else b""

    return get
