"""Requests to the dashboard: routes and their parameters."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import parse_qsl, urlsplit

from tallyloom import constants as C


class Request(NamedTuple):
    """What a target asks for: page, rules, data, events, evidence, ask, or why it is refused."""

    route: str
    values: dict


def parameters(target: str) -> dict[str, str]:
    """The parameters of a target, percent-decoded, plus as blank; of repeated names the first counts."""
    out: dict[str, str] = {}
    for name, value in parse_qsl(urlsplit(target).query, keep_blank_values=True):
        out.setdefault(name, value)
    return out


def route(method: str, target: str) -> Request:
    """The route of a request: only GET, evidence by digest and locator, ask with a question and a limit above zero."""
    path = urlsplit(target).path
    if method != "GET":
        return Request("method-not-allowed", {})
    plain = {"/": "page", "/rules": "rules", "/api/data": "data", "/api/events": "events"}
    if path in plain:
        return Request(plain[path], {})
    if m := re.fullmatch(r"/api/evidence/([0-9a-f]{64})/([1-9][0-9]{0,8})", path):
        return Request("evidence", {"source_hash": m[1], "locator": int(m[2])})
    if path == "/api/ask":
        p = parameters(target)
        limit = p.get("limit", str(C.DEFAULT_ASK_LIMIT))
        if not p.get("q", "").strip() or not re.fullmatch(r"[0-9]+", limit) or int(limit) < 1:
            return Request("bad-request", {})
        return Request("ask", {"question": p["q"], "limit": int(limit)})
    return Request("not-found", {})
