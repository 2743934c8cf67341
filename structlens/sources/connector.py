"""Fetching documents by id: the interface, a polite client over any transport, and one that reads a folder.

The transport is a function (url, headers) -> (status, headers, body), so the
client can be run and tested without a network.
"""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Protocol

from structlens.errors import AuthenticationError, NotFoundError, ResponseError

Transport = Callable[[str, dict[str, str]], tuple[int, dict[str, str], str]]


@dataclass(frozen=True)
class RawDocument:
    source: str
    source_identifier: str
    retrieved_at: datetime
    request_url: str
    content_type: str
    http_status: int
    body: str


class Fetcher(Protocol):
    def fetch(self, ids: Sequence[str]) -> dict[str, RawDocument]:
        """The documents of the ids that the source has; others are absent."""


def split_items(body: str) -> dict[str, str]:
    """A document per item id of a batch document, its root as it was; items without id are dropped, of a repeated id the last stands."""
    root = ET.fromstring(body)
    out: dict[str, str] = {}
    for item in root.findall("item"):
        ident = (item.get("id") or "").strip()
        if ident:
            alone = ET.Element(root.tag, root.attrib)
            item.tail = None
            alone.append(item)
            out[ident] = ET.tostring(alone, encoding="unicode")
    return out


@dataclass
class HttpFetcher:
    """Batches of ids over a transport, requests `spacing` seconds apart, retried with growing pauses while the source is busy."""

    base_url: str
    transport: Transport
    source: str = "catalog"
    token: str | None = None
    batch: int = 20
    spacing: float = 5.0
    retries: int = 4
    pause: float = 2.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _last: float | None = field(default=None, repr=False)

    #: Statuses of a source that is preparing an answer or asks to slow down.
    BUSY = (202, 429, 500, 502, 503, 504)

    def _request(self, url: str) -> tuple[int, str, str]:
        headers = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        for attempt in range(self.retries + 1):
            if self._last is not None and (wait := self._last + self.spacing - self.clock()) > 0:
                self.sleep(wait)
            self._last = self.clock()
            status, answer, body = self.transport(url, headers)
            if status in (401, 403):
                raise AuthenticationError(f"{url}: status {status}")
            if status == 200:
                return status, answer.get("Content-Type", ""), body
            if status not in self.BUSY:
                raise ResponseError(f"{url}: status {status}")
            if attempt < self.retries:
                self.sleep(float(answer.get("Retry-After") or self.pause * 2**attempt))
        raise ResponseError(f"{url}: status {status} after {self.retries} retries")

    def fetch(self, ids: Sequence[str]) -> dict[str, RawDocument]:
        out: dict[str, RawDocument] = {}
        for at in range(0, len(ids), self.batch):
            url = f"{self.base_url}?stats=1&id={','.join(ids[at : at + self.batch])}"
            status, kind, body = self._request(url)
            now = datetime.now(timezone.utc).replace(tzinfo=None)
            for ident, document in split_items(body).items():
                out[ident] = RawDocument(self.source, ident, now, url, kind, status, document)
        return out

    def fetch_one(self, ident: str) -> RawDocument:
        found = self.fetch([ident])
        if ident not in found:
            raise NotFoundError(f"no item {ident}")
        return found[ident]


@dataclass
class FolderFetcher:
    """Documents from files named by id, for runs without a network."""

    folder: str
    source: str = "catalog"

    def fetch(self, ids: Sequence[str]) -> dict[str, RawDocument]:
        out = {}
        for ident in ids:
            path = Path(self.folder) / f"{ident}.xml"
            if path.is_file():
                out[ident] = RawDocument(self.source, ident, datetime.fromtimestamp(path.stat().st_mtime, timezone.utc).replace(tzinfo=None), path.as_uri(), "text/xml", 200, path.read_text())
        return out
