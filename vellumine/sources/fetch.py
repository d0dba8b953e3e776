"""Fetching pages in tasks, decoding them, crawl schedules, and handing materials to another system."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol
from urllib.error import HTTPError, URLError

import pandas as pd
from pyspark.sql import DataFrame

#: Answers after which another try is of no use.
FINAL = frozenset({401, 403, 404})
#: Encodings that are tried after those that a page names.
LADDER = ("utf-8", "gb18030", "gbk", "gb2312")
META = re.compile(rb"""<meta[^>]+charset=["']?([a-zA-Z0-9._-]+)""", re.I)
CHARSET = re.compile(r"charset=([a-zA-Z0-9._-]+)", re.I)


def decode(body: bytes, content_type: str = "") -> str:
    """Text of a page: by its header's encoding, that of its meta tags, then the ladder; what can't be read becomes U+FFFD."""
    named = CHARSET.findall(content_type) + [m.decode("ascii") for m in META.findall(body[:4096])]
    for encoding in dict.fromkeys(x.strip().lower() for x in [*named, *LADDER]):
        try:
            return body.decode(encoding)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("utf-8", errors="replace")


def _open(url: str, timeout: float) -> tuple[bytes, str]:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"Accept": "text/html,*/*;q=0.8"}), timeout=timeout) as answer:
        return answer.read(), answer.headers.get("content-type", "")


def fetched(url: str, opener: Callable[[str, float], tuple[bytes, str]] = _open, retries: int = 3, backoff: float = 0.5, timeout: float = 20.0) -> tuple[str | None, str | None]:
    """(text, error) of an address: tried again with doubling pauses, unless the answer is final."""
    error = "no try"
    for attempt in range(retries + 1):
        try:
            return decode(*opener(url, timeout)), None
        except HTTPError as e:
            error = f"status {e.code}"
            if e.code in FINAL:
                break
        except (URLError, TimeoutError, OSError) as e:
            error = type(e).__name__
        if attempt < retries:
            time.sleep(backoff * 2**attempt)
    return None, error


def fetch(urls: DataFrame, opener: Callable[[str, float], tuple[bytes, str]] = _open, retries: int = 3, backoff: float = 0.5) -> DataFrame:
    """(url, text, error) of a table of addresses; each task goes through its own, and an address that fails leaves a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [fetched(u, opener, retries, backoff) for u in frame["url"]]
            yield pd.DataFrame({"url": frame["url"], "text": [t for t, _ in found], "error": [e for _, e in found]})

    return urls.select("url").mapInPandas(run, "url string, text string, error string")


def crawl_schedule(sources: Sequence[Mapping[str, Any]]) -> dict[str, dict[str, str]]:
    """By source, the five fields of its cron line; sources that are off or have none are left out.

    For the scheduler that starts the crawls, which is no part of this package.
    """
    fields = ("minute", "hour", "day", "month", "day_of_week")
    lines = {s["id"]: (s.get("schedule") or {}).get("cron") for s in sources if s.get("enabled", True)}
    return {k: dict(zip(fields, line.split(), strict=True)) for k, line in lines.items() if line}


class Target(Protocol):
    """Another system that keeps materials."""

    def upsert(self, rows: Iterator[Mapping[str, Any]]) -> int: ...


class Nowhere:
    """Takes nothing; the default."""

    def upsert(self, rows: Iterator[Mapping[str, Any]]) -> int:
        return 0


def sync(target: Target | None = None, columns: Sequence[str] = ("id", "text", "knowledge_tags", "fit_scores")) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that hands each micro-batch to the target, partition by partition."""
    target = target or Nowhere()

    def hand_over(batch: DataFrame, number: int) -> None:
        batch.select(*(c for c in columns if c in batch.columns)).foreachPartition(lambda rows: target.upsert(r.asDict() for r in rows) and None)

    return hand_over
