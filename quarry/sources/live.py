"""Live pulls: addresses to contents, throttled and retried.

Addresses are dealt out over max_concurrent partitions, each of which waits min_delay_ms before a request, so the cluster as a
whole keeps the rate that the settings allow. Answers land as a table; a table of earlier answers is the cache.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.settings import Settings

RETRIED = (429, 500, 502, 503, 504)
JITTER_MS = 500


def got(url: str, agent: str, settings: Settings, headers: dict[str, str]) -> tuple[int, str | None, str | None]:
    """status, content, error of an address, after retries."""
    error = None
    for attempt in range(settings.max_retries + 1):
        time.sleep(settings.min_delay_ms / 1000)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent, **headers}), timeout=60) as r:
                return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            error = (e.code, None, str(e))
            if e.code not in RETRIED:
                return error
        except OSError as e:
            error = (0, None, str(e))
        if attempt < settings.max_retries:
            time.sleep((2**attempt * settings.min_delay_ms + random.uniform(0, JITTER_MS)) / 1000)
    return error


def fetched(urls: DataFrame, settings: Settings, headers: dict[str, str] | None = None, url: str = "url") -> DataFrame:
    """url, status, content, error of each distinct address; write it before use, since a second look fetches anew."""
    agent, extra = settings.user_agent(), headers or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(u, *got(u, agent, settings, extra)) for u in b["url"]], columns=["url", "status", "content", "error"])

    asked = urls.select(F.col(url).alias("url")).filter("url is not null").distinct()
    return asked.repartition(settings.max_concurrent).mapInPandas(run, "url string, status int, content string, error string")


def fetched_or_cached(urls: DataFrame, cache: DataFrame, settings: Settings, max_age_s: int = 7 * 24 * 3600, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Answers of the cache (url, content, fetched_at) that aren't too old, and those fetched for the rest."""
    young = cache.filter(F.col("fetched_at") > F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_s).cast("decimal(18,6)")))
    asked = urls.select(F.col(url).alias("url")).distinct()
    return asked.join(young.select("url", "content"), "url"), fetched(asked.join(young.select("url"), "url", "left_anti"), settings)
