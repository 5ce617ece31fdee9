"""Vintage observations over HTTP as a Spark data source: one partition a series, paged, polite, and discreet.

    spark.dataSource.register(VintageApi)
    spark.read.format("vintage_api").options(url=..., key=..., series="A,B", endpoint="observations").load()

With the option ``audit`` each series has one more row, which says how its requests went; a failure is such a row too
instead of an error. With the option ``push_filters`` (and spark.sql.python.filterPushdown.enabled, which sessions of this
library have) a filter on the series reaches the source: only those that it names are asked for.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

PAGE, ATTEMPTS, TIMEOUT, PAUSE = 10_000, 3, 60, 0.7
ENDPOINTS = {
    "observations": (
        "series/observations",
        "observations",
        "series_id string, observation_date string, realtime_start string, realtime_end string, value_text string",
        ("date", "realtime_start", "realtime_end", "value"),
    ),
    "vintagedates": ("series/vintagedates", "vintage_dates", "series_id string, vintage_date string", None),
}

#: The columns that ``audit`` adds. Rows of data have nulls in them, and the row of the requests has nulls elsewhere.
AUDIT = "requests int, rate_limited int, http_status int, error string"


class VintageApiError(RuntimeError):
    """A request failed for good. The message has neither URL nor key."""


def fetch(url: str) -> tuple[int, bytes]:
    """Status and body of a request; network failures have status 0."""
    try:
        with urlopen(url, timeout=TIMEOUT) as answer:
            return answer.status, answer.read()
    except HTTPError as error:
        return error.code, b""
    except (URLError, TimeoutError, OSError):
        return 0, b""


class Client:
    """Paged reads with retries on 429, 5xx and network failures; other statuses are final."""

    def __init__(self, url: str, key: str, get: Callable[[str], tuple[int, bytes]] = fetch, sleep: Callable[[float], None] = time.sleep, clients: int = 1) -> None:
        """``clients`` says how many may read at once: each pauses so much longer, so that all together keep the pace."""
        self.url, self._key, self._get, self._sleep, self._pause = url.rstrip("/"), key, get, sleep, PAUSE * clients
        self.requests = self.rate_limited = self.status = 0

    def _json(self, path: str, **query) -> dict:
        asked = f"{self.url}/{path}?{urlencode(query | {'api_key': self._key, 'file_type': 'json'})}"
        status = 0
        for attempt in range(ATTEMPTS):
            if self.requests:
                self._sleep(self._pause)
            self.requests += 1
            status, body = self._get(asked)
            self.status = status
            if status == 200:
                try:
                    return json.loads(body)
                except ValueError:
                    raise VintageApiError(f"{path} answered with no JSON") from None
            if status == 429:
                self.rate_limited += 1
            if status and status != 429 and status < 500:
                break
            if attempt + 1 < ATTEMPTS:
                self._sleep(2.0 * (attempt + 1))
        raise VintageApiError(f"{path} failed with status {status}")

    def rows(self, endpoint: str, series_id: str, start: str = "1776-07-04", end: str = "9999-12-31") -> Iterator[tuple]:
        path, field, _, columns = ENDPOINTS[endpoint]
        offset = 0
        while True:
            page = self._json(path, series_id=series_id, realtime_start=start, realtime_end=end, limit=PAGE, offset=offset)
            page = page.get(field) if isinstance(page, dict) else None
            if not isinstance(page, list):
                raise VintageApiError(f"{path} answered without {field}")
            for item in page:
                yield (series_id, *(item[c] for c in columns)) if columns else (series_id, item)
            if len(page) < PAGE:
                return
            offset += PAGE


class VintageApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vintage_api"

    def schema(self) -> str:
        plain = ENDPOINTS[self.options.get("endpoint", "observations")][2]
        return f"{plain}, {AUDIT}" if _audited(self.options) else plain

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (_Filtered if options.get("push_filters", "false").lower() == "true" else _Reader)(options)


def _audited(options: dict[str, str]) -> bool:
    return options.get("audit", "false").lower() == "true"


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.only = options, None

    def partitions(self) -> list[InputPartition]:
        asked = [s.strip() for s in self.options["series"].split(",") if s.strip()]
        return [InputPartition(s) for s in asked if self.only is None or s in self.only]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        # An InputPartition without a series is what Spark plans where no partition is left.
        if partition is None or partition.value is None:
            return
        options, audited = self.options, _audited(self.options)
        client, endpoint = Client(options["url"], options["key"], clients=len(self.partitions())), options.get("endpoint", "observations")
        more, error = (None,) * (4 if audited else 0), None
        try:
            for row in client.rows(endpoint, partition.value, options.get("realtime_start", "1776-07-04"), options.get("realtime_end", "9999-12-31")):
                yield row + more
        except VintageApiError as failed:
            if not audited:
                raise
            error = str(failed)
        if audited:
            width = len(ENDPOINTS[endpoint][2].split(", "))
            yield (partition.value, *[None] * (width - 1), client.requests, client.rate_limited, client.status, error)


class _Filtered(_Reader):
    """A reader of its own, as Spark refuses readers that take filters where pushing them is switched off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take filters on the series, which partitions answer; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("series_id",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
            else:
                yield f
