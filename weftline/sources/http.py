"""A paged HTTP API as a Spark data source: one partition per page, and a snapshot whose pages all agree."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.settle import settled

#: Rows of a page, attempts of a request and of a snapshot, seconds of a request, and the longest wait.
PAGE, ATTEMPTS, SNAPSHOT_ATTEMPTS, TIMEOUT, LONGEST_WAIT = 100, 5, 3, 60, 16


class SnapshotChanged(RuntimeError):
    """The library changed while it was read."""


def retry_delay(headers, attempt: int) -> float:
    """Seconds asked for by Retry-After or else Backoff; where that isn't a number, 2**attempt up to LONGEST_WAIT."""
    asked = headers.get("Retry-After") or headers.get("Backoff")
    try:
        return max(0.0, float(asked))
    except (TypeError, ValueError):
        return float(min(2**attempt, LONGEST_WAIT))


def required_integer_header(headers: dict[str, str], name: str, url: str) -> int:
    low = {k.lower(): v for k, v in headers.items()}
    try:
        return int(low[name.lower()])
    except (KeyError, ValueError) as error:
        raise ValueError(f"{url}: header {name} is missing or not an integer") from error


def fetch_json(url: str, user_agent: str, version: tuple[str, str] | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[object, dict[str, str]]:
    """JSON and headers of a page. 429 and 503 are tried again; a Backoff header is heeded on success too.

    version: the API version's header and value; it is sent, and an answer with another one is refused.
    """
    sent = {"User-Agent": user_agent} | ({version[0]: version[1]} if version else {})
    for attempt in range(ATTEMPTS):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=sent), timeout=TIMEOUT) as answer:
                body, headers = json.loads(answer.read()), dict(answer.headers)
        except urllib.error.HTTPError as error:
            if error.code not in (429, 503) or attempt + 1 == ATTEMPTS:
                raise
            sleep(retry_delay(error.headers, attempt))
            continue
        low = {k.lower(): v for k, v in headers.items()}
        if version and low.get(version[0].lower()) != version[1]:
            raise ValueError(f"{url}: unexpected API version {low.get(version[0].lower())!r}")
        if "backoff" in low:
            sleep(retry_delay({"Backoff": low["backoff"]}, attempt))
        return body, headers
    raise AssertionError("unreachable")


class _Page(InputPartition):
    def __init__(self, start: int, version: int, total: int):
        super().__init__(start)
        self.start, self.version, self.total = start, version, total


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.agent = options["path"], options.get("userAgent", "weftline")
        self.page = int(options.get("page", PAGE))
        self.api = (options["versionHeader"], options["versionValue"]) if "versionHeader" in options else None

    def _get(self, start: int):
        query = urllib.parse.urlencode({"format": "json", "limit": self.page, "start": start})
        url = f"{self.url}?{query}"
        rows, headers = fetch_json(url, self.agent, self.api)
        return rows, required_integer_header(headers, "last-modified-version", url), required_integer_header(headers, "total-results", url), url

    def partitions(self):
        _, version, total, _ = self._get(0)
        return [_Page(s, version, total) for s in range(0, max(total, 1), self.page)]

    def read(self, partition):
        rows, version, total, url = self._get(partition.start)
        if (version, total) != (partition.version, partition.total):
            raise SnapshotChanged(f"{url}: the library changed")
        for row in rows:
            yield (str((row.get("data") or {}).get("key") or row.get("key") or ""), json.dumps(row, ensure_ascii=False), version, total, url)


class PagedSource(DataSource):
    """spark.read.format("paged_json").load(endpoint): key, record (JSON text), version, total, url.

    Options: userAgent, page, versionHeader and versionValue.
    """

    @classmethod
    def name(cls):
        return "paged_json"

    def schema(self):
        return "key string, record string, version long, total long, url string"

    def reader(self, schema):
        return _PageReader(self.options)


def fetch_snapshot(spark: SparkSession, root: str, endpoints: tuple[str, ...] = ("collections", "items/top"), expected_version: int | None = None, land: Callable[[str, DataFrame], DataFrame] = lambda name, df: settled(df), **options: str) -> dict[str, DataFrame]:
    """Rows of each endpoint in ascending order of key, all of one library version. Tried again if the library changes.

    land stores an endpoint's rows, so that they are fetched once whatever becomes of an executor, and gives them back: by
    default as a checkpoint. Keys must be there and unique, and as
    many as the library says.
    """
    from pyspark.sql import functions as F

    spark.dataSource.register(PagedSource)
    for attempt in range(SNAPSHOT_ATTEMPTS):
        try:
            out, versions = {}, set()
            for name in endpoints:
                df = land(name, spark.read.format("paged_json").options(**options).load(f"{root}/{name}"))
                found = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"), F.count_if(F.col("key") == "").alias("empty"), F.max("total").alias("total"), F.collect_set("version").alias("versions")).first()
                if found["n"] and (found["n"] != found["total"] or found["keys"] != found["n"] or found["empty"]):
                    raise SnapshotChanged(f"{name}: {found['n']} rows of {found['total']}, {found['keys']} keys")
                versions |= set(found["versions"])
                out[name] = df.orderBy("key")
            if len(versions) > 1:
                raise SnapshotChanged(f"versions differ: {sorted(versions)}")
            if expected_version is not None and versions != {expected_version}:
                raise ValueError(f"library version is {sorted(versions)}, not {expected_version}")
            return out
        except Exception as error:
            if "SnapshotChanged" not in f"{type(error).__name__} {error}" or attempt + 1 == SNAPSHOT_ATTEMPTS:
                raise
    raise AssertionError("unreachable")
