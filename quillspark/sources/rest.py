"""A paginated REST feed as a Spark data source, a page to a partition; polite fetching; the state of each fetched post."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T

# ---- fixed values: politeness ----
DELAY_S, TIMEOUT_S, RETRIES, PAUSE_AFTER_ERROR_S = 2.0, 60, 3, 5.0


def fetch(url: str, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep, retries: int = RETRIES):
    """(body, headers) of a URL, or None. Each try waits first; an HTTP error is final, a network error is tried again."""
    for _ in range(retries):
        sleep(DELAY_S)
        try:
            with opener(url, timeout=TIMEOUT_S) as r:
                return r.read(), dict(r.headers)
        except urllib.error.HTTPError:
            return None
        except OSError:
            sleep(PAUSE_AFTER_ERROR_S)
    return None


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class FeedReader(DataSourceReader):
    def __init__(self, options, schema):
        self.url, self.schema = options["url"], schema
        self.per_page, self.header = int(options.get("perPage", 100)), options.get("pagesHeader", "X-WP-TotalPages")
        self.delay = float(options.get("delay", DELAY_S))

    def page_url(self, number: int) -> str:
        """Only the wanted fields are asked of the server."""
        query = {"per_page": self.per_page, "page": number, "_fields": ",".join(f.name for f in self.schema.fields)}
        return f"{self.url}{'&' if '?' in self.url else '?'}{urllib.parse.urlencode(query)}"

    def _get(self, number: int):
        got = fetch(self.page_url(number), sleep=lambda s: time.sleep(min(s, self.delay)))
        if got is None:
            raise OSError(f"page {number} can't be read")
        return got

    def partitions(self):
        _, headers = self._get(1)
        pages = {k.lower(): v for k, v in headers.items()}.get(self.header.lower(), "1")
        return [Page(i) for i in range(1, int(pages) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        body, _ = self._get(partition.number)
        for post in json.loads(body):
            yield tuple(str(x) if (x := post.get(f.name)) is not None else None for f in self.schema.fields)


class Feed(DataSource):
    """spark.read.format("paged_feed").schema("id string, ...").option("url", ...).load(); all columns are strings."""

    @classmethod
    def name(cls):
        return "paged_feed"

    def schema(self):
        return "id string, title string, date string, link string"

    def reader(self, schema):
        return FeedReader(self.options, schema)


def fetch_status(posts: DataFrame) -> DataFrame:
    """State of each post (html, download, is_pdf): page_failed, no_pdf, download_failed, not_a_pdf or ok. The first link of the page counts."""
    links = T.pdf_links(F.col("html"))
    state = F.when(F.col("html").isNull(), "page_failed").when(F.size(links) == 0, "no_pdf").when(F.col("download").isNull(), "download_failed").when(~F.col("is_pdf"), "not_a_pdf").otherwise("ok")
    return posts.withColumns({"status": state, "pdf_url": F.coalesce(F.get(links, 0), F.lit("")), "n_pdf_links": F.coalesce(F.size(links), F.lit(0))})


def file_stem(month: Column, id_: Column) -> Column:
    """2020-03_17, or unknown_17 without a month."""
    return F.coalesce(F.concat(F.date_format(month, "yyyy-MM"), F.lit("_"), id_.cast("string")), F.concat(F.lit("unknown_"), id_.cast("string")))
