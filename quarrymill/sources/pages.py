"""Tables of URLs to tables of pages: fetched by tasks, failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.errors import RecordError
from quarrymill.functions.guards import url_problem
from quarrymill.functions.scratch import written
from quarrymill.sources.fetch import Page, fetch
from quarrymill.sources.readers import html_title, json_records, parse_csv, strip_html, text_lines

PAGE = "url string, text string, content_type string, bytes long, format string, problem string, message string"


def fetcher_of(get: Callable[[str], Page]):
    """A function for mapInPandas: URLs to pages, one row each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url, problem in zip(batch["url"], batch["problem"], strict=True):
                row = {"url": url, "text": None, "content_type": None, "bytes": None, "format": None, "problem": problem, "message": None}
                if problem is None:
                    try:
                        page = get(url)
                        row |= {"text": page.text, "content_type": page.content_type, "bytes": page.bytes, "format": page.format}
                    except RecordError as e:
                        row |= {"problem": e.code, "message": str(e)}
                    except OSError as e:
                        row |= {"problem": "FETCH_FAILED", "message": str(e)}
                # a page a batch: as many pages as Arrow's batches have rows needn't fit in memory
                yield pd.DataFrame([row]).astype({"bytes": "Int64"})

    return cut


def fetch_pages(urls: DataFrame, url: str = "url", get: Callable[[str], Page] = fetch, tasks: int = 64, per_host: int = 4) -> DataFrame:
    """(url, text, content_type, bytes, format, problem, message): the page of every different URL of ``urls``.

    URLs are dealt to ``tasks`` tasks by host, the URLs of one host to ``per_host`` of them at most: a host isn't asked by
    all tasks at once, and a host with a third of all URLs isn't one task's work. What the guards refuse is
    told from the URL and not asked for; what can't be fetched is a row with a problem. Nulls are a row with EMPTY_URL.
    Pages are written to the shared folder as they are fetched, so later steps don't ask for them again; a task that
    is lost asks again for its own only.
    """
    each = urls.select(F.col(url).cast("string").alias("url")).distinct().withColumn("problem", url_problem(F.col("url")))
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    dealt = each.repartition(tasks, host, F.pmod(F.xxhash64("url"), F.lit(per_host)))
    return written(dealt.mapInPandas(fetcher_of(get), PAGE), "pages")


def page_records(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, record, problem) of pages with text, format and problem, each parsed as its format says.

    JSON gives a record an element, CSV one a line, text one a line, a page of HTML or XML one. A page with a problem, or
    of unknown format, is one row with that problem.
    """
    none = F.lit(None).cast("string").alias("problem")
    number = F.col("id").cast("long").alias("id")
    of = lambda *formats: pages.where(F.col("problem").isNull() & F.col("format").isin(*formats))
    bare = strip_html(F.col("text"))
    html, plain = F.to_json(F.struct(html_title(F.col("text")).alias("title"), bare.alias("text"))), F.to_json(F.struct(bare.alias("text")))
    failed = pages.where(F.col("problem").isNotNull() | ~F.coalesce(F.col("format"), F.lit("unknown")).isin("json", "csv", "text", "html", "xml"))
    zero = F.lit(0).cast("long").alias("id")
    parts = [
        json_records(of("json"), "text", keys).select(*keys, F.col("index").cast("long").alias("id"), "record", "problem"),
        parse_csv(of("csv"), "text", keys).select(*keys, number, F.to_json("record").alias("record"), none),
        text_lines(of("text"), "text", keys, numbered=True).select(*keys, number, F.to_json(F.struct("id", "text")).alias("record"), none),
        of("html", "xml").select(*keys, F.lit(1).cast("long").alias("id"), F.when(F.col("format") == "html", html).otherwise(plain).alias("record"), none),
        failed.select(*keys, zero, F.lit(None).cast("string").alias("record"), F.coalesce("problem", F.lit("UNKNOWN_FORMAT")).alias("problem")),
    ]
    return reduce(DataFrame.unionByName, parts)
