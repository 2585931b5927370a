"""Reading pages and files, and fetching with an injected function."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.functions import urls
from weftlake.operators import crawl
from weftlake.staging import stage

Fetch = Callable[[str], tuple[int, bytes]]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A table of pages (page_id, url, html)."""
    return spark.read.parquet(path)


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, bytes, mtime`` of the files below a folder whose names match; none if it is missing."""
    schema = "path string, mtime timestamp, length bigint, content binary"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema).select("path", F.col("content").alias("bytes"), "mtime")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.col("content").alias("bytes"), F.col("modificationTime").alias("mtime"))


def read_output(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of the pages built below ``folder``: the URL paths of its files under
    ``pages/`` that end in ``index.html``, in order. Contents are not read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    files = read_files(spark, folder.rstrip("/") + "/pages", "*index.html")
    return files.select(urls.page_url_path(F.substring("path", len(root) + 2, 1 << 30)).alias("path")).orderBy("path")


def listed(spark: SparkSession, addresses: list[str]) -> DataFrame:
    """``page_id, url`` of addresses given by hand instead of a sitemap, repeated ones once."""
    return spark.createDataFrame(list(enumerate(dict.fromkeys(addresses))), "page_id bigint, url string")


LANES, PER_LANE = 16, 200  # tasks that share a host at most; addresses that a further one is for
AGAIN = (408, 425, 429, 500, 502, 503, 504)  # statuses that may be better later


def next_slot(now: float, epoch: float, delay: float, lane: int, lanes: int, last: int) -> tuple[int, float]:
    """The number and time of a lane's next slot. A host's time is cut into slots of
    ``delay`` seconds from ``epoch`` on; lane j of n has every n-th of them, from the j-th,
    so no two lanes ever send in one slot, whenever their tasks happen to run."""
    if delay <= 0:
        return last + 1, now
    n = max(last + 1, math.ceil(((now - epoch) / delay - lane) / lanes - 1e-9))
    return n, epoch + (n * lanes + lane) * delay


def _fetch_once(requests: DataFrame, get: Fetch, url: str, hosts: int, delay: float, lanes: int, per_lane: int, sleep: Callable[[float], None], clock: Callable[[], float]) -> DataFrame:
    todo = requests.select(F.col(url).alias("url")).distinct().withColumn("host", urls.host("url"))
    sizes = todo.groupBy("host").agg(F.least(F.lit(lanes), F.ceil(F.count(F.lit(1)) / per_lane)).cast("int").alias("lanes"))
    dealt = todo.join(sizes, "host").withColumn("lane", F.pmod(F.xxhash64("url"), F.col("lanes")).cast("int"))
    dealt = dealt.repartition(hosts, "host", "lane").sortWithinPartitions("host", "lane", "url")
    epoch = clock()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[tuple[str, int], int] = {}
        for batch in batches:
            out = []
            for address, host, lane, n in zip(batch["url"], batch["host"], batch["lane"], batch["lanes"]):
                last[host, lane], at = next_slot(clock(), epoch, delay, lane, n, last.get((host, lane), -1))
                if (wait := at - clock()) > 0:
                    sleep(wait)
                try:
                    status, body = get(address)
                    out.append((address, status, body if 200 <= status < 300 else None, None if 200 <= status < 300 else f"HTTP {status}"))
                except Exception as e:  # a failed request is a row, whatever went wrong
                    out.append((address, None, None, str(e)))
            yield pd.DataFrame({"url": [r[0] for r in out], "status": pd.array([r[1] for r in out], dtype="Int32"), "body": [r[2] for r in out], "error": [r[3] for r in out]})

    return dealt.mapInPandas(run, "url string, status int, body binary, error string")


def fetch(requests: DataFrame, get: Fetch, url: str = "url", hosts: int = 64, delay: float = 0.2, lanes: int = LANES, per_lane: int = PER_LANE, retries: int = 0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> DataFrame:
    """``url, status, body, error``: each distinct address once, failures as rows;
    ``hosts`` partitions bound what runs at once.

    A host with many addresses is shared by up to ``lanes`` tasks, so it neither fills one
    task nor waits for one slow answer. Requests to it stay ``delay`` seconds apart, as
    each task has slots of its own (machines' clocks have to agree better than that).
    With ``retries``, what failed in a way that may pass (no answer, or a status in
    ``AGAIN``) is written to a table and asked again, a round at a time; then ``attempts``
    tells how often an address was asked."""
    once = lambda rows, column: _fetch_once(rows, get, column, hosts, delay, lanes, per_lane, sleep, clock)
    if not retries:
        return once(requests, url)
    left, column, done = requests, url, []
    for attempt in range(1, retries + 2):
        got = stage(once(left, column).withColumn("attempts", F.lit(attempt)), "fetched")
        again = F.coalesce(F.col("status").isin(*AGAIN), F.lit(True)) & (attempt <= retries)
        done.append(got.where(~again))
        left, column = got.where(again).select("url"), "url"
        if attempt <= retries and left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def fetch_robots(requests: DataFrame, get: Fetch, url: str = "url", **options) -> DataFrame:
    """``host, txt`` of every host asked once; null where anything failed (all is allowed)."""
    by_host = requests.select(urls.host(url).alias("host"), urls.scheme(url).alias("s")).where("host <> ''").groupBy("host").agg(F.min("s").alias("s"))
    asked = by_host.select("host", F.concat("s", F.lit("://"), "host", F.lit("/robots.txt")).alias("url"))
    return asked.join(fetch(asked, get, **options), "url").select("host", F.col("body").cast("string").alias("txt"))


def permitted(requests: DataFrame, get: Fetch, url: str = "url", agent: str = "*", **options) -> DataFrame:
    """The requests that the robots files of their hosts, fetched first, allow; hosts
    without such a file and addresses that don't parse are kept."""
    rules = crawl.parse_robots(fetch_robots(requests, get, url, **options), "host", "txt", agent)
    return crawl.allowed(requests, rules, url)


def fetch_pages(requests: DataFrame, get: Fetch, url: str = "url", robots: bool = True, agent: str = "*", **options) -> DataFrame:
    """:func:`fetch` of what robots files allow; of everything without ``robots``."""
    return fetch(permitted(requests, get, url, agent, **options) if robots else requests, get, url, **options)


def fetch_assets(refs: DataFrame, get: Fetch, robots: bool = True, agent: str = "*", **options) -> DataFrame:
    """``url, type, local_path, body, error``: each address once, under a name that holds
    the hash of its content, below ``assets/<type>/``. Those that robots files forbid are
    not fetched and have no row."""
    refs = permitted(refs, get, "url", agent, **options) if robots else refs
    todo = refs.groupBy("url").agg(F.min("type").alias("type")) if "ord" not in refs.columns else refs.groupBy("url").agg(F.min_by("type", "ord").alias("type"))
    got = fetch(todo, get, **options).join(todo, "url")
    name = F.concat(F.lit("assets/"), "type", F.lit("/"), urls.hashed_name("url", "type", "body"))
    return got.select("url", "type", F.when(F.col("body").isNotNull(), name).alias("local_path"), "body", "error")
