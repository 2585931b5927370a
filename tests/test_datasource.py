"""The data sources: what is asked, restarts, and files of runs that fail."""

import os

import pytest
from pyspark.sql import functions as F

from weftlake.sources import datasource


def answer(url):
    """A transport that notes what it is asked in files."""
    log = os.path.join("/tmp", "weftlake-asked-" + url.split("//")[1].split(".")[0])
    with open(log, "a") as f:
        f.write(url + "\n")
    if "broken" in url:
        raise OSError("no route")
    return (404, b"") if "missing" in url else (200, url.encode())


@pytest.fixture
def site(tmp_path):
    """A host name of its own, so that each test has a log of its own."""
    name = "t" + os.path.basename(str(tmp_path)).replace("_", "") + str(os.getpid())
    log = os.path.join("/tmp", "weftlake-asked-" + name)
    open(log, "w").close()
    yield name, lambda: open(log).read().split()
    os.remove(log)


@pytest.fixture(autouse=True)
def registered(spark):
    datasource.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def table(spark, addresses):
    return spark.createDataFrame([(a,) for a in addresses], "url string")


def source(reader, folder):
    return reader.format("fetched").option("path", folder).option("transport", "tests.test_datasource:answer").option("delay", "0").load()


def test_batch(spark, tmp_path, site):
    name, asked = site
    folder = f"file://{tmp_path}/a"
    assert source(spark.read, folder).count() == 0
    urls = [f"https://{name}.org/{i}" for i in range(50)] + [f"https://{name}.org/missing", f"https://{name}.org/broken"]
    datasource.write_addresses(table(spark, [*urls, *urls, None]), folder, parts=4, lanes=3)
    rows = {r["url"]: r for r in source(spark.read, folder).collect()}
    assert sorted(rows) == sorted(urls) and sorted(asked()) == sorted(urls)
    assert bytes(rows[urls[7]]["body"]) == urls[7].encode() and rows[urls[7]]["host"] == f"{name}.org"
    assert (rows[urls[50]]["status"], rows[urls[50]]["error"]) == (404, "HTTP 404")
    assert (rows[urls[51]]["status"], rows[urls[51]]["error"]) == (None, "no route")
    with pytest.raises(ValueError, match="not parts=4,lanes=1"):
        datasource.write_addresses(table(spark, urls), folder, parts=4)


def test_filters_decide_what_is_asked(spark, tmp_path, site):
    name, asked = site
    folder = f"file://{tmp_path}/a"
    datasource.write_addresses(table(spark, [f"https://{name}.org/{p}/{i}" for p in "ab" for i in range(20)]), folder, parts=4, lanes=2)
    rows = source(spark.read, folder)
    assert rows.where(F.col("url").startswith(f"https://{name}.org/a/1") & (F.col("host") == f"{name}.org") & (F.col("status") == 200)).count() == 11
    assert len(asked()) == 11
    assert rows.where(F.col("url").isin(f"https://{name}.org/b/3", "x")).count() == 1
    assert rows.where("host = 'other.org'").count() == 0
    assert len(asked()) == 12


def test_a_host_and_lane_are_in_one_part(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    for k in range(3):
        datasource.write_addresses(table(spark, [f"https://h{h}.org/{k}/{i}" for h in range(5) for i in range(20)]), folder, parts=7, lanes=2)
    rows = spark.read.parquet(f"{folder}/parts=7,lanes=2")
    assert rows.count() == 300 and rows.groupBy("host", "lane").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    reader = datasource.FetchReader({"path": folder, "transport": "x:y"})
    assert [len(p.folders) for p in reader.partitions()] == [3] * len(reader.partitions())


def test_a_restarted_stream_asks_for_what_is_new(spark, tmp_path, site):
    name, asked = site
    folder, out = f"file://{tmp_path}/a", f"{tmp_path}/out"

    def run():
        q = source(spark.readStream, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    first, second = ([f"https://{name}.org/{k}/{i}" for i in range(10)] for k in "ab")
    datasource.write_addresses(table(spark, first), folder, parts=3)
    run()
    assert sorted(asked()) == sorted(first)
    datasource.write_addresses(table(spark, second), folder, parts=3)
    os.makedirs(f"{tmp_path}/a/parts=3,lanes=1/batch=00000002/part=0")  # a batch that is still being written
    run()
    run()
    assert sorted(asked()) == sorted(first + second)
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == sorted(first + second)


def files(folder):
    return sorted(os.path.relpath(os.path.join(top, n), folder) for top, _, names in os.walk(folder) for n in names if not n.endswith(".crc"))


def test_page_files(spark, tmp_path):
    rows = [(f"pages/p{i}/index.html", f"<p>ä{i}</p>") for i in range(40)] + [(None, "x"), ("pages/none", None)]
    pages = spark.createDataFrame(rows, "local_path string, html string").repartition(5)
    for _ in range(2):  # a second run replaces
        pages.write.format("page_files").option("path", f"file://{tmp_path}/o").mode("append").save()
    assert files(f"{tmp_path}/o") == sorted([r[0] for r in rows[:40]] + ["_SUCCESS"])
    assert open(f"{tmp_path}/o/pages/p7/index.html", encoding="utf-8").read() == "<p>ä7</p>"
    pages.where("false").write.format("page_files").option("path", f"{tmp_path}/none").mode("append").save()
    assert files(f"{tmp_path}/none") == ["_SUCCESS"]


@pytest.mark.parametrize("bad", ["../out.html", "/etc/out.html", "a/../../out.html"])
def test_a_run_that_fails_leaves_no_file(spark, tmp_path, bad):
    rows = spark.createDataFrame([(f"p{i}.html", "x") for i in range(30)] + [(bad, "x")], "local_path string, html string").repartition(4)
    with pytest.raises(Exception, match="outside of the folder"):
        rows.write.format("page_files").option("path", f"{tmp_path}/o").mode("append").save()
    assert files(str(tmp_path)) == []
