"""Fetching one host by many tasks, state over many batches, glyphs as bitmaps."""

import json
import os
import random
import uuid

from pyspark.sql import functions as F

from weftlake.operators import reports
from weftlake.sources import readers
from weftlake.streaming import incremental


def test_slots_of_lanes_never_meet():
    rng = random.Random(1)
    lanes, delay, epoch, sent = 5, 0.2, 1000.0, []
    for lane in range(lanes):
        now, last = epoch + rng.random() * 9, -1  # tasks start whenever they start
        for _ in range(50):
            last, at = readers.next_slot(now, epoch, delay, lane, lanes, last)
            assert at >= now - 1e-6
            sent.append(at)
            now = max(now, at) + rng.choice([0.0, 0.01, 3.0])  # some answers are slow
    sent.sort()
    assert min(b - a for a, b in zip(sent, sent[1:])) >= delay - 1e-6


def test_one_host_over_many_tasks(spark, tmp_path):
    """A clock that only sleeping moves; each request notes its time and its process's task."""
    folder = str(tmp_path)

    class World:
        now = 50.0

        def clock(self):
            return self.now

        def sleep(self, seconds):
            self.now += seconds

        def get(self, url):
            from pyspark import TaskContext

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                json.dump([self.now, TaskContext.get().partitionId(), url], f)
            return 200, url.encode()

    w = World()
    asked = spark.range(600).select(F.concat(F.lit("https://one.test/p"), "id").alias("url"))
    got = readers.fetch(asked, w.get, hosts=12, delay=0.5, lanes=6, per_lane=50, sleep=w.sleep, clock=w.clock)
    assert got.where("status = 200").count() == 600
    noted = [json.load(open(f"{folder}/{x}")) for x in os.listdir(folder)]
    times = sorted(t for t, _, _ in noted)
    assert len(noted) == 600 and len({p for _, p, _ in noted}) > 2
    # every task starts its own clock at the epoch here, and still no two share a slot
    assert min(b - a for a, b in zip(times, times[1:])) >= 0.5 - 1e-6


def test_failures_are_asked_again(spark, tmp_path):
    folder = str(tmp_path)

    def get(url):
        name = f"{folder}/{url.rsplit('/', 1)[1]}"
        with open(name, "a") as f:
            f.write("x")
        n = os.path.getsize(name)
        if "down" in url:
            raise OSError("down")
        return (503, b"") if "busy" in url and n < 3 else (404, b"") if "none" in url else (200, b"ok")

    asked = spark.createDataFrame([(f"https://e.org/{x}",) for x in ("a", "busy", "none", "down")], "url string")
    got = {r["url"][14:]: (r["status"], r["error"], r["attempts"]) for r in readers.fetch(asked, get, hosts=2, delay=0.0, retries=2).collect()}
    assert got == {"a": (200, None, 1), "busy": (200, None, 3), "none": (404, "HTTP 404", 1), "down": (None, "down", 3)}
    assert {x: os.path.getsize(f"{folder}/{x}") for x in os.listdir(folder)} == {"a": 1, "busy": 3, "none": 1, "down": 3}


def test_files_read_stay_few_over_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MERGE", 4)
    monkeypatch.setattr(incremental, "DEALT", 1)
    folder = str(tmp_path / "state")
    most, want = 0, {}
    for n in range(40):
        rows = [(f"pages/{n}", f"f{n}"), ("pages/hot", f"h{n}")]
        want |= {p: (f, n) for p, f in rows}
        df = spark.createDataFrame([(p, f, n) for p, f in rows], "local_path string, fingerprint string, batch bigint").withColumn("built_at", F.current_timestamp())
        incremental.add_state(df.select("local_path", "fingerprint", "built_at", "batch"), n, folder)
        most = max(most, len(incremental.runs(spark, folder)))
    assert most <= 3 * 3 and incremental.runs(spark, folder)[0] == (0, 15)
    state = incremental.read_state(spark, folder).groupBy("local_path").agg(F.max_by(F.struct("fingerprint", "batch"), "batch").alias("x"))
    assert {r["local_path"]: tuple(r["x"]) for r in state.collect()} == want
    assert incremental.read_state(spark, folder, 39).where("batch >= 39").count() == 0
    # a merged run without its commit mark is not read; runs inside a whole one are not either
    os.makedirs(f"{folder}/run-{0:012d}-{99:012d}")
    assert incremental.runs(spark, folder)[0] == (0, 15)
    open(f"{folder}/run-{0:012d}-{99:012d}/_SUCCESS", "w").close()
    assert incremental.runs(spark, folder) == [(0, 99)]


def test_glyphs_from_bitmaps(spark):
    texts = ["<p>abc é 中\U0001f600", "<p>a\U0010fffd", "<p>", "<p>zz翿耀"]
    pages = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "g int, html string")
    found = {(r["g"], r["glyph"]) for r in reports.glyphs(pages, "html", ["g"]).collect()}
    assert {x for x in found if x[1] != " "} == {(0, c) for c in "abcé中\U0001f600"} | {(1, c) for c in "az\U0010fffd翿耀"}
    many = spark.range(5_000).select(F.concat(F.lit("<p>"), F.decode(F.unhex(F.lpad(F.hex(F.col("id") + 0x4E00), 8, "0")), "UTF-32")).alias("html"))
    assert reports.glyph_maps(many, "html").count() <= 3 and reports.glyphs(many, "html").count() >= 5_000
