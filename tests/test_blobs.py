"""The blob source against a store in this process that only tests use."""

import json
import threading
import urllib.parse
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sedge.sources import blobs


class Shop(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def answer(self, status, body=b""):
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def act(self):
        s = self.server
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        if self.headers.get("Authorization") != "Bearer secret":
            return self.answer(401)
        path, _, query = self.path.partition("?")
        path = urllib.parse.unquote(path.lstrip("/"))
        with s.lock:
            s.seen.append((self.command, path, query))
            if s.trouble.get(path, 0):
                s.trouble[path] -= 1
                return self.answer(s.status)
            if self.command == "PUT":
                s.count += path not in s.data
                s.data[path] = (s.data.get(path, (s.count - 1,))[0], body)
                return self.answer(200)
            if self.command == "DELETE":
                return self.answer(200 if s.data.pop(path, None) else 404)
            if path:
                return self.answer(200, s.data[path][1]) if path in s.data else self.answer(404)
            q = dict(urllib.parse.parse_qsl(query, keep_blank_values=True))
            if "latest" in q:
                return self.answer(200, json.dumps({"sequence": s.count}).encode())
            rows = [{"pathname": p, "size": len(b), "sequence": n} for p, (n, b) in s.data.items()]
            if "from" in q:
                rows = sorted((r for r in rows if int(q["from"]) <= r["sequence"] < int(q["to"])), key=lambda r: r["sequence"])
            else:
                rows = sorted((r for r in rows if r["pathname"].startswith(q["prefix"]) and r["pathname"] > q["after"] and (not q["until"] or r["pathname"] < q["until"])), key=lambda r: r["pathname"])
            n = min(int(q["limit"]), 7)
            return self.answer(200, json.dumps({"blobs": rows[:n], "more": len(rows) > n}).encode())

    do_GET = do_PUT = do_DELETE = act


def opened():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Shop)
    s.data, s.count, s.seen, s.trouble, s.status, s.lock = {}, 0, [], {}, 503, threading.Lock()
    s.base = f"http://127.0.0.1:{s.server_port}"
    threading.Thread(target=s.serve_forever, daemon=True).start()
    return s


@pytest.fixture
def shop():
    s = opened()
    yield s
    s.shutdown()


@pytest.fixture
def other():
    s = opened()
    yield s
    s.shutdown()


def put(shop, path, body):
    shop.data[path] = (shop.count, body)
    shop.count += 1


@pytest.fixture
def read(spark, shop):
    blobs.register(spark)
    return lambda **o: spark.read.format("blobs").options(**{"base": shop.base, "token": "secret", "wait": 0.01} | o).load()


def write(df, shop, name="up", **o):
    df.write.format("blobs").options(base=shop.base, token="secret", wait=0.01, name=name, **o).mode("append").save()


def test_reads_prefixes_and_splits_in_pages(shop, read):
    for i in range(40):
        put(shop, f"a/{i:02d} é.txt", b"%d" % i)
        put(shop, f"b/{i:02d}", b"")
    want = sorted((p, len(b), b, None) for p, (_, b) in shop.data.items())
    assert sorted(tuple(r) for r in read().collect()) == want
    df = read(prefixes="a/,b/", splits="a/10,a/25 é.txt,b/03")
    assert df.rdd.getNumPartitions() == 5
    assert sorted(tuple(r) for r in df.collect()) == want
    assert read(prefixes="c/").collect() == []


def test_errors_are_rows(shop, read):
    put(shop, "x", b"1")
    put(shop, "y", b"2")
    put(shop, "z", b"3")
    shop.trouble = {"x": 2, "y": 99}
    got = {r.pathname: (r.content, r.error) for r in read(tries=3).collect()}
    assert got == {"x": (b"1", None), "y": (None, "Failed to fetch blob (503)"), "z": (b"3", None)}
    shop.status, shop.trouble = 403, {"z": 1}
    assert {r.pathname: r.error for r in read(tries=3).collect()}["z"] == "Failed to fetch blob (403)"  # not tried again


def test_a_prefix_that_is_asked_for_reaches_the_listing(spark, shop, read):
    for p in ("a/1", "a/2", "b/1"):
        put(shop, p, b"x")
    assert [r.pathname for r in read().filter(F.col("pathname").startswith("a/")).orderBy("pathname").collect()] == ["a/1", "a/2"]
    assert not any(p == "b/1" for _, p, _ in shop.seen)


def rows(spark, n=30, parts=4):
    return spark.range(n).select(F.concat(F.lit("uploads/u 1/"), F.col("id").cast("string"), F.lit(".txt")).alias("pathname"), F.col("id").cast("string").cast("binary").alias("content")).repartition(parts)


def test_a_run_is_published_whole(spark, shop, read):
    write(rows(spark), shop)
    got = read(committed="up").collect()
    assert sorted(int(r.content) for r in got) == list(range(30)) and all(r.pathname.startswith("uploads/u 1/") and r.pathname.endswith(".txt") for r in got)
    assert len([p for p in shop.data if p.startswith("_runs/up/")]) == 1 and read(committed="other").collect() == []
    write(rows(spark, 5, 2), shop)
    assert read(committed="up").count() == 35 and len([p for p in shop.data if p.startswith("uploads/")]) == 35


def test_a_run_that_fails_leaves_nothing_to_see(spark, shop, read):
    write(rows(spark, 3, 1), shop)
    before = {p for p in shop.data if p.startswith("uploads/")}
    bad = rows(spark, 30, 4).withColumn("content", F.when(F.col("pathname").contains("/17."), F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        write(bad, shop)
    assert read(committed="up").count() == 3 and before <= set(shop.data)
    assert len([p for p in shop.data if p.startswith("_runs/")]) == 1


def test_streams_read_and_write_each_blob_once(spark, shop, other, read, tmp_path):
    blobs.register(spark)

    def run():
        source = spark.readStream.format("blobs").options(base=shop.base, token="secret", wait=0.01, per_task=3).load()
        texts = source.filter(F.col("pathname").startswith("in/")).select(F.concat(F.lit("out/"), F.substring("pathname", 4, 99)).alias("pathname"), F.upper(F.col("content").cast("string")).cast("binary").alias("content"))
        q = texts.writeStream.format("blobs").options(base=other.base, token="secret", wait=0.01, tries=1, name="upper").option("checkpointLocation", str(tmp_path)).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for i in range(10):
        put(shop, f"in/{i}.txt", b"text %d" % i)
    run()
    published = lambda: sorted(r.content for r in read(base=other.base, committed="upper").collect())
    assert published() == sorted(b"TEXT %d" % i for i in range(10))
    # the store refuses to publish, the query ends; once it runs again the batch counts once
    put(shop, "in/10.txt", b"text 10")
    batch = sum(p.startswith("_runs/upper/") for p in other.data)
    other.trouble = {f"_runs/upper/batch-{b:012d}": 1 for b in range(batch, batch + 40)}
    with pytest.raises(Exception, match="503"):
        run()
    assert len(published()) == 10
    other.trouble = {}
    run()
    assert published() == sorted(b"TEXT %d" % i for i in range(11))


def test_bodies_of_files(spark, shop):
    put(shop, "a.txt", b"stored")
    shop.trouble = {"busy": 1}
    put(shop, "busy", b"later")
    stamp = datetime(2024, 1, 1)
    files = [(1, f"{shop.base}/a.txt", "data:text/plain;base64,eA==", stamp), (2, f"{shop.base}/none", None, stamp), (3, None, "data:text/plain;base64,eHk=", stamp), (4, "", "junk", stamp), (5, None, None, stamp), (6, f"{shop.base}/busy", None, None), (7, "no address", None, None)]
    df = blobs.with_bodies(spark.createDataFrame(files, "id long, storage_url string, file_data string, at timestamp"), "secret", wait=0.01)
    got = {r.id: (r.content, r.body_error) for r in df.collect()}
    assert got[1] == (b"stored", None) and got[2] == (None, "Failed to fetch blob (404)") and got[3] == (b"xy", None)
    assert got[4] == (None, "Invalid data URI content") and got[5] == (None, "No source payload available for ingestion") and got[6] == (b"later", None)
    assert got[7][0] is None and got[7][1]
    assert blobs.with_bodies(spark.createDataFrame(files[:1], "id long, storage_url string, file_data string, at timestamp"), None, wait=0.01).first().body_error == "Failed to fetch blob (401)"


def test_suffix_as_expression(spark):
    paths = ["uploads/u/1-a.b.txt", "name", "x/.hidden", "dir.d/name", "a/b.", "é/ü.md", "line\nbreak/x.txt"]
    df = spark.createDataFrame([(p, b"body") for p in paths], "p string, b binary")
    got = [r[0] for r in df.select(blobs.suffixed_column(F.col("p"), F.lit("run"), F.col("b"))).collect()]
    assert got == [blobs.suffixed(p, "run", b"body") for p in paths]
