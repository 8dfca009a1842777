import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from people import SCHEMA, frame, links, row

from kinfold.operators.resolve import assign_clusters
from kinfold.sources.records import read_github
from kinfold.streaming.incremental import fuse_stream, state

ROWS = [
    row(1, full_name="Ann Lee", emails=["a@x.org"]), row(2, emails=["b@x.org"]), row(3, full_name="Bob Ray"), row(4, emails=["c@x.org"], phones=["5551234567"]),
    row(5, emails=["a@x.org", "b@x.org"]), row(6, full_name="bob ray", links=links("linkedin.com/in/b")), row(7, phones=["555-123-4567"]), row(8, emails=["b@x.org", "c@x.org"]),
]


def test_stream_gives_the_clusters_of_a_batch(spark, tmp_path):
    for i in range(0, 8, 2):
        frame(spark, ROWS[i : i + 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = fuse_stream(stream, str(tmp_path / "state"), available_now=True)
    query.awaitTermination(300)
    assert query.exception() is None
    last = max(p["batchId"] for p in query.recentProgress)
    got = {r.rec_idx: r.cluster_id for r in state(spark, str(tmp_path / "state"), last).collect()}
    want = {r.rec_idx: r.cluster_id for r in assign_clusters(frame(spark, ROWS)).collect()}
    assert got == want and len(set(got.values())) == 2


class Api(BaseHTTPRequestHandler):
    def do_GET(self):
        found = {"/users/ann": {"login": "ann", "name": "Ann Lee"}, "/users/ann/repos?per_page=100&sort=updated": [{"name": "x", "language": "Go"}], "/users/bob": {"login": "bob"}}.get(self.path)
        self.send_response(200 if found is not None else 404)
        self.end_headers()
        self.wfile.write(json.dumps(found).encode())

    def log_message(self, *args):
        pass


def test_live_profiles(spark):
    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.conf.set("kinfold.profile_api", f"http://127.0.0.1:{server.server_port}")
    try:
        got = {r.full_name: r for r in read_github(spark, ["ann", "nobody", "bob"]).collect()}
    finally:
        spark.conf.unset("kinfold.profile_api")
        server.shutdown()
    assert set(got) == {"Ann Lee", "bob"} and got["Ann Lee"].skills == ["Go"] and got["bob"].links.github == "https://github.com/bob"
