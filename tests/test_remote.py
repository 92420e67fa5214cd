import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from velumen.functions import preprocess
from velumen.sources import catalog, remote


class Service(BaseHTTPRequestHandler):
    failures = 0

    def answer(self, body: bytes, status: int = 200):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self.answer(b"bytes of " + self.path.encode(), 404 if self.path == "/gone" else 200)

    def do_POST(self):
        text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["inputs"]
        if Service.failures:
            Service.failures -= 1
            return self.answer(b"busy", 503)
        lines = text.strip().splitlines()
        self.answer(json.dumps([{"input": x, "embedding": [str(len(x)), 1]} for x in lines]).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def address():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_service_is_tried_again(address):
    pauses = []
    Service.failures = 6
    e = remote.RemoteEncoder(address, dim=2, sleep=pauses.append)
    assert np.allclose(e.embed("abc")[0], np.array([3, 1]) / np.sqrt(10)) and len(pauses) == 6 and max(pauses) == 1.0
    Service.failures = 3
    with pytest.raises(OSError):
        remote.RemoteEncoder(address, dim=2, retries=1, sleep=pauses.append).embed("abc")
    Service.failures = 0
    with pytest.raises(ValueError):
        e.predictions("  ")


def test_fetch_and_files(spark, address, tmp_path):
    df = spark.createDataFrame([(1, f"{address}/a"), (2, f"{address}/gone"), (3, None)], "id long, url string")
    got = {r.id: r for r in remote.fetched(df, retries=0).collect()}
    assert bytes(got[1].bytes) == b"bytes of /a" and "404" in got[2].error and got[3].bytes is None
    (tmp_path / "x.bin").write_bytes(b"xyz")
    assert bytes(remote.files(spark, str(tmp_path)).first().content) == b"xyz"
    assert remote.database({}) == "dev" and remote.database({"NODE_ENV": "production"}) == "prod" and remote.database({"DB_SCHEMA": "x"}) == "x"


def test_preprocess():
    grey = np.full((300, 500), 128, dtype=np.uint8)
    out = preprocess.preprocess(preprocess.to_rgb(grey))
    assert out.shape == (3, 256, 256) and np.allclose(out, 128 / 255) and preprocess.preprocess(preprocess.to_rgb(grey), "mobileclip_b").shape == (3, 224, 224)
    ramp = np.repeat(np.arange(8, dtype=np.uint8)[None, :, None] * 30, 8, axis=0)
    assert np.array_equal(preprocess.resize(ramp, 8, 8), ramp) and preprocess.resize(ramp, 4, 4)[0, 0, 0] < preprocess.resize(ramp, 4, 4)[0, 3, 0]
    assert preprocess.to_rgb(np.zeros((2, 2, 4), np.uint8)).shape == (2, 2, 3)
    assert preprocess.to_rgb(np.array([[1]]), np.array([[0, 0, 0], [9, 8, 7]])).tolist() == [[[9, 8, 7]]]


def test_token_ids():
    import public_tokenizers

    ids = preprocess.token_ids(["a cat", "word " * 200], public_tokenizers.path("word_bpe_49k.json"))
    assert ids.shape == (2, 77) and ids[0, 0] == 49406 and ids[0, 3] == 49407 and not ids[0, 4:].any() and ids[1, 76] == 49407


def test_views_and_replacement(spark, tmp_path):
    spark.sql("DROP DATABASE IF EXISTS view_src CASCADE")
    spark.sql("CREATE DATABASE view_src")
    spark.range(4).write.saveAsTable("view_src.t")
    assert catalog.copy_views(spark, {"v": "SELECT id FROM prod.t WITH NO DATA;"}, "prod", "view_src") == ["v"]
    assert spark.table("view_src.v").count() == 4 and catalog.columns(spark, "view_src").where("table = 't'").count() == 1
    spark.sql("DROP DATABASE view_src CASCADE")
    at = str(tmp_path / "d")
    for n in (3, 5):
        catalog.replace_dataset(spark, spark.range(n), at)
        assert spark.read.parquet(at).count() == n
