import http.client
import json
import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from millrace.__main__ import main
from millrace.plans import fixtures, scoring
from millrace.plans import graph as g
from millrace.sources import models
from millrace.streaming import http as endpoint

MODEL = fixtures.linear(6, 4)


def test_batcher_answers_all_in_batches():
    batcher = endpoint.Batcher(MODEL, 6, 8, 20_000)
    rows = np.random.default_rng(1).uniform(-1, 1, (50, 6)).astype(np.float32)
    answers = [batcher.enqueue(r) for r in rows]
    got = np.array([a.result(10) for a in answers])
    assert np.abs(got - scoring.run_batch(MODEL, rows)).max() < 1e-4
    with pytest.raises(ValueError):
        batcher.enqueue(rows[0][:5])
    last = batcher.enqueue(rows[0])
    batcher.stop()
    assert last.done() and batcher.requests == 51 and batcher.largest <= 8 and batcher.batches < 51
    with pytest.raises(RuntimeError):
        batcher.enqueue(rows[0])


def test_errors_reach_every_caller():
    broken = g.Model(g.Graph([g.Node("fc", "Gemm", ["x", "w"], ["y"])], ["x"], ["y"]), {"w": np.ones((5, 2), np.float32)})
    batcher = endpoint.Batcher(broken, 6, 4, 1000)
    answers = [batcher.enqueue(np.zeros(6, np.float32)) for _ in range(4)]
    assert all(isinstance(a.exception(10), ValueError) for a in answers)
    batcher.stop()


def test_endpoint():
    batcher = endpoint.Batcher(MODEL, 6, 4, 5000)
    server = endpoint.server(batcher, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None, headers=None):
        connection = http.client.HTTPConnection("127.0.0.1", server.server_address[1], timeout=10)
        connection.request(method, path, body, headers or {})
        r = connection.getresponse()
        return r.status, r.read()

    try:
        x = np.array([1, 0, -1, 0.5, 2, -0.25], "<f4")
        with ThreadPoolExecutor(8) as pool:
            answers = list(pool.map(lambda _: ask("POST", "/infer", x.tobytes()), range(20)))
        assert all(a == (200, b'{"prediction":3,"logits":[0.185000,0.252500,0.287500,0.355000]}') for a in answers)
        assert ask("GET", "/health") == (200, b'{"status":"ok"}')
        assert ask("POST", "/infer", bytes(6))[0] == 200
        assert [ask("POST", "/infer", b)[0] for b in (b"123", np.full(6, np.nan, "<f4").tobytes(), b"")] == [400] * 3
        assert [ask(*r)[0] for r in (("GET", "/"), ("POST", "/health"), ("PUT", "/infer"))] == [404] * 3
        assert ask("POST", "/infer", None, {"Content-Length": str(2 << 20)})[0] == 413
        assert ask("POST", "/infer", None, {"Content-Length": "x"})[0] == 400
        assert ask("GET", "/health", None, {"X-Long": "y" * 9000})[0] == 431
        seen = json.loads(ask("GET", "/metrics")[1])
        assert (seen["requests"], seen["errors"], seen["batched_requests"]) == (21, 3, 21) and seen["max_batch_observed"] <= 4
    finally:
        server.shutdown()
        batcher.stop()


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    pixels, labels = rng.integers(0, 256, (12, 784)), rng.integers(0, 4, 12)
    path, data, image = (str(tmp_path / n) for n in ("m.bin", "set.bin", "image"))
    models.write_model(fixtures.linear(784, 4), path)
    models.write_image_set(data, pixels, labels)
    open(image, "wb").write(pixels[0].astype("u1").tobytes())
    want = scoring.run_batch(fixtures.linear(784, 4), pixels / 255).argmax(axis=1)
    assert main(["inspect", path]) == 0 and "level 1: fc(Gemm)" in capsys.readouterr().out
    assert main(["run", path, image, "--profile"]) == 0 and f"Predicted digit: {want[0]}" in capsys.readouterr().out
    assert main(["eval", path, data, "--batch", "5"]) == 0
    said = capsys.readouterr().out
    assert f"Correct: {(want == labels).sum()}" in said and "Latency p95" in said
    assert main(["inspect", data]) == 1
