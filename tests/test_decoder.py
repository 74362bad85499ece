"""Probe, crops, frames, the command line and the remote extractor, with stand-ins for the ffmpeg tools and the service."""

import json
import sys
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from echotrace.__main__ import main
from echotrace.sources import decoder as decoding
from echotrace.sources.decoder import Decoder
from echotrace.sources.remote import RemoteExtractor, png

SIZE = 8
#: What the tools print for a file that holds the spec of its footage as JSON.
TOOL = '''
import json, sys, numpy as np
args = sys.argv[1:]
spec = json.load(open(args[args.index("-i") + 1] if "-i" in args else args[-1]))
if spec.get("broken"):
    sys.exit("cannot read")
if "-show_streams" in args:
    print(json.dumps({"streams": [] if spec.get("audio") else [{"codec_type": "video", "width": 64, "height": 48, "avg_frame_rate": "25/1"}], "format": {"duration": str(spec["seconds"])}}))
elif "null" in args:
    for c in spec.get("crops", []):
        print("crop=" + c, file=sys.stderr)
else:
    chain, rng = args[args.index("-vf") + 1], np.random.default_rng(spec["seed"])
    if spec.get("undecodable"):
        sys.exit("no decoder")
    keys = "showinfo" in chain
    fps = 1 / spec.get("every", 2) if keys else float(chain.split("fps=")[1].split(",")[0])
    shown = rng.standard_normal((8, 8, 3))
    for i in range(int(spec["seconds"] * fps)):
        shown = 0.9 * shown + 0.5 * rng.standard_normal((8, 8, 3))
        if keys and not spec.get("timeless"):
            print(f"[showinfo] n: {i} pts_time:{i / fps + 0.25} pos: 1", file=sys.stderr, flush=True)
        image = np.clip(128 + 60 * shown, 0, 255).astype(np.uint8)
        sys.stdout.buffer.write((image if i % 5 else image // 255).tobytes())
'''


@pytest.fixture(scope="module")
def footage(tmp_path_factory):
    root = tmp_path_factory.mktemp("footage")
    (root / "tool.py").write_text(TOOL)
    specs = {"a": {"seconds": 60, "seed": 1}, "b": {"seconds": 60, "seed": 1, "x": 0}, "c": {"seconds": 60, "seed": 3, "crops": ["64:48:0:0", "64:30:0:9", "64:30:0:9", "4:4:1:1"]}, "bad": {"seconds": 9, "seed": 4, "undecodable": True}, "sound": {"seconds": 9, "seed": 5, "audio": True}, "broken": {"broken": True}, "dense": {"seconds": 1, "seed": 6, "every": 0.001}}
    (root / "v").mkdir()
    for name, spec in specs.items():
        (root / "v" / f"{name}.mp4").write_text(json.dumps(spec))
    return root


def tools(root):
    return {"ffprobe": (sys.executable, str(root / "tool.py")), "ffmpeg": (sys.executable, str(root / "tool.py"))}


def videos(spark, root, *names):
    return spark.createDataFrame([(i, f"{root}/v/{n}.mp4", 60.0 if n != "dense" else 1.0, 64, 48) for i, n in enumerate(names)], "video_id int, path string, duration double, width int, height int")


def test_probe(spark, footage):
    rows = {r["path"][-7:]: r for r in decoding.probe(videos(spark, footage, "a", "sound", "broken"), Decoder(**tools(footage))).collect()}
    assert rows["v/a.mp4"]["duration"] == 60 and rows["v/a.mp4"]["fps"] == 25 and rows["und.mp4"]["error"] and rows["ken.mp4"]["error"]


def test_frames_at_a_rate(spark, footage):
    rows = decoding.decoded(videos(spark, footage, "a", "bad"), Decoder(size=SIZE, fps=2, **tools(footage))).collect()
    ts = sorted(r["ts"] for r in rows if r["video_id"] == 0)
    assert ts == [i / 2 for i in range(120) if i % 5] and {r["problem"] for r in rows if r["video_id"] == 1} == {"failed"}  # flat frames go, times stay


def test_keyframes_have_their_own_times_and_a_budget(spark, footage):
    rows = decoding.decoded(videos(spark, footage, "a", "dense"), Decoder(size=SIZE, keyframes=True, crop=False, **tools(footage))).collect()
    assert sorted(r["ts"] for r in rows if r["video_id"] == 0) == [2 * i + 0.25 for i in range(30) if i % 5]
    assert [r["problem"] for r in rows if r["video_id"] == 1 and r["pixels"] is None] == ["rejected"]
    timeless = footage / "v2.mp4"
    timeless.write_text(json.dumps({"seconds": 20, "seed": 1, "timeless": True}))
    assert [t for t, _ in decoding.frames_of_file(str(timeless), None, 100, Decoder(size=SIZE, keyframes=True, **tools(footage)))] == [2.0 * i for i in range(10) if i % 5]


def test_crops_and_commands(spark, footage):
    both = videos(spark, footage, "a", "c")
    for keyframes, want in ((True, "crop=64:30:0:9"), (False, "crop=4:4:1:1")):
        d = Decoder(size=SIZE, keyframes=keyframes, **tools(footage))
        assert [tuple(r) for r in decoding.crops(both, d).collect()] == [(1, want)]
        assert d.frame_command("x", want)[d.frame_command("x", want).index("-vf") + 1].startswith(want + ",")


def test_command_line(spark, footage, tmp_path, capsys):
    root, shared = str(tmp_path / "s"), ["--size", str(SIZE), "--dim", "32"]
    run = lambda *a: main([*a[:1], "--root", root, *a[1:]], spark, lambda _: "n", tools(footage))
    assert run("find", f"{footage}/v/a.mp4", *shared) == 1
    assert run("index", f"{footage}/v", *shared, "--no-mirror") == 0
    assert "Indexed 4 new video(s). 1 failed." in capsys.readouterr().out
    assert run("scan", f"{footage}/v", *shared, "--no-mirror", "--json", str(tmp_path / "out.json")) == 0
    assert "a.mp4 <-> b.mp4" in capsys.readouterr().out and len(json.loads((tmp_path / "out.json").read_text())) == 1
    assert run("find", f"{footage}/v/b.mp4", *shared, "--no-mirror") == 0
    assert "b.mp4 <-> a.mp4" in capsys.readouterr().out
    assert run("status") == 0 and "5 video(s)" in capsys.readouterr().out
    assert run("reset") == 1 and run("reset", "-y") == 0 and run("scan") == 1


def test_a_video_with_too_many_keyframes_is_rejected_once(spark, footage, tmp_path, capsys):
    argv = ["index", "--root", str(tmp_path / "s"), f"{footage}/v/dense.mp4", "--keyframes", "--size", str(SIZE)]
    assert main(argv, spark, tools=tools(footage)) == 0 and "1 rejected" in capsys.readouterr().out
    assert main(argv, spark, tools=tools(footage)) == 0 and capsys.readouterr().out.strip() == "Indexed 0 new video(s)."


class Service(BaseHTTPRequestHandler):
    drops, seen = 2, []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append(self.headers["Authorization"])
        if Service.drops:
            Service.drops -= 1
            return self.connection.close()  # no answer
        rows = [{"index": i, "embedding": [float(i), 1.0]} for i in range(len(body["input"]))]
        data = json.dumps({"data": rows[::-1][: 1 if body["model"] == "short" else None]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


def test_remote_extractor():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, images = f"http://127.0.0.1:{server.server_port}/", np.zeros((3, 4, 4, 3), np.uint8)
    assert RemoteExtractor(url, "m", 2, "key").encode(images).tolist() == [[0, 1], [1, 1], [2, 1]] and Service.seen == ["Bearer key"] * 3
    for model, dim in (("m", 5), ("short", 2)):
        with pytest.raises(ValueError):
            RemoteExtractor(url, model, dim).encode(images)
    server.shutdown()
    with pytest.raises(OSError):
        RemoteExtractor("http://127.0.0.1:9", "m", 2).encode(images)
    file = png(np.arange(48, dtype=np.uint8).reshape(4, 4, 3))
    assert zlib.decompress(file[file.index(b"IDAT") + 4 :][: int.from_bytes(file[file.index(b"IDAT") - 4 : file.index(b"IDAT")], "big")])[1:4] == b"\x00\x01\x02"
