import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleweave.errors import ChatError, PerceptualHashError
from ruleweave.functions import chunkers, cleaners, hashing, jpeg, vectors
from ruleweave.functions.chat_text import answer_explanation, answer_matches, prompt, read_answer, read_completion
from ruleweave.operators import models

TEXTS = ["hello ١٢٣ world", "test 123 value", "data ०१२ end", "ﬁne ＡＢ", "ΟΔΟΣ", "a  b\t\nc ", "Hi... there", "A b. C! d? e", "one\n\ntwo\n\n \n\nthree", "   ", "", "a_b ²x Ⅷ", " ".join(map(str, range(1000)))]


@pytest.mark.parametrize("name", list(cleaners.CLEANERS))
def test_cleaners_agree_with_python(spark, name):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", cleaners.CLEANERS[name](F.col("t")).alias("c")).collect()}
    assert got == {i: cleaners.clean_text(name, t) for i, t in enumerate(TEXTS)}


def test_cleaner_values():
    clean = cleaners.clean_text
    assert [clean("aggressive_cleaning", t) for t in TEXTS[:3]] == ["hello world", "test value", "data end"]
    assert clean("default_cleaning", "ﬁne ＡＢ") == "fine ab" and clean("default_cleaning", "ΟΔΟΣ") == "οδος"


@pytest.mark.parametrize("name", list(chunkers.CHUNKERS))
def test_chunkers_agree_with_python(spark, name):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", chunkers.CHUNKERS[name](F.col("t")).alias("c")).collect()}
    assert got == {i: chunkers.chunk_text(name, t) for i, t in enumerate(TEXTS)}


def test_chunker_values(spark):
    one = lambda chunker, t: spark.createDataFrame([(t,)], "t string").select(chunker(F.col("t"))).first()[0]
    assert one(chunkers.word_chunker(0), "a b c") == ["a b c"]
    assert one(chunkers.word_chunker(2), "a b c d e") == ["a b", "c d", "e"]
    assert one(chunkers.fixed_size_chunker(3, 1), "a b c d e") == ["a b c", "c d e", "e"]
    assert one(chunkers.fixed_size_chunker(2, 2), "a b c") == ["a b", "b c", "c"]
    assert one(chunkers.sentence_chunking, "Hi... there") == ["Hi.", ".", ".", "there"]
    assert one(chunkers.paragraph_chunking, " \n\n ") == [" \n\n "]


def test_cosine(spark):
    cases = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0), ([0.95, 0.1, 0.0], [1.0, 0.0, 0.0], 0.9945)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a array<double>, b array<double>").coalesce(1)
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    for (a, b, want), g in zip(cases, got):
        assert g == pytest.approx(want, abs=1e-4) and vectors.cosine_of(a, b) == pytest.approx(want, abs=1e-4)


def test_hamming(spark):
    df = spark.createDataFrame([(0, 15), (7, 7), (0, -1)], "a long, b long").coalesce(1)
    rows = df.select(vectors.hamming(F.col("a"), F.col("b")), vectors.hash_similarity(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(4, 1 - 4 / 64), (0, 1.0), (64, 0.0)]


def wav(samples, channels=1, width=2, before=b"", claim=None):
    data = b"".join(int(s).to_bytes(width, "little", signed=width > 1) * channels for s in samples)
    fmt = struct.pack("<HHIIHH", 1, channels, 44100, 44100 * channels * width, channels * width, 8 * width)
    chunks = before + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data) if claim is None else claim) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def png(gray):
    gray = np.asarray(gray, np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in gray)
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


SAMPLES = [1000 * i % 32767 for i in range(4410)]
RAMP = np.tile(np.arange(32) * 255 // 31, (32, 1))


def test_audio_hash():
    assert hashing.audio_hash(wav(SAMPLES)) == hashing.audio_hash(wav(SAMPLES, channels=2)) != 0
    assert hashing.audio_hash(wav(SAMPLES, before=b"LIST" + struct.pack("<I", 3) + b"abc\0")) == hashing.audio_hash(wav(SAMPLES))
    assert hashing.audio_hash(wav([])) == 0
    assert hashing.audio_hash(wav(range(65, 0, -1), width=4)) == -1
    assert hashing.audio_hash(wav(range(65, 0, -1), width=1)) == -1
    for bad in (b"no", b"RIFFxxxxWAVX" + b"\0" * 40, wav(SAMPLES, claim=512 << 20)):
        with pytest.raises(PerceptualHashError):
            hashing.audio_hash(bad)


def test_video_hash():
    up = bytes(range(256))
    assert hashing.video_hash(b"") == 0 and hashing.video_hash(b"x") == 0
    assert hashing.video_hash(up) == 0 and hashing.video_hash(up[::-1]) == -1


def test_image_hash():
    up, down = hashing.image_hash(png(RAMP)), hashing.image_hash(png(RAMP[:, ::-1]))
    assert up == 0 and down == -1
    ppm = b"P6 32 32 255\n" + np.repeat(RAMP.astype(np.uint8)[..., None], 3, axis=2).tobytes()
    assert hashing.image_hash(ppm) == up
    with pytest.raises(PerceptualHashError):
        hashing.image_hash(png(RAMP), size=9)
    with pytest.raises(PerceptualHashError):
        hashing.image_hash(b"GIF89a")


def test_png_filters():
    rng = np.random.default_rng(0)
    gray = rng.integers(0, 256, (5, 7)).astype(int)
    lines = b""
    for y in range(5):
        left = np.concatenate([[0], gray[y, :-1]])
        up = gray[y - 1] if y else np.zeros(7, int)
        corner = np.concatenate([[0], up[:-1]])
        guess = {0: 0, 1: left, 2: up, 3: (left + up) // 2}.get(y)
        if y == 4:
            q = left + up - corner
            guess = [min((abs(q[i] - left[i]), 0, left[i]), (abs(q[i] - up[i]), 1, up[i]), (abs(q[i] - corner[i]), 2, corner[i]))[2] for i in range(7)]
        lines += bytes([y]) + ((gray[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + b"\0\0\0\0"
    content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines))
    assert (hashing.decode(content) == gray).all()


ANSWERS = {"YES: it does": (True, "it does"), "YES": (True, "LLM matched"), " no : a: b ": (False, "a: b"), "NO": (False, "LLM did not match"), "Yesterday: x": (False, "Ambiguous LLM response: Yesterday: x"), "Notable": (False, "Ambiguous LLM response: Notable"), "YES, 1: x": (True, "x"), "maybe": (False, "Ambiguous LLM response: maybe")}


def test_answers(spark):
    df = spark.createDataFrame([(a,) for a in ANSWERS], "a string").coalesce(1)
    rows = df.select("a", answer_matches(F.col("a")), answer_explanation(F.col("a"))).collect()
    for a, yes, why in rows:
        assert (yes, why) == ANSWERS[a] == read_answer(a)


def test_completions():
    ok = lambda content, finish="stop": {"choices": [{"finish_reason": finish, "message": {"content": content}}]}
    assert read_completion(ok("YES")) == "YES" and read_completion(ok("YES", "length")) == "YES"
    with pytest.raises(ChatError, match="truncated"):
        read_completion(ok(" ", "length"))
    for bad in (ok(""), {}, {"choices": []}, ok(None)):
        with pytest.raises(ChatError):
            read_completion(bad)


def test_chat_config():
    c = models.ChatConfig(extra_body={"temperature": 1, "top_p": 0.5})
    body = c.body("q")
    assert list(body)[:5] == ["model", "messages", "temperature", "max_tokens", "stream"]
    assert (body["temperature"], body["top_p"], body["reasoning_effort"], body["max_tokens"]) == (1, 0.5, "none", 8192)
    assert "reasoning_effort" not in models.ChatConfig(reasoning_effort=None).body("q")
    assert "secret" not in repr(models.ChatConfig(api_key="secret"))
    with pytest.raises(ChatError):
        models.ChatConfig(endpoint="nowhere")
    with pytest.raises(ChatError):
        models.LocalNeuralChat("x")
    assert "<pattern>p</pattern>" in prompt("p", "t") and "<input>t</input>" in prompt("p", "t")


def test_chat_config_from_env():
    read = models.chat_config_from_env
    assert read({}).endpoint == "http://localhost:1234/v1/chat/completions"
    assert read({"OPENAI_BASE_URL": "https://x/v1/", "OPENAI_MODEL": "m", "OPENAI_API_KEY": "k"}) == models.ChatConfig("https://x/v1/chat/completions", "m", "k")
    assert read({"RULEWEAVE_LLM_ENDPOINT": "http://a", "OPENAI_BASE_URL": "http://b"}).endpoint == "http://a"
    assert read({"RULEWEAVE_LLM_REASONING_EFFORT": ""}).reasoning_effort is None
    assert read({"RULEWEAVE_LLM_NO_ENV": "1", "OPENAI_MODEL": "m"}).model == "local-model"


@pytest.mark.parametrize("name", sorted(cleaners.CLEANERS))
def test_white_space_agrees_with_python(spark, name):
    texts = ["a\x1cb  \x1f c", " x y\u0085", "\x1d", " 　 ", "", "one\x1e\x1etwo. three\x1c! four\n\n\x1d five"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(cleaners.CLEANERS[name](F.col("t"))).collect()]
    assert got == [cleaners.clean_text(name, t) for t in texts]
    for chunker, f in chunkers.CHUNKERS.items():
        assert [r[0] for r in df.select(f(F.col("t"))).collect()] == [chunkers.chunk_text(chunker, t) for t in texts]


def test_connections_are_kept_and_renewed():
    import http.server
    import threading

    met = []

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            met.append(self.client_address)
            self.send_response(500 if b"fail" in body else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
            self.close_connection = b"close" in body

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1/x?y=1"
    for word in ("a", "b", "close", "c"):
        assert models.post_json(url, {"w": word}, {}, 5) == {"w": word}
    assert met[0] == met[1] == met[2] != met[3]
    with pytest.raises(OSError):
        models.post_json(url, {"w": "fail"}, {}, 5)
    server.shutdown()
    with pytest.raises(OSError):
        models.post_json("http://127.0.0.1:9/none", {}, {}, 1)


@pytest.mark.parametrize("kind, size", [("gray", (40, 61)), ("colour", (48, 64)), ("colour", (33, 17))])
def test_jpeg_against_the_jvm(spark, kind, size):
    """Files that the JVM's encoder writes, and the pixels that its decoder reads."""
    height, width = size
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 10 if kind == "gray" else 1)
    y, x = np.mgrid[:height, :width]
    waves = [(127 + 120 * np.sin(x / 9 + k) * np.cos(y / (7 + k))).astype(int) for k in range(3)]
    for i in range(height):
        for j in range(width):
            image.setRGB(j, i, int(sum(int(w[i, j]) << s for w, s in zip(waves if kind == "colour" else waves[:1] * 3, (16, 8, 0)))))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    content = bytes(out.toByteArray())
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(content))
    got = jpeg.decode(content)
    assert got.shape == (height, width, 1 if kind == "gray" else 3)
    if kind == "gray":
        want = np.array([[read.getRaster().getSample(j, i, 0) for j in range(width)] for i in range(height)])
        assert np.abs(got[..., 0].astype(int) - want).max() <= 1
    else:
        want = np.array([[[(read.getRGB(j, i) >> s) & 255 for s in (16, 8, 0)] for j in range(width)] for i in range(height)])
        assert np.abs(got.astype(int) - want).mean() < 6  # colour differences are not smoothed here
    gray = want if kind == "gray" else hashing.luma(want)
    assert bin((hashing.image_hash(content) ^ hashing.gradient_hash(gray)) & (1 << 64) - 1).count("1") <= 3
    for broken in (content[:100], content[: len(content) // 2], content[:2] + b"\x00" * 50):
        with pytest.raises(PerceptualHashError):
            hashing.image_hash(broken)
