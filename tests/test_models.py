"""Backends that need more than a table: ONNX models, made here."""

import numpy as np
import pytest

from ruleweave import compile_str
from ruleweave.errors import RuleweaveError
from ruleweave.operators import models

WORDS = {"[UNK]": 0, "cat": 1, "dog": 2, "car": 3, "the": 4}
TABLE = np.array([[0, 0, 1], [1, 0.1, 0], [0.9, 0.2, 0], [0, 1, 0], [0.1, 0.1, 0.1]], np.float32)


def field(number, value):
    """A field of a protocol buffer: a number, or bytes with their length."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.fixture
def folder(tmp_path):
    """A model whose token vectors are rows of TABLE, and a tokenizer of five words."""
    from tokenizers import Tokenizer, models as kinds, pre_tokenizers

    shape = lambda *dims: field(2, b"".join(field(1, field(2, d)) for d in dims))
    value = lambda name, kind, *dims: field(1, name) + field(2, field(1, field(1, kind) + shape(*dims)))
    table = field(1, 5) + field(1, 3) + field(2, 1) + field(8, "table") + field(9, TABLE.tobytes())
    node = field(1, "table") + field(1, "input_ids") + field(2, "last_hidden_state") + field(4, "Gather")
    graph = field(1, node) + field(2, "g") + field(5, table) + field(11, value("input_ids", 7, "b", "s")) + field(11, value("attention_mask", 7, "b", "s")) + field(12, value("last_hidden_state", 1, "b", "s", "d"))
    (tmp_path / "model.onnx").write_bytes(field(1, 8) + field(7, graph) + field(8, field(2, 13)))
    tokenizer = Tokenizer(kinds.WordLevel(WORDS, "[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    return str(tmp_path)


def test_onnx_vectors_are_means_of_tokens(folder):
    texts = ["cat", "", "the dog the car", "car", "what", *["the cat"] * 40]
    got = models.OnnxEmbedder(folder, batch=4).embed(texts)
    for t, v in zip(texts, got):
        rows = TABLE[[WORDS.get(w, 0) for w in t.split()]]
        mean = rows.mean(axis=0) if t else rows
        assert v == pytest.approx((mean / np.linalg.norm(mean)).tolist() if t else [], abs=1e-6)
    assert models.OnnxEmbedder(folder, max_tokens=1).embed(["cat car"])[0] == pytest.approx(got[0], abs=1e-6)
    with pytest.raises(RuleweaveError):
        models.OnnxEmbedder(folder + "/none").embed(["cat"])


def test_onnx_in_rules(spark, folder):
    rules = compile_str('rule near { similarity: $s = "cat" threshold=0.95 matcher=onnx cleaner=no_op chunker=no_chunking\n condition: $s }\nrule like { classifier: $c = "dog" threshold=0.95 classifier=onnx cleaner=no_op chunker=no_chunking\n condition: $c }')
    embedder = models.OnnxEmbedder(folder)
    rules.register_semantic_matcher("onnx", embedder)
    rules.register_classifier("onnx", models.EmbeddingClassifier(embedder))
    df = spark.createDataFrame([(1, "dog"), (2, "car"), (3, "cat cat")], "i long, text string")
    got = {r.i: (r.near, r.like) for r in rules.scan(df, output="wide").collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (True, True)}


def test_pattern_is_embedded_once_on_the_driver(spark):
    class Counter:
        """Counts what it is asked, in this process."""

        def __init__(self):
            self.met = []

        def embed(self, texts):
            self.met += texts
            return [[float(len(t)), 1.0] for t in texts]

    counter = Counter()
    rules = compile_str('rule r { similarity: $s = "abc" threshold=0.9 matcher=counter cleaner=no_op chunker=no_chunking\n condition: $s }')
    rules.register_semantic_matcher("counter", counter)
    df = spark.createDataFrame([(i, "abcd") for i in range(100)], "i long, text string")
    assert rules.scan(df, output="matched").count() == 100 and counter.met == ["abc"]
