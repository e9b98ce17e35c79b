"""Model backends: embedders, classifiers and chat models behind small protocols.

Backends are pickled to executors; clients and sessions are made there, on first use. `embed`, `score`
and `ask` take lists, so that a backend can batch.
"""

from __future__ import annotations

import http.client
import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import xxhash

from ..errors import ChatError, ClassifierError, RuleweaveError, SemanticError
from ..functions.chat_text import prompt, read_answer, read_completion
from ..functions.vectors import cosine_of
from ..shipping import Cache


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[Sequence[float]]:
        """A vector for each text; an empty one where there is none."""


class Classifier(Protocol):
    def score(self, pattern: str, texts: Sequence[str]) -> list[float]: ...


class Chat(Protocol):
    def ask(self, pattern: str, texts: Sequence[str]) -> list[tuple[bool, str]]: ...


# -- tables and rules: deterministic backends ----------------------------------------------------


@dataclass(frozen=True)
class TableEmbedder:
    """Vectors from a mapping; other texts have a zero vector."""

    table: Mapping[str, Sequence[float]]
    size: int = 3

    def embed(self, texts):
        return [self.table.get(t, [0.0] * self.size) for t in texts]


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed hashed counts of words and their character trigrams, of unit length."""

    size: int = 64

    def embed(self, texts):
        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in t.lower().split():
                for part in (w, *(f" {w} "[i : i + 3] for i in range(len(w)))):
                    h = xxhash.xxh64_intdigest(part)
                    v[h % self.size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist() if t else [])
        return out


@dataclass(frozen=True)
class TableClassifier:
    """Scores from a mapping of (pattern, text); 0 for others."""

    table: Mapping[tuple[str, str], float]

    def score(self, pattern, texts):
        return [float(self.table.get((pattern, t), 0.0)) for t in texts]


@dataclass(frozen=True)
class EmbeddingClassifier:
    """The cosine of two embeddings; 0 where either is empty."""

    embedder: Embedder

    def score(self, pattern, texts):
        try:
            first, *rest = self.embedder.embed([pattern, *texts])
        except RuleweaveError as e:
            raise ClassifierError(str(e)) from None
        return [cosine_of(first, v) for v in rest]


@dataclass(frozen=True)
class TableChat:
    """Answers from a mapping of (pattern, text); others do not match."""

    table: Mapping[tuple[str, str], tuple[bool, str]]

    def ask(self, pattern, texts):
        return [self.table.get((pattern, t), (False, t)) for t in texts]


@dataclass(frozen=True)
class FunctionChat:
    """Answers of a Python function of (pattern, text)."""

    function: Callable[[str, str], tuple[bool, str]]

    def ask(self, pattern, texts):
        return [self.function(pattern, t) for t in texts]


# -- HTTP -----------------------------------------------------------------------------------


#: Fixed: seconds to wait for a connection.
CONNECT_TIMEOUT = 10.0
#: Open connections of this process, by scheme and host.
_CONNECTIONS = Cache()


def post_json(url: str, body: dict, headers: Mapping[str, str], timeout: float, connect: float = CONNECT_TIMEOUT) -> dict:
    """POST and read JSON, over a connection that is kept; statuses other than 2xx raise OSError."""
    parts = urllib.parse.urlsplit(url)
    headers = {"Content-Type": "application/json", **headers}
    if parts.scheme in urllib.request.getproxies() and not urllib.request.proxy_bypass(parts.netloc):
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as response:
            return json.load(response)
    where = parts.scheme, parts.netloc
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    while True:
        kept = _CONNECTIONS.pop(where, None)
        line = kept or {"http": http.client.HTTPConnection, "https": http.client.HTTPSConnection}[parts.scheme](parts.netloc, timeout=min(connect, timeout))
        try:
            if not kept:
                line.connect()
            line.sock.settimeout(timeout)
            line.request("POST", path, json.dumps(body).encode(), headers)
            response = line.getresponse()
            data = response.read()
        except (http.client.HTTPException, OSError) as e:
            line.close()
            if kept and isinstance(e, (http.client.RemoteDisconnected, http.client.CannotSendRequest, ConnectionError)):
                continue  # the other side has closed it since
            raise e if isinstance(e, OSError) else OSError(f"{type(e).__name__}: {e}") from None
        if response.will_close:
            line.close()
        else:
            _CONNECTIONS[where] = line
        if not 200 <= response.status < 300:
            raise urllib.error.HTTPError(url, response.status, response.reason, response.headers, None)
        return json.loads(data)


@dataclass(frozen=True)
class HttpEmbedder:
    """An embeddings endpoint. `style` openai reads data[0].embedding, ollama reads embeddings[0]."""

    endpoint: str = "http://localhost:1234/v1/embeddings"
    model: str = "text-embedding-3-small"
    style: str = "openai"
    timeout: float = 30.0
    headers: Mapping[str, str] = field(default_factory=dict, repr=False)

    def embed(self, texts):
        known: dict[str, list[float]] = {"": []}
        return [known[t] if t in known else known.setdefault(t, self._one(t)) for t in texts]

    def _one(self, text: str) -> list[float]:
        try:
            found = post_json(self.endpoint, {"model": self.model, "input": text}, self.headers, self.timeout)
            return found["data"][0]["embedding"] if self.style == "openai" else found["embeddings"][0]
        except (OSError, ValueError, KeyError, IndexError, TypeError) as e:
            raise SemanticError(f"{self.endpoint}: {e}") from None


@dataclass(frozen=True)
class ChatConfig:
    """How a chat endpoint is asked. Keys and headers stay out of repr, plans and logs."""

    endpoint: str = "http://localhost:1234/v1/chat/completions"
    model: str = "local-model"
    api_key: str | None = field(default=None, repr=False)
    temperature: float = 0.0
    max_tokens: int = 8192
    system_prompt: str = "You judge whether texts match a pattern. Answer YES or NO with a brief reason."
    headers: Mapping[str, str] = field(default_factory=dict, repr=False)
    reasoning_effort: str | None = "none"
    extra_body: Mapping[str, object] = field(default_factory=dict)
    timeout: float = 60.0
    style: str = "openai"

    def __post_init__(self) -> None:
        if not self.endpoint.startswith(("http://", "https://")):
            raise ChatError(f"endpoint {self.endpoint!r} is not an HTTP URL")
        if self.timeout <= 0 or self.max_tokens <= 0:
            raise ChatError("timeout and max_tokens must be positive")

    def body(self, text: str) -> dict:
        """The request; entries of extra_body replace others of the same name."""
        messages = [{"role": "system", "content": self.system_prompt}, {"role": "user", "content": text}]
        if self.style == "ollama":
            return {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": self.temperature}} | dict(self.extra_body)
        out = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens, "stream": False}
        if self.reasoning_effort is not None:
            out["reasoning_effort"] = self.reasoning_effort
        return out | dict(self.extra_body)


def chat_config_from_env(env: Mapping[str, str] | None = None) -> ChatConfig:
    """RULEWEAVE_LLM_ENDPOINT, _MODEL, _API_KEY, _REASONING_EFFORT, then OPENAI_BASE_URL, OPENAI_MODEL,
    OPENAI_API_KEY, then a local server. RULEWEAVE_LLM_NO_ENV=1 reads none of them. Read on the driver;
    an empty reasoning effort leaves the field out."""
    env = os.environ if env is None else env
    config = ChatConfig()
    if env.get("RULEWEAVE_LLM_NO_ENV", "").lower() in ("1", "true", "yes"):
        return config
    base = env.get("OPENAI_BASE_URL")
    if base and not base.endswith("/chat/completions"):
        base = base.rstrip("/") + "/chat/completions"
    effort = env.get("RULEWEAVE_LLM_REASONING_EFFORT", config.reasoning_effort)
    return replace(
        config,
        endpoint=env.get("RULEWEAVE_LLM_ENDPOINT") or base or config.endpoint,
        model=env.get("RULEWEAVE_LLM_MODEL") or env.get("OPENAI_MODEL") or config.model,
        api_key=env.get("RULEWEAVE_LLM_API_KEY") or env.get("OPENAI_API_KEY"),
        reasoning_effort=effort or None,
    )


@dataclass(frozen=True)
class HttpChat:
    """A chat endpoint. Equal questions of a batch are asked once if the temperature is 0."""

    config: ChatConfig = field(default_factory=ChatConfig)

    def ask(self, pattern, texts):
        known: dict[str, tuple[bool, str]] = {}
        out = []
        for t in texts:
            if t not in known or self.config.temperature != 0:
                known[t] = self._one(pattern, t)
            out.append(known[t])
        return out

    def _one(self, pattern: str, text: str) -> tuple[bool, str]:
        if not pattern or not text:
            return False, "Empty input"
        c = self.config
        headers = dict(c.headers) | ({"Authorization": f"Bearer {c.api_key}"} if c.api_key else {})
        try:
            found = post_json(c.endpoint, c.body(prompt(pattern, text)), headers, c.timeout)
        except (OSError, ValueError) as e:
            raise ChatError(f"{c.endpoint}: {e}") from None
        if c.style == "ollama":
            try:
                return read_answer(found["message"]["content"])
            except (KeyError, TypeError, AttributeError):
                raise ChatError("response has no message.content") from None
        return read_answer(read_completion(found))


class LocalNeuralChat:
    """Local generation is not supported; making one says so."""

    def __init__(self, *_: object) -> None:
        raise ChatError("local neural chat models are not supported; use an HTTP endpoint")


# -- ONNX -----------------------------------------------------------------------------------


_SESSIONS = Cache()


def _onnx(folder: str):
    import onnxruntime
    from tokenizers import Tokenizer

    if folder not in _SESSIONS:
        tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        _SESSIONS[folder] = tokenizer, onnxruntime.InferenceSession(f"{folder}/model.onnx", providers=["CPUExecutionProvider"])
    return _SESSIONS[folder]


@dataclass(frozen=True)
class OnnxEmbedder:
    """A sentence encoder in a folder with tokenizer.json and model.onnx, loaded once per worker. Token
    vectors are averaged under the attention mask and scaled to unit length."""

    folder: str
    max_tokens: int = 256

    #: Texts of about the same length that go through the model together.
    batch: int = 32

    def embed(self, texts):
        out: list[list[float]] = [[] for _ in texts]
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        try:
            tokenizer, session = _onnx(self.folder)
            found = dict(zip(some, tokenizer.encode_batch([texts[i] for i in some])))
            some = sorted((i for i in some if found[i].ids), key=lambda i: len(found[i].ids))
            for k in range(0, len(some), self.batch):
                part = some[k : k + self.batch]
                for i, vector in zip(part, self._vectors(session, [found[i] for i in part])):
                    out[i] = vector.tolist()
        except Exception as e:
            raise SemanticError(f"{self.folder}: {e}") from None
        return out

    def _vectors(self, session, found) -> np.ndarray:
        """Unit vectors of tokenized texts; shorter ones are padded, and the mask leaves that out."""
        size = min(self.max_tokens, max(len(e.ids) for e in found))
        fill = lambda values: np.array([[*v[:size], *[0] * (size - len(v))] for v in values], np.int64)
        feeds = {"input_ids": fill(e.ids for e in found), "attention_mask": fill(e.attention_mask for e in found), "token_type_ids": fill(e.type_ids for e in found)}
        wanted, names = {i.name for i in session.get_inputs()}, [o.name for o in session.get_outputs()]
        hidden = session.run(["last_hidden_state" if "last_hidden_state" in names else names[0]], {k: v for k, v in feeds.items() if k in wanted})[0]
        mask = feeds["attention_mask"][:, :, None].astype(np.float32)
        mean = (hidden * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1e-9)
        return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
