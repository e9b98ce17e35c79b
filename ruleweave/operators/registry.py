"""Components by the names that rules use."""

from __future__ import annotations

from ..errors import ComponentNotFound
from ..functions.chunkers import CHUNKERS
from ..functions.cleaners import CLEANERS
from ..functions.hashing import HASHERS
from .models import EmbeddingClassifier, HttpChat, HttpEmbedder, chat_config_from_env

KINDS = ("cleaner", "chunker", "matcher", "classifier", "llm", "hasher")


class Registry:
    """Six tables of components. Defaults talk to local servers only when a rule uses them."""

    def __init__(self) -> None:
        chat = chat_config_from_env()
        local = "http://localhost:11434/api/chat"
        self.tables: dict[str, dict[str, object]] = {
            "cleaner": dict(CLEANERS),
            "chunker": dict(CHUNKERS),
            "matcher": {"sbert": HttpEmbedder()},
            "classifier": {"tuned-sbert": EmbeddingClassifier(HttpEmbedder())},
            "llm": {"openai-api-compatible": HttpChat(chat), "ollama": HttpChat(type(chat)(endpoint=local, model="llama3.2", style="ollama", timeout=30.0))},
            "hasher": dict(HASHERS),
        }

    def register(self, kind: str, name: str, component: object) -> None:
        if kind not in KINDS:
            raise ComponentNotFound("kind of component", kind)
        self.tables[kind][name] = component

    def get(self, kind: str, name: str):
        if name not in self.tables[kind]:
            raise ComponentNotFound(kind, name)
        return self.tables[kind][name]
