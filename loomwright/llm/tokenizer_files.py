"""Tokenizer files as broadcast bytes, and the tokenizers made from them once per Python worker."""

from __future__ import annotations

import base64
import hashlib
import os

_LOADED: dict = {}


class TokenizerFile:
    """A vocabulary file's bytes (a few MB at most) sent to the executors by broadcast, so that
    they need not have the file. ``version`` identifies content and library."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.kind = os.path.splitext(path)[1].lstrip(".")
        if self.kind not in ("json", "model", "tiktoken"):
            raise ValueError(f"unknown tokenizer file: {path}")
        module = {"json": "tokenizers", "model": "sentencepiece", "tiktoken": "tiktoken"}[self.kind]
        self.version = hashlib.sha256(data + f"|{module} {__import__(module).__version__}".encode()).hexdigest()
        self.data = spark.sparkContext.broadcast(data)

    def load(self):
        """The library's tokenizer; for .tiktoken files the ranks."""
        if self.version not in _LOADED:
            _LOADED[self.version] = _load(self.kind, self.data.value)
        return _LOADED[self.version]


def _load(kind: str, data: bytes):
    if kind == "model":
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=data)
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_str(data.decode())
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
