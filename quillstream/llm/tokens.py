"""Tokenizing whole texts with the tokenizers library, as packed little-endian ids."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np

#: Chunks of text kept by one worker; a full table is begun anew. Memory only, never results.
MEMO_CHUNKS = 600_000
MEMO_WORD_CHARS = 48
MARKS = ".,;:!?#$%&*|"
#: A mark right after a Latin-1 letter: letters and marks are never one pre-token.
AFTER_LETTER = re.compile(r"[.,;:!?#$%&*|](?<=[a-z\u00df-\u00f6\u00f8-\u00ff].)")
CHUNK_CHARS = 1_000_000

_encoders: dict[str, "PackedEncoder"] = {}


def load_definition(path: str) -> str:
    """The tokenizer's JSON, read on the driver; a few MB, whatever the input's size."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoder(definition: str) -> "PackedEncoder":
    """One encoder per worker process and tokenizer, kept between tasks."""
    key = hashlib.sha1(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = PackedEncoder(definition)
    return _encoders[key]


class PackedEncoder:
    """Texts to ids, two bytes an id where the vocabulary allows it, else four.

    The word tokenizer drops white space, so a text's ids are those of its words in order; ids of
    words seen before come from a table. Only ASCII white space splits here: the pre-tokenizer
    never joins across it, and the ids are equal to those of the whole text (tests compare them).
    A tokenizer whose ids depend on white space is used text by text.
    """

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 else np.dtype("<u4")
        probe = ["a b", " a\n\nb ", "a\tb"]
        ids = [e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]
        ab = [x for w in ("a", "b") for x in self.tokenizer.encode(w, add_special_tokens=False).ids]
        self.by_word = all(x == ab for x in ids)
        ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        suffix = json.loads(definition)["model"].get("end_of_word_suffix") or ""
        for token, number in self.tokenizer.get_vocab().items():
            ends[number] = bool(suffix) and token.endswith(suffix)
        self.ends = ends
        self.by_part = self.by_word and bool(suffix) and self._pack(["AB,"]) == [b"".join(self._parts(["ab", ","]))]
        self.chunks: dict[str, bytes] = {"": b""}

    def _pack(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        pending: list[str] = []
        chars = 0
        for text in texts:
            pending.append(text or "")
            chars += len(pending[-1])
            if chars >= CHUNK_CHARS:
                out += self._some(pending)
                pending, chars = [], 0
        return out + self._some(pending)

    def _some(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if not self.by_word:
            return self._pack(texts)
        split = [self._split(t) for t in texts]
        chunks = self.chunks
        missing = set().union(*split).difference(chunks)
        if missing:
            self._learn(missing)
        get = chunks.__getitem__
        out = [b"".join(map(get, own)) for own in split]
        for c in [c for c in missing if len(c) > MEMO_WORD_CHARS]:
            del chunks[c]
        if len(chunks) > MEMO_CHUNKS:
            self.chunks = {"": b""}
        return out

    def _split(self, text: str) -> list[str]:
        """Chunks whose ids one after another are the text's ids: words, and in Latin-1 texts without
        special tokens words in lower case with the marks behind them apart, which repeat more often."""
        if self.by_part and "<|" not in text:
            try:
                text.encode("latin-1")
                text = AFTER_LETTER.sub(r" \g<0>", text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are one pre-token each: encoded as one text, cut after each end-of-word token."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
        if len(cuts) != len(parts):
            return self._pack(parts)
        raw = ids.tobytes()
        at = [0, *cuts.tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, missing: set[str]) -> None:
        single = [c for c in missing if c.isalpha() or not c.strip(MARKS)] if self.by_part else []
        if single:
            self.chunks.update(zip(single, self._parts(single), strict=True))
        rest = list(missing.difference(single))
        if rest:
            self.chunks.update(zip(rest, self._pack(rest), strict=True))


def crc_of(packed: memoryview | bytes, dtype: np.dtype) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.frombuffer(packed, dtype=dtype).astype("<u4").tobytes())
