"""Subword ids of whole texts from a public tokenizer file, encoded word by word and remembered."""

from __future__ import annotations

import os
import struct

import numpy as np

from .common import worker_cache

#: Words kept per Python worker before the memory is emptied; results don't depend on it.
REMEMBERED = 600_000
#: Longer words are encoded but not kept.
LONG_WORD = 48
#: Words encoded by one call.
GROUP = 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids
    are the ids of its words in a row. A word is encoded once per worker.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        # special tokens are cut out of the text before anything else happens to it
        self.mark, self.mark_id = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), (None, None))

    @classmethod
    def held(cls, path: str) -> "Encoder":
        cache = worker_cache()
        if ("encoder", path) not in cache:
            cache["encoder", path] = cls(path)
        return cache["encoder", path]

    def encode(self, texts: list) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") if t else [] for t in texts]
        if len(self.words) > REMEMBERED:
            self.words = {"": b""}
        known = self.words
        missing = [w for w in set().union(*split) if w not in known]
        extra = {}
        for s in range(0, len(missing), GROUP * 64):
            part = missing[s : s + GROUP * 64]
            for w, code in zip(part, self._codes(part)):
                (known if len(w) <= LONG_WORD else extra)[w] = code
        if extra:
            known = _Both(known, extra)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def _codes(self, words: list[str]) -> list[bytes]:
        """Words in groups, with a special token between them that marks where each ends in the ids."""
        if self.mark is None or any(self.mark in w for w in words):
            encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
            return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in encoded]
        groups = [self.mark.join(words[i : i + GROUP]) for i in range(0, len(words), GROUP)]
        out = []
        for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            raw = ids.tobytes()
            cut = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            out += [raw[4 * x + 4 : 4 * y] for x, y in zip(cut, cut[1:])]
        return out


class _Both(dict):
    """extra in front of known, without a copy of known."""

    def __init__(self, known, extra):
        super().__init__(extra)
        self.known = known

    def __missing__(self, word):
        return self.known[word]
