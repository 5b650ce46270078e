"""Token ids of whole texts through a cache of pre-tokens.

The library splits a text into pre-tokens and encodes each by itself, so its ids can be put
together from those of the pre-tokens. A text with characters whose treatment is not spelled out
here, or with what may be a special string, is encoded by the library as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import cache, partial

import numpy as np

# The pre-tokens of word_bpe_49k.json for texts of the characters that PLAIN admits.
# These need no normalisation besides lower case, and their letters and digits are as listed.
LETTERS = "a-zß-öø-ÿœ"
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^ \t\n\r{LETTERS}0-9]+")
PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿŒœ¡¿«»§°€‘’“”„–—…]*")
SPECIAL_START = "<|"

CACHE_SIZE = 1_000_000
"""Most pre-tokens a worker remembers, about 200 MB; then it starts anew."""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_type(path: str) -> np.dtype:
    """The narrowest little-endian type that holds every id."""
    return np.dtype("<u2" if load(path).get_vocab_size() <= 1 << 16 else "<u4")


def split(text: str) -> list[str] | None:
    """The pre-tokens of a text, or None when the library must encode it as a whole."""
    if SPECIAL_START in text or not PLAIN.fullmatch(text):
        return None
    return PRE_TOKEN.findall(text.lower())


def encode_whole(path: str, texts: list[str]) -> list[list[int]]:
    return [x.ids for x in load(path).encode_batch(texts, add_special_tokens=False)]


def encode_pre_tokens(path: str, pre_tokens: list[str]) -> tuple[list[int], list[int]]:
    """The ids of all pre-tokens, one after the other, and where those of each end. They are encoded in one text, where spaces keep them apart."""
    encoding = load(path).encode(" ".join(pre_tokens), add_special_tokens=False)
    of_word = encoding.word_ids
    if None not in of_word and of_word and of_word[-1] == len(pre_tokens) - 1:
        return encoding.ids, np.cumsum(np.bincount(of_word, minlength=len(pre_tokens))).tolist()
    each = encode_whole(path, pre_tokens)
    return [x for ids in each for x in ids], np.cumsum([len(ids) for ids in each]).tolist()


def lengths(ids: list[int], ends: list[int]) -> list[int]:
    """How many ids each pre-token has."""
    return np.diff(ends, prepend=0).tolist()


class Memo:
    """What is remembered of pre-tokens in one worker: a first tier that stays, and a bounded second one.

    ``of_all`` makes the values of pre-tokens from what ``encode_pre_tokens`` returns of them.
    """

    def __init__(self, path: str, of_all, frequent: dict | None = None, size: int = CACHE_SIZE):
        self.path, self.of_all, self.frequent, self.size = path, of_all, frequent or {}, size
        self.known = dict(self.frequent)

    def learn(self, pre_tokens: Iterable[str]) -> None:
        """Encode those that are not known yet."""
        missing = list(set(pre_tokens).difference(self.known))
        if len(self.known) + len(missing) > self.size + len(self.frequent):
            self.known = dict(self.frequent)
            missing = list(set(pre_tokens).difference(self.known))
        for i in range(0, len(missing), 10_000):
            part = missing[i : i + 10_000]
            self.known.update(zip(part, self.of_all(*encode_pre_tokens(self.path, part))))

    def values(self, pre_tokens: list[str]) -> list:
        found = list(map(self.known.get, pre_tokens))
        if None not in found:
            return found
        missing = {pre for pre, value in zip(pre_tokens, found) if value is None}
        self.learn(missing)
        known = self.known
        return [known[pre] if value is None else value for pre, value in zip(pre_tokens, found)]


def id_blobs(kind: str, ids: list[int], ends: list[int]) -> list[bytes]:
    """The ids of each pre-token as bytes."""
    width = np.dtype(kind).itemsize
    blob, places = np.array(ids, kind).tobytes(), [width * end for end in ends]
    return [blob[a:b] for a, b in zip([0, *places], places)]


class WorkerIds:
    """The ids of whole texts, as bytes, from what one worker remembers of their pre-tokens."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind
        # Not a method of this object: in a cycle the memory would stay until Python looks for cycles.
        self.memo = Memo(path, partial(id_blobs, kind))

    def of_text(self, text: str) -> bytes:
        pre = split(text)
        if pre is None:
            return np.array(encode_whole(self.path, [text])[0], self.kind).tobytes()
        return b"".join(self.memo.values(pre))


@cache
def worker_ids(path: str, kind: str) -> WorkerIds:
    """What one worker process remembers from task to task, as many pre-tokens as ``CACHE_SIZE``."""
    return WorkerIds(path, kind)


def forget() -> None:
    """Give back what this worker process remembers. Workers outlive a job, and the next operator needs the memory for its own."""
    worker_ids.cache_clear()
    load.cache_clear()
