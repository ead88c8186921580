"""BPE encoding and decoding by tree concatenation.

A text is cut by the vocabulary's own splitting rule into pieces.  Short pieces go to the BPE
model at once (and into a bounded cache).  A piece that the rule leaves unsplit and that is long
is cut in halves again and again; all leaves of a batch are encoded in one parallel call, and the
encodings are joined bottom-up.  At each join a window of k ids on either side is encoded anew;
the join holds when the window starts with the left side's id and ends with the right side's id
(or covers the side), else k doubles.  An id sequence is the BPE encoding of its bytes exactly if
each neighbouring pair is, so such a join is exact.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

from pyspark.sql import DataFrame

from .common import arrow_rows

#: Characters for which Python's own classes and the vocabulary's splitting rule agree.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
LEAF = 256
CACHE = 300_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies (public rule of GPT-2)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in kept}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + n)
            n += 1
    return [letters[b] for b in range(256)]


class TreeBPE:
    """Encoder and decoder for one byte-level ``tokenizers`` file."""

    def __init__(self, path: str, leaf: int = LEAF, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.leaf, self.limit = leaf, cache
        self.whole = Tokenizer.from_file(path)
        self.raw = Tokenizer.from_file(path)
        self.raw.pre_tokenizer = None
        self.raw.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letter = byte_letters()
        back = {c: b for b, c in enumerate(self.letter)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.text_of, self.bytes_of = [""] * size, [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.text_of[i] = token
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.cache: dict[str, bytes] = {}

    # -- splitting -------------------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """The splitting rule's pieces of a text without special tokens."""
        if not _PLAIN.search(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[str]:
        if self._special is None or "<|" not in text:
            return self.pieces(text)
        out: list[str] = []
        for x in self._special.split(text):
            out += [x] if x in self.special else self.pieces(x)
        return out

    # -- encoding --------------------------------------------------------------------------
    def _ids(self, letters: list[str]) -> list[list[int]]:
        return [e.ids for e in self.raw.encode_batch_fast(letters, add_special_tokens=False)]

    def tree(self, pieces: list[str]) -> list[list[int]]:
        """Encode long unsplit pieces; leaves and windows of all pieces share batch calls."""
        letter = self.letter
        mapped = ["".join(map(letter.__getitem__, p.encode())) for p in pieces]
        cut = [[m[i : i + self.leaf] for i in range(0, len(m), self.leaf)] or [""] for m in mapped]
        flat = iter(self._ids([x for c in cut for x in c]))
        level = [[next(flat) for _ in c] for c in cut]
        while any(len(x) > 1 for x in level):
            jobs = [(a, b) for a, x in enumerate(level) for b in range(0, len(x) - 1, 2)]
            done: dict[tuple[int, int], list[int]] = {}
            k = 1
            while jobs:
                windows = self._ids(["".join(self.text_of[i] for i in level[a][b][-k:] + level[a][b + 1][:k]) for a, b in jobs])
                again = []
                for (a, b), w in zip(jobs, windows, strict=True):
                    left, right = level[a][b], level[a][b + 1]
                    if w and (k >= len(left) or w[0] == left[-k]) and (k >= len(right) or w[-1] == right[k - 1]):
                        done[a, b] = left[: max(0, len(left) - k)] + w + right[k:]
                    elif not w:
                        done[a, b] = []
                    else:
                        again.append((a, b))
                jobs, k = again, k * 2
            level = [[done.get((a, b), x[b]) for b in range(0, len(x), 2)] for a, x in enumerate(level)]
        return [x[0] for x in level]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.parts(t) for t in texts]
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        new = {p for s in split for p in s if p not in cache}
        for token in new & self.special.keys():
            cache[token] = array("I", [self.special[token]]).tobytes()
        new -= self.special.keys()
        short = [p for p in new if len(p) <= self.leaf // 4]
        for p, e in zip(short, self.whole.encode_batch_fast(short, add_special_tokens=False), strict=True):
            cache[p] = array("I", e.ids).tobytes()
        long = [p for p in new if len(p) > self.leaf // 4]
        own = dict(zip(long, (array("I", x).tobytes() for x in self.tree(long)), strict=True)) if long else {}
        if not own:
            return [b"".join([cache[p] for p in s]) for s in split]
        return [b"".join([own[p] if p in own else cache[p] for p in s]) for s in split]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_CODECS: dict[str, TreeBPE] = {}


def codec(path: str) -> TreeBPE:
    """One codec per worker process and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; tasks run in parallel
    if path not in _CODECS:
        _CODECS[path] = TreeBPE(path)
    return _CODECS[path]


def encode_column(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of each row; null text counts as empty.

    Rows are independent: repeated rows, ties and empty tables need no care; other columns of any
    name are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        c = codec(tokenizer_path)

        def f(cols):
            ids = c.encode_batch([t or "" for t in cols[1]])
            return {id_col: cols[0], "ids": [memoryview(x).cast("I").tolist() for x in ids], "decoded": [c.decode(x) for x in ids]}

        return f

    return arrow_rows(docs, make, f"`{id_col}` {kind}, ids array<int>, decoded string", id_col, text_col)


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: id count, SHA-256 of the ids and of the decoded text."""

    def make():
        c = codec(tokenizer_path)

        def f(cols):
            ids = c.encode_batch([t or "" for t in cols[1]])
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return {"doc_id": cols[0], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(c.decode(x).encode()) for x in ids]}

        return f

    return arrow_rows(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "doc_id", "text")
