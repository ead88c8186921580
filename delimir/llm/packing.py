"""Packing by cutting-stock column generation.

Each document becomes ids plus an end id and is cut into full sequences and one rest.  Rests fall
into length classes of ``width`` ids; only the histogram over these (a few hundred numbers,
whatever the corpus) reaches the driver.  There a linear program over patterns -- how many rests
of each class share a sequence -- is solved by column generation: the duals of a revised simplex
price the classes and a knapsack dynamic program finds the best new pattern.  Patterns are rounded
down, the few rests left over are packed first-fit decreasing, and each pattern's places are
intervals of ranks, so a document finds its sequence from its class and its rank there.

Ranks are counted where rows lie: each task numbers its rows by class, and prefix sums over
(task, class) counts shift them.  A class that holds most rows is spread over all tasks.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_tree import byte_letters
from .common import written

SEQUENCE = 4096
CLASS_WIDTH = 8
END_ID = 2
#: Column generation ends when the bound shows that no solution is better by more than this share.
GAP = 1e-4
#: Chunks a worker remembers.
CHUNKS = 900_000
#: Rows and characters that are encoded together.
ROWS, CHARS = 4096, 6 << 20
_LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
#: A full stop or comma that ends a word is a token of its own under the vocabulary's splitting rule.
_STOP = r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF])([.,])(\s|$)"


class WordCodec:
    """ids of texts by a ``tokenizers`` file that lower-cases and drops white space.

    Texts are cut at blanks and line feeds, which the file's splitting rule never crosses.  Arrow
    finds the distinct chunks of many texts; each new one is encoded once.  So that few are
    distinct, ASCII letters are lowered and a final stop or comma parted first, neither of which
    changes an id; texts beside one that may hold a special token stay as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.t = Tokenizer.from_file(path)
        # words of plain letters are one piece of the splitting rule: for them the merges alone do
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), None
        self.letters = str.maketrans({c: "".join(map(byte_letters().__getitem__, c.encode())) for c in map(chr, range(0xDF, 0x100))})
        # chunks known so far: their number, and where the ids of each lie in one pool
        self.chunks: dict[str, int] = {}
        self.pool, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def forget(self, kept: list[str]) -> None:
        """Forget all chunks but some known ones."""
        code = np.array([self.chunks[c] for c in kept], np.int64)
        at, size = self.ends[code], self.ends[code + 1] - self.ends[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        self.pool = self.pool[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
        self.chunks, self.ends = dict(zip(kept, range(len(kept)), strict=True)), ends

    def learn(self, new: list[str]) -> None:
        plain, odd = [], []
        for w in new:
            if _LETTERS(w):
                plain.append(w)
            else:
                odd.append(w)
        mapped = [w if w.isascii() else w.translate(self.letters) for w in plain]
        ids = [e.ids for e in self.merges.encode_batch_fast(mapped, add_special_tokens=False)]
        ids += [e.ids for e in self.t.encode_batch_fast(odd, add_special_tokens=False)]
        n = len(self.chunks)
        self.chunks.update(zip(chain(plain, odd), range(n, n + len(new))))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's start (and the last ends)."""
        texts = pc.replace_substring(texts, "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(pc.replace_substring_regex(texts, _STOP, r"\1 \2\3"))
        parts = pc.split_pattern(texts, " ")
        flat = parts.flatten().dictionary_encode()
        distinct, index = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        get = self.chunks.get
        code = np.array(list(map(get, distinct, repeat(-1))), np.int64)
        new = [distinct[i] for i in np.flatnonzero(code < 0).tolist()]
        if new:
            gc.disable()  # very many short lists, none in a cycle
            try:
                self.learn(new)
            finally:
                gc.enable()
            code[code < 0] = list(map(self.chunks.__getitem__, new))
        at, size = self.ends[code].astype(np.int32), (self.ends[code + 1] - self.ends[code]).astype(np.int32)
        each = size[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        where = np.repeat(at[index] - ends[:-1].astype(np.int32), each)
        where += np.arange(len(where), dtype=np.int32)
        offsets, ids = parts.offsets.to_numpy(), self.pool[where]
        if len(self.chunks) > CHUNKS:
            self.forget(distinct)
        return ids, ends[offsets - offsets[0]]


_CODECS: dict[str, WordCodec] = {}


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """(first row, rows) of slices of at most ROWS rows and, beyond one row, CHARS bytes."""
    size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    out, at = [], 0
    while at < len(texts):
        n = max(1, min(ROWS, int(np.searchsorted(size, size[at] + CHARS, side="right")) - 1 - at))
        out.append((at, n))
        at += n
    return out


def cut(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, width: int = CLASS_WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, class, part, rank (within part and class).

    Null text counts as empty: such a document is its end id alone.  Rows with the same id are
    documents of their own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "class", "part", "rank"]
    schema = pa.schema([("id", pa.int64() if kind == "bigint" else pa.string()), *[(n, pa.int64()) for n in names]])
    full = -(-sequence // width)

    def run(batches):
        from pyspark import TaskContext

        if tokenizer_path not in _CODECS:
            _CODECS[tokenizer_path] = WordCodec(tokenizer_path)
        c, part, ranks = _CODECS[tokenizer_path], TaskContext.get().partitionId(), Counter()
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for at, n_rows in slices(texts):
                ids, ends = c.encode(texts.slice(at, n_rows))
                rows = []
                for i, lo, hi in zip(batch.column(0).slice(at, n_rows).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    n = hi - lo + 1
                    for start in range(0, n, sequence):
                        length = min(sequence, n - start)
                        k = full if length == sequence else -(-length // width)
                        crc = zlib.crc32(ids[lo + start : min(hi, lo + start + length)])
                        rows.append((i, start, length, zlib.crc32(end, crc) if start + length == n else crc, n, k, part, ranks[k]))
                        ranks[k] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).alias("id") if kind == "bigint" else F.col(id_col).cast("string").alias("id"), F.col(text_col)).mapInArrow(run, f"id {'long' if kind == 'bigint' else 'string'}, " + ", ".join(f"{n} long" for n in names))


# -- the linear program -----------------------------------------------------------------------
def knapsack(value: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of items within the capacity: its value and counts."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(weight, kind="stable")
    w, v = weight[order], value[order]
    upto = np.searchsorted(w, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            got = v[: upto[c]] + best[c - w[: upto[c]]]
            j = int(np.argmax(got))
            if got[j] > best[c]:
                best[c], item[c] = got[j], j
    counts, c = np.zeros(len(value), np.int64), capacity
    while c > 0:
        if item[c] < 0:
            c -= 1
        else:
            counts[order[item[c]]] += 1
            c -= int(w[item[c]])
    return float(best[capacity]), counts


def column_generation(weight: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a column) and how often each is used in the relaxed optimum, within ``gap`` of it."""
    m = len(weight)
    fit = capacity // weight
    basis = np.diag(fit).astype(float)
    inverse, x = np.diag(1.0 / fit), demand / fit
    ones = np.ones(m)
    for n in range(rounds):
        dual = ones @ inverse
        value, pattern = knapsack(np.maximum(dual, 0), weight, capacity)
        # value * bound is at most the optimum: the duals divided by it are feasible for the dual program
        if value <= 1 + 1e-9 or x.sum() <= (np.maximum(dual, 0) @ demand) / value * (1 + gap):
            break
        step = inverse @ pattern
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, step, 1), np.inf)
        r = int(np.argmin(ratio))
        theta = ratio[r]
        x = x - theta * step
        x[r] = theta
        x[x < 0] = 0
        basis[:, r] = pattern
        row = inverse[r] / step[r]
        inverse -= np.outer(step, row)
        inverse[r] = row
        if n % 200 == 199:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
    return basis.round().astype(np.int64), x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern {class: places}, how many sequences take it); the places cover the histogram exactly or more.

    ``histogram``: rests by class; class k weighs k and ``capacity`` is the largest class.
    """
    classes = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), np.int64)
    out: list[tuple[dict[int, int], int]] = []
    if histogram.get(capacity):
        out.append(({capacity: 1}, histogram[capacity]))
    if not len(classes):
        return out
    left = np.array([histogram[int(k)] for k in classes], np.int64)
    patterns, x = column_generation(classes, left.astype(float), capacity)
    for p, n in zip(patterns.T, np.floor(x + 1e-9).astype(np.int64), strict=True):
        p = np.minimum(p, left // n if n else 0)
        if n > 0 and p.any():
            out.append(({int(k): int(a) for k, a in zip(classes, p, strict=True) if a}, int(n)))
            left = left - n * p
    bins: list[tuple[list[int], int]] = []
    room = np.zeros(0, np.int64)
    held: list[Counter] = []
    for k, n in sorted(zip(classes.tolist(), left.tolist(), strict=True), reverse=True):
        for _ in range(n):
            fits = np.flatnonzero(room >= k)
            if len(fits):
                j = int(fits[np.argmin(room[fits])])
            else:
                j, room = len(room), np.append(room, capacity)
                held.append(Counter())
            room[j] -= k
            held[j][k] += 1
    same = Counter(tuple(sorted(h.items())) for h in held)
    return out + [(dict(h), n) for h, n in sorted(same.items())]


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per class: interval ends of ranks, with the first rank, sequence count, first sequence and slot of each."""
    got, done, base = defaultdict(list), Counter(), 0
    for pattern, n in patterns:
        slot = 0
        for k, a in sorted(pattern.items(), reverse=True):
            got[k].append((done[k] + a * n, done[k], n, base, slot))
            done[k] += a * n
            slot += a
        base += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in got.items()}


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, width: int = CLASS_WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``sequence`` must be a multiple of ``width``.  Sequences hold at most ``sequence`` ids; the last
    few may be emptier.  Null text counts as empty and is one piece, the closing id; rows with one id, or one
    text, are documents of their own; texts of any length are cut, not shortened; other columns aren't read
    and may have any name.  An empty table gives an empty result.
    """
    if sequence % width:
        raise ValueError("the sequence length must be a multiple of the class width")
    pieces = written(cut(docs, tokenizer_path, sequence, width, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "class").agg(F.count("*").alias("n"))
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most sequence / width rows
    where = places(plan(histogram, sequence // width))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = pieces.join(counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), ["part", "class"])
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]

    def assign(batches):
        for b in batches:
            k, rank = b.column("class").to_numpy(), b.column("rank").to_numpy() + b.column("shift").to_numpy()
            seq, slot = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for one in np.unique(k):
                rows = np.flatnonzero(k == one)
                ends, first, n, base, at = where[int(one)]
                j = np.searchsorted(ends, rank[rows], side="right")
                r = rank[rows] - first[j]
                seq[rows], slot[rows] = base[j] + r % n[j], at[j] + r // n[j]
            cols = [b.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.array(seq), pa.array(slot)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    id_kind = pieces.schema["id"].dataType.simpleString()
    put = shifted.mapInArrow(assign, f"`{id_col}` {id_kind}, " + ", ".join(f"{n} long" for n in names[1:]))
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return put.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")
