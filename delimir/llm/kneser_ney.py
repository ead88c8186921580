"""Language-model scoring: interpolated modified Kneser-Ney over word pairs.

Spark counts words, then pairs; the model lies in the shared folder as sorted arrays that workers
map into memory:

* words: sorted 64-bit hashes; a word's id is its rank, so ids are dense and in hash order;
* pairs: sorted numbers (place of the first word in its shard, second id) with counts, in shards; counts
  beyond 32 bits have a table of their own;
* per word: count, how many words precede it (a), and how many follow it once, twice, more often.

Pairs travel between tasks as sorted, difference-coded, compressed columns, a few bytes each.
A shard holds a range of first words; a word so frequent that it would swell its shard is spread
over several by its second word, and the per-word sums are added up afterwards.

    p(z|y) = max(c(yz) - D(c), 0) / c(y) + g(y) p(z)      g(y) = sum_k D_k n_k(y) / c(y)
    p(z)   = max(a(z) - E(a), 0) / A     + g / (V + 1)     g    = sum_k E_k m_k / A

with the discounts D and E of Chen and Goodman from counts of counts.  A text is
``end w1 ... wn end``; unknown words share the uniform part.  The order is two: with this many
distinct words, three-word arrays alone exceed four times the input (see README).
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, shared_path

#: Words, and pairs, of a shard; a task holds one shard at a time.
WORD_SHARD, PAIR_SHARD = 2_000_000, 3_000_000
#: Arrays that a worker keeps mapped, and bytes of those that it had to read instead.
MAPPED, READ_BYTES = 4096, 256 << 20
#: Pairs that a counting task gathers before it sends them.
HELD = 1_500_000
ROWS, CHARS = 4096, 4 << 20
#: The end of a text has this hash; no word's hash is changed to it (chance 2**-64).
END = 0x9E3779B97F4A7C15
_U = np.uint64


# -- files of the shared folder -----------------------------------------------------------------
def _local(path: str) -> str | None:
    return path[len("file:") :].replace("//", "/", 1) if path.startswith("file:") else None


def save(path: str, array: np.ndarray) -> None:
    """Write an array whole or not at all; a repeated task writes the same again."""
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        tmp = f"{local}.{os.getpid()}.tmp"
        array.tofile(tmp)
        os.replace(tmp, local)
    else:
        from pyarrow.fs import FileSystem

        fs, p = FileSystem.from_uri(path)
        fs.create_dir(os.path.dirname(p), recursive=True)
        with fs.open_output_stream(p) as f:
            f.write(array.tobytes())


_OPEN: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


def load(path: str, kind: str) -> np.ndarray:
    """A stored array; mapped into memory where the shared folder is mounted.  Absent means empty.

    The arrays used last are kept, MAPPED of them and READ_BYTES of those that were read, so neither maps nor memory grow with the model.
    """
    key = (path, kind)
    if key in _OPEN:
        _OPEN.move_to_end(key)
        return _OPEN[key]
    local = _local(path)
    if local is not None:
        got = np.memmap(local, kind, "r") if os.path.exists(local) and os.path.getsize(local) else np.zeros(0, kind)
    else:
        from pyarrow.fs import FileSystem, FileType

        fs, p = FileSystem.from_uri(path)
        got = np.zeros(0, kind)
        if fs.get_file_info(p).type == FileType.File:
            with fs.open_input_stream(p) as f:
                got = np.frombuffer(f.read(), kind)
    _OPEN[key] = got
    while len(_OPEN) > MAPPED or len(_OPEN) > 1 and sum(x.nbytes for x in _OPEN.values() if not isinstance(x, np.memmap)) > READ_BYTES:
        _OPEN.popitem(last=False)
    return got


# -- compressed columns -------------------------------------------------------------------------
def squeeze(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys as differences and values, each as its byte planes, compressed."""
    import zstandard

    out = [np.array([len(keys), len(values)], np.int64).tobytes()]
    for x in (np.diff(keys, prepend=_U(0)).astype(np.uint64), *(v.astype(np.uint64) for v in values)):
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        out += [bytes((width,)), np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def expand(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, more = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for _ in range(more + 1):
        width = raw[at]
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(x.view(np.uint64).ravel())
        at += 1 + n * width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def summed(parts: list[list[np.ndarray]], keys: int = 1) -> list[np.ndarray]:
    """Parts of (keys..., values...) as one: the first ``keys`` columns sorted and distinct, values added up."""
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.argsort(cols[0], kind="stable") if keys == 1 else np.lexsort(cols[keys - 1 :: -1])
    by = [c[order] for c in cols[:keys]]
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in by])
    first = np.flatnonzero(np.concatenate([[True], new])) if len(order) else np.zeros(0, np.int64)
    return [*(k[first] for k in by), *(np.add.reduceat(v[order], first, dtype=np.uint64) if len(first) else v.astype(np.uint64) for v in cols[keys:])]


# -- tokens -------------------------------------------------------------------------------------
def slices(texts: pa.Array) -> Iterator[pa.Array]:
    size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        n = max(1, min(ROWS, int(np.searchsorted(size, size[at] + CHARS, side="right")) - 1 - at))
        yield texts.slice(at, n)
        at += n


def tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words; the word number of each token, texts end to end; tokens of each text.

    Words are cut at space, tab, line feed, vertical tab, form feed and return; A-Z are lowered.
    """
    flat = pc.split_pattern(pc.ascii_lower(pc.replace_substring_regex(texts, "[\\t-\\r]", " ")), " ")
    code = flat.flatten().dictionary_encode()
    words, index, offsets = code.dictionary.to_pylist(), code.indices.to_numpy(), flat.offsets.to_numpy()
    offsets = offsets - offsets[0]
    empty = words.index("") if "" in words else -1
    real = index != empty
    ends = np.concatenate([[0], np.cumsum(real)])[offsets]
    return words, index[real], np.diff(ends)


def hashed(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def framed(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second ids of all pairs of ``end w1 .. wn end``, text by text (n + 1 pairs each)."""
    stops = np.cumsum(counts + 1) - 1
    second = np.full(len(ids) + len(counts), end, np.int64)
    inner = np.ones(len(second), bool)
    inner[stops] = False
    second[inner] = ids
    first = np.empty_like(second)
    first[1:] = second[:-1]
    if len(first):
        first[0] = end
    return first, second


# -- the model ----------------------------------------------------------------------------------
@dataclass
class Model:
    """Sizes and discounts; the arrays lie under ``path``."""

    path: str
    total: int
    words: int
    word_shards: int
    bases: list[int]
    pair_shards: int
    pair_size: int = PAIR_SHARD
    preceding: int = 0
    high: tuple[float, ...] = (0.0, 0.0, 0.0)
    low: tuple[float, ...] = (0.0, 0.0, 0.0)
    classes: tuple[int, ...] = (0, 0, 0)
    #: Counts from here on are kept apart from the 32-bit ones.
    most: int = (1 << 32) - 1

    @property
    def bits(self) -> int:
        """Bits of a second word in a key."""
        return max(1, (self.words - 1).bit_length())

    @property
    def range(self) -> int:
        """More than the first words of any shard's range."""
        return -(-self.words // self.pair_shards) + 1

    def array(self, name: str, shard: int, kind: str) -> np.ndarray:
        return load(f"{self.path}/{name}-{shard}", kind)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of word hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        shard = word_shard(hashes, self.word_shards)
        order = np.lexsort((hashes, shard))
        for s, rows in runs(shard, order):
            have = self.array("w", s, "u8")
            if len(have):
                at = np.minimum(np.searchsorted(have, hashes[rows]), len(have) - 1)
                out[rows] = np.where(have[at] == hashes[rows], at + self.bases[s], -1)
        return out

    def of_words(self, name: str, ids: np.ndarray, kind: str = "u8") -> np.ndarray:
        """Values of words by id; 0 for id -1."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.bases, ids, side="right") - 1
        order = np.lexsort((ids, shard))
        for s, rows in runs(shard, order):
            if s >= 0:
                have = self.array(name, s, kind)
                at = ids[rows] - self.bases[s]
                ok = at < len(have)
                out[rows[ok]] = have[at[ok]]
        return out

    def frequent(self) -> np.ndarray:
        """Ids of the words that are spread over several shards, sorted."""
        return load(f"{self.path}/frequent", "i8")

    def spread(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are spread, and their places among these."""
        f = self.frequent()
        at = np.minimum(np.searchsorted(f, first), max(0, len(f) - 1))
        return (f[at] == first if len(f) else np.zeros(len(first), bool)), at

    def start(self, shard):
        """The first word of a shard's range."""
        return -(-shard * self.words // self.pair_shards)

    def pair_keys(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shards and keys of pairs.  A shard has a range of first words; those too frequent for one are spread by their second word."""
        shard = first * self.pair_shards // max(1, self.words)
        place = first - self.start(shard)
        often, at = self.spread(first)
        if often.any():
            f = first[often]
            parts = -(-4 * self.of_words("c", f, "u8") // self.pair_size)
            k = _mix(second[often].astype(np.uint64)) % parts.astype(np.uint64)
            shard[often] = (_mix(_mix(f.astype(np.uint64)) + k) % _U(self.pair_shards)).astype(np.int64)
            place[often] = self.range + at[often]
        return shard, place.astype(np.uint64) << _U(self.bits) | second.astype(np.uint64)

    def pair_ids(self, shard: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second words of a shard's keys."""
        place = (key >> _U(self.bits)).astype(np.int64)
        often = place >= self.range
        first = place + self.start(shard)
        if often.any():
            first[often] = self.frequent()[place[often] - self.range]
        return first, (key & _U((1 << self.bits) - 1)).astype(np.int64)

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of known pairs; ids of at least 0."""
        out = np.zeros(len(first), np.int64)
        shard, key = self.pair_keys(first, second)
        order = np.lexsort((key, shard))
        for s, rows in runs(shard, order):
            have = self.array("p", s, "u8")
            if len(have):
                at = np.minimum(np.searchsorted(have, key[rows]), len(have) - 1)
                n = np.where(have[at] == key[rows], self.array("n", s, "u4")[at], 0).astype(np.int64)
                if (n == self.most).any():
                    large, of = self.array("lk", s, "u8"), np.flatnonzero(n == self.most)
                    n[of] = self.array("ln", s, "u8")[np.searchsorted(large, key[rows][of])]
                out[rows] = n
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def runs(shard: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its row numbers in the given order)."""
    s = shard[order]
    cut = np.flatnonzero(np.diff(s)) + 1
    for rows in np.split(order, cut):
        if len(rows):
            yield int(shard[rows[0]]), rows


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartition(shards, "shard").sortWithinPartitions("shard")


def each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of batches sorted by their first column, the shard: a shard's rows as slices of batches."""
    now, held = None, []
    for b in batches:
        shard = b.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if lo == hi:
                continue
            if int(shard[lo]) != now:
                if held:
                    yield now, held
                now, held = int(shard[lo]), []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, held


def discounts(t: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from how many counts are 1, 2, 3 and 4; k/2 where these say nothing."""
    if not (t[0] and t[1]):
        return 0.5, 1.0, 1.5
    y = t[0] / (t[0] + 2 * t[1])
    d = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2] if t[2] else 1.5]
    return tuple(float(min(max(x, 0.0), k + 0.999)) for k, x in enumerate(d))


def _class(c: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def train(docs: DataFrame, text_col: str = "text", word_size: int = WORD_SHARD, pair_size: int = PAIR_SHARD, held_pairs: int = HELD, most: int = Model.most) -> Model:
    """Count all given texts (null: empty).  An empty table gives a model that knows no word.

    Counts from ``most`` on are kept apart.  Rows with one text count each; texts are read whole, those of any length.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "kneser-ney")
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))

    def count_words(batches):
        held, n_docs, size = [], 0, 0

        def out():
            k, v = summed(held)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(v.astype(np.int64))], names=["w", "c"])

        for b in batches:
            for t in slices(b.column(0)):
                words, index, counts = tokens(t)
                n_docs += len(counts)
                n = np.bincount(index, minlength=len(words)).astype(np.uint64)
                held.append([hashed(words)[n > 0], n[n > 0]])
                size += len(words)
                if size > held_pairs:
                    yield out()
                    held, size = [], 0
        if n_docs:
            held.append([np.array([END], np.uint64), np.array([n_docs], np.uint64)])
            yield out()

    known = texts.mapInArrow(count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    known = known.persist(StorageLevel.MEMORY_AND_DISK)
    n = known.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    words, total = int(n[0]), int(n[1])
    ws, ps = max(1, -(-words // word_size)), max(1, -(-total // pair_size))
    # words: sorted hashes and counts, a file a shard
    def with_shard(batches):
        for b in batches:
            w = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word_shard(w, ws)), b.column(0), b.column(1)], names=["shard", "w", "c"])

    def store_words(batches):
        for s, rows in each_shard(batches):
            w, c = (np.concatenate([b.column(i).to_numpy() for b in rows]).view(np.uint64) for i in (1, 2))
            order = np.argsort(w)
            w, c = w[order], c[order]
            save(f"{path}/w-{s}", w)
            save(f"{path}/c-{s}", c)
            often = np.flatnonzero(4 * c > _U(pair_size))  # at most 4 / pair_size of all tokens
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([len(w)]), pa.array([often.astype(np.int64)], pa.list_(pa.int64()))], names=["shard", "n", "often"])

    stored = sorted(by_shard(known.mapInArrow(with_shard, "shard long, w long, c long"), ws).mapInArrow(store_words, "shard long, n long, often array<long>").collect())
    sizes = {r["shard"]: r["n"] for r in stored}
    known.unpersist()
    bases = np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(ws)])])[:-1].tolist()
    model = Model(path, total, words, ws, bases, ps, pair_size, most=most)
    if not words:
        return model
    often = np.array([bases[r["shard"]] + k for r in stored for k in r["often"]], np.int64)
    save(f"{path}/frequent", often)
    if model.bits + (model.range + len(often)).bit_length() > 64:
        raise ValueError("keys of pairs have more than 64 bits")

    # pairs: counted per task, sent by shard
    def count_pairs(batches):
        m, held, size = model, [], 0
        end = int(m.ids(np.array([END], np.uint64))[0])

        def out():
            shard, key, n = summed(held, keys=2)
            held.clear()
            got = [(s, squeeze(key[r], n[r])) for s, r in runs(shard, np.arange(len(shard)))]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], names=["shard", "blob"])

        for b in batches:
            for t in slices(b.column(0)):
                w, index, counts = tokens(t)
                ids = np.append(m.ids(hashed(w)), end)
                y, z = framed(index, counts, len(w))  # numbers within this slice
                both, n = np.unique(y * len(ids) + z, return_counts=True)
                shard, key = m.pair_keys(ids[both // len(ids)], ids[both % len(ids)])
                held.append([shard.astype(np.int32), key, n.astype(np.uint32)])  # a slice has fewer tokens than that
                size += len(key)
                if size > held_pairs:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    # a shard's pairs are stored; its sums by first and by second word go on, by the word's shard
    def store_pairs(batches):
        for s, rows in each_shard(batches):
            key, n = summed([expand(x.as_py()) for b in rows for x in b.column(1)])
            save(f"{path}/p-{s}", key)
            large = n >= _U(most)
            save(f"{path}/n-{s}", np.minimum(n, _U(most)).astype("u4"))
            if large.any():
                save(f"{path}/lk-{s}", key[large])
                save(f"{path}/ln-{s}", n[large])
            t = [int((n == k).sum()) for k in (1, 2, 3, 4)]
            y, z = (x.view(np.uint64) for x in model.pair_ids(s, key))
            del key
            first = summed([[y, *((n == k).astype(np.uint8) for k in (1, 2)), (n > 2).astype(np.uint8)]])
            second = summed([[z, np.ones(len(n), np.uint8)]])
            del y, z, n
            sent = []
            for kind, cols in enumerate((first, second)):
                at = np.searchsorted(bases, cols[0].astype(np.int64), side="right") - 1
                sent += [(ws_, kind, squeeze(*[c[r] for c in cols])) for ws_, r in runs(at, np.argsort(at, kind="stable"))]
            k = len(sent)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int64()), pa.array([x[1] for x in sent], pa.int64()), pa.array([x[2] for x in sent], pa.binary()), *[pa.array([v] + [0] * (k - 1), pa.int64()) for v in t]], names=["shard", "kind", "blob", "t1", "t2", "t3", "t4"])

    def store_stats(batches):
        t = np.zeros(4, np.int64)
        for s, rows in each_shard(batches):
            out = {k: np.zeros(sizes[s], np.uint64) for k in ("a", "f1", "f2", "f3")}
            for kind, blob, *ts in (r for b in rows for r in zip(*(b.column(i) for i in range(1, 7)), strict=True)):
                kind = kind.as_py()
                t += [x.as_py() for x in ts]
                cols = expand(blob.as_py())
                at = cols[0].astype(np.int64) - bases[s]
                for k, v in zip(("f1", "f2", "f3") if kind == 0 else ("a",), cols[1:], strict=True):
                    out[k][at] += v
            for k, v in out.items():
                save(f"{path}/{k}-{s}", v)
            a = out["a"]
            m = [int((a == k).sum()) for k in (1, 2, 3, 4)] + [int((a > 2).sum()), int(a.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in [*t.tolist(), *m]], names=[*"tuvw", *"abcd", "more", "sum"])
            t[:] = 0

    kinds = "shard long, kind long, blob binary, t1 long, t2 long, t3 long, t4 long"
    pairs = by_shard(texts.mapInArrow(count_pairs, "shard long, blob binary"), ps).mapInArrow(store_pairs, kinds)
    stats = by_shard(pairs, ws).mapInArrow(store_stats, ", ".join(f"{c} long" for c in [*"tuvw", *"abcd", "more", "sum"]))
    got = [int(x) for x in stats.agg(*[F.sum(c) for c in stats.columns]).first()]
    model.high, model.low = discounts(got[:4]), discounts(got[4:8])
    model.classes, model.preceding = (got[4], got[5], got[8]), got[9]
    return model


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.end = int(model.ids(np.array([END], np.uint64))[0]) if model.words else -1

    def low(self, ids: np.ndarray) -> np.ndarray:
        """p(z) of words by id."""
        m = self.m
        if not m.preceding:
            return np.full(len(ids), 1.0 / (m.words + 1))
        a = m.of_words("a", ids)
        left = sum(d * k for d, k in zip(m.low, m.classes, strict=True)) / m.preceding
        return (a - _class(a, m.low)) / m.preceding + left / (m.words + 1)

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        m = self.m
        words, index, counts = tokens(texts)
        ids = m.ids(hashed(words)) if m.words else np.full(len(words), -1)
        y, z = framed(ids[index] if len(index) else np.zeros(0, np.int64), counts, self.end)
        starts = np.cumsum(counts + 1) - (counts + 1)
        some, back = np.unique(z, return_inverse=True)
        c, low = m.of_words("c", some, "u8"), self.low(some)
        base = np.log10((c + 0.1) / (m.total + 0.1 * (m.words + 1)))
        p = low[back]
        known = np.flatnonzero((y >= 0))
        if len(known):
            ctx, cb = np.unique(y[known], return_inverse=True)
            pair, pb = np.unique(cb * len(some) + back[known], return_inverse=True)  # numbers within this slice
            a, b = ctx[pair // len(some)], some[pair % len(some)]
            n = np.where(b >= 0, m.pair_counts(a, np.maximum(b, 0)), 0)[pb]
            cy = m.of_words("c", ctx, "u8").astype(float)
            g = sum(d * m.of_words(f, ctx) for d, f in zip(m.high, ("f1", "f2", "f3"), strict=True)) / cy
            p[known] = (n - _class(n, m.high)) / cy[cb] + g[cb] * p[known]
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        return {"n_tokens": counts + 1, "n_known": add((c > 0).astype(np.int64)[back]), "base_score": add(base[back]), "score": add(np.log10(p))}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row.

    ``score`` is the model's log10 probability of the text with its end; perplexity is
    10 ** (-score / n_tokens).  Null and empty texts are that end alone.  Texts are read whole, however
    long; rows with one id, or one text, get a row each; other columns aren't read and may have any name; a
    model of no text gives each word the same share; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        s = Scorer(model)
        for b in batches:
            at = 0
            for t in slices(b.column(1)):
                got = s.score(t)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(t)), pa.array(got["n_tokens"], pa.int64()), pa.array(got["n_known"], pa.int64()), pa.array(np.full(len(t), model.total), pa.int64()), pa.array(got["base_score"], pa.float64()), pa.array(got["score"], pa.float64())], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                at += len(t)

    return docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_in(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that the query learns from."""
    return docs.where(F.coalesce(remainder(id_col, 10) != 0, F.lit(True)))
