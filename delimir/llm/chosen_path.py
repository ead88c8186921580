"""N-gram Jaccard join: Chosen Path.

Documents are sets of five-word shingles.  Equal sets are one *text* from the start.  Each text has
a signature of T minimum hashes; its entries are the tokens of the search.  A run samples tokens of
each text -- ``rate`` of them on average, by a hash of the path so far, so that similar texts sample
shared ones -- and texts that sampled the same token meet in a bucket.  Buckets of at most SPLIT
texts are compared by brute force, larger ones are split again on further sampled tokens, and what
is still together after ``depth`` levels is compared by brute force too, however large.

Comparing means counting the entries in which two *sketches*, two bits of each signature entry,
differ.  That count is a metric, so a large group of near copies needs no splitting: the texts
within LEAVE of a bucket's pivot leave the bucket, and nothing is lost by it.  Two of them are both
tied to the pivot; a partner of one of them is within ``reach`` of it, hence within LEAVE + reach of
the pivot, and those are compared with the texts that leave, in blocks (``_bridges``).  The pivot is
the least by a hash of text and bucket, so that another text is it in each bucket.

Runs are repeated until the recall bound holds: with rate = 1.6 / threshold a pair at the threshold
survives a run of any depth with at least the fixed point s = 1 - exp(-1.6 s) = 0.64, and RUNS = 12
runs miss it with chance below 5e-6.  Two bits agree by chance in a quarter of the differing
entries; ``reach`` lies 4.8 deviations above what a pair at the threshold has on average, which a pair
at the threshold of 0.8 exceeds with chance 9e-6, and ever fewer above.

All this only proposes: ties make candidate groups, and each group's real shingle sets are then
compared exactly, pair by pair, in blocks.  Pairs are counted where they are compared and never
leave the task; what leaves is one row per text and block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, written
from .components import components, least_of_component

N = 5
THRESHOLD = 0.8
T = 64
RUNS = 12
DEPTH = 4
#: Texts of a bucket that is split no more: comparing that many sketches costs less than moving them on.
SPLIT = 4096
#: Texts of a bucket that are compared in one sweep over many buckets; larger ones are compared in blocks.
LIMIT = 128
#: A text that differs from the pivot in so many entries at most leaves the bucket.
LEAVE = 16
#: Texts of a block of a bucket, and of the texts that leave it.
PART, LEAVERS = 2048, 32768
#: Texts and shingles of a block of the exact comparison.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, T, dtype=np.uint64) | _U(1)
_ADD = _rng.integers(0, 1 << 63, T, dtype=np.uint64)
_STEP = _rng.integers(1, 1 << 63, N, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Per text: the sorted distinct hashes of the n-word shingles of the lower-cased text (null: empty).

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    import xxhash

    parts = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    code = parts.flatten().dictionary_encode()
    words = code.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    h = hashes[code.indices.to_numpy()]
    real = np.array([w != "" for w in words], bool)[code.indices.to_numpy()]  # splitting leaves empty ends
    ends = np.concatenate([[0], np.cumsum(real)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
    h, out = h[real], []
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        k = min(n, hi - lo)
        if not k:
            out.append(np.zeros(0, np.uint64))
            continue
        m = hi - lo - k + 1
        total = np.full(m, k, np.uint64)
        for j in range(k):
            total += h[lo + j : lo + j + m] * _STEP[j]
        out.append(np.unique(mix(total)))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Low halves of T minimum hashes; long sets in slices, so memory stays bounded."""
    least = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        least = np.minimum(least, ((part[None, :] ^ _ADD[:, None]) * _MUL[:, None]).min(1))
    return (mix(least) & _U(0xFFFFFFFF)).astype(np.uint32)


def fingerprint(s: np.ndarray) -> int:
    """A 64-bit name of the set; two different sets share one with chance 2**-64."""
    with np.errstate(over="ignore"):
        x = mix(np.array([np.bitwise_xor.reduce(mix(s + _U(1))) if len(s) else _U(0), s.sum(dtype=np.uint64) + _U(len(s))], np.uint64))
        return int(mix(x[:1] * _U(3) + x[1:])[0].astype(np.int64))


def extend(parent: np.ndarray, used: np.ndarray, sig: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled tokens of each row: row numbers, new paths, tokens used so far (a bit each)."""
    j = np.arange(T, dtype=np.uint64)
    h = mix(mix(parent)[:, None] + sig.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + (j + _U(1)) * _U(0xD1B54A32D192ED03))
    free = (used[:, None] >> j) & _U(1) == 0
    row, at = np.nonzero((h < _U(int(min(rate / T, 0.999) * 2**64))) & free)
    return row, mix(h[row, at] + _U(11)), used[row] | (_U(1) << at.astype(np.uint64))


def sketch(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each entry, as two words a row."""
    at = np.arange(T, dtype=np.uint64)
    return tuple((((sig >> np.uint32(k)) & np.uint32(1)).astype(np.uint64) << at).sum(1, dtype=np.uint64) for k in (17, 5))


def differing(a1, a2, b1, b2):
    """In how many entries two sketches differ.  Signed numbers would be counted by their absolute value."""
    return np.bitwise_count(((a1 ^ b1) | (a2 ^ b2)).view(np.uint64))


def reach(threshold: float) -> int:
    """So many entries of two sketches differ at most, at the threshold and 4.8 deviations above the mean."""
    p = 0.75 * (1 - threshold)
    return min(T, int(T * p + 4.8 * math.sqrt(T * p * (1 - p))))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, n, s1, s2, sig) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1))
                sigs = [signature(s).view(np.int32) for s in sets]
                flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int32)
                s1, s2 = sketch(flat.view(np.uint32).reshape(-1, T))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), _signed(s1), _signed(s2), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, T, dtype=np.int32), pa.array(flat))], names=["id", "fp", "n", "s1", "s2", "sig"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, f"id {kind}, fp long, n int, s1 long, s2 long, sig array<int>")


def _sigs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint32).reshape(-1, T)


_ROW = ("b", "fp", "s1", "s2", "used")
_ROW_SCHEMA = "b long, fp long, s1 long, s2 long, used long"


def _paths(path, used, row, fp, s1, s2) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(path), pa.array(fp[row]), pa.array(s1[row]), pa.array(s2[row]), _signed(used)], names=list(_ROW))


def _first_paths(texts: DataFrame, runs: int, rate: float) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                p = b.slice(at, 2048)
                sig, (fp, s1, s2) = _sigs(p.column(3)), (p.column(i).to_numpy() for i in range(3))
                for r in range(runs):
                    row, path, used = extend(np.full(len(fp), r, np.uint64), np.zeros(len(fp), np.uint64), sig, rate)
                    yield _paths(path, used, row, fp, s1, s2)

    return texts.select("fp", "s1", "s2", "sig").mapInArrow(run, _ROW_SCHEMA)


def _next_paths(rows: DataFrame, texts: DataFrame, rate: float) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                p = b.slice(at, 2048)
                parent, fp, s1, s2, used = (p.column(i).to_numpy() for i in range(5))
                row, path, used = extend(parent.view(np.uint64), used.view(np.uint64), _sigs(p.column(5)), rate)
                yield _paths(path, used, row, fp, s1, s2)

    return rows.join(texts.select("fp", "sig"), "fp").select(*_ROW, "sig").mapInArrow(run, _ROW_SCHEMA)


def _star(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Ties as stars: what a task has found costs a row a text, however many pairs there were."""
    v, root = least_of_component(np.concatenate(a), np.concatenate(b))
    keep = v != root
    return pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(root[keep])], names=["a", "b"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, size: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first ``keys`` ones, in pieces of whole groups and about ``size`` rows."""
    held, rows = [], 0
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        rows += b.num_rows
        if rows < size:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        last = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in cols[:keys]])))  # the last group may go on
        if last:
            yield [c[:last] for c in cols]
        held, rows = [[c[last:] for c in cols]], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _groups(*keys: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each group of sorted keys."""
    cut = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
    return np.split(np.arange(len(keys[0])), cut)


def _brute(rows: DataFrame, limit: int, near: int) -> DataFrame:
    """Ties within buckets of at most ``limit`` texts: rows sorted by bucket are compared with the next ones."""

    def run(batches):
        for b, fp, s1, s2 in _grouped(batches, 1):
            found = [], []
            for d in range(1, min(limit, len(b))):
                at = np.flatnonzero(b[d:] == b[:-d])
                if not len(at):
                    break
                at = at[differing(s1[at + d], s2[at + d], s1[at], s2[at]) <= near]
                found[0].append(fp[at])
                found[1].append(fp[at + d])
            if found[0]:
                yield _star(*found)

    return rows.select("b", "fp", "s1", "s2").repartition("b").sortWithinPartitions("b").mapInArrow(run, "a long, b long")


def _in_blocks(rows: DataFrame, near: int, part: int) -> DataFrame:
    """Ties within buckets of any size (column ``stay``): blocks of about ``part`` texts, each against each."""
    nb = F.ceil(F.col("stay") / part).cast("int")
    own = rows.select("b", "fp", "s1", "s2", nb.alias("nb")).withColumn("x", F.pmod(F.xxhash64("fp"), "nb").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    side = ((F.col("x") > F.col("y"))).cast("int")
    dealt = own.select("b", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), side.alias("side"), "fp", "s1", "s2").repartition("b", "i", "j").sortWithinPartitions("b", "i", "j")

    def run(batches):
        for b, i, j, side, fp, s1, s2 in _grouped(batches, 3):
            for at in _groups(b, i, j):
                one = at if i[at[0]] == j[at[0]] else at[side[at] == 0]
                two = at if i[at[0]] == j[at[0]] else at[side[at] == 1]
                found = [], []
                for lo in range(0, len(one), 256):
                    k = one[lo : lo + 256]
                    x, y = np.nonzero(differing(s1[k][:, None], s2[k][:, None], s1[two], s2[two]) <= near)
                    found[0].append(fp[k[x]])
                    found[1].append(fp[two[y]])
                if found[0]:
                    yield _star(*found)

    return dealt.mapInArrow(run, "a long, b long")


def _bridges(rows: DataFrame, near: int, leave: int, leavers: int) -> DataFrame:
    """Ties of texts that stay to the pivot, where one of those that leave is near them.

    Both are dealt to blocks of about ``leavers``, and each block of the one meets each of the other.
    A text that stays is compared only with what the triangle inequality leaves possible.
    """
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / leavers)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    gone = rows.where(f"r <= {leave} and fp != p").withColumn("i", own(blocks("gone"))).withColumn("j", every(blocks("stay")))
    some = rows.where(f"r > {near} and r <= farthest + {near}").withColumn("j", own(blocks("stay"))).withColumn("i", every(blocks("gone")))
    cols = ("b", "i", "j", "r", "p", "fp", "s1", "s2")
    both = gone.select(*cols).unionByName(some.select(*cols)).repartition("b", "i", "j").sortWithinPartitions("b", "i", "j", "r")

    def run(batches):
        for b, i, j, r, p, fp, s1, s2 in _grouped(batches, 3):
            for at in _groups(b, i, j):
                far, found = at[r[at] > near], []
                left = at[r[at] <= leave][::-1]  # the farthest from the pivot first: most likely near those that stay
                for lo in range(0, len(far), 64):
                    open_ = far[lo : lo + 64]
                    possible = left[r[left] >= r[open_].min() - near]
                    step = 64
                    while len(possible) and len(open_):
                        k, possible, step = possible[:step], possible[step:], 4096
                        hit = (differing(s1[open_][:, None], s2[open_][:, None], s1[k], s2[k]) <= near).any(1)
                        found.append(open_[hit])
                        open_ = open_[~hit]
                if found:
                    f = np.concatenate(found)
                    yield pa.RecordBatch.from_arrays([pa.array(fp[f]), pa.array(p[f])], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _level(rows: DataFrame, near: int, leave: int, split: int, limit: int, part: int, leavers: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """Ties of one level's buckets, and the rows to split on; both written."""
    pivot = F.min(F.struct(F.xxhash64("fp", "b").alias("o"), "fp", "s1", "s2")).alias("pivot")
    buckets = rows.groupBy("b").agg(F.count("*").alias("size"), pivot).where("size > 1")
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("pivot.s1")).bitwiseOR(F.col("s2").bitwiseXOR(F.col("pivot.s2"))))
    met = rows.join(buckets, "b").select(*[F.col(c) for c in _ROW], "size", apart.alias("r"), F.col("pivot.fp").alias("p")).persist(StorageLevel.MEMORY_AND_DISK)
    small, large = met.where(f"size <= {limit}"), met.where(f"size > {limit}").drop("size")
    left = (F.col("fp") != F.col("p")) & (F.col("r") <= leave)
    counts = large.groupBy("b").agg(F.sum((F.col("r") > leave).cast("int")).alias("stay"), F.sum(left.cast("int")).alias("gone"), F.max(F.when(left, F.col("r"))).alias("farthest"))
    large = large.join(counts, "b")
    rest = large.where(f"r > {leave}")
    swept = small.select("b", "fp", "s1", "s2").unionByName(rest.where(f"stay <= {limit}").select("b", "fp", "s1", "s2"))
    blocks = rest.where(f"stay > {limit}" if last else f"stay > {limit} and stay <= {split}")
    ties = large.where(f"fp != p and r <= {near}").select(F.col("fp").alias("a"), F.col("p").alias("b"))
    ties = ties.unionByName(_bridges(large.where("farthest > 0"), near, leave, leavers)).unionByName(_brute(swept, limit, near)).unionByName(_in_blocks(blocks, near, part))
    ties = written(ties.distinct(), "ties")
    hard = rest.select(*_ROW).limit(0) if last else written(rest.where(f"stay > {split}").select(*_ROW), "hard")
    met.unpersist()
    return ties, hard


def candidate_ties(texts: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, depth: int = DEPTH, split: int = SPLIT, limit: int = LIMIT, leave: int = LEAVE, part: int = PART, leavers: int = LEAVERS) -> DataFrame:
    """(a, b): texts that may be similar.  ``texts``: fp, s1, s2, sig; each fp once.  Each level is written, which keeps plans small."""
    near, rate = reach(threshold), 1.6 / threshold
    ties, rows = None, _first_paths(texts, runs, rate)
    for level in range(1, depth + 1):
        new, hard = _level(rows, near, min(leave, near), split, limit, part, leavers, level == depth)
        ties = new if ties is None else ties.unionByName(new)
        if level > 1:
            rows.unpersist()
        if level == depth or hard.isEmpty():
            break
        rows = _next_paths(hard, texts, rate).persist(StorageLevel.MEMORY_AND_DISK)  # read twice
        release(texts.sparkSession)
    return ties


# -- exact comparison -------------------------------------------------------------------------
def similar(sets: list[np.ndarray], threshold: float, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each i of ``a``: the members of ``b`` that reach the threshold, i itself left out.  Exact."""
    size = np.array([len(s) for s in sets], np.int64)
    need, base = round(threshold * 1_000_000), 1_000_000
    ok = lambda inter, x, y: (inter > 0) & (inter * base >= need * (x + y - inter))
    if len(a) * len(b) <= 64:
        for i in a:
            got = [j for j in b if i != j and min(size[i], size[j]) * base >= need * max(size[i], size[j]) and ok(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), size[i], size[j])]
            yield int(i), np.array(got, np.int64)
        return
    tokens, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    place = np.cumsum(counts > 1) - 1
    column = place[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((len(a), len(b)), np.float32)
    row_a, row_b = np.full(len(sets), -1), np.full(len(sets), -1)
    row_a[a], row_b[b] = np.arange(len(a)), np.arange(len(b))
    width, at = 2048, 0
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        end = int(np.searchsorted(column, lo + width))
        o, c = owner[at:end], column[at:end] - lo
        at = end
        left, right = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        left[row_a[o[row_a[o] >= 0]], c[row_a[o] >= 0]] = 1
        right[row_b[o[row_b[o] >= 0]], c[row_b[o] >= 0]] = 1
        inter += left @ right.T
    good = ok(inter.astype(np.int64), size[a][:, None], size[b][None, :])
    for k, i in enumerate(a):
        j = b[good[k]]
        yield int(i), j[j != i]


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: g, i, j, side, fp, copies, set, sorted by (g, i, j).  One row per text and block pair: links, least text tied to it."""

    def block(same, side, fp, copies, sets):
        one = np.flatnonzero(side == 0)
        two = one if same else np.flatnonzero(side == 1)
        links, parent = np.zeros(len(fp), np.int64), list(range(len(fp)))
        for i, found in similar(sets, threshold, one, two) if len(one) and len(two) else ():
            links[i] += copies[found].sum()
            if not same:
                links[found] += copies[i]
            for j in found.tolist():
                x, y = _root(parent, i), _root(parent, j)
                if x != y:
                    x, y = (x, y) if fp[x] < fp[y] else (y, x)
                    parent[y] = x
        roots = np.array([fp[_root(parent, i)] for i in range(len(fp))], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(links), pa.array(roots)], names=["fp", "links", "root"])

    def run(batches):
        key, held = None, []

        def done():
            side, fp, copies = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 2))
            return block(key[1] == key[2], side, fp, copies, [h[3] for h in held])

        for b in batches:
            g, i, j, side, fp, copies = (b.column(k).to_pylist() for k in range(6))
            sets, values = b.column(6).offsets.to_numpy(), b.column(6).values.to_numpy().view(np.uint64)
            for k in range(b.num_rows):
                if (g[k], i[k], j[k]) != key:
                    if held:
                        yield done()
                    key, held = (g[k], i[k], j[k]), []
                held.append((side[k], fp[k], copies[k], values[sets[k] : sets[k + 1]].copy()))
        if held:
            yield done()

    return rows.select("g", "i", "j", "side", "fp", "copies", "set").mapInArrow(run, "fp long, links long, root long")


def _sets(rows: DataFrame) -> DataFrame:
    """g, nb, fp, copies, set of the rows whose text really has that fp (ids may repeat)."""

    def run(batches):
        for batch in batches:
            for p in slices(batch, 4):
                fp, sets = p.column(2).to_pylist(), shingle_sets(p.column(4))
                keep = [k for k, s in enumerate(sets) if fingerprint(s) == fp[k]]
                t = p.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), t.column(3), pa.array([sets[k].view(np.int64) for k in keep], pa.list_(pa.int64()))], names=["g", "nb", "fp", "copies", "set"])

    return rows.select("g", "nb", "fp", "copies", "t").mapInArrow(run, "g long, nb int, fp long, copies long, set array<long>")


def _found(docs: DataFrame, id_col: str, text_col: str, groups: DataFrame, texts: DataFrame, threshold: float, block: int, shingles: int) -> DataFrame:
    """(fp, links, root) of each text of the candidate groups (v, root) and each pair of blocks it is compared in; written."""
    members = groups.join(texts.select(F.col("fp").alias("v"), "copies", "rep", "n"), "v")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.least(F.count("*"), F.ceil(F.sum("n") / shingles))).cast("int").alias("nb"))
    members = members.join(sizes, "root").select(F.col("root").alias("g"), "nb", F.col("v").alias("fp"), "copies", "rep")
    whole = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    # never broadcast: which texts have partners grows with the input
    sets = _sets(whole.join(members.hint("merge"), F.col("id").eqNullSafe(F.col("rep"))))
    sets = sets.dropDuplicates(["fp"])
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    # text of block x goes to the pairs (x, y) and (y, x) of all blocks y
    pairs = sets.withColumn("x", own).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = pairs.withColumn("i", F.least("x", "y")).withColumn("j", F.greatest("x", "y")).withColumn("side", F.when((F.col("i") != F.col("j")) & (F.col("x") == F.col("j")), 1).otherwise(0))
    dealt = pairs.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return written(_compare(dealt, threshold), "found")


def join(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, depth: int = DEPTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", shingles: int = BLOCK_SHINGLES, **search) -> DataFrame:
    """(id, class_id, n_links, is_first) of each row.

    A class is a connected component of documents linked at ``threshold`` or more; ``class_id`` is
    its least id.  ``n_links`` counts the other documents at the threshold or above, copies
    included.  Null text counts as empty; documents without words are copies of one another.  Rows
    with one id are documents of their own; a null id comes after all others.  An empty table gives
    an empty result; texts of any length are compared whole; columns other than the two are not read,
    so they may have any name.  ``search``: limits of ``candidate_ties``.
    """
    rows = written(described(docs, id_col, text_col), "described")
    one = [F.first(c).alias(c) for c in ("n", "s1", "s2", "sig")]
    texts = written(rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("id").alias("rep"), *one), "texts")
    groups = components(candidate_ties(texts.where("n > 0"), threshold, runs, depth, **search))
    release(docs.sparkSession)
    found = _found(docs, id_col, text_col, groups, texts, threshold, block, shingles)
    release(docs.sparkSession)
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    named = texts.select("fp", "copies", "rep").join(links, "fp", "left").join(classes.withColumnRenamed("v", "fp"), "fp", "left")
    named = named.select("fp", "rep", F.coalesce("root", "fp").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"), F.min(F.struct(F.col("rep").isNull(), "rep", "fp")).alias("lead"))
    named = named.join(least, "root").select("fp", "class_id", "n_links", (F.col("lead.fp") == F.col("fp")).alias("lead"))
    return rows.select("id", "fp").join(named, "fp").select(F.col("id").alias(id_col), "class_id", "n_links", (F.col("lead") & F.col("id").eqNullSafe(F.col("class_id"))).alias("is_first"))
