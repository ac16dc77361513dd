"""Similarity join on word shingles (Jaccard), size-aware and heavy-light.

A document's set holds its distinct shingles of WORDS words; equal sets form one class, and classes are joined. All shingles
stand in one global order, rare ones first, by a frequency table of fixed size gathered over the whole corpus. A
set of n shingles that links to another shares at least ceil(t n) of them, so that two linked sets share at least c
shingles among the first n - ceil(t n) + c of each.
  Small sets (n up to a boundary) enumerate all subsets of size 2 of that prefix (c = 2); two small sets that link share one.
  Large sets write their prefix (c = 1) to inverted lists, which are scanned; so do small sets that can link to a large one.
The boundary is the one of least cost: subsets written against entries written and scanned, by the histogram of small
sizes and the mean length of the lists.

Lists are dealt out in pairs of blocks of BLOCK members where they are long. Within one, vectors of counts bound the difference of two sets
from below; pairs that pass tie sets into clusters, and only a spanning forest of them leaves a task, so that no list is expanded into
its pairs. Two linked sets are in one cluster. Then links are verified on whole sets:
  First each set meets the nearest one that it is tied to: it is sent once, and once more for each BLOCK sets that it is the nearest of.
  Where these links leave several parts of a cluster, sets of different parts meet in pairs of blocks, those of the largest part
  with the others only, and pairs that are not yet connected are verified, the nearest first.
The components of the verified links are the result. No task holds more than a pair of blocks.

Defined results: null and empty texts, and those without words, have an empty set, linked with nothing: their component
is their own doc_id. Fewer than WORDS words make one shingle. Rows that repeat get a row each; equal sets are one class.
Rows with one doc_id and different texts are apart. An empty table gives an empty result. Other columns are not read.
drop_near() keeps all rows that are equal in doc_id and text to the one that stays, and all without a set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, broadcast_if_small, compact, drop_stored, gathered, in_batches, packed, partitions, stored, table
from .components import components

WORDS = 5
#: Links: NUMER * union <= DENOM * intersection.
NUMER, DENOM = 4, 5
SLOTS, PARTS = 1 << 22, 256
SMALL_MOST = 64
#: Slots of the counts that go along in lists, and shingles of a set for each slot at most.
COUNTS, LOAD = 256, 10
#: Parities by which whole sets are compared first.
BITS = 4096
#: Members of a list or of a part of a cluster that are a block, and bytes of whole sets.
BLOCK, BLOCK_BYTES = 2000, 32 << 20
#: Rows of lists that are looked at together.
CHUNK = 100_000
#: Members of clusters, held as a narrow row each, up to which they are broadcast.
MEMBERS = 300_000
MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; bytes.lower() and split() know ASCII only, as wanted."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    size = min(n, k)
    out = h[: n - size + 1].copy()
    for i in range(1, size):
        out = out * MUL + h[i : n - size + 1 + i]
    return np.unique(mix(out + np.uint64(size)))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def need(n: int) -> int:
    return -(-NUMER * n // DENOM)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return DENOM * both >= NUMER * (len(a) + len(b) - both)


def bits(s: np.ndarray, size: int) -> np.ndarray:
    """Parities of the number of shingles in each of `size` slots. Two sets differ in at least as many shingles as their parities differ."""
    return np.packbits((np.bincount(((s >> np.uint64(22)) % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.uint64)


def counted(s: np.ndarray) -> bytes:
    """Number of shingles in each slot, modulo 16, two slots a byte. Two sets differ in at least as many shingles as their counts differ by."""
    size = COUNTS
    while size * LOAD < len(s):
        size *= 2
    c = (np.bincount(((s >> np.uint64(22)) % np.uint64(size)).astype(np.int64), minlength=size) & 15).astype(np.uint8)
    return (c[0::2] | (c[1::2] << 4)).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return np.column_stack([a & 15, a >> 4]).ravel()


def folded(c: np.ndarray, size: int) -> np.ndarray:
    """Counts of a set in fewer slots."""
    while len(c) > size:
        c = (c[: len(c) // 2] + c[len(c) // 2 :]) & 15
    return c


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much counts differ, a row each."""
    d = (a - b) & 15
    return np.minimum(d, 16 - d).sum(-1, dtype=np.int64)


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """did, cls, n, th, counts for each document; at the end part, sums: how many sets of this task have a shingle in each slot."""
    names, counts, seen = ["did", "cls", "n", "th", "counts", "part", "sums"], np.zeros(SLOTS, np.uint32), set()
    for batch in batches:
        rows = []
        for t in batch.column(1).cast(pa.binary()):
            text = t.as_py() or b""
            s = shingles(text)
            cls = digest(s.tobytes()) if len(s) else None
            rows.append((cls, len(s), hashlib.sha256(text).digest()[:16], counted(s) if len(s) else None))
            if cls and cls not in seen:
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(cls)
                np.add.at(counts, (s % np.uint64(SLOTS)).astype(np.int64), 1)
        n = batch.num_rows
        cls, size, th, flags = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(size, pa.int64()), pa.array(th, pa.binary()), pa.array(flags, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    if counts.any():
        pack, step = zstandard.ZstdCompressor(1), SLOTS // PARTS
        blobs = [pack.compress(counts[i * step : (i + 1) * step].tobytes()) for i in range(PARTS)]
        no = lambda kind: pa.nulls(PARTS, kind)
        yield pa.RecordBatch.from_arrays([no(pa.int64()), no(pa.binary()), no(pa.int64()), no(pa.binary()), no(pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], names=names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all tasks added up part by part: part, level (a byte for each slot), squares, total."""
    sums: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.frombuffer(unpack.decompress(blob), np.uint32)
            sums[part] = sums[part] + found if part in sums else found.astype(np.uint64)
    if sums:
        level = [np.ceil(np.log2(v.astype(float) + 1)).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array(level, pa.binary()), pa.array([float((v.astype(float) ** 2).sum()) for v in sums.values()]), pa.array([float(v.sum()) for v in sums.values()])], names=["part", "level", "squares", "total"])


def boundary(sizes: dict[int, int], partners: float) -> int:
    """The size up to which sets count as small, of least cost. sizes: sets by size, up to SMALL_MOST; partners: other sets in a list."""
    best = (float("inf"), 3)
    for edge in range(3, SMALL_MOST + 1):
        cost = 0.0
        for n, count in sizes.items():
            p = n - need(n) + 1
            cost += count * ((p + 1) * p / 2 if n <= edge else 0)
            cost += count * (p * (1 + partners) if n > NUMER * edge / DENOM else 0)
        best = min(best, (cost, edge))
    return best[1]


def signatures(s: np.ndarray, level: np.ndarray, edge: int) -> np.ndarray:
    """Signatures of a set: hashes of subsets of size 2, of prefix shingles, or of both near the boundary."""
    n = len(s)
    if n < NUMER:
        return s[:0]  # links to equal sets only
    weight = (level[(s % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
    ordered = s[np.argsort(weight, kind="stable")]
    out = []
    if n <= edge:
        p = ordered[: n - need(n) + 2]
        i, j = np.triu_indices(len(p), 1)
        out.append(mix(p[i] * MUL + p[j]))
    if n * DENOM > NUMER * edge:
        out.append(ordered[: n - need(n) + 1])
    return np.concatenate(out)


def _lists(block: int):
    """Rows sorted by sig, c1 -> sig, c1, own (number of the row's block) of lists of two or more c1; a row without c1 says how many blocks a list of several has."""
    schema = pa.schema([("sig", pa.int64()), ("c1", pa.int64()), ("own", pa.int32()), ("blocks", pa.int32())])

    def tails(sig: list, n: list) -> Iterator[pa.RecordBatch]:
        if found := [{"sig": int(s), "blocks": -(-int(k) // block)} for s, k in zip(sig, n) if k > block]:
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, c, n = None, None, 0  # of the list that is open: its last c1, and how many it has
        for b in batches:
            s, c1 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (c1[1:] != c1[:-1])
            if n and len(s):
                new[0] = s[0] != sig or c1[0] != c
            s, c1 = s[new], c1[new]
            if not len(s):
                continue
            if n == 1:  # a first row has been held back
                s, c1, n = np.r_[sig, s], np.r_[c, c1], 0
            elif s[0] != sig:
                yield from tails([sig], [n])
                n = 0
            at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[at, len(s)])
            place = np.arange(len(s)) - np.repeat(at, size)
            place[: size[0]] += n
            total = size.copy()
            total[0] += n
            keep = np.repeat(total > 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(c1[keep]), pa.array((place[keep] // block).astype(np.int32)), pa.nulls(int(keep.sum()), pa.int32())], schema=schema)
            yield from tails(s[at[:-1]], total[:-1])
            sig, c, n = s[-1], c1[-1], int(total[-1])
        yield from tails([sig], [n])

    return run


def _root(top: list, x: int) -> int:
    while top[x] != x:
        top[x] = top[top[x]]
        x = top[x]
    return x


def tied(key: np.ndarray, at: np.ndarray, n: np.ndarray, counts: list[np.ndarray]) -> Iterator[tuple[int, int, float]]:
    """key: sig, lo, hi, own of each row; at: its set -> pairs of sets and how far they are apart: a spanning forest of the pairs within a list that the counts let pass."""
    vectors, width = np.array([folded(c, COUNTS) for c in counts]), np.array([len(c) for c in counts])
    order = np.lexsort((at, key[:, 2], key[:, 1], key[:, 0]))
    key, at = key[order], at[order]
    same = (key[1:, :3] == key[:-1, :3]).all(1)
    group, starts = np.r_[0, np.cumsum(~same)], np.r_[0, np.flatnonzero(~same) + 1]
    last = np.r_[np.flatnonzero(~same), len(at) - 1][group]  # place of the last row of each row's list
    cross = key[:, 1] != key[:, 2]  # rows of two different blocks: only pairs across
    label, step, left = np.arange(len(n)), 1, np.arange(len(at))
    while True:
        left = left[left + step <= last[left]]
        if not len(left):
            return
        i, j = at[left], at[left + step]
        ok = (label[i] != label[j]) & (DENOM * np.minimum(n[i], n[j]) >= NUMER * np.maximum(n[i], n[j]))
        ok &= ~cross[left] | (key[left, 3] != key[left + step, 3])
        pairs = np.unique(np.minimum(i[ok], j[ok]) * len(n) + np.maximum(i[ok], j[ok]))
        merged = False
        for k in range(0, len(pairs), CHUNK):
            p, q = pairs[k : k + CHUNK] // len(n), pairs[k : k + CHUNK] % len(n)
            far = apart(vectors[p], vectors[q])
            ok = (NUMER + DENOM) * far <= (DENOM - NUMER) * (n[p] + n[q])
            for m in np.flatnonzero(ok & (width[p] > COUNTS) & (width[q] > COUNTS)):
                u, v = counts[p[m]], counts[q[m]]
                far[m] = apart(folded(u, len(v)), folded(v, len(u)))
                ok[m] = (NUMER + DENOM) * far[m] <= (DENOM - NUMER) * (n[p[m]] + n[q[m]])
            if not ok.any():
                continue
            merged, top = True, label.tolist()
            p, q, far = p[ok], q[ok], far[ok] / (n[p[ok]] + n[q[ok]])
            for m in np.argsort(far, kind="stable").tolist():
                u, v = _root(top, int(p[m])), _root(top, int(q[m]))
                if u != v:
                    top[max(u, v)] = min(u, v)
                    yield int(p[m]), int(q[m]), float(far[m])
            label = np.array(top)
            while (label[label] != label).any():
                label = label[label]
        if merged:  # lists that are of one label are done
            held = label[at]
            open_lists = np.minimum.reduceat(held, starts) != np.maximum.reduceat(held, starts)
            left = left[open_lists[group[left]]]
        step += 1


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sig, lo, hi, own, cls, n, counts, sorted by sig, lo, hi -> a, b, far. Memory holds CHUNK rows or one list."""

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cls = rows["cls"].combine_chunks().dictionary_encode()
        names, at = cls.dictionary, cls.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first = np.unique(at, return_index=True)
        if len(first) < 2:
            return
        key = np.column_stack([rows[c].to_numpy().astype(np.int64) for c in ("sig", "lo", "hi", "own")])
        counts = [unpacked(x) for x in rows["counts"].take(pa.array(first)).to_pylist()]
        found = list(tied(key, at, rows["n"].to_numpy()[first], counts))
        for k in range(0, len(found), 20_000):
            a, b, far = zip(*found[k : k + 20_000])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(far, pa.float64())], names=["a", "b", "far"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CHUNK:
            rows = pa.Table.from_batches(held)
            key = [rows[c].to_numpy() for c in ("sig", "lo", "hi")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            if len(cuts):
                yield from flush(rows.slice(0, int(cuts[-1])))
                held = rows.slice(int(cuts[-1])).to_batches()
                size = sum(x.num_rows for x in held)
    if size:
        yield from flush(pa.Table.from_batches(held))


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows hub, salt, kind, cls, set, sorted; the hub's own row (kind 0) first -> links a, b of the hub with the others. Memory holds the hub's set."""
    hub, whole = None, None
    for b in batches:
        found = []
        for i, (key, kind, cls) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3)))):
            if not kind:
                hub, whole = key, _set(b.column(4)[i].as_py())
            elif key == hub and links(whole, _set(b.column(4)[i].as_py())):
                found.append((hub, cls))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def forest(left: list[tuple], right: list[tuple] | None) -> Iterator[tuple[bytes, bytes]]:
    """(cls, part, set) -> a spanning forest of the links among the sets of left, or between those of left and right; sets of one part are connected already."""
    rows = left + (right or [])
    first = len(left) if right is not None else 0
    n = np.array([len(s) for _, _, s in rows])
    size = BITS
    while size < n.max() / 2:  # a pair that links may differ in 2 n / 9; parities of unlike sets differ in up to size / 2
        size *= 2
    vectors = np.array([bits(s, size) for _, _, s in rows])
    _, part = np.unique(np.array([p for _, p, _ in rows], object), return_inverse=True)
    top, found = list(range(part.max() + 1)), []
    for i in range(len(left)):
        j = np.arange(max(first, i + 1), len(rows))
        j = j[(part[j] != part[i]) & (DENOM * np.minimum(n[i], n[j]) >= NUMER * np.maximum(n[i], n[j]))]
        if len(j):
            far = np.bitwise_count(vectors[i] ^ vectors[j]).sum(1, dtype=np.int64)
            ok = (NUMER + DENOM) * far <= (DENOM - NUMER) * (n[i] + n[j])
            found.append((np.full(ok.sum(), i, np.int32), j[ok].astype(np.int32), (far[ok] / (n[i] + n[j][ok])).astype(np.float32)))
    if not found:
        return
    a, b, far = (np.concatenate(z) for z in zip(*found))
    for k in np.argsort(far, kind="stable"):
        p, q = _root(top, part[a[k]]), _root(top, part[b[k]])
        if p != q and links(rows[a[k]][2], rows[b[k]][2]):
            top[p] = q
            yield rows[a[k]][0], rows[b[k]][0]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows cluster, lo, hi, own, part, cls, set, sorted by cluster, lo, hi -> verified links a, b. Memory holds one pair of blocks."""
    key, rows = None, {}

    def flush() -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        _, lo, hi = key
        side = lambda block: [(c, part, s) for c, (own, part, s) in rows.items() if own == block]
        out = list(forest(side(lo), None if lo == hi else side(hi)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    for b in batches:
        for i, (cluster, lo, hi, own, part, cls) in enumerate(zip(*(b.column(i).to_pylist() for i in range(6)))):
            if key != (cluster, lo, hi):
                yield from flush()
                key, rows = (cluster, lo, hi), {}
            rows[cls] = (own, part, _set(b.column(6)[i].as_py()))
    yield from flush()


def _sent(docs: DataFrame, members: DataFrame, targets: str, most: int) -> DataFrame:
    """members (cls, _did, to: array of targets) -> a row for each target with cls and the whole set of the class, made from the texts of docs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, cls, to in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), b.column(2)):
                data = shingles(text.as_py()).tobytes()
                if digest(data) == cls:  # else another text of this doc_id
                    to = to.values
                    for k in range(0, len(to), max(1, BLOCK_BYTES // len(data))):
                        some = to.slice(k, max(1, BLOCK_BYTES // len(data)))
                        yield pa.RecordBatch.from_arrays([some, pa.array([cls] * len(some), pa.binary()), pa.array([data] * len(some), pa.binary())], names=["to", "cls", "set"])

    rows = docs.select("doc_id", "text").join(broadcast_if_small(members, members.count(), most), F.col("doc_id").eqNullSafe(F.col("_did")))
    return rows.select("text", "cls", "to").mapInArrow(alone(run), f"to {targets}, cls binary, set binary").select("to.*", "cls", "set")


def near_groups(docs: DataFrame, block: int = BLOCK, most: int = MEMBERS) -> DataFrame:
    """One row per document: did (doc_id), th (key of the text), n (size of the set), component_id, first (stands for its group)."""
    spark = docs.sparkSession
    n_parts = partitions(spark)
    frame = in_batches(docs).select("doc_id", "text")
    profile = stored(gathered(frame.mapInArrow(alone(_profile), "did long, cls binary, n long, th binary, counts binary, part int, sums binary")), "profile")
    rows = profile.where("part is null").select("did", "cls", "n", "th", "counts")
    most_rows = profile.count()
    parts = profile.where("part is not null").select("part", "sums").repartition(min(PARTS, n_parts), "part").mapInArrow(alone(_summed), "part int, level binary, squares double, total double").collect()
    levels, step = np.zeros(SLOTS, np.uint8), SLOTS // PARTS  # of fixed size, whatever the corpus
    for r in parts:
        levels[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["level"], np.uint8)
    total = sum(r["total"] for r in parts)
    partners = max(0.0, sum(r["squares"] for r in parts) / max(total, 1) - total / SLOTS - 1)
    sizes = {r["n"]: r["count"] for r in rows.where(F.col("n").between(NUMER, SMALL_MOST)).groupBy("n").count().collect()}  # at most SMALL_MOST rows
    edge, shared = boundary(sizes, partners), spark.sparkContext.broadcast(levels.tobytes())

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            sig, c1, size = [], [], 0
            for t in batch.column(0).cast(pa.binary()):
                s = shingles(t.as_py())
                cls = digest(s.tobytes())
                if cls in seen:  # copies within a task are written once
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(cls)
                found = signatures(s, level, edge)
                sig.append(found.view(np.int64))
                c1.append(np.full(len(found), int.from_bytes(cls[:8], "big", signed=True), np.int64))
                size += len(found)
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (sig, c1)], names=["sig", "c1"])
                    sig, c1, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (sig, c1)], names=["sig", "c1"])

    pairs = docs.select("text").mapInArrow(alone(post), "sig long, c1 long").repartition(n_parts, "sig").sortWithinPartitions("sig", "c1")
    lists = stored(gathered(pairs.mapInArrow(alone(_lists(block)), "sig long, c1 long, own int, blocks int")), "lists")
    # Copies of a class are alike in counts and size; c1 is the head of cls, and classes that share it are both taken.
    classes = rows.where("cls is not null").groupBy("cls", "n", "counts").agg(F.min(F.struct(F.col("did").isNull().alias("none"), "did", "th")).alias("first"))
    classes = stored(compact(classes, most_rows), "classes")
    head = F.conv(F.hex(F.substring("cls", 1, 8)), 16, -10).cast("long")
    several = lists.where("c1 is null").select(F.col("sig").alias("_sig"), F.col("blocks").alias("_blocks"))
    listed = lists.where("c1 is not null").join(broadcast_if_small(several, several.count()), F.col("sig") == F.col("_sig"), "left")
    listed = listed.select("sig", "c1", "own", F.coalesce("_blocks", F.lit(1)).alias("blocks")).join(classes.select(head.alias("c1"), "cls", "n", "counts"), "c1")
    listed = listed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    listed = listed.select("sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cls", "n", "counts")
    listed = listed.repartition(n_parts, "sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    ties = stored(gathered(listed.mapInArrow(alone(_tied), "a binary, b binary, far double")), "ties")
    drop_stored(lists)
    clusters = components(ties.select("a", "b"))

    # Each set and the nearest that it is tied to; of two that are each other's nearest, one is the hub.
    both = ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    nearest = both.groupBy("a").agg(F.min(F.struct("far", "b")).alias("s")).select("a", F.col("s.b").alias("b"))
    nearest = nearest.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("a").alias("cls")).select("cls", F.when(F.col("cls") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("hub"))
    nearest = stored(compact(nearest, most_rows), "nearest")
    hubs = nearest.groupBy(F.col("hub").alias("_hub")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("salts"))
    spokes = nearest.join(hubs, F.col("hub") == F.col("_hub")).select("cls", "hub", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"))
    own = hubs.select(F.col("_hub").alias("cls"), F.col("_hub").alias("hub"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(0).alias("kind"))
    to = spokes.unionByName(own).groupBy(F.col("cls").alias("_cls")).agg(F.collect_list(F.struct("hub", "salt", "kind")).alias("to"))
    home = classes.select("cls", "n", F.col("first.did").alias("_did"))
    members = stored(compact(home.join(to, F.col("cls") == F.col("_cls")).select("cls", "_did", "to"), most_rows), "members")
    met = _sent(docs, members, "struct<hub: binary, salt: int, kind: int>", most)
    met = met.repartition(n_parts, "hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    verified = components(met.mapInArrow(alone(_verified), "a binary, b binary"))

    # The parts of each cluster; where there are several, the largest and the others.
    at = home.join(clusters.select("node", F.col("root").alias("cluster")), F.col("cls") == F.col("node")).select("cls", "n", "_did", "cluster")
    at = at.join(verified, F.col("cls") == F.col("node"), "left").select("cls", "n", "_did", "cluster", F.coalesce("root", "cls").alias("own_part"))
    at = stored(compact(at, most_rows), "parts")
    sums = at.groupBy("cluster", "own_part").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size"))
    whole = sums.groupBy(F.col("cluster").alias("_cluster")).agg(F.max(F.struct("sets", "size", "own_part")).alias("top"), F.sum("sets").alias("sets"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("several"))
    blocks = lambda sets, size: F.greatest(F.ceil(sets / block), F.ceil(size * 8 / BLOCK_BYTES)).cast("int")
    whole = whole.where("several > 1").select("_cluster", F.col("top.own_part").alias("largest"), blocks(F.col("top.sets"), F.col("top.size")).alias("l"), blocks(F.col("sets") - F.col("top.sets"), F.col("size") - F.col("top.size")).alias("r"))
    left = at.join(whole, F.col("cluster") == F.col("_cluster")).withColumn("inside", F.col("own_part") == F.col("largest"))
    left = left.withColumn("own", F.expr("if(inside, pmod(xxhash64(cls), l), l + pmod(xxhash64(cls), r))").cast("int"))
    left = left.withColumn("others", F.expr("sequence(if(inside, l, 0), l + r - 1)"))
    left = stored(gathered(left.select("cls", "_did", F.expr("transform(others, o -> named_struct('cluster', cluster, 'lo', least(own, o), 'hi', greatest(own, o), 'own', own, 'part', own_part))").alias("to"))), "left")
    met = _sent(docs, left, "struct<cluster: binary, lo: int, hi: int, own: int, part: binary>", most)
    met = met.repartition(n_parts, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    more = met.mapInArrow(alone(_joined), "a binary, b binary")
    part_of = at.select(F.col("cls").alias("_c"), F.col("own_part").alias("_p"))
    for c in ("a", "b"):
        more = more.join(part_of, F.col(c) == F.col("_c")).select(*[F.col("_p").alias(x) if x == c else x for x in ("a", "b")])
    joined = components(more)
    roots = at.join(joined, F.col("own_part") == F.col("node"), "left").select(F.col("cls").alias("node"), F.coalesce("root", "own_part").alias("root"))

    at = classes.select("cls", "first").join(roots, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"), "first")
    at = stored(compact(at, most_rows), "at")
    firsts = at.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("best"))
    at = stored(gathered(at.join(firsts, F.col("root") == F.col("_root")).select(F.col("cls").alias("_cls"), "best")), "groups")
    for gone in (ties, clusters, nearest, members, verified, left, joined, classes):
        drop_stored(gone)
    full = rows.where("cls is not null").join(at, F.col("cls") == F.col("_cls"))
    full = full.select("did", "th", "n", F.col("best.did").alias("component_id"), (F.col("did").eqNullSafe(F.col("best.did")) & (F.col("th") == F.col("best.th"))).alias("first"))
    return full.unionByName(rows.where("cls is null").select("did", "th", "n", F.col("did").alias("component_id"), F.lit(True).alias("first")))


def drop_near(docs: DataFrame, bound: int = MEMBERS) -> DataFrame:
    """docs, with all their columns, without the documents that another one of their group stands for."""
    away = stored(gathered(near_groups(docs).where(~F.col("first")).select(F.col("did").alias("_did"), F.col("th").alias("_th")).distinct()), "away")
    rows = packed(docs, text_key(F.col("text")))
    return rows.join(broadcast_if_small(away, away.count(), bound), F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_key") == F.col("_th")), "left_anti").select("_row.*")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("did").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
c AS (SELECT rid, rid AS other FROM d UNION SELECT c.rid, l.y FROM c JOIN l ON l.x = c.other),
m AS (SELECT c.rid, min(d.doc_id) AS component_id FROM c JOIN d ON d.rid = c.other GROUP BY c.rid)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN m USING (rid) LEFT JOIN n USING (rid)
"""
