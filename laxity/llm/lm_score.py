"""Language-model scores by deleted interpolation over word pairs.

p(w | v) = a2 c(v, w) / c(v) + a1 c(w) / N + a0 / (V + 1), where the weights a depend on the frequency bucket of the context v and are
learned by expectation-maximisation on held-out counts: each token of the tuning documents (crc32(doc_id) mod 10 = 1) is deleted from the
counts that predict it. Counts are exact and over all training documents (crc32(doc_id) mod 10 <> 0).

A task packs its documents into blocks of about BLOCK tokens, which are stored. Each block sends its distinct words and pairs with their
counts, split by hash into ranges. A range adds up the counts of all blocks and answers each block with the totals of its keys; a
block then scores its documents. What moves is packed arrays of distinct keys, so that a word or pair with a third of all tokens is one entry
a block; no table of words is broadcast or collected. A task holds one range or one block at a time.
For EM, the tuning tokens' probabilities are rounded to quarters of a power of ten, so that a table of fixed size holds them (the loss against
exact probabilities is tested).

Defined results: null and empty texts have the end alone; a null doc_id counts as the empty string for the split; rows that repeat are scored and counted each.
Without training tokens every token has probability 1 of 1 (N = 0, V = 0: base 0.1 / 0.1), the model's 1 / (V + 1). An empty table gives an empty result.
Words and pairs are counted by 64-bit hashes; counts are exact but where two hashes are equal (expected for 1e9 distinct pairs: 0.03 collisions).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, partitions, stored, table
from .ngram_join import MUL, mix

BLOCK = 700_000
#: Documents for which one range more is made.
RANGE_DOCS = 2000
END = np.uint64(xxhash.xxh64_intdigest(b" "))  # no word holds a space
BUCKETS = 26
CELLS = 48

PACKED = "block long, tune boolean, ids binary, nulls binary, lens binary, tokens binary, words binary, ranks binary"
BLOCKS = pa.schema([("block", pa.int64()), ("tune", pa.bool_()), *[(n, pa.binary()) for n in ("ids", "nulls", "lens", "tokens", "words", "ranks")]])
ASKED = "kind string, part int, block long, tune boolean, keys binary, counts binary"
ASKS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("tune", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(a.tobytes())


def _unzip(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _planes(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _whole(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _code(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all of them, so that the leading zeros go."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _decode(data: bytes) -> np.ndarray:
    return np.cumsum(_whole(data, np.uint64), dtype=np.uint64)


def _pairs(at: np.ndarray, lens: np.ndarray, uni: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block's words (indices into uni): first and second word of each distinct pair, the pair of each token, the pairs' keys and their order."""
    before = np.empty(len(at), np.int64)
    before[1:] = at[:-1]
    before[np.r_[0, np.cumsum(lens)[:-1]]] = np.searchsorted(uni, END)
    pair, token = np.unique(before * len(uni) + at, return_inverse=True)
    first, second = pair // len(uni), pair % len(uni)
    keys = mix(uni[first] * MUL + uni[second])
    return first, second, token, keys, np.argsort(keys, kind="stable")


def pack(ids: list, docs: list[np.ndarray], tune: bool) -> pa.RecordBatch:
    """A block: its documents as indices of words, frequent words with small numbers, which pack well."""
    lens = np.array([len(d) for d in docs], np.int64)
    words = np.concatenate(docs)
    docs.clear()
    uni, at = np.unique(words, return_inverse=True)
    del words
    rank = np.argsort(-np.bincount(at, minlength=len(uni)), kind="stable").astype(np.int32)
    place = np.empty(len(uni), np.int32)
    place[rank] = np.arange(len(uni), dtype=np.int32)
    some = np.array([0 if i is None else i for i in ids], np.int64)
    null = np.array([i is None for i in ids])
    row = {"block": uuid.uuid4().int >> 65, "tune": tune, "ids": _zip(some), "nulls": null.tobytes(), "lens": _zip(lens), "tokens": _planes(place[at]), "words": _code(uni), "ranks": _planes(rank)}
    return pa.RecordBatch.from_pylist([row], schema=BLOCKS)


def _ids(d: dict) -> list[int | None]:
    return [None if z else int(i) for i, z in zip(_unzip(d["ids"], np.int64), np.frombuffer(d["nulls"], bool))]


def _opened(d: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's row: the lengths of its documents, its distinct words, the word of each token."""
    return _unzip(d["lens"], np.int64), _decode(d["words"]), _whole(d["ranks"], np.int32)[_whole(d["tokens"], np.int32)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}
    size = {True: 0, False: 0}
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            words = (t.as_py() or b"").lower().split()
            h = np.empty(len(words) + 1, np.uint64)
            h[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            h[-1] = END
            tune = fold_of(i) == 1
            held[tune][0].append(i)
            held[tune][1].append(h)
            size[tune] += len(h)
            if size[tune] >= BLOCK:
                yield pack(*held[tune], tune)
                held[tune], size[tune] = ([], []), 0
    for tune in (True, False):
        if size[tune]:
            yield pack(*held[tune], tune)


def _asked(ranges: int):
    """Blocks -> the words (kind u) and pairs (kind b) of each, with their training counts, range by range."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.to_pylist():
                lens, uni, at = _opened(d)
                train = np.repeat(np.array([fold_of(i) != 0 for i in _ids(d)]), lens)
                _, _, token, keys, order = _pairs(at, lens, uni)
                for kind, key, count in (("u", uni, np.bincount(at[train], minlength=len(uni))), ("b", keys[order], np.bincount(token[train], minlength=len(keys))[order])):
                    cuts = np.searchsorted(key >> shift, np.arange(ranges + 1, dtype=np.uint64))
                    rows = [{"kind": kind, "part": g, "block": d["block"], "tune": d["tune"], "keys": _code(key[x:y]), "counts": _planes(count[x:y].astype(np.uint32))} for g, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
                    yield pa.RecordBatch.from_pylist(rows, schema=ASKS)

    return run


REPLY = "block long, tune boolean, kind string, part int, totals binary, distinct long, tokens_in long"
REPLIES = pa.schema([("block", pa.int64()), ("tune", pa.bool_()), ("kind", pa.string()), ("part", pa.int32()), ("totals", pa.binary()), ("distinct", pa.int64()), ("tokens_in", pa.int64())])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind and part -> for each the totals of its keys; for each range of words, how many occur and how often (kind n)."""

    def flush(kind: str, part: int, rows: list) -> Iterator[pa.RecordBatch]:
        keys = [_decode(r[2]) for r in rows]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_whole(r[3], np.uint32) for r in rows])).astype(np.uint64)
        out, i = [], 0
        for r, k in zip(rows, keys):
            out.append({"block": r[0], "tune": r[1], "kind": kind, "part": part, "totals": _planes(total[at[i : i + len(k)]])})
            i += len(k)
        if kind == "u":
            out.append({"kind": "n", "part": part, "distinct": int((total > 0).sum()), "tokens_in": int(total.sum())})
        yield pa.RecordBatch.from_pylist(out, schema=REPLIES)

    key, rows = None, []
    for b in batches:
        for kind, part, *row in zip(*(b.column(i).to_pylist() for i in range(6))):
            if key != (kind, part):
                if rows:
                    yield from flush(*key, rows)
                key, rows = (kind, part), []
            rows.append(row)
    if rows:
        yield from flush(*key, rows)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows sorted by block, kind, part -> (row d, its lens, the pair of each token, counts of context, word and pair)."""

    def whole(d: dict, found: dict[str, list]) -> tuple:
        cu, cb = (np.concatenate(found[k]).astype(float) for k in "ub")
        lens, uni, at = _opened(d)
        first, second, token, _, order = _pairs(at, lens, uni)
        pair = np.empty(len(cb))
        pair[order] = cb
        return d, lens, token, cu[first], cu[second], pair

    block, d, found = None, None, {"u": [], "b": []}
    for b in batches:
        for row in b.to_pylist():
            if row["block"] != block:
                if d:
                    yield whole(d, found)
                block, d, found = row["block"], None, {"u": [], "b": []}
            if row["kind"] == "d":
                d = row
            else:
                found[row["kind"]].append(_whole(row["totals"], np.uint64))
    if d:
        yield whole(d, found)


def _met(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """Documents and replies of a block, together and in order."""
    names = ["ids", "nulls", "lens", "tokens", "words", "ranks"]
    left = docs.select("block", F.lit("d").alias("kind"), F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("totals"), *names)
    right = replies.select("block", "kind", "part", "totals", *[F.lit(None).cast("binary").alias(n) for n in names])
    rows = left.unionByName(right)
    return rows.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "kind", "part")


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(count.astype(float) + 1)).astype(np.int64), BUCKETS - 1)


def _cell(p: np.ndarray) -> np.ndarray:
    """0 for no probability, else a step of a quarter of a power of ten from 1e-11 on."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round((np.log10(p) + 11.5) * 4), 1, CELLS - 1), 0).astype(np.int64)


def _cell_p() -> np.ndarray:
    p = 10 ** (np.arange(CELLS) / 4 - 11.5)
    p[0] = 0
    return p


def _histogram(total: int):
    """cell, weight: how many tuning tokens have (bucket, p2, p1), each token deleted from the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS * CELLS * CELLS, np.int64)
        for _, _, token, context, word, pair in _blocks(batches):
            context, word, pair = context - 1, word - 1, pair - 1
            p2 = np.where(context > 0, pair / np.maximum(context, 1), 0)
            cell = (_bucket(context) * CELLS + _cell(p2)) * CELLS + _cell(word / max(total - 1, 1))
            np.add.at(sums, cell, np.bincount(token, minlength=len(cell)))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["cell", "weight"])

    return run


def em(cells: dict[int, int], words: int, rounds: int = 60) -> np.ndarray:
    """Weights (a2, a1, a0) for each bucket, by expectation-maximisation; a bucket without held-out tokens takes the weights of all."""
    p = _cell_p()
    at, weight = np.array(list(cells), np.int64), np.array(list(cells.values()), float)
    parts = np.column_stack([p[at // CELLS % CELLS], p[at % CELLS], np.full(len(at), 1 / (words + 1))]) if len(at) else np.zeros((0, 3))

    def learn(pick: np.ndarray) -> np.ndarray:
        a = np.array([0.5, 0.4, 0.1])
        for _ in range(rounds):
            share = parts[pick] * a
            share /= share.sum(1, keepdims=True)
            a = (share * weight[pick, None]).sum(0) + 1e-3
            a /= a.sum()
        return np.maximum(a, 1e-7) / np.maximum(a, 1e-7).sum()

    whole = learn(np.ones(len(at), bool)) if len(at) else np.array([0.5, 0.4, 0.1])
    bucket = at // (CELLS * CELLS)
    out = np.array([learn(bucket == b) if (bucket == b).any() else whole for b in range(BUCKETS)])
    out[0] = [0, out[0][1] / (out[0][1] + out[0][2]), out[0][2] / (out[0][1] + out[0][2])]  # the context is unknown
    return out


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(weights: np.ndarray, total: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, lens, token, context, word, pair in _blocks(batches):
            a = weights[_bucket(context)]
            p = a[:, 0] * pair / np.maximum(context, 1) + a[:, 1] * word / max(total, 1) + a[:, 2] / (words + 1)
            p = np.where(word.sum() + total > 0, p, 1 / (words + 1))
            base = np.log10((word + 0.1) / (total + 0.1 * (words + 1)))
            at = np.r_[0, np.cumsum(lens)[:-1]]
            added = lambda x: np.add.reduceat(x[token], at)
            out_ids = _ids(d)
            held = [fold_of(i) == 0 for i in out_ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_ids, pa.int64()), pa.array(held), pa.array(lens), pa.array(added((word > 0).astype(np.int64))), pa.array(np.full(len(lens), total)), pa.array(added(base)), pa.array(added(np.log10(p)))],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return run


def score(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    n = in_batches(docs).select("doc_id").count()
    ranges = 1 << min(16, max(6, (n // RANGE_DOCS).bit_length()))
    packed = stored(docs.select("doc_id", "text").mapInArrow(_packed, PACKED), "packed")
    asked = packed.mapInArrow(_asked(ranges), ASKED).repartition(partitions(spark), "kind", "part").sortWithinPartitions("kind", "part")
    replies = stored(asked.mapInArrow(_answered, REPLY), "replies")
    sums = replies.where("kind = 'n'").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens_in"), F.lit(0))).first()
    words, total = int(sums[0]), int(sums[1])
    cells = _met(packed.where("tune"), replies.where("tune and kind <> 'n'")).mapInArrow(_histogram(total), "cell long, weight long")
    found = {r["cell"]: r["weight"] for r in cells.groupBy("cell").agg(F.sum("weight").alias("weight")).collect()}  # at most BUCKETS * CELLS ** 2
    return _met(packed, replies.where("kind <> 'n'")).mapInArrow(_scores(em(found, words), total, words), SCHEMA)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
