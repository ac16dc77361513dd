"""Byte-level BPE with word ends, encoded by forced-boundary splitting.

A pair of neighbouring byte symbols that occurs inside no token of the vocabulary can never be merged across, so it
marks a certain cut: the fragments between cuts are encoded independently and their ids are joined. The result
equals that of merging the whole word, since no merge can reach over a cut.

The vocabulary file is that of a public tokenizer and its path a parameter; its normaliser (NFC, white space to one space, lower case) and its
pattern are applied here. Special tokens standing in a text are taken as such, as the library does.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty string; repeated rows are encoded alike.
Texts are encoded whole, about BATCH_BYTES of them at a time. Stretches without white space and the words in them are remembered by their ids
alone, in one cache of two generations of CACHE_BYTES; a word of any length is encoded in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import by_bytes, in_batches, kept, table

#: Bytes, roughly, that each of two generations of remembered words takes; the older one goes when the younger is full.
CACHE_BYTES = 32 << 20
#: Words of a text whose ids are taken apart at a time.
STRETCH = 50_000
CACHE_CHARS = 64
#: Bytes of text that are encoded before their results leave.
BATCH_BYTES = 1 << 20
#: Fragments up to this many symbols are merged by repeated scans, longer ones with a heap.
SCAN = 24
#: From here on, tables of letters differ between Unicode versions; such words take the library's normaliser and pattern.
OLD_LETTERS = "\u0530"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Signs that end a piece of letters by themselves.
SIGNS = (".", ",", ";", ":", "!", "?")
#: Characters that Python's split() drops, but the pattern's \s does not hold.
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class Memo(dict):
    """What make() gives for a text, remembered in two generations."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.taken = make, {}, 0

    def __missing__(self, text: str) -> str:
        found = self.old.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= CACHE_CHARS:
            self.keep(text, found)
        return found

    def keep(self, text: str, found: str) -> None:
        if self.taken >= CACHE_BYTES:
            self.old, self.taken = self.copy(), 0
            self.clear()
        self[text] = found
        self.taken += 200 + len(text) + len(found)


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks, self.made = {}, []  # rank of each pair of ids, and the id that it makes
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), rank)
            self.made.append(self.vocab[a + b])
        self.inside = set()  # neighbouring byte symbols that some token holds
        for t in self.vocab:
            t = t.removesuffix(self.end) if self.end else t
            self.inside.update(zip(t, t[1:]))
        self.bytes = byte_symbols()
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.memo = Memo(self.chunk)
        self.texts = [str(i) for i in range(max(self.tokens) + 1)]
        self.names = {self.texts[i]: t for i, t in self.tokens.items()}
        self.counts: dict[str, int] = {}
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer

    def merge(self, ids: list[int]) -> list[int]:
        """Merges by rank, the leftmost first among equals; a heap over a linked list where there are many symbols."""
        n, rank, made, none = len(ids), self.ranks.get, self.made, len(self.made)
        if n <= SCAN:
            own = [rank(pair, none) for pair in zip(ids, ids[1:])]
            while own and (least := min(own)) < none:
                i = own.index(least)
                ids[i : i + 2] = [new] = [made[least]]
                del own[i]
                if i < len(own):
                    own[i] = rank((new, ids[i + 1]), none)
                if i:
                    own[i - 1] = rank((ids[i - 1], new), none)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, _ = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((new, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (p := before[i]) >= 0 and (r := rank((ids[p], new))) is not None:
                heapq.heappush(heap, (r, p, ids[p], new))
        return [x for x in ids if x >= 0]

    def fragments(self, symbols: str) -> list[str]:
        """symbols, cut where no token reaches over."""
        inside = self.inside
        if inside.issuperset(zip(symbols, symbols[1:])):
            return [symbols]
        cuts = [i for i in range(1, len(symbols)) if (symbols[i - 1], symbols[i]) not in inside]
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]

    def word(self, symbols: str) -> list[int]:
        """Ids of a word written in byte symbols."""
        parts, out = self.fragments(symbols), []
        for k, part in enumerate(parts):
            ids = [*map(self.vocab.__getitem__, part)]
            if k == len(parts) - 1:
                ids[-1] = self.vocab[part[-1] + self.end]
            out += self.merge(ids)
        return out

    def coded(self, symbols: str) -> str:
        """Ids, joined by single spaces, of a word written in byte symbols."""
        texts = self.texts
        return " ".join([texts[i] for i in self.word(symbols)])

    def symbols(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join([self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")])

    def found(self, text: str) -> list[str]:
        """The words that the pattern finds in a text below OLD_LETTERS, normalised."""
        text = unicodedata.normalize("NFC", text)
        lower = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()  # no final form by context
        if lower.isalpha():
            return [lower]
        if lower[-1:] in SIGNS and lower[:-1].isalpha():
            return [lower[:-1], lower[-1:]]
        return self.pattern.findall(lower)

    def piece(self, piece: str) -> str:
        """Ids of a word that found() has cut out. Remembered where the word as a text of its own is this word again."""
        if len(piece) > CACHE_CHARS or not (piece.isascii() or (unicodedata.is_normalized("NFC", piece) and piece.lower() == piece)):
            return self.coded(self.symbols(piece))
        ids = self.memo.get(piece) or self.memo.old.get(piece)
        if ids is None:
            ids = self.coded(self.symbols(piece))
            self.memo.keep(piece, ids)
        return ids

    def plain(self, text: str) -> str:
        """Ids of a text without special tokens."""
        if not text.isascii() and max(text) >= OLD_LETTERS:
            return " ".join([self.coded(piece) for piece, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))])
        return " ".join([self.piece(x) for x in self.found(text)])

    def chunk(self, text: str) -> str:
        """Ids of a stretch without white space, which the caller remembers."""
        if text.isascii() or max(text) < OLD_LETTERS:
            found = self.found(text)
            return self.coded(self.symbols(text)) if found == [text] else " ".join([self.piece(x) for x in found])
        return self.plain(text)

    def stretches(self, text: str) -> Iterator[str]:
        """Ids of a whole text, some words at a time; spaces may be too many."""
        if self.cut and "<" in text and self.cut.search(text):
            for x in self.cut.split(text):
                if x in self.special:
                    yield self.texts[self.special[x]]
                else:
                    yield from self.stretches(x)
        elif ODD_SPACE.search(text):
            yield self.plain(text)
        else:
            words, get = text.split(), self.memo.__getitem__
            for i in range(0, len(words), STRETCH):
                yield " ".join(map(get, words[i : i + STRETCH]))

    def joined(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the decoded text of a whole text."""
        total, ids, tokens, names = 0, [], [], self.names.__getitem__
        for found in self.stretches(text):
            if parts := found.split():
                total += len(parts)
                ids.append(" ".join(parts) if "  " in found or found[0] == " " or found[-1] == " " else found)
                tokens.append(" ".join(map(names, parts)))
        return total, " ".join(ids), " ".join(tokens)

    def count(self, text: str) -> int:
        """Number of ids of a whole text; only counts are remembered."""
        if self.cut and "<" in text and self.cut.search(text):
            return sum(1 if x in self.special else self.count(x) for x in self.cut.split(text))
        if ODD_SPACE.search(text):
            return len(self.plain(text).split())
        total, counts = 0, self.counts
        for c in text.split():
            n = counts.get(c)
            if n is None:
                n = len(self.plain(c).split())
                if len(c) <= CACHE_CHARS:
                    if len(counts) >= CACHE_BYTES // 200:
                        counts.clear()
                    counts[c] = n
            total += n
        return total

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.joined(text or "")[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by single spaces."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker."""
    return kept(("bpe", path), lambda: Encoder(path))


def mapped(docs: DataFrame, path: str, schema: str, fn) -> DataFrame:
    """doc_id and what fn(encoder, text) returns as a tuple, text by text."""
    names, kinds = zip(*(x.strip().split() for x in schema.split(",")))
    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in by_bytes(whole, 1, BATCH_BYTES):
                cols = zip(*(fn(enc, t.as_py() or "") for t in batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, arrow[k]) for c, k in zip(cols, kinds[1:])]], names=names)

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def _digest(enc: Encoder, text: str) -> tuple[int, str, str]:
    n, ids, decoded = enc.joined(text)
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def _coded(enc: Encoder, text: str) -> tuple[np.ndarray, str]:
    _, ids, decoded = enc.joined(text)
    return np.fromstring(ids, np.int32, sep=" "), decoded


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded."""
    return mapped(docs, path, "doc_id long, ids array<int>, decoded string", _coded)


def counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens."""
    return mapped(docs, path, "doc_id long, n_tokens long", lambda enc, text: (enc.count(text),))


def digests(docs: DataFrame, path: str) -> DataFrame:
    return mapped(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
