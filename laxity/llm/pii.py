"""Personal data: a linear-chain conditional random field over word shapes, beside four fixed patterns.

The fixed patterns (email, ip, card, phone) always count. The field labels tokens as other or secret from the
shapes of the token and its neighbours; it is trained by gradient ascent on a small labelled table made here from
a seed, and decoded by Viterbi in numpy over whole batches of texts. A secret is an access key, a password or a token: a run of labelled tokens is
one span. Spans of the field that overlap a fixed one are dropped, the fixed ones always stay.

Only a token with a digit, "=" or "@" may be a secret: in training and decoding every other token's label is fixed to other. A path
through such a token falls into two parts that do not depend on each other, so that the stretches around live tokens are decoded by themselves with the
result of whole texts, and texts without live tokens are not decoded at all.

Defined results: null and empty texts have no spans; repeated rows each get a row; offsets are code points, ends exclusive. Texts are searched whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_bytes, in_batches, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Local parts of emails are found from the @ backwards, so that long runs of letters cost linear time.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LIVE = re.compile(r"[0-9=@]")
LABELS = ("other", "secret")
#: Bytes of text that are decoded together.
BATCH_BYTES = 4 << 20


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches that do not overlap."""
    done, at = 0, text.find("@")
    while at >= 0:
        tail = EMAIL_TAIL.match(text, at)
        if tail:
            start = at
            while start > done and text[start - 1] in EMAIL_HEAD:
                start -= 1
            if start < at:
                yield start, tail.end()
                done = tail.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(order of kind, kind, start, end), by kind and start."""
    out = [(0, "email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    for k, kind in enumerate(KINDS[1:], 1):
        for m in PATTERNS[kind].finditer(text):
            found = m.group()
            if kind == "ip":
                good = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in found.split("."))
            else:
                digits = re.sub("[^0-9]", "", found)
                good = 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15
            if good:
                out.append((k, kind, m.start(), m.end()))
    return out


def shape(token: str) -> tuple[str, ...]:
    """Features of a token's form; the same for all tokens without a digit, = or @ (but for a few cue words)."""
    core = token.strip(".,;:!?()[]{}'\"")
    if not LIVE.search(core):
        return ("cue:" + core.lower(),) if core.lower() in CUES else ("plain",)
    digits, upper, lower = (sum(map(f, core)) for f in (lambda c: "0" <= c <= "9", lambda c: "A" <= c <= "Z", lambda c: "a" <= c <= "z"))
    n, head, eq, rest = len(core), *core.partition("=")
    out = ["len:" + ("1" if n < 6 else "2" if n < 12 else "3" if n < 16 else "4" if n < 24 else "5")]
    out.append("mix:" + "".join(x for x, k in (("A", upper), ("a", lower), ("9", digits)) if k) + ("x" if digits + upper + lower < n else ""))
    if eq:
        out += ["eq", "name:" + ("cue" if head.lower() in CUES else "any"), "value:" + ("none" if not rest else "9" if any("0" <= c <= "9" for c in rest) and len(rest) >= 8 else "any")]
    if n >= 16 and not set(core) - set("0123456789abcdef"):
        out.append("hex")
    if n >= 16 and not set(core) - set("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") and upper and digits:
        out.append("key")
    if digits == n:
        out.append("number")
    if "@" in core:
        out.append("at")
    return tuple(out)


CUES = frozenset(["token", "password", "passwd", "secret", "api_key", "apikey", "key", "pwd"])


def labelled(n: int = 200, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: (tokens, labels)."""
    rnd, out = random.Random(seed), []
    word = lambda: "".join(rnd.choice(["an", "the", "ing", "ver", "ción", "eau", "st", "o"]) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "", "", ".", ","])
    hexa = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    for _ in range(n):
        kind = rnd.randrange(13)
        key = "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        inside = {
            0: [(key, 1)], 1: [(f"{rnd.choice(['password', 'pwd', 'passwd'])}={hexa(rnd.choice([12, 18, 24]))}", 1)],
            2: [(rnd.choice(["token", "secret", "api_key"]), 0), ("=", 0), (f'"{hexa(rnd.choice([32, 40]))}"', 1)],
            3: [(f"user{digits(2)}@mail.example.com", 0)], 4: [(".".join(digits(2) for _ in range(4)), 0)], 5: [(digits(16), 0)],
            6: [("+1", 0), (f"({digits(3)})", 0), (f"555-{digits(4)}", 0)], 7: [("token", 0), (word(), 0)], 8: [("version", 0), (f"{digits(1)}.{digits(1)}.", 0)],
            9: [("password", 0), ("=", 0), (word(), 0)], 10: [(word() + "=" + word(), 0)], 11: [(digits(rnd.randint(1, 20)), 0)], 12: [("key", 0), (word(), 0), (digits(4), 0)],
        }[kind]
        row = [(word(), 0) for _ in range(rnd.randint(0, 6))] + inside + [(word(), 0) for _ in range(rnd.randint(0, 6))]
        out.append(([t for t, _ in row], [y for _, y in row]))
    return out


def pins(tokens: list[str]) -> np.ndarray:
    """What is added to the emissions so that a token that is not live is other."""
    return np.array([[0.0, 0.0 if LIVE.search(t) else -1e6] for t in tokens]).reshape(-1, len(LABELS))


class Field:
    """Weights of the chain: for each feature at each place (before, here, after) and label; start and transitions."""

    def __init__(self, steps: int = 50, rate: float = 0.5, decay: float = 1e-3):
        rows = labelled()
        self.ids: dict[tuple[int, str], int] = {}
        for tokens, _ in rows:
            for f in self.features(tokens, True):
                pass
        n = len(LABELS)
        self.w, self.t = np.zeros((len(self.ids), n)), np.zeros((n, n))
        feats = [self.features(tokens) for tokens, _ in rows]
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        sw, st = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        for _ in range(steps):
            gw[:], gt[:] = -decay * self.w, -decay * self.t
            for (tokens, ys), fs in zip(rows, feats):
                fixed = pins(tokens)
                e = np.array([self.w[f].sum(0) for f in fs]) + fixed
                a, b = [e[0]], [np.zeros(n)]
                for x in e[1:]:
                    a.append(x + np.logaddexp.reduce(a[-1][:, None] + self.t, 0))
                for x in e[:0:-1]:
                    b.append(np.logaddexp.reduce(self.t + x + b[-1], 1))
                b.reverse()
                z = np.logaddexp.reduce(a[-1])
                for i, f in enumerate(fs):
                    p = np.exp(a[i] + b[i] - z)
                    gw[f] -= p / len(rows)
                    gw[f, ys[i]] += 1 / len(rows)
                    if i:
                        gt -= np.exp(a[i - 1][:, None] + self.t + e[i] + b[i] - z) / len(rows)
                        gt[ys[i - 1], ys[i]] += 1 / len(rows)
            sw += gw**2
            st += gt**2
            self.w += rate * gw / np.sqrt(sw)
            self.t += rate * gt / np.sqrt(st)
        # Unknown shapes weigh for other.
        self.unknown = np.array([0.5, -0.5])

    def features(self, tokens: list[str], learn: bool = False) -> list[list[int]]:
        shapes = [("edge",), *[shape(t) for t in tokens], ("edge",)]
        out = []
        for i in range(1, len(shapes) - 1):
            keys = [(k, f) for k in (-1, 0, 1) for f in shapes[i + k]]
            if learn:
                for key in keys:
                    self.ids.setdefault(key, len(self.ids))
            out.append([self.ids[key] for key in keys if key in self.ids])
        return out

    def emissions(self, tokens: list[str]) -> np.ndarray:
        return np.array([self.w[f].sum(0) if f else self.unknown for f in self.features(tokens)]) + pins(tokens)

    def decode(self, batch: list[list[str]]) -> list[np.ndarray]:
        """Viterbi over a batch of token rows at once, the longest first."""
        order = sorted(range(len(batch)), key=lambda i: -len(batch[i]))
        rows = [self.emissions(batch[i]) for i in order]
        if not rows:
            return []
        steps = len(rows[0])
        e = np.zeros((len(rows), steps, len(LABELS)))
        for i, r in enumerate(rows):
            e[i, : len(r)] = r
        lens = np.array([len(r) for r in rows])
        score, back = e[:, 0].copy(), np.zeros((len(rows), steps, len(LABELS)), np.int8)
        for s in range(1, steps):
            k = int(np.searchsorted(-lens, -s, "left"))  # rows longer than s
            both = score[:k, :, None] + self.t
            back[:k, s] = both.argmax(1)
            score[:k] = both.max(1) + e[:k, s]
        out: list = [None] * len(rows)
        for i, r in enumerate(rows):
            path = np.zeros(len(r), np.int8)
            path[-1] = score[i].argmax()
            for s in range(len(r) - 1, 0, -1):
                path[s - 1] = back[i, s, path[s]]
            out[order[i]] = path
        return out


@lru_cache(1)
def field() -> Field:
    return Field()


def stretches(text: str) -> list[tuple[int, list[re.Match]]]:
    """Runs of tokens around those with a digit, = or @, with two plain ones on each side; the tokens between are not live and so other."""
    if not LIVE.search(text):
        return []
    out: list[list[re.Match]] = []
    last, recent, left = -9, [], 0
    for i, m in enumerate(TOKEN.finditer(text)):
        if LIVE.search(m.group()):
            if i - last > 4:
                out.append(recent[-2:])
            else:
                out[-1] += recent[len(recent) - left :] if left else []
            out[-1].append(m)
            last, recent, left = i, [], 0
        else:
            recent.append(m)
            left += 1
            if len(recent) > 4:
                recent, left = recent[-4:], min(left, 4)
            if last == i - 2:  # two plain ones after
                out[-1] += recent[-2:]
                recent, left = [], 0
    if out and last >= 0 and left == 1 and recent and recent[0].start() > out[-1][-1].start():
        out[-1] += recent
    return out


def found_spans(texts: list[str], crf: Field) -> list[list[tuple[int, str, int, int]]]:
    """The field's spans for each text, before those that overlap base spans are dropped."""
    where, rows, out = [], [], [[] for _ in texts]
    for i, text in enumerate(texts):
        for run in stretches(text):
            where.append((i, run))
            rows.append([m.group() for m in run])
    for (i, run), path in zip(where, crf.decode(rows)):
        start = None
        for m, y in [*zip(run, path), (None, 0)]:
            if y and start is None:
                start = m.start()
            if y:
                end = m.end()
            elif start is not None:
                out[i].append((4, "secret", start, end))
                start = None
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in "\"'([{<":
        a += 1
    while a < b and text[b - 1] in "\"').,;:!?]}>":
        b -= 1
    return a, b


def spans(texts: list[str], crf: Field | None = None) -> list[tuple[list, list]]:
    """For each text: base spans, and all spans in the same order of kinds and starts."""
    out = []
    for text, more in zip(texts, found_spans(texts, crf or field())):
        base = base_spans(text)
        extra = [(k, name, *trimmed(text, a, b)) for k, name, a, b in more]
        extra = [x for x in extra if x[2] < x[3] and not any(x[2] < b and a < x[3] for _, _, a, b in base)]
        out.append((base, sorted(base + extra, key=lambda x: (x[0], x[2]))))
    return out


def redacted(text: str, found: list[tuple[int, str, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans go by the leftmost."""
    out, at = [], 0
    for _, kind, a, b in sorted(found, key=lambda x: (x[2], -x[3])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])


def _joined(found: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for _, kind, a, b in found)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find(docs: DataFrame) -> DataFrame:
    crf = field()  # trained on the driver, a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 1, BATCH_BYTES)):
            found = spans([t.as_py() or "" for t in batch.column(1)], crf)
            counts = [[sum(x[1] == kind for x in base) for base, _ in found] for kind in KINDS]
            digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            cols = [*[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array([_joined(s) for _, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
