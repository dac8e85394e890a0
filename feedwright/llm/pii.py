"""Personal data by fixed rules and by a character-level bidirectional LSTM with a CRF on top.

The rules find addresses, IPs, cards and phones in their usual form. The tagger, written in numpy and trained at the start
of each job, learns from what the rules label in a bounded sample of documents and from labelled spans in other spellings
set into windows of the same texts. It reads windows of ``WINDOW`` characters that overlap by half; each window decides
about its inner half, and the tags of all windows together are read as spans of the whole text. What it adds has to pass
a check of its kind, and never displaces what the rules found.

A window without a digit or an ``@`` has nothing to tag (no span of any kind does without), so only the others are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from feedwright.llm.text import drawn, per_document

KINDS = ("email", "ip", "card", "phone")
WINDOW = 96
HALF = WINDOW // 2
HIDDEN = 20
#: Documents about which the tagger learns, and windows that one of them may give.
SAMPLE = 4000
PER_DOCUMENT = 6
STEPS = 150

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits whose start did not match, so the look-behind changes nothing but speed.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _small(part: str) -> bool:
    """Whether a number is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, ``@`` and domain, from left to right, found from the ``@`` on."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """What the rules find, by start and then kind."""
    found: list[Span] = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def plausible(kind: str, text: str) -> bool:
    """Whether a span found by the tagger can be what it is tagged as."""
    digits, letters = _digits(text), sum(map(str.isalpha, text))
    if kind == "email":
        left, at, right = text.partition("@")
        return bool(at) and "@" not in right and any(map(str.isalnum, left)) and "." in right.strip(" .") and letters > 3
    if letters:
        return False
    if kind == "ip":
        parts = _DIGITS.findall(text)
        return len(parts) == 4 and all(map(_small, parts)) and text.count(".") >= 3
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(_DIGITS.findall(text)) > 1 and not luhn(digits)


# Classes of characters: letters, digits, blanks, and every other ASCII character for itself.
_CLASS = np.full(128, 4, dtype=np.int64)
_CLASS[[*range(48, 58)]] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 2
_CLASS[[*range(9, 14), 32]] = 3
_CLASS[[ord(c) for c in "@.+-_%()[],:;=\"'/#*&"]] = np.arange(6, 6 + 20)  # 6 to 25
CLASSES = 27
_FOREIGN, _PAD, _O = 5, 26, 0


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], _FOREIGN)


def window_starts(n: int, trigger: np.ndarray) -> np.ndarray:
    """Starts of the windows to read: the grid of half windows, each reaching a quarter beyond the part it decides about,
    where any of its characters is a trigger."""
    if not len(trigger):
        return np.zeros(0, dtype=np.int64)
    quarter = HALF // 2
    cells = np.unique(np.concatenate([trigger // HALF, (trigger - quarter) // HALF, (trigger + quarter) // HALF]))
    return cells[(cells >= 0) & (cells * HALF < n)] * HALF - quarter


def cut(codes: np.ndarray, starts: np.ndarray, fill: int) -> np.ndarray:
    padded = np.concatenate([np.full(HALF, fill), codes, np.full(WINDOW + HALF, fill)])
    return padded[(starts + HALF)[:, None] + np.arange(WINDOW)[None, :]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Bidirectional LSTM over character classes, and a chain of tags (0 outside, then the kinds)."""

    TAGS = 1 + len(KINDS)

    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        h, f = HIDDEN, np.float32
        self.p = {"out": (r.standard_normal((2 * h, self.TAGS)) * 0.2).astype(f), "bias": np.zeros(self.TAGS, f), "moves": np.zeros((self.TAGS, self.TAGS), f)}
        for way in ("fore", "back"):
            self.p[f"{way}_in"] = (r.standard_normal((CLASSES, 4 * h)) * 0.3).astype(f)
            self.p[f"{way}_own"] = (r.standard_normal((h, 4 * h)) * 0.2).astype(f)
            self.p[f"{way}_in"][:, h : 2 * h] += 1  # remember at first

    def _run(self, x: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        n, steps = x.shape
        size = HIDDEN
        h = c = np.zeros((n, size), np.float32)
        out = np.empty((steps, n, size), np.float32)
        for t in range(steps) if way == "fore" else range(steps - 1, -1, -1):
            g = self.p[f"{way}_in"][x[:, t]] + h @ self.p[f"{way}_own"]
            i, f, o = (_sigmoid(g[:, k * size : (k + 1) * size]) for k in range(3))
            u = np.tanh(g[:, 3 * size :])
            before, last = c, h
            c = f * c + i * u
            bent = np.tanh(c)
            h = o * bent
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, u, bent, before, last))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Steps by windows by tags."""
        hidden = []
        for way in ("fore", "back"):
            tape = None if keep is None else keep.setdefault(way, [])
            hidden.append(self._run(x, way, tape))
        both = np.concatenate(hidden, axis=2)
        if keep is not None:
            keep["both"] = both
        return both @ self.p["out"] + self.p["bias"]

    def _chain(self, e: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log likelihood of the tags, and its slope by emissions and moves."""
        steps, n, k = e.shape
        moves = self.p["moves"]
        fore, back = np.empty_like(e), np.zeros_like(e)
        fore[0] = e[0]
        for t in range(1, steps):
            fore[t] = _logsum(fore[t - 1][:, :, None] + moves[None], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            back[t] = _logsum(moves[None] + (e[t + 1] + back[t + 1])[:, None, :], 2)
        total = _logsum(fore[-1], 1)
        slope = np.exp(fore + back - total[None, :, None])
        moved = np.zeros((k, k))
        for t in range(1, steps):
            pair = fore[t - 1][:, :, None] + moves[None] + (e[t] + back[t])[:, None, :] - total[:, None, None]
            moved += np.exp(pair).sum(axis=0)
        gold = np.eye(k, dtype=np.float32)[tags.T]
        score = (e * gold).sum() + moves[tags[:, :-1], tags[:, 1:]].sum()
        np.add.at(moved, (tags[:, :-1], tags[:, 1:]), -1)
        return float((total.sum() - score) / n), (slope - gold) / n, (moved / n).astype(np.float32)

    def slopes(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: dict = {}
        loss, by_e, by_moves = self._chain(self.emissions(x, keep), tags)
        both, size = keep["both"], HIDDEN
        g = {
            "moves": by_moves, "bias": by_e.sum(axis=(0, 1)),
            "out": np.tensordot(both, by_e, axes=([0, 1], [0, 1])),
        }
        by_hidden = by_e @ self.p["out"].T
        hot = np.eye(CLASSES, dtype=np.float32)
        for way, part in (("fore", slice(0, size)), ("back", slice(size, None))):
            g[f"{way}_in"], g[f"{way}_own"] = np.zeros_like(self.p[f"{way}_in"]), np.zeros_like(self.p[f"{way}_own"])
            dh = dc = np.zeros((len(x), size), np.float32)
            for t, i, f, o, u, bent, before, last in reversed(keep[way]):
                dh = dh + by_hidden[t][:, part]
                dc = dc + dh * o * (1 - bent * bent)
                dg = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                g[f"{way}_own"] += last.T @ dg
                g[f"{way}_in"] += hot[x[:, t]].T @ dg
                dh, dc = dg @ self.p[f"{way}_own"].T, dc * f
        return loss, g

    def train(self, x: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = 96, rate: float = 0.02, seed: int = 5) -> float:
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            chosen = r.integers(0, len(x), size=min(batch, len(x)))
            loss, g = self.slopes(x[chosen], tags[chosen])
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def best(self, x: np.ndarray) -> np.ndarray:
        """The likeliest tags of each window."""
        e = self.emissions(x)
        steps, n, _ = e.shape
        score, came = e[0], np.zeros((steps, n, self.TAGS), dtype=np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + self.p["moves"][None]
            came[t] = all_.argmax(axis=1)
            score = all_.max(axis=1) + e[t]
        out = np.empty((n, steps), dtype=np.int8)
        out[:, -1] = score.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = came[t, rows, out[:, t]]
        return out

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Spans of each text, from the tags of all its windows."""
        coded, starts = [], []
        for text in texts:
            codes = classes(text)
            coded.append(codes)
            starts.append(window_starts(len(codes), np.flatnonzero((codes == _CLASS[48]) | (codes == _CLASS[64]))))
        rows = [cut(c, s, _PAD) for c, s in zip(coded, starts)]
        x = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int64)
        tags = np.concatenate([self.best(x[k : k + 1024]) for k in range(0, len(x), 1024)]) if len(x) else np.zeros((0, WINDOW), np.int8)
        out, at = [], 0
        for text, codes, own in zip(texts, coded, starts):
            inner = tags[at : at + len(own), HALF // 2 : HALF // 2 + HALF]
            at += len(own)
            out.append(read_tags(text, own + HALF // 2, inner))
        return out


def read_tags(text: str, places: np.ndarray, tags: np.ndarray) -> list[Span]:
    """Spans of a text from decided stretches of ``HALF`` tags; between stretches nothing is tagged."""
    found: list[Span] = []
    kind, start, end = 0, 0, 0
    for place, row in zip(places.tolist(), tags.tolist()):
        if kind and place != end:
            found.append((KINDS[kind - 1], start, end))
            kind = 0
        for k, tag in enumerate(row):
            if tag != kind:
                if kind:
                    found.append((KINDS[kind - 1], start, place + k))
                kind, start = tag, place + k
        end = place + len(row)
    if kind:
        found.append((KINDS[kind - 1], start, end))
    trimmed = []
    for kind_, s, e in found:
        e = min(e, len(text))
        while s < e and text[s].isspace():
            s += 1
        while s < e and (text[e - 1].isspace() or text[e - 1] in ".,;:"):
            e -= 1
        cut_number = s > 0 and text[s - 1].isdigit() or e < len(text) and text[e].isdigit()
        if s < e and not cut_number and plausible(kind_, text[s:e]):
            trimmed.append((kind_, s, e))
    return trimmed


def all_spans(base: list[Span], added: list[Span]) -> list[Span]:
    """The rules' spans, and of the tagger's those that touch none of them."""
    free = [a for a in added if not any(a[1] < e and s < a[2] for _, s, e in base)]
    return ordered(base + free)


def labelled_spellings(seed: int, n: int) -> list[tuple[str, str]]:
    """(kind, text) of made-up personal data in usual and in other spellings."""
    r = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *c: c[r.integers(len(c))]
    word = lambda: "".join(chr(97 + v) for v in r.integers(0, 26, r.integers(3, 9)))
    out = []
    for _ in range(n):
        user = word() + pick("", ".", "_", "-") + pick(word(), digits(2))
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), (" @ ", " . "))
        out.append(("email", user + at + dot.join([word() + pick("", digits(1)), word(), pick("com", "org", "net")])))
        dot = pick(".", ".", "[.]", " . ")
        out.append(("ip", dot.join(str(v) for v in r.integers(1, 256, 4))))
        sep = pick("", " ", "-", ".")
        out.append(("card", sep.join(digits(4) for _ in range(4))))
        area, a, b = digits(3), digits(3), digits(4)
        out.append(("phone", pick(f"+{digits(1)} ({area}) {a}-{b}", f"+{digits(2)} {area} {a} {b}", f"({area}) {a}-{b}", f"00{digits(2)} {area} {a} {b}")))
    return out


def labelled_windows(contexts: list[str], found: list[list[Span]], seed: int = 3, made: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags to learn from: texts with the spans that the rules found, and texts with made-up spans set in."""
    texts, spans = list(contexts), [list(s) for s in found]
    r = np.random.default_rng(seed)
    plain = [t for t, s in zip(contexts, found) if not s] or ["these are words that stand around, and more of them follow here."]
    for kind, text in labelled_spellings(seed, made):
        around = plain[int(r.integers(len(plain)))]
        at = int(r.integers(0, max(1, len(around))))
        left, right = around[max(0, at - int(r.integers(0, WINDOW - 20))) : at], around[at:]
        texts.append(f"{left} {text} {right}"[:WINDOW])
        spans.append([(kind, len(left) + 1, len(left) + 1 + len(text))])
    x, y = [], []
    for text, own in zip(texts, spans):
        codes = np.full(WINDOW, _PAD)
        tags = np.zeros(WINDOW, dtype=np.int64)
        part = classes(text[:WINDOW])
        codes[: len(part)] = part
        for kind, s, e in own:
            tags[s : min(e, WINDOW)] = 1 + KINDS.index(kind)
        x.append(codes)
        y.append(tags)
    return np.array(x), np.array(y)


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """A tagger trained on windows of ``sample`` documents, those of the least hashes of id and text."""
    texts = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    few = drawn(texts, sample, (F.col("_id"), F.col("text")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                near = [max(0, s - (s + e) % HALF) for _, s, e in spans]
                near += [max(0, m.start() - HALF) for k, m in zip(range(PER_DOCUMENT), _DIGITS.finditer(text))] + [0]
                for at in sorted(set(near))[:PER_DOCUMENT]:
                    own = [(k, max(s, at) - at, min(e, at + WINDOW) - at) for k, s, e in spans if s < at + WINDOW and e > at]
                    out.append((text[at : at + WINDOW], [{"kind": k, "start": s, "end": e} for k, s, e in own]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [(), ()], (pa.string(), _ARROW_SPANS))], names=["text", "spans"])

    rows = (
        few.select("text")
        .mapInArrow(windows, "text string, spans array<struct<kind:string,start:long,end:long>>")
        .collect()
    )  # at most PER_DOCUMENT windows of each of the sampled documents
    rows = sorted((r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows)
    # As many windows with as without personal data, as far as there are.
    some, none = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    number = [r for r in none if _DIGITS.search(r[0])]
    none = number[: max(200, len(some))] + [r for r in none if not _DIGITS.search(r[0])][: max(200, len(some) // 2)]
    tagger = Tagger()
    tagger.train(*labelled_windows([r[0] for r in some + none], [r[1] for r in some + none]))
    return tagger


_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def detect(docs: DataFrame, tagger: Tagger, fields: list[StructField], result, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` with what ``result(text, base spans, all spans)`` gives. Null texts are empty;
    repeated rows are judged each."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger.p)

    def setup():
        tagger = Tagger()
        tagger.p = shared.value
        trigger = np.zeros(256, dtype=bool)
        trigger[[*range(48, 58), 64]] = True

        def judge(raw: list[bytes]) -> list[tuple]:
            texts = [t.decode("utf-8", "replace") for t in raw]
            some = [k for k, t in enumerate(raw) if trigger[np.frombuffer(t, np.uint8)].any()]
            added: list[list[Span]] = [[] for _ in texts]
            for at in range(0, len(some), 64):
                for k, spans in zip(some[at : at + 64], tagger.spans([texts[k] for k in some[at : at + 64]])):
                    added[k] = spans
            base: list[list[Span]] = [[] for _ in texts]
            for k in some:
                base[k] = base_spans(texts[k])
            return [result(t, b, all_spans(b, a)) for t, b, a in zip(texts, base, added)]

        return judge

    return per_document(docs, fields, setup, id_col, text_col, also, together=True)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of spans that overlap the first is replaced."""
    at, parts = 0, []
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
            at = end
        elif end > at:
            at = end
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """id, text with personal data replaced, and the columns named in ``also``."""
    return detect(docs, tagger, [StructField("masked", StringType())], lambda t, _, spans: (masked(t, spans),), id_col, text_col, also)


FIGURES = [*(StructField(f"n_{k}", LongType()) for k in KINDS), StructField("base_sha256", StringType()), StructField("spans", StringType())]


def figures(text: str, base: list[Span], spans: list[Span]) -> tuple:
    """Counts of the rules' spans by kind, digest of their list, list of all spans."""
    counts = [sum(s[0] == k for s in base) for k in KINDS]
    return (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))
