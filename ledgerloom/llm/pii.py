"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field is trained from a small labelled table (labelled_rows) and reads the words
within `around` words of any digit or at sign, as no span lies elsewhere; it adds the spans that the patterns drop or don't know: numbers that run into one another,
card-like numbers with a wrong check digit, addresses with blanks. Base spans stay, added spans never overlap them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .crf import LinearChainCRF

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, str, int]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: No match begins inside a run of digits, as one that began earlier in the run would hold it.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
MARK = re.compile("[0-9@]")
WORD = re.compile(r"[^ \t-\r]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign: the domain after it and the longest local part before it, back to the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done and (m := DOMAIN.match(text, at)):
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' matches that hold, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, "email", b) for a, b in _emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


# The field.


def shape(word: str) -> str:
    """Kinds of characters of the whole word; runs of letters count once, runs of digits by their length up to 9 and 12 to
    19 alike, any other character once for each run of it. Shapes of short words are kept."""
    return _known_shape(word) if len(word) <= 64 else _shape(word)


def _shape(word: str) -> str:
    out = []
    for m in re.finditer(r"[A-Z]+|[a-z]+|[0-9]+|(.)\1*", word, re.S):
        c = m[0]
        if c[0].isdigit() and c.isascii():
            out.append("9*" if 12 <= len(c) <= 19 else "9" * min(len(c), 9))
        elif c.isascii() and c.isalpha():
            out.append("A" if c[0].isupper() else "a")
        else:
            out.append("a" if c.isalpha() else c[0])
    return re.sub("[Aa]+", "a", "".join(out))


_known_shape = lru_cache(maxsize=100_000)(_shape)


def core(word: str) -> str:
    return word.strip(".,;:!?\"'|&*#$%<>") or word


def features(words: list[str]) -> list[list[str]]:
    shapes = [shape(core(w)) for w in words]
    out = []
    for k, s in enumerate(shapes):
        before, after = (shapes[k - 1] if k else "^"), (shapes[k + 1] if k + 1 < len(shapes) else "$")
        digits = sum(c.isdigit() for c in words[k])
        out.append(["bias", f"s={s}", f"p={before}", f"n={after}", f"sp={before}|{s}", f"sn={s}|{after}", f"d={min(digits, 20)}", f"at={'@' in words[k]}", f"dots={min(4, s.count('.'))}", f"c={s[:1]}"])
    return out


LABELS = ["O", *(f"{x}-{k}" for k in KINDS for x in "BI")]
#: Rows that a field may be trained from, on the driver.
MOST_ROWS = 5000


def rows_of(labelled: DataFrame) -> list[tuple[list[str], list[str]]]:
    """The caller's labelled table: words and labels (arrays of equal length; labels of LABELS). Rows without words are
    left out; more than MOST_ROWS rows, or a label that isn't known, are an error."""
    found = labelled.select("words", "labels").where(F.size("words") > 0).limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"a field is trained from at most {MOST_ROWS} rows")
    for r in found:
        if len(r.words) != len(r.labels) or not set(r.labels) <= set(LABELS):
            raise ValueError(f"labels {r.labels} don't fit {r.words}")
    return [(list(r.words), list(r.labels)) for r in found]


def labelled_rows(n: int = 240) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences of ordinary words with values made by rule, a label to each word.

    Labels are O, B-kind and I-kind. Numbers that are nothing personal (years, amounts, versions, hashes) are labelled O.
    """
    rng = np.random.default_rng(11)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    plain = "please write to or call us about the order before noon with your name and note that this is only a list of items for them".split()
    fillers = [lambda: digits(4), lambda: digits(2), lambda: f"{digits(2)}.{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"v{digits(1)}", lambda: hashlib.sha256(digits(6).encode()).hexdigest()[:32], lambda: f"{digits(3)},{digits(3)}", lambda: f"{digits(5)}%", lambda: f"${digits(3)}", lambda: f"#{digits(4)}", lambda: f"@{plain[rng.integers(0, 9)]}", lambda: digits(8), lambda: digits(6)]
    made = {
        "email": [lambda: [f"{plain[rng.integers(0, 20)]}.{digits(2)}@mail{digits(1)}.example.com"], lambda: [f"{plain[rng.integers(0, 20)]}@host.org"], lambda: [f"{plain[rng.integers(0, 20)]}_{digits(3)}@sub.host-{digits(1)}.net"]],
        "ip": [lambda: [".".join(str(x) for x in rng.integers(0, 256, 4))]],
        "card": [lambda: [digits(16)], lambda: [digits(4) for _ in range(4)], lambda: ["-".join(digits(4) for _ in range(4))], lambda: [digits(15)], lambda: [digits(13)]],
        "phone": [lambda: [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], lambda: [f"+{digits(2)}", digits(3), digits(7)], lambda: [f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}"], lambda: [f"+{digits(11)}"], lambda: [f"({digits(3)})", f"{digits(3)}-{digits(4)}"]],
    }
    rows = []
    for k in range(n):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(1, 5))):
                words.append(plain[rng.integers(0, len(plain))])
                labels.append("O")
            if k % 3 == 0:
                words.append(fillers[rng.integers(0, len(fillers))]())
                labels.append("O")
            for _ in range(1 + (rng.random() < 0.2)):
                kind = KINDS[rng.integers(0, 4)]
                value = made[kind][rng.integers(0, len(made[kind]))]()
                words += value
                labels += [f"B-{kind}"] + [f"I-{kind}"] * (len(value) - 1)
        words.append(plain[rng.integers(0, len(plain))])
        labels.append("O")
        if rng.random() < 0.4:
            k = int(rng.integers(0, len(words)))
            words[k] += ".,;"[rng.integers(0, 3)]
        rows.append((words, labels))
    return rows


def fitted(rows: list[tuple[list[str], list[str]]]) -> LinearChainCRF:
    return LinearChainCRF(LABELS, features).fit(rows)


@lru_cache(maxsize=1)
def trained() -> LinearChainCRF:
    """The field of the table made by rule."""
    return fitted(labelled_rows())


def windows(text: str, around: int = 2) -> list[list[tuple[int, int]]]:
    """Words within `around` words of a digit or an at sign, as runs of (start, end)."""
    if not MARK.search(text):
        return []
    words = [m.span() for m in WORD.finditer(text)]
    marked = np.zeros(len(words), bool)
    for k, (a, b) in enumerate(words):
        if MARK.search(text, a, b):
            marked[max(0, k - around) : k + around + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return [words[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def field_spans(texts: list[str], model: LinearChainCRF) -> list[list[Span]]:
    """Spans that the field finds in each text: from a B word to the last I word of its kind, without outer marks."""
    rows, homes = [], []
    for k, text in enumerate(texts):
        for run in windows(text):
            homes.append((k, run))
            rows.append(model.scores([text[a:b] for a, b in run]))
    out: list[list[Span]] = [[] for _ in texts]
    for (k, run), labels in zip(homes, model.decode(rows), strict=True):
        names = [model.labels[x] for x in labels]
        i = 0
        while i < len(names):
            j = i + 1
            if names[i] != "O":
                kind = names[i][2:]
                while j < len(names) and names[j] == f"I-{kind}":
                    j += 1
                a, b = run[i][0], run[j - 1][1]
                while a < b and not (texts[k][a].isalnum() or texts[k][a] in "+("):
                    a += 1
                while a < b and not texts[k][b - 1].isalnum():
                    b -= 1
                if MARK.search(texts[k], a, b):
                    out[k].append((a, kind, b))
            i = j
    return out


def all_spans(texts: list[str], model: LinearChainCRF) -> list[tuple[list[Span], list[Span]]]:
    """Of each text: base spans, and base and added spans together."""
    out = []
    for text, more in zip(texts, field_spans(texts, model), strict=True):
        base = base_spans(text)
        starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
        free = [s for s in more if not (k := bisect_left(starts, s[2])) or reach[k - 1] <= s[0]]
        out.append((base, in_order(base + free)))
    return out


CHUNK = 512


def _found(docs: DataFrame, labelled: DataFrame | None):
    bounded(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(trained() if labelled is None else fitted(rows_of(labelled)))


def personal_data(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. labelled: a table to train the field from.

    Defined cases: a null text is empty and has no spans; repeated rows are answered each; a null doc_id stays null;
    other columns are ignored.
    """
    model = _found(docs, labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                found = all_spans([t or "" for t in batch.column(1).to_pylist()], model.value)
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                spans = pa.array([joined(every) for _, every in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"]))


def masked(text: str, spans: list[Span]) -> str:
    """Each span gives way to its kind in angle brackets; of overlapping spans the earlier one's kind stands for both."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs with all spans masked in text, and n_chars following it where that column exists."""
    model = _found(docs, labelled)
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                texts = batch.column(at).to_pylist()
                found = all_spans([t or "" for t in texts], model.value)
                clean = [t if t is None or not every else masked(t, every) for t, (_, every) in zip(texts, found, strict=True)]
                columns = list(batch.columns)
                columns[at] = pa.array(clean, batch.schema.field(at).type)
                if chars is not None:
                    sizes = [n if c is t else len(c) for n, c, t in zip(columns[chars].to_pylist(), clean, texts, strict=True)]
                    columns[chars] = pa.array(sizes, batch.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
