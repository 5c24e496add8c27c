"""Secret scans: candidates by pattern, false positives removed by a random forest.

Patterns find candidates in whole texts. The forest judges each from its length, the transitions
between kinds of characters, its coverage by a dictionary, its path and the words beside it. The
dictionary is the whole words of a public tokenizer's vocabulary. The forest is trained from
labelled findings, a table of (line, value, label), bounded by ``MAX_FINDINGS``;
``sample_findings`` makes a labelled set of known kinds of secrets and of look-alikes, amid lines
that are sampled from the documents and without a list that the features use.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ship

#: Labelled findings, at most, that a forest is trained on: a bounded sample by hash order.
MAX_FINDINGS = 50_000
#: Lines of the documents, at most, that stand around the values of ``sample_findings``; a sample
#: by hash order, of lines of these lengths.
MAX_LINES, LINE_CHARS = 2_000, (20, 400)

# Prefixes and shapes of public token formats, and key names.
FORMATS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "slack_token": r"\bxox[abpr]-[0-9A-Za-z-]{10,72}\b",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "stripe_key": r"\b[sr]k_live_[0-9A-Za-z]{16,64}\b",
    "web_token": r"\beyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
    # Through the END line; where there is none, as far as its lines go.
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|(?:(?:\s|\\[nr])*+[0-9A-Za-z+/=]{32,}+)*+)",
    # The name may stand anywhere in a longer one; without a value the word is passed over at once, so that long words stay linear.
    "assigned": r"""(?:api[_-]?key|access[_-]?key|auth|credential|passwd|password|pwd|secret|token)\w*+(?:(?:-key\w*+)?["']?\s*(?::=|=>|[:=])\s*["']?(?P<value>(?!-----BEGIN )[^\s"'<>{}()]{8,}))?""",
}
KEY_NAMES = ["api", "key", "auth", "credential", "passwd", "password", "pwd", "secret", "token"]
#: Names of keys as they stand in configurations, for the labelled findings.
LONG_NAMES = ["DB_PASSWORD", "aws_secret_access_key", "GITHUB_TOKEN", "client_secret", "API-KEY", "x-api-key", "spring.datasource.password", "app.secret-key", "authToken"]
DOUBT_WORDS = ["example", "sample", "test", "dummy", "placeholder", "changeme", "your", "todo", "checksum", "sha", "md5", "commit", "hash", "uuid", "xxx"]

_FIXED = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in FORMATS.items() if kind != "assigned"))
_ASSIGNED = re.compile(FORMATS["assigned"], re.IGNORECASE)
#: A text without any of these has no candidate; found at the speed of a plain search.
_HINTS = re.compile(r"AKIA|ASIA|gh[pousr]_|xox|AIza|k_live_|eyJ|BEGIN|key|auth|credential|passw|pwd|secret|token", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]{3,}")
_DOUBT = frozenset(DOUBT_WORDS)
#: Characters on either side that are looked at, and those right before that may name a key.
NEAR, NAME = 60, 40

FEATURES = ["kind", "log_length", "entropy", "transitions", "digits", "uppers", "lowers", "others", "distinct", "dictionary", "hex", "dots", "slashes", "is_path", "key_before", "doubt_before", "doubt_near", "doubt_inside", "words_near", "quoted", "longest_run"]


def _kinds(value: str) -> list[int]:
    return [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]


def dictionary(path: str) -> frozenset[str]:
    """Words of three ASCII letters or more that a tokenizer's vocabulary marks as whole."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = (t.removesuffix("</w>") for t in vocabulary if t.endswith("</w>"))
    return frozenset(w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha())


def describe(kind: str, value: str, before: str, after: str, known: frozenset[str]) -> list[float]:
    """The features of a candidate between the texts around it; ``known`` is the dictionary."""
    n, kinds = len(value), _kinds(value)
    counts = [kinds.count(k) / n for k in range(4)]
    chars = [c / n for c in Counter(value).values()]
    covered = sum(len(w) for w in _WORD.findall(value) if w.lower() in known)
    low, near = value.lower(), (before[-NEAR:] + " " + after[:NEAR]).lower()
    run = longest = 1
    for a, b in zip(value, value[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    beside = _WORD.findall(near)
    return [
        float(list(FORMATS).index(kind)), math.log(n), -sum(p * math.log2(p) for p in chars), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(n - 1, 1), *counts, len(chars) / n, covered / n,
        float(all(c in "0123456789abcdef" for c in low)), value.count(".") / n, value.count("/") / n, float(bool(re.match(r"[./~]|[A-Za-z]:\\|https?:", value))),
        float(any(k in before[-NAME:].lower() for k in KEY_NAMES)), float(any(w in _DOUBT for w in _WORD.findall(before[-NAME:].lower()))), float(any(w in _DOUBT for w in beside)), float(any(w in low for w in DOUBT_WORDS)), sum(w in known for w in beside) / (len(beside) + 1), float(before[-1:] in ("'", '"')), longest / n,
    ]


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the values in a text, by code points, from left to right.

    A candidate inside another is left out; of two with the same span the fixed format stays.
    """
    if not _HINTS.search(text):
        return
    found = [(*m.span(), m.lastgroup) for m in _FIXED.finditer(text)]
    found += [(*m.span("value"), "assigned") for m in _ASSIGNED.finditer(text) if m["value"] is not None]
    reached = 0
    for a, b, kind in sorted(found, key=lambda f: (f[0], -f[1], f[2] == "assigned")):
        if b > reached:
            yield kind, a, b
            reached = b


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), threshold, children, share of label 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    roots: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 12, least: int = 3, seed: int = 11) -> "Forest":
        """Bootstrap samples, and the best Gini split among the root of the number of features."""
        rng, nodes, roots = np.random.default_rng(seed), [], []
        some = max(1, int(math.sqrt(x.shape[1])) + 1)

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, -1, -1, share])
            if level == depth or len(rows) < 2 * least or share in (0.0, 1.0):
                return at
            best = None
            for f in rng.permutation(x.shape[1])[:some]:
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                k = np.arange(1, len(order))
                ok = (v[1:] > v[:-1]) & (k >= least) & (len(order) - k >= least)
                if not ok.any():
                    continue
                p, q = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(order) - k)
                impurity = np.where(ok, k * p * (1 - p) + (len(order) - k) * q * (1 - q), np.inf)
                i = int(impurity.argmin())
                if best is None or impurity[i] < best[0]:
                    best = (impurity[i], int(f), (v[i] + v[i + 1]) / 2)
            if best is not None:
                go = x[rows, best[1]] <= best[2]
                nodes[at][0], nodes[at][1] = best[1], best[2]
                nodes[at][2] = grow(rows[go], level + 1)
                nodes[at][3] = grow(rows[~go], level + 1)
            return at

        for _ in range(trees):
            roots.append(grow(rng.integers(0, len(y), len(y)), 0))
        cols = list(zip(*nodes, strict=True))
        return cls(*(np.array(c, t) for c, t in zip(cols, (np.int64, float, np.int64, np.int64, float), strict=True)), np.array(roots))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 over the trees."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(self.feature[at] >= 0)).size:
                node = at[inner]
                go = x[inner, self.feature[node]] <= self.threshold[node]
                at[inner] = np.where(go, self.left[node], self.right[node])
            total += self.share[at]
        return total / len(self.roots)


def plain_lines(docs: DataFrame, limit: int = MAX_LINES, text_col: str = "text") -> list[str]:
    """Lines of the documents without a candidate, ``limit`` at most: those of the lowest hashes."""
    line = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).where(F.char_length("line").between(*LINE_CHARS))
    place, top = F.pmod(F.xxhash64("line"), F.lit(1 << 30)), 1 << 30
    # Only the low end of the hashes reaches the driver, however many tasks there are.
    upto = min(top, limit * top // (8 * max(docs.count(), 1)) + 1)
    while True:
        rows = line.where(place < upto).orderBy(place, "line").limit(limit).collect()
        if len(rows) == limit or upto == top:
            break
        upto = min(top, 8 * upto)
    return [r.line for r in rows if next(candidates(r.line), None) is None]


def sample_findings(words: Sequence[str], lines: Sequence[str] = (), n: int = 2000, seed: int = 5) -> list[tuple[str, str, int]]:
    """Labelled findings (line, value, label): random tokens of known kinds, and look-alikes.

    Look-alikes are made of ``words``; around the values stand pieces of ``lines``, or random
    words where there are none.
    """
    rng = np.random.default_rng(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = sorted(words)

    def draw(chars: str, size: int) -> str:
        return "".join(chars[k] for k in rng.integers(0, len(chars), size))

    def some(k: int) -> list[str]:
        return [words[i] for i in rng.integers(0, len(words), k)]

    def prose(k: int) -> list[str]:
        """Words of a document, of the dictionary or of no language, with marks."""
        pick = int(rng.integers(0, 5))
        if pick < 2 and lines:
            own = lines[int(rng.integers(0, len(lines)))].split()
            at = int(rng.integers(0, max(1, len(own) - k)))
            return own[at : at + k]
        if pick == 2:
            return some(k)
        if pick == 3:  # addresses and words of doubt stand beside secrets as well
            own = some(k)
            for _ in range(min(k, 2)):
                odd = DOUBT_WORDS[int(rng.integers(0, len(DOUBT_WORDS)))]
                own[int(rng.integers(0, k))] = (odd, f"{some(1)[0]}@{odd}.com", f"{some(1)[0]}.{rng.integers(0, 99)}@mail.example")[int(rng.integers(0, 3))]
            return own
        return [draw("abcdefghijklmnopqrstuvwxyz", int(rng.integers(1, 11))) + ("", "", "", ",", ".", "###", "!!", " |")[int(rng.integers(0, 8))] for _ in range(k)]

    def pem(line) -> str:
        """A private key of such lines."""
        kind = ("", "RSA ", "EC ", "OPENSSH ")[int(rng.integers(0, 4))]
        return "\n".join([f"-----BEGIN {kind}PRIVATE KEY-----", *(line() for _ in range(int(rng.integers(1, 26)))), f"-----END {kind}PRIVATE KEY-----"])

    out = []
    for _ in range(n):
        names = (KEY_NAMES, LONG_NAMES)[int(rng.integers(0, 2))]
        key, around = names[int(rng.integers(0, len(names)))], " ".join(prose(int(rng.integers(0, 12))))
        sign, quote = (" = ", ": ", "=")[int(rng.integers(0, 3))], ('"', "'", "")[int(rng.integers(0, 3))]
        real = [
            lambda: (f"{around} {key}{sign}{quote}", draw("0123456789abcdef", int(rng.choice([32, 40, 48, 64])))),
            lambda: (f"{around} {key}{sign}{quote}", draw(alnum + "_-+/", int(rng.integers(16, 64)))),
            lambda: (f"{around} password{sign}{quote}", draw(alnum + "!#%&*@^", int(rng.integers(9, 24)))),
            lambda: (f"{around} ", "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16)),
            lambda: (f"{around} ", "ghp_" + draw(alnum, 36)),
            lambda: (f"{around} ", "AIza" + draw(alnum + "_-", 35)),
            lambda: (f"{around} ", "sk_live_" + draw(alnum, 24)),
            lambda: (f"{around} {key}{sign}{quote}", draw(alnum + "_-+/", int(rng.integers(201, 1200)))),
            lambda: (f"{around} ", pem(lambda: draw(alnum + "+/", 64))),
            lambda: (f"{around} ", ".".join(("eyJ" + draw(alnum, int(rng.integers(15, 40))), "eyJ" + draw(alnum, int(rng.integers(20, 200))), draw(alnum + "_-", 43)))),
            lambda: (f"{around} ", f"xox{draw('abpr', 1)}-{draw('0123456789', 11)}-{draw('0123456789', 12)}-{draw(alnum, 24)}"),
        ]
        fake = [
            lambda: (f"{around} {key}{sign}{quote}", "_".join(some(2))),
            lambda: (f"{around} {key}{sign}{quote}", "your-" + "-".join(some(2)) + "-here"),
            lambda: (f"{around} {key}{sign}{quote}", "x" * int(rng.integers(8, 40))),
            lambda: (f"{around} {key}{sign}{quote}", "/".join(["", *some(3)])),
            lambda: (f"{around} {key}{sign}{quote}", ".".join(some(3))),
            lambda: (f"{around} commit sha token{sign}{quote}", draw("0123456789abcdef", 40)),
            lambda: (f"{around} example ", "AKIA" + "EXAMPLE" + draw("ABCDEFGHI", 9)),
            lambda: (f"{around} {key}{sign}{quote}", "".join(some(2)) + ","),
            lambda: (f"{around} ", pem(lambda: ("...", "x" * 64, "your key here")[int(rng.integers(0, 3))])),
            lambda: (f"{around} example ", "eyJ" + ".".join("x" * int(rng.integers(12, 40)) for _ in range(3))),
            lambda: (f"{around} ", f"xox{draw('abpr', 1)}-your-" + "-".join(some(2)) + "-here"),
        ]
        for label, makers in ((1, real), (0, fake)):
            before, value = makers[int(rng.integers(0, len(makers)))]()
            out.append((f"{before}{value}{quote if before.endswith(quote) else ''}{('', ' ', '###', '.')[int(rng.integers(0, 4))]} {' '.join(prose(int(rng.integers(0, 12))))}", value, label))
    return out


def train(findings: list[tuple[str, str, int]], known: frozenset[str], limit: int = MAX_FINDINGS) -> Forest:
    """From (line, value, label). Beyond ``limit`` the findings of the lowest hashes are taken."""
    if len(findings) > limit:
        findings = sorted(findings, key=lambda f: hashlib.md5(repr(f).encode()).digest())[:limit]
    x, y = [], []
    for line, value, label in findings:
        for kind, a, b in candidates(line):
            if line[a:b] == value or value in line[a:b]:
                x.append(describe(kind, line[a:b], line[:a], line[b:], known))
                y.append(label)
                break
    if not y:
        raise ValueError("no labelled finding holds a candidate")
    return Forest.train(np.array(x), np.array(y, float))


_FOUND = "doc_id long, nth int, kind string, start int, length int, secret string, score double, is_secret boolean"


def scan(docs: DataFrame, forest: Forest, known: frozenset[str], threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate of a whole text: doc_id, nth, kind, start, length, secret, score,
    is_secret. ``start`` and ``length`` count code points; ``nth`` counts from 0 in the text.

    Null and empty texts have no candidates; rows with the same or a null id are each scanned, so
    repeated rows repeat theirs; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((forest, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, words = shared.value
        for batch in batches:
            rows, x = [], []
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for d, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    for k, (kind, a, b) in enumerate(candidates(text or "")):
                        rows.append((d, k, kind, a, b - a, text[a:b]))
                        x.append(describe(kind, text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], words))
            p = judge.score(np.array(x)) if x else np.zeros(0)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)] + [pa.array(p, pa.float64()), pa.array(p >= threshold)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "nth", "kind", "start", "length", "secret", "score", "is_secret"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _FOUND)
