"""Language identification with error-correcting output codes.

Each language has a codeword. One binary classifier per bit tells the languages with a 1 there
from those with a 0, by log odds of byte trigrams within and around words. Decoding sums a loss
over the bits, weighted by how well each classifier did for each language on learning rows, and
takes the nearest codeword; a small gap to the next one is flagged.

Learning counts trigrams per language over all learning rows, as partial sums per task. The counts
are a table, from which the driver takes one language after the other: its model is languages
times 2**18 numbers, and more than ``MAX_LANGS`` languages are refused. Prediction is one pass.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, scratch, ship
from .rowwise import held_out, per_document
from .words import CHUNK, string_bytes

GRAMS = 1 << 18
#: Languages, at most, of a model; a column with more is taken for something else.
MAX_LANGS = 512
#: Rows, at most about, on which the loss weights of the bits are measured.
WEIGHT_ROWS = 20_000
#: How strongly the mean log odds of a text's letters count.
STEEPNESS = 8.0
#: Below this difference between the two best languages' scores a result is ambiguous.
AMBIGUOUS = 0.2

_COLUMNS = "lang_pred string, score double, ambiguous boolean"


def _classes() -> np.ndarray:
    """64 classes of bytes: 0 for what is no letter, 1-26 letters, the rest bytes above ASCII."""
    out = np.zeros(256, np.int64)
    for k in range(26):
        out[65 + k] = out[97 + k] = k + 1
    out[128:] = 27 + np.arange(128) % 37
    return out


_CLASS = _classes()


def trigrams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks as (first document, offsets, trigrams): one per byte, in its neighbours' middle.

    The trigram of a byte that is no letter is 0.
    """
    raw, offsets = string_bytes(texts)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1))
        lo = int(offsets[at])
        own = _CLASS[raw[lo : int(offsets[end])]]
        o = offsets[at : end + 1] - lo
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        inner = o[:-1][np.diff(o) > 0]
        before[inner] = 0
        after[o[1:][np.diff(o) > 0] - 1] = 0
        g = (before << 12) | (own << 6) | after
        g[own == 0] = 0
        yield at, o, g
        at = end


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1, a row per language: exhaustive up to 6, else the best of 200
    random codes of 10 log2 n bits by least distance."""
    if n <= 1:
        return np.zeros((n, 0))
    if n <= 6:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1)]
        return np.array([c for c in columns if -1 in c], float).T
    bits, best, least = int(np.ceil(10 * np.log2(n))), None, -1
    rng = np.random.default_rng(seed)
    for _ in range(200):
        code = rng.choice([1.0, -1.0], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > least:
            best, least = code, apart.min()
    return best


@dataclass
class Model:
    """``odds``: per bit, log odds of each trigram; ``weight``: per language and bit."""

    langs: list[str]
    code: np.ndarray
    odds: np.ndarray
    weight: np.ndarray

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per document and bit the mean log odds, and the number of letters."""
        out, letters = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts), np.int64)
        for first, o, g in trigrams(texts):
            own = slice(first, first + len(o) - 1)
            total = np.concatenate([[0], np.cumsum(g != 0)])
            letters[own] = total[o[1:]] - total[o[:-1]]
            for b in range(out.shape[1]):
                total = np.concatenate([[0.0], np.cumsum(self.odds[b][g], dtype=np.float64)])
                out[own, b] = total[o[1:]] - total[o[:-1]]
        return out / np.maximum(letters, 1)[:, None], letters

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its score, and whether another is about as near."""
        n = len(margins)
        if len(self.langs) == 1:
            return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
        agree = STEEPNESS * margins[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0.0, -agree) * self.weight[None, :, :]).sum(axis=2)
        near = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        near /= near.sum(axis=1, keepdims=True)
        top = np.sort(near, axis=1)
        return near.argmax(axis=1), top[:, -1], top[:, -1] - top[:, -2] < AMBIGUOUS


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", weight_rows: int = WEIGHT_ROWS) -> Model | None:
    """Learn from rows that aren't held out and have an id, a language and a text; None if no such.

    More than ``MAX_LANGS`` languages are an error, before anything is counted.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, o, g in trigrams(batch.column(1)):
                own = langs[first : first + len(o) - 1]
                which = np.repeat(np.array(own, object), np.diff(o))
                for lang in set(own):
                    sums.setdefault(lang, np.zeros(GRAMS, np.int64))
                    sums[lang] += np.bincount(g[which == lang], minlength=GRAMS)
                    seen[lang] = seen.get(lang, 0) + own.count(lang)
        for lang, total in sums.items():
            total[0] = seen[lang]
            i = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(i), "gram": i, "n": total[i]})

    counted = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, gram long, n long")
    langs = sorted(r.lang for r in rows.select(F.col(lang_col).alias("lang")).distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return None
    rate, n_rows = np.zeros((len(langs), GRAMS), np.float64), 0
    with scratch():
        sums = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-counts")
        for k, lang in enumerate(langs):
            own = sums.where(F.col("lang") == lang).select("gram", "n").toPandas()  # GRAMS rows at most
            rate[k, own["gram"].to_numpy()] = own["n"].to_numpy()
            n_rows += int(rate[k, 0])
            rate[k, 0] = 0
    known = max(int((rate.sum(axis=0) > 0).sum()), 1)
    rate = (rate + 0.5) / (rate.sum(axis=1, keepdims=True) + 0.5 * known)
    code = codebook(len(langs))
    odds = np.zeros((code.shape[1], GRAMS), np.float32)
    for b in range(code.shape[1]):
        odds[b] = np.log(rate[code[:, b] > 0].mean(axis=0)) - np.log(rate[code[:, b] < 0].mean(axis=0))
    odds[:, 0] = 0
    model = Model(langs, code, odds, np.ones_like(code) / max(code.shape[1], 1))
    if code.shape[1]:
        model.weight = _weights(rows, model, n_rows, weight_rows, id_col, text_col, lang_col)
    return model


def _weights(rows: DataFrame, model: Model, n_rows: int, weight_rows: int, id_col: str, text_col: str, lang_col: str) -> np.ndarray:
    """Per language, the share of its rows that each bit gets right, scaled to sum 1."""
    per_mille = min(1_000_000, -(-1_000_000 * weight_rows // max(n_rows, 1)))
    some = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < per_mille).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        at = {lang: k for k, lang in enumerate(m.langs)}
        sums = np.zeros((len(m.langs), m.code.shape[1] + 1), np.int64)
        for batch in batches:
            own = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
            margins, _ = m.margins(batch.column(1))
            np.add.at(sums[:, :-1], own, (margins * m.code[own] > 0).astype(np.int64))
            np.add.at(sums[:, -1], own, 1)
        i, b = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"lang": i, "bit": b, "n": sums[i, b]})

    got = some.mapInArrow(right, "lang long, bit long, n long").groupBy("lang", "bit").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((len(model.langs), model.code.shape[1] + 1))
    sums[got["lang"].to_numpy(), got["bit"].to_numpy()] = got["n"].to_numpy()
    share = (sums[:, :-1] + 1) / (sums[:, -1:] + 1)
    return share / share.sum(axis=1, keepdims=True)


def _has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, ambiguous.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned; very
    short texts get what little they show, mostly with a low score; rows with the same or a null
    id each have their row; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def kernel(texts: pa.Array) -> list[pa.Array]:
            m = shared.value
            raw, offsets = string_bytes(texts)
            ascii_letter = np.concatenate([[0], np.cumsum((_CLASS[raw] > 0) & (raw < 128))]) if m else None
            if m is None:
                n = len(texts)
                return [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool))]
            plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
            margins, letters = m.margins(texts)
            best, score, ambiguous = m.decode(margins)
            names = [m.langs[k] for k in best]
            for i in np.flatnonzero(~plain):
                if not letters[i] or not _has_letter(texts[int(i)].as_py() or ""):
                    names[i], score[i], ambiguous[i] = "und", 0.0, False
            return [pa.array(names, pa.string()), pa.array(score), pa.array(ambiguous)]

        return kernel

    return per_document(docs, make, _COLUMNS, id_col, text_col, carry)
