"""Token counts under a unigram model, with the dynamic program shared along a trie.

The best split of a word into pieces is found by forward scores: the score of a prefix is the
best over the pieces that end there. Two words with a common prefix have the same scores along
it. So the distinct pre-tokens of a batch go into a trie, scores are worked out once per trie
node, and the nodes where a word ends (terminals) store the number of pieces of its best split.
A document's count is the sum over its words, and frequent words keep their count in the worker.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rowwise import per_document

#: Words kept per Python worker, in two generations.
MEMO_WORDS = 600_000
#: Texts whose new words share a trie.
TRIE_TEXTS = 256
#: The sign that stands for the white space before a word in the vocabulary.
LEAD = "▁"

_COLUMNS = "n_words long, n_tokens long, n_unknown long"


class Unigram:
    """Pieces with log probabilities, and counts of best splits.

    The vocabulary file gives pieces in order of rank; a piece of rank r has the probability
    1 / (r + 1), scaled to sum 1. A character that no piece covers is an unknown token with the
    log probability of the last rank less ``unknown_penalty``. Of splits with equal scores the
    one with fewer pieces counts, then the one with fewer unknown characters.
    """

    def __init__(self, pieces: dict[str, float], unknown: float, limit: int = MEMO_WORDS):
        self.pieces, self.unknown, self.limit = pieces, unknown, limit
        self.longest = max(map(len, pieces), default=1)
        self.known: dict[str, tuple[int, int]] = {}
        self.older: dict[str, tuple[int, int]] = {}

    @classmethod
    def from_sentencepiece(cls, path: str, unknown_penalty: float = 10.0, limit: int = MEMO_WORDS) -> "Unigram":
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked = [vocabulary.id_to_piece(i) for i in range(vocabulary.get_piece_size()) if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i))]
        total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
        pieces = {p: -math.log(r + 1) - total for r, p in enumerate(ranked)}
        return cls(pieces, -math.log(len(ranked) + 1) - total - unknown_penalty, limit)

    def split_counts(self, words: Iterable[str]) -> dict[str, tuple[int, int]]:
        """Pieces and unknown characters of each word's best split.

        The words are taken in order, so the path to the previous word is the trie's stack: what
        they share is kept, and only new nodes are scored.
        """
        out: dict[str, tuple[int, int]] = {}
        pieces, unknown, longest = self.pieces, self.unknown, self.longest
        last, stack = "", [(0.0, 0, 0)]  # per prefix: score, pieces, unknown characters
        for word in sorted(set(words)):
            shared = len(os.path.commonprefix((last, word)))
            del stack[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                s, n, u = stack[end - 1]
                best = (s + unknown, -n - 1, -u - 1)
                for start in range(max(0, end - longest), end):
                    p = pieces.get(word[start:end])
                    if p is not None:
                        s, n, u = stack[start]
                        one = (s + p, -n - 1, -u)
                        if one > best:
                            best = one
                stack.append((best[0], -best[1], -best[2]))
            out[word] = stack[-1][1:]
            last = word
        return out

    def learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > self.limit // 2:
            self.older, self.known = self.known, {}
        older = self.older
        self.known.update((w, older[w]) for w in new if w in older)
        self.known.update(self.split_counts(w for w in new if w not in older))

    def count(self, text: str) -> tuple[int, int, int]:
        """Words, tokens and unknown tokens of a text."""
        words = text.split()
        distinct, known = set(words), self.known
        if len(distinct) > self.limit // 2:  # more than is kept: counted for this text alone
            known = self.split_counts(distinct)
        elif not distinct <= known.keys():
            for _ in range(2):  # the first may begin a new generation, without the words known before
                self.learn(distinct.difference(self.known))
            known = self.known
        got = [known[w] for w in words]
        return len(words), sum(g[0] for g in got), sum(g[1] for g in got)


_models: dict[str, Unigram] = {}


def _model(path: str) -> Unigram:
    if path not in _models:
        _models[path] = Unigram.from_sentencepiece(path)
        model = _models[path]
        plain = model.split_counts
        model.split_counts = lambda words: {w[len(LEAD) :]: c for w, c in plain(LEAD + w for w in words).items()}
    return _models[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown.

    Pre-tokens are runs without white space, each led by the sign for it. Null, empty and blank
    texts have no words and no tokens; rows with the same or a null id each have their row; an
    empty table gives no rows; other columns are not read.
    """

    def make():
        model = _model(vocabulary)

        def kernel(texts: pa.Array) -> list[pa.Array]:
            rows = np.zeros((len(texts), 3), np.int64)
            for at in range(0, len(texts), TRIE_TEXTS):
                some = [t or "" for t in texts.slice(at, TRIE_TEXTS).to_pylist()]
                new = set().union(*(t.split() for t in some)).difference(model.known)
                if len(new) <= model.limit // 2:
                    model.learn(new)
                for i, t in enumerate(some):
                    rows[at + i] = model.count(t)
            return [pa.array(rows[:, k]) for k in range(3)]

        return kernel

    return per_document(docs, make, _COLUMNS, id_col, text_col, carry)
