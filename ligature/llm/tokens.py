"""Token ids of whole texts, with the ids of frequent words kept.

Both kinds of tokenizer served here cut a text into words before they merge, and never merge
across a cut. So ids of a text are those of its words one after another, and a word's ids are
asked of the library once for as long as the word stays in the memo. Texts that hold an added
token or white space outside ASCII go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Words kept per Python worker, in two generations; a few hundred bytes each.
MEMO_WORDS = 1_000_000

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: ASCII punctuation but the apostrophe, which may begin a contraction.
_MARKS = r"[!-&(-/:-@\[-`{-~]"
#: Words, with plain letters parted from the punctuation behind them: more words repeat so.
_DROPPED = re.compile(rf"[a-zß-öø-ÿ]+(?={_MARKS}*(?:\s|\Z))|{_MARKS}+(?=\s|\Z)|\S+")
_LED = re.compile(rf" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?={_MARKS}*(?:\s|\Z))|{_MARKS}+(?=\s|\Z)| ?\S+|\s+(?!\S)|\s+")
#: Words of plain letters, which no step before the merges changes, by kind of cut.
_PLAIN = {"dropped": re.compile(r"[a-zß-öø-ÿ]+"), "led": re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")}


def _byte_signs() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if it prints."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = _byte_signs()

_memos: dict[tuple[str, int], "WordMemo"] = {}


@dataclass(frozen=True)
class Facts:
    """What a tokenizer file says about its cuts; found once on the driver, as reading the whole
    file takes a worker more memory than its words do."""

    added: tuple[str, ...]
    parts: tuple[str, int] | None
    cut: str
    byte_level: bool
    lower: bool

    @classmethod
    def of(cls, path: str) -> "Facts":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [t for t in spec["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        pre = spec["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers", [pre])
        # "dropped": a split that keeps no white space; "led": byte level with its own pattern,
        # where one space leads a word; else texts are encoded whole.
        cut = "whole"
        if steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed":
            cut = "dropped"
        elif steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex") and not steps[0].get("add_prefix_space") and not spec["normalizer"]:
            cut = "led"
        plain_model = spec["model"].get("type") == "BPE" and not any(spec["model"].get(k) for k in ("dropout", "unk_token", "fuse_unk", "ignore_merges"))
        byte_level = cut != "whole" and steps[-1].get("type") == "ByteLevel" and plain_model and sys.byteorder == "little" and array("I").itemsize == 4
        lowers = any(n.get("type") == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        return cls(tuple(t["content"] for t in spec["added_tokens"]), (plain[0]["content"], plain[0]["id"]) if plain else None, cut, byte_level, cut == "dropped" and lowers)


def memo(path: str, limit: int = MEMO_WORDS, facts: Facts | None = None) -> "WordMemo":
    """This process's memo for a tokenizer file; it outlives a task."""
    if (path, limit) not in _memos:
        _memos[path, limit] = WordMemo(path, limit, facts)
    return _memos[path, limit]


class WordMemo:
    """``encode(texts)``: per text, its ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, limit: int = MEMO_WORDS, facts: Facts | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        facts = facts or Facts.of(path)
        self.added, self.parts, self.cut, self.byte_level, self.lower = facts.added, facts.parts, facts.cut, facts.byte_level, facts.lower
        self.limit, self.known, self.older = limit, {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, text: str) -> list[str] | None:
        if self.cut == "whole" or _ODD_SPACE.search(text):
            return None
        if self.lower:
            text = text.encode().lower().decode()  # A-Z alone, as the tokenizer would in the end
        if any(t in text for t in self.added):
            return None
        return (_DROPPED if self.cut == "dropped" else _LED).findall(text)

    def _learn(self, new: set[str]) -> None:
        known, older = self.known, self.older
        if len(known) + len(new) > self.limit // 2:
            self.older, self.known = known, {}
            return
        again = [w for w in new if w in older]
        known.update((w, older[w]) for w in again)
        fresh = list(new.difference(again))
        known.update(zip(fresh, self._encode_words(fresh), strict=True))

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Plain words by the tokenizer's merges alone, which is all that happens to them."""
        if not self.byte_level:
            return self._encode_mixed(words)
        merge, plain, out = self.tokenizer.model.tokenize, _PLAIN[self.cut].fullmatch, []
        mixed = iter(self._encode_mixed([w for w in words if not plain(w)]))
        for w in words:
            if plain(w):
                w = w.translate(_BYTES) if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)
                out.append(array("I", [t.id for t in merge(w)]).tobytes())
            else:
                out.append(next(mixed))
        return out

    def _encode_mixed(self, words: list[str]) -> list[bytes]:
        """Words in one call, parted by an added token, whose id no word has."""
        if not self.parts or len(words) < 2:
            return [self.whole(w) for w in words]
        sign, part = self.parts
        ids = np.array(self.tokenizer.encode_batch_fast([sign.join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * np.append(np.flatnonzero(ids == part), len(ids))
        raw, starts = ids.tobytes(), [0, *(ends[:-1] + 4).tolist()]
        return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 64):
            some = [t or "" for t in texts[at : at + 64]]
            cut = [self._words(t) for t in some]
            self._learn(set().union(*(w for w in cut if w is not None)).difference(self.known))
            for t, words in zip(some, cut, strict=True):
                out.append(self.whole(t) if words is None else self._join(t, words))
        return out

    def _join(self, text: str, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:  # a new generation began
            self._learn(set(words).difference(self.known))
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:  # more words than the memo holds
            return self.whole(text)
