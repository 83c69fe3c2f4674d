"""Token counts by byte-pair merging of many pre-tokens at once, in ragged arrays."""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakescribe.llm.common import located, per_text, Place

#: White space by the Unicode property, which patterns of the vocabulary file mean by \s.
_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CACHED = 300_000
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in shown):
        shown[b] = chr(256 + i)
    return [shown[b] for b in range(256)]


class PairMerger:
    """Counts tokens of texts as the tokenizer file gives them, without special tokens around the text.

    Handles byte-level BPE with lower case, NFC and a pattern for pre-tokens; other settings raise.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (
            model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"]
            or split["type"] != "Split" or not split["invert"] or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]
            or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
        ):
            raise ValueError("not a tokenizer that this operator handles")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace("\\s", _SPACE))
        specials = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        vocab, suffix, letters = model["vocab"], model["end_of_word_suffix"] or "", byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        # A merged symbol may only occur in later merges; else equal pairs must be merged one by one.
        rank_of = {x: r for r, x in reversed(list(enumerate(made)))}
        self.together = len(rank_of) == len(made) and all(
            rank_of.get(vocab[x], -1) < r for r, pair in enumerate(merges) for x in pair)
        self.size = len(vocab) + len(spec["added_tokens"])
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), np.array(made, np.int64)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[str]) -> np.ndarray:
        """Number of symbols that survive in each pre-token."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(x) for x in raw], np.int64)
        count = np.zeros(len(words), np.int64)
        symbols = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[np.frombuffer(b"".join(x[-1:] for x in raw), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            # ranks of neighbours; the last symbol of each sequence has none
            rank = np.full(len(symbols), _NONE, np.int32)
            inside = owner[:-1] == owner[1:]
            pairs = np.flatnonzero(inside)
            rank[pairs] = self._rank(symbols[pairs], symbols[pairs + 1])
            starts = np.flatnonzero(np.r_[True, ~inside])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            done = lowest == _NONE
            count[owner[starts[done]]] = sizes[done]
            low = np.repeat(lowest, sizes)
            active = low != _NONE
            hit = active & (rank == low)
            where = np.flatnonzero(hit)
            if self.together:  # in a run of overlapping hits each second one merges
                fresh = np.r_[True, where[1:] != where[:-1] + 1] if len(where) else np.empty(0, bool)
                first = where[np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))] if len(where) else where
                where = where[(where - first) % 2 == 0]
            else:
                where = where[np.r_[True, owner[where[1:]] != owner[where[:-1]]]] if len(where) else where
            symbols[where] = self.made[rank[where]]
            active[where + 1] = False
            symbols, owner = symbols[active], owner[active]
        return count

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special tokens that stand in the text."""
        if self.special and "<" in text:
            parts = self.special.split(text)
            found = [w for part in parts for w in self.pattern.findall(_normal(part))]
            return found, len(parts) - 1
        return self.pattern.findall(_normal(text)), 0

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pre_tokens(x) for x in texts]
        fresh = {w for words, _ in split for w in words} - self.known.keys()
        if len(self.known) + len(fresh) > _CACHED:  # what was not used lately goes
            self.older, self.known = self.known, {}
            fresh = {w for words, _ in split for w in words}
        for w in fresh & self.older.keys():
            self.known[w] = self.older[w]
        unknown = [w for w in fresh if w not in self.known]
        for i in range(0, len(unknown), 100_000):
            part = unknown[i : i + 100_000]
            self.known.update(zip(part, self.merge(part).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, words)) + special for words, special in split]


def _normal(text: str) -> str:
    """NFC, then lower case letter by letter: a final sigma is not told apart."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


@functools.lru_cache(maxsize=2)
def _merger(path: str) -> PairMerger:
    return PairMerger(path)


_SCHEMA = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
])


def count_tokens(docs: DataFrame, path: Place, limit: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """UTF-8 bytes and tokens of every whole text, and whether it has more tokens than the limit.

    path: a tokenizer file that the executors can read, or a function that gives its place there. Special strings inside texts count as one token
    each. Null and empty texts have no bytes and no tokens. Rows are independent; other columns are ignored.
    """

    def worker():
        merger = _merger(located(path))

        def work(texts):
            n = merger.counts([x.decode() for x in texts])
            return [len(x) for x in texts], n, [x > limit for x in n]

        return work

    return per_text(docs, worker, _SCHEMA, keep)
