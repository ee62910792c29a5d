"""Token ids of whole texts by a ``tokenizers`` file, with each distinct word encoded once per worker.

Where the file's rules cut texts at white space before anything else, ids of a text are the
ids of its words one after another, so a worker asks the library once per new word and looks
the rest up by hash. Any other file goes through the library text by text. The file's added
tokens (``<|endoftext|>``) have their own id wherever a text holds them, as in the library.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pandas as pd

from retenta.llm import text as T

#: Words that one worker remembers at most; then it begins anew. Costs about 30 bytes a word.
REMEMBERED = 1_000_000


def _cuts_at_space(path: str) -> bool:
    """True if words can be encoded apart: normal forms and lower case by character, and a split that drops space."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    steps = [step["type"] for step in (rules.get("normalizer") or {}).get("normalizers", [])]
    cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = cuts[0].get("pattern", {}).get("Regex", "") if cuts else ""
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and len(cuts) == 2
        and cuts[0]["type"] == "Split"
        and cuts[0]["invert"]
        and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and cuts[1]["type"] == "ByteLevel"
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and rules["model"]["type"] == "BPE"
        and not rules.get("post_processor")
    )


def _added(path: str) -> dict[bytes, int] | None:
    """The file's added tokens as bytes with their ids; None if they are not found by their bytes alone, longest first."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens") or []
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens)
    return {t["content"].encode(): t["id"] for t in tokens} if plain else None


class Encoder:
    """Ids of texts as one flat array and the number of ids of each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = _added(path)
        self.by_word = self.added is not None and _cuts_at_space(path)
        self.table = T.byte_table(fold_case=True)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of a to z only: no rule of the file changes or cuts them, so the model takes them as they are."""
        cut = self.library.model.tokenize
        return _flat([[token.id for token in cut(word)] for word in b" ".join(words).decode().split(" ")])

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        lower = [word.lower() for word in words]
        plain = np.fromiter((w.isalpha() for w in lower), bool, len(lower))
        pools, starts, counts, order = [self.pool], [], [], []
        at = len(self.pool)
        for kind, encode in ((True, self._plain), (False, lambda own: self._library([w.decode() for w in own]))):
            own = np.flatnonzero(plain == kind)
            if len(own):
                ids, n = encode([lower[i] for i in own])
                pools.append(ids)
                starts.append(at + np.cumsum(n) - n)
                counts.append(n)
                order.append(own)
                at += len(ids)
        self.pool = np.concatenate(pools)
        known = np.concatenate([self.known, hashes[np.concatenate(order)]])
        sorting = np.argsort(known, kind="stable")
        self.known = known[sorting]
        self.start = np.concatenate([self.start, *starts])[sorting]
        self.count = np.concatenate([self.count, *counts])[sorting]

    def _look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, hashes)
        found = at < len(self.known)
        found[found] = self.known[at[found]] == hashes[found]
        return at, found

    def encode(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows ``first`` to ``last`` of a string column's buffers."""
        if self.by_word and self.added:
            return self._around_added(data, offsets, first, last)
        return self._encode(data, offsets, first, last)

    def _around_added(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """As the library does, texts are cut at the file's added tokens before all else, and the rest is encoded."""
        low, high = int(offsets[first]), int(offsets[last])
        raw = data[low:high].tobytes()
        rows = offsets[first : last + 1] - low
        literal = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)))
        found = [m.span() for m in literal.finditer(raw)] if any(x in raw for x in self.added) else []
        if found:
            # A match over the end of a row is none; what begins within it is looked for once more.
            row = np.searchsorted(rows, [a for a, _ in found], "right") - 1
            if any(b > rows[i + 1] for (_, b), i in zip(found, row.tolist())):
                found = [m.span() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()) for m in literal.finditer(raw, a, b)]
        if not found:
            return self._encode(data, offsets, first, last)
        start, end = np.array(found, np.int64).T
        # Parts between row ends and added tokens, in order; the parts that are such tokens are taken out before encoding.
        tails = np.setdiff1d(end, rows)
        cuts = np.unique(np.concatenate([rows, start, tails]))
        token = np.isin(cuts[:-1], start)
        whole = np.repeat(token, np.diff(cuts))
        text = data[low:high][~whole]
        sizes = np.where(token, 0, np.diff(cuts))
        ids, counts = self._encode(text, np.concatenate([[0], np.cumsum(sizes)]), 0, len(sizes))
        at = (np.cumsum(counts) - counts)[token]
        own = np.array([self.added[raw[a:b]] for a, b in found], np.int32)
        ids = np.insert(ids, at, own)
        counts = counts + token
        part = np.searchsorted(rows, cuts[:-1], "right") - 1
        return ids, np.bincount(part, counts, last - first).astype(np.int64)

    def _encode(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(first, last)]
            return self._library(texts)
        words = _pieces(T.words_of(data, offsets, first, last))
        n_rows = last - first
        if not len(words.start):
            return np.zeros(0, np.int32), np.zeros(n_rows, np.int64)
        codes, distinct = pd.factorize(words.hashes(self.table))
        sorting = np.argsort(distinct)
        codes, distinct = np.argsort(sorting)[codes], distinct[sorting]
        at, found = self._look_up(distinct)
        if not found.all():
            new = np.flatnonzero(~found)
            if len(self.known) + len(new) > REMEMBERED:
                self._forget()
                new = np.arange(len(distinct))
            one = np.empty(len(distinct), np.int64)
            one[codes] = np.arange(len(codes))
            self._learn(distinct[new], words.texts(one[new]))
            at, _ = self._look_up(distinct)
        counts = self.count[at][codes]
        ends = np.cumsum(counts)
        total = int(ends[-1])
        take = np.arange(total) - np.repeat(ends - counts - self.start[at][codes], counts)
        sums = np.concatenate([[0], ends])
        return self.pool[take], np.diff(sums[words.of])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts


def _pieces(words: T.Words) -> T.Words:
    """Words cut once more where a letter a-z meets ASCII punctuation other than an apostrophe.

    The file's split always cuts there, and "word" and "word," then share what is remembered.
    """
    x = words.data
    letter, mark = np.zeros(256, bool), np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    mark[33:48] = mark[58:65] = mark[91:97] = mark[123:127] = True
    mark[ord("'")] = False
    cut = np.flatnonzero(letter[x[:-1]] & mark[x[1:]]) + 1
    inner = np.zeros(len(x) + 1, bool)
    inner[cut] = True
    inner[words.rows] = False  # two rows meet here
    cut = cut[inner[cut]]
    start, end = np.concatenate([words.start, cut]), np.concatenate([words.end, cut])
    start.sort()
    end.sort()
    return T.Words(x, words.rows, start, end, np.searchsorted(start, words.rows))


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    store = T.worker_store()
    if ("encoder", path) not in store:
        store["encoder", path] = Encoder(path)
    return store["encoder", path]


T.ship_by_value(__name__)
