"""Blocks of queries against blocks of titles: bounds of each pair's lookup score, so that few pairs are scored."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd

from ..functions.similarity import AUTHOR_EXACT, AUTHOR_PART, CONTAINS, EXACT, PREFIX

#: Titles that are compared with a query at a time.
STEP = 4_096
#: Characters of keys as numbers; a line break is between keys.
LETTERS = " 0123456789abcdefghijklmnopqrstuvwxyz"
BREAK = len(LETTERS)
_CODES = np.full(256, BREAK, "int64")
_CODES[np.frombuffer(LETTERS.encode(), "uint8")] = np.arange(BREAK)


def _grams(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys, and the numbers of their distinct pairs of characters (``similarity.bigrams``)."""
    c = _CODES[np.frombuffer((" " + " \n ".join(keys) + " ").encode("ascii"), "uint8")]
    inside = (c[:-1] != BREAK) & (c[1:] != BREAK)
    each = np.unique((np.cumsum(c == BREAK)[:-1] * BREAK * BREAK + c[:-1] * BREAK + c[1:])[inside])
    return each // (BREAK * BREAK), each % (BREAK * BREAK)


def _words(key: str) -> list[str]:
    """``similarity.overlap_tokens``"""
    return [w for w in key.split(" ") if len(w) > 1 or w.isdigit()]


class _Texts:
    """Texts, several of which may be equal, searched for what they hold."""

    def __init__(self, texts: list[str], places: np.ndarray):
        self.distinct, at = np.unique(np.array(texts, dtype=object), return_inverse=True) if len(texts) else (np.array([], dtype=object), np.array([], "int64"))
        order = np.argsort(at, kind="stable")
        self.places = np.split(places[order], np.cumsum(np.bincount(at, minlength=len(self.distinct)))[:-1]) if len(texts) else []
        self.whole = "\n" + "\n".join(self.distinct) + "\n"
        self.starts = np.cumsum([1, *(len(x) + 1 for x in self.distinct)])

    def holding(self, part: str) -> list[tuple[str, np.ndarray]]:
        """The texts that hold a part that isn't blank, with their places."""
        out, at = [], self.whole.find(part)
        while at >= 0:
            n = int(np.searchsorted(self.starts, at, "right")) - 1
            out.append((self.distinct[n], self.places[n]))
            at = self.whole.find(part, int(self.starts[n + 1]))
        return out


class Titles:
    """A step's titles by pairs of characters, by words and by what they hold."""

    def __init__(self, held: pd.DataFrame):
        self.keys, self.loose = held["key"].to_list(), held["loose"].to_list()
        n = len(self.keys)
        place, gram = _grams(self.keys)
        self.has = np.zeros((BREAK * BREAK, n), "uint8")
        self.has[gram, place] = 1
        self.letters = np.stack([np.bincount(c[c < BREAK], minlength=BREAK) for c in (_CODES[np.frombuffer(k.encode("ascii"), "uint8")] for k in self.keys)], axis=1).astype("int32") if n else np.zeros((BREAK, 0), "int32")
        self.grams = np.bincount(place, minlength=n)
        self.length = np.array([len(k) for k in self.keys])
        self.blank = self.length == 0
        self.by_word: dict[str, list[int]] = {}
        for at, k in enumerate(self.keys):
            for w in set(_words(k)):
                self.by_word.setdefault(w, []).append(at)
        self.words = sorted(self.by_word)
        self.authors = _Texts(held["authors"].to_list(), np.arange(n))
        odd = [at for at in range(n) if self.loose[at] != self.keys[at]]
        self.odd, self.all_loose = _Texts([self.loose[at] for at in odd], np.array(odd, "int64")), None
        self.met: dict[str, np.ndarray] = {}

    def alike(self, word: str) -> np.ndarray:
        """Places of titles that have a word like this one (``similarity.tokens_similar``)."""
        if word not in self.met:
            found = [word] if word in self.by_word else []
            if len(word) >= 3 and not word.isdigit():
                at = bisect_left(self.words, word)
                while at < len(self.words) and self.words[at].startswith(word):
                    found.append(self.words[at])
                    at += 1
                found += [word[:n] for n in range(3, len(word)) if word[:n] in self.by_word and not word[:n].isdigit()]
            self.met[word] = np.unique(np.concatenate([np.array(self.by_word[w], "int64") for w in found])) if found else np.empty(0, "int64")
        return self.met[word]

    def closer(self, text: str, places: np.ndarray, score: np.ndarray) -> np.ndarray:
        """What scores can reach by edits, by how often each character stands in both texts; places of titles that differ by eight characters at most."""
        c = _CODES[np.frombuffer(text.encode("ascii"), "uint8")]
        mine = np.bincount(c, minlength=BREAK)[:, None]
        shared = np.minimum(self.letters[:, places], mine).sum(axis=0)
        lb = self.length[places]
        return _with_edits(score, np.maximum(np.maximum(lb, len(text)) - shared, self.fewest[places]), len(text), lb)

    def bounds(self, key: str, loose: str, text: str, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of a query that names no ISBN lies between these; they differ where an edit distance decides."""
        na, la, nb, lb = len(grams), len(text), self.grams, self.length
        c = self.has[grams].sum(axis=0, dtype="uint8" if na < 256 else "uint16").astype("int64")
        spoken, overlap = _words(text), np.zeros(len(lb))
        for w, times in Counter(spoken).items():
            overlap[self.alike(w)] += times
        overlap /= max(1, len(spoken))
        least = np.maximum(overlap * 0.78, 2.0 * c / (na + nb) * 0.86)
        whole = np.flatnonzero(c >= na - 2) if key else np.empty(0, "int64")
        inside = [at for at in whole if key in self.keys[at]]
        if len(loose) >= 3:
            if loose == key:
                places = [np.array([at for at in inside if self.loose[at] == self.keys[at]], "int64"), *(p for _, p in self.odd.holding(loose))]
            else:
                self.all_loose = self.all_loose or _Texts(self.loose, np.arange(len(lb)))
                places = [p for _, p in self.all_loose.holding(loose)]
            for p in places:
                least[p] = np.maximum(least[p], 0.8)
        if key:
            apart = np.abs(lb - la)
            distance = np.where(apart > 8, 99, np.maximum((np.maximum(nb, na) - c + 1) // 2, apart))  # an edit changes two pairs at most
            self.fewest = distance
            most = _with_edits(least, distance, la, lb)
            least = np.where(apart > 8, most, least)
        else:
            most = least.copy()
        least[self.blank] = most[self.blank] = 0.0
        if loose:
            for blob, p in self.authors.holding(loose):
                least[p] = most[p] = np.maximum(AUTHOR_EXACT if blob == loose else AUTHOR_PART, np.where(self.blank[p], 0.0, overlap[p] * 0.7))
        for at in inside:
            k = self.keys[at]
            least[at] = most[at] = EXACT if k == key else PREFIX if k.startswith(key) else CONTAINS + min(0.07, la / len(k) * 0.07)
        return least, most


def _with_edits(score: np.ndarray, distance: np.ndarray, la: int, lb: np.ndarray) -> np.ndarray:
    """The score with what an edit distance adds to it."""
    near = 1 - distance / np.maximum(lb, la)
    score = np.maximum(score, np.where(near > 0.72, near * 0.9, 0.0))
    return np.where((distance <= 2) & (lb >= 5), np.maximum(score, 0.9), score) if la >= 5 else score


def edit_distances(text: str, keys: list[str]) -> np.ndarray:
    """Of a text to each key, row by row for all keys at once; running minima are taken by doubled steps."""
    lengths = np.array([len(k) for k in keys])
    most = int(lengths.max())
    kind = "int16" if len(text) + most < 32_000 else "int32"
    letters = np.frombuffer("".join(k.ljust(most) for k in keys).encode("ascii"), "uint8").reshape(len(keys), most).T.copy()
    row = np.zeros((most + 1, len(keys)), kind)  # distances less the column, so that insertions are a running minimum
    for i, c in enumerate(text.encode("ascii"), 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] - (letters == c), row[1:] + 1, out=new[1:], casting="unsafe")
        step = 1
        while step <= most:
            new[step:] = np.minimum(new[step:], new[:-step])
            step *= 2
        row = new
    return row[lengths, np.arange(len(keys))] + lengths


def _millionths(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e6 + 0.5).astype("int64")


def bounded(min_score: float, limit: int | None):
    """Of a block of queries (query_id, key, loose, text) and one of titles (id, title, key, loose, authors) the pairs whose score may reach min_score.

    With a limit pairs go that come after ``limit`` others of their query and block for certain, by score, title and id.
    Columns: query_id, id, title, least, most (millionths).
    """
    asks = int(np.ceil(min_score * 1e6 - 1e-6))

    def enough(least: np.ndarray, most: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of a query's pairs no ``limit`` others come before for certain; places tell ties apart."""
        fits = most >= asks
        sure = ((least << 32) - at)[least >= asks]
        if limit is not None and len(sure) >= limit:
            fits &= (most << 32) - at >= np.partition(sure, -limit)[-limit]
        return np.flatnonzero(fits)

    def settled(text: str, keys: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
        open_ = np.flatnonzero((least < most) & ((least < asks) | (limit is not None)))
        if len(open_):
            names = keys[at[open_]].tolist()
            score = _millionths(_with_edits(np.zeros(len(names)), edit_distances(text, names), len(text), np.array([len(k) for k in names])))
            least[open_] = most[open_] = np.maximum(least[open_], score)
        found = enough(least, most, at)
        return at[found], least[found], most[found]

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["title", "id"], ignore_index=True)  # of equal scores the first places come first
        texts, keys = asked["text"].to_list(), held["key"].to_numpy()
        place, gram = _grams(texts)
        grams = np.split(gram, np.searchsorted(place, np.arange(1, len(texts))))
        none = np.empty(0, "int64")
        kept = [(none, none, none)] * len(texts)
        for start in range(0, len(held) if texts else 0, STEP):
            titles = Titles(held.iloc[start : start + STEP])
            for i, (key, loose, text) in enumerate(zip(asked["key"], asked["loose"], texts)):
                least, most = titles.bounds(key, loose, text, grams[i])
                first = enough(lo := _millionths(least), hi := _millionths(most), np.arange(start, start + len(lo)))
                if len(first):
                    hi = hi[first]
                    open_ = np.flatnonzero(lo[first] < hi)
                    if len(open_):
                        hi[open_] = _millionths(titles.closer(text, first[open_], least[first[open_]]))
                    both = [np.concatenate(x) for x in zip(kept[i], (first + start, lo[first], hi))]
                    found = enough(both[1], both[2], both[0])
                    kept[i] = tuple(x[found] for x in both)
        kept = [settled(text, keys, *k) if len(k[0]) else k for text, k in zip(texts, kept)]
        at, least, most = map(np.concatenate, zip(*kept)) if kept else (none, none, none)
        return pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), [len(k[0]) for k in kept]), "id": held["id"].to_numpy()[at], "title": held["title"].to_numpy()[at], "least": least, "most": most})

    return compare
