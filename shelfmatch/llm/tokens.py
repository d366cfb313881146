"""Token ids of texts with a public tokenizer, in Arrow batches.

``Encoder`` gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` for the
word-level vocabularies (NFC, lower case, white space dropped).  Their pre-tokens never hold white
space and are encoded one by one, so the ids of a text are those of its white-space words in a row.
A batch's words are told apart by
64-bit hashes, and only those that a worker hasn't met are encoded.  Texts
that hold, in lower case, a character beyond Latin Extended-B, a separator that only Python splits at,
or the start of a special token go to the library whole; a test compares both ways over all characters.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from .hashing import prefix, ranges, words

#: In lower case: beyond Latin Extended-B, separators that only Python splits at, and special tokens.
_WHOLE = re.compile("[\x1c-\x1f\x85\u0250-\U0010ffff]|<\\|")
_ASCII = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Words kept by a worker; beyond that it starts anew.
MOST = 2_000_000
#: Bytes of text encoded at once.
CHUNK = 4 << 20
_loaded: dict = sys.modules.setdefault("_shelfmatch_token_cache", type(sys)("_shelfmatch_token_cache")).__dict__


def _pattern() -> re.Pattern:
    """The vocabulary's own pre-token pattern, with the letters and numbers of the Latin range spelt out; a line end stands alone."""
    kinds = {k: re.escape("".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == k)) for k in "LN"}
    return re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\\s{L}{N}]+|\n".format(**kinds))


class _Known:
    """Ids of the words met so far by their 64-bit hashes: two sorted tables, the smaller of which takes new words in."""

    def __init__(self, make) -> None:
        self.make, self.tables = make, []

    def of(self, keys: np.ndarray, word) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct hashes: where their ids begin, how many they are, and ids; word(i) are the words at some places."""
        start, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        some, base = [], 0
        for h, s, m, ids in self.tables:
            at = np.minimum(np.searchsorted(h, keys), len(h) - 1)
            hit = h[at] == keys
            start[hit], n[hit] = s[at[hit]] + base, m[at[hit]]
            some.append(ids)
            base += len(ids)
        missing = np.flatnonzero(n == 0)
        if len(missing):
            made = self.make(word(missing))
            m = np.array([len(x) for x in made], np.int64) // 2
            s, ids = np.cumsum(m) - m, np.frombuffer(b"".join(made), "<u2")
            start[missing], n[missing] = s + base, m
            some.append(ids)
            self._keep(keys[missing], s, m, ids)
        return start, n, np.concatenate(some)

    def _keep(self, h, s, m, ids) -> None:
        if len(self.tables) == 2 and len(self.tables[1][0]) + len(h) > MOST // 8:
            self._merge(0, *self.tables.pop())
        if len(self.tables) < 2:
            self.tables.append((h, s, m, ids))
        else:
            self._merge(1, h, s, m, ids)
        if len(self.tables[0][0]) > MOST:
            self.tables = []

    def _merge(self, i: int, h, s, m, ids) -> None:
        g, t, n, own = self.tables[i]
        both = np.concatenate([g, h])
        by = np.argsort(both, kind="stable")
        self.tables[i] = both[by], np.concatenate([t, s + len(own)])[by], np.concatenate([n, m])[by], np.concatenate([own, ids])


def _words(tokenizer) -> _Known:
    """Ids (uint16, little-endian as all hosts of Spark) of lower-case white-space words, from those of their pre-tokens."""
    pattern, model = _pattern(), tokenizer.model.tokenize
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    shown = {b: b if b in visible else next(spare) for b in range(256)}  # the byte-level alphabet

    def coded(part: str) -> bytes:
        if not (part.isascii() and part.isalnum()):
            part = part.encode().decode("latin-1").translate(shown)
        return array("H", [t.id for t in model(part)]).tobytes()

    def make(missing: list[str]) -> list[bytes]:
        parts = pattern.findall("\n".join(missing))
        known = {p: coded(p) for p in set(parts)}
        out, one = [], []
        for p in parts:
            if p == "\n":
                out.append(one[0] if len(one) == 1 else b"".join(one))
                one = []
            else:
                one.append(known[p])
        return [*out, b"".join(one)]

    return _Known(make)


class Encoder:
    def __init__(self, path: str) -> None:
        if path not in _loaded:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            if t.get_vocab_size() > 1 << 16:
                raise ValueError("ids need more than 16 bits")
            _loaded[path] = (t, _words(t))
        self.tokenizer, self.words = _loaded[path]

    def whole(self, text: str) -> bool:
        """Whether a text in lower case is left to the library."""
        return any(x in text for x in _ASCII) if text.isascii() else _WHOLE.search(text) is not None

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """uint16 ids of whole texts in a row, and where each begins (+ total); null: none."""
        low = [(t or "").lower() for t in texts]
        hard = [i for i, t in enumerate(low) if self.whole(t)]
        for i in hard:
            low[i] = ""
        size = np.zeros(len(low) + 1, np.int64)
        plain = [t.encode() if t.isascii() else t.replace("\xa0", " ").encode() for t in low]
        off = np.concatenate([[0], np.cumsum([len(t) for t in plain], dtype=np.int64)])
        buf = np.frombuffer(b"".join(plain), np.uint8)
        starts, ends, first = words(buf, off)
        if len(starts):
            keys, head, which = np.unique(ranges(prefix(buf), starts, ends), return_index=True, return_inverse=True)
            at, n, known = self.words.of(keys, lambda i: [buf[a:b].tobytes().decode() for a, b in zip(starts[head[i]].tolist(), ends[head[i]].tolist())])
            n, at = n[which], at[which]
            end = np.cumsum(n)
            ids = known[np.repeat(at - (end - n), n) + np.arange(end[-1])]
            size[:] = np.concatenate([[0], end])[first]
        else:
            ids = np.zeros(0, "<u2")
        if not hard:
            return ids, size
        parts = np.split(ids, size[1:-1])
        for i in hard:  # one by one: a text has no bound
            parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u2")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])

    def ids(self, text: str | None) -> bytes:
        """Little-endian uint16 ids of one whole text; null: none."""
        return self.encode([text])[0].tobytes()


def id_batches(path: str, batches, end: int):
    """For Arrow batches of (id, text): (Arrow ids of rows, uint16 ids in a row with the end ids, where each row's begin (+ total)), some whole rows at a time."""
    encoder = Encoder(path)
    for batch in batches:
        texts, i = batch.column(1), 0
        while i < len(texts):
            some, held = [], 0
            while i + len(some) < len(texts) and held < CHUNK:
                some.append(texts[i + len(some)].as_py())
                held += len(some[-1] or "")
            ids, cut = encoder.encode(some)
            out = np.insert(ids, cut[1:], end)
            yield batch.column(0).slice(i, len(some)), out, cut + np.arange(len(cut))
            i += len(some)


def default_path() -> str:
    """The vocabulary used by the registered queries; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc(ids: bytes) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())

