"""Token ids of whole texts inside Arrow tasks, by the tokenizers library."""

from __future__ import annotations

import gc
import os
from itertools import compress, islice
from operator import not_

import numpy as np
import public_tokenizers

#: Vocabulary used unless another file is named.
VOCABULARY = "byte_bpe_50k.json"
#: Pieces whose ids a worker remembers; longer pieces than PIECE are not remembered.
REMEMBERED, PIECE = 900_000, 16
#: Marks that end a piece after a letter and are then tokens of their own.
MARKS = ".,!?;:%&*#$|"
#: Pieces of one text that the library gets at a time.
JOINED = 500


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, for byte-level vocabularies that put a space before its word.

    Such a vocabulary never merges across the start of a space between two other characters, so the ids of a
    text are those of its pieces between spaces, each with its space. Pieces seen before are looked up. New
    ones go through the library joined to one text, whose ids are told apart by the bytes they stand for.
    Texts in which a space meets other white space, or an end, and those that hold the string of an added
    token (special ones too) go through the library whole; with a vocabulary that normalises, all do.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self.tokenizer.normalizer is None and all(t.content and not t.normalized and " " not in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self.known: dict[str | None, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str], others: set[str]) -> None:
        """Ids of each new piece (words of letters only, and others) with a space before it; marks behind its last letter are looked up apart."""
        known, tails, need = self.known, [], words
        for p in others:
            stem = p.rstrip(MARKS)
            if stem is not p and stem[-1:].isalpha():
                tails.append((p, stem))
                if stem not in known:
                    need.add(stem)
            else:
                need.add(p)
        need = list(need)
        parts = [need[i : i + JOINED] for i in range(0, len(need), JOINED)]
        texts = [" " + " ".join(p) for p in parts]
        for part, text, ids in zip(parts, texts, self._ids(texts)):
            sizes = map(len, part) if text.isascii() else (len(p.encode("utf-8", "surrogatepass")) for p in part)
            ends = np.cumsum(np.fromiter(sizes, dtype=np.int64, count=len(part)) + 1)
            stops = (4 * (np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1)).tolist()
            data = ids.tobytes()
            known.update(zip(part, map(data.__getitem__, map(slice, [0, *stops], stops))))
        for p, stem in tails:
            mark = p[len(stem) :]
            if mark not in self.marks:
                self.marks[mark] = self._ids([mark])[0].tobytes()
            known[p] = known[stem] + self.marks[mark]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Nothing here makes cycles, so the collector need not walk what is remembered."""
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            self.marks.clear()
        special = [n for n, t in enumerate(texts) if not self.plain or any(map(t.__contains__, self.added))]
        if special:
            out = [ids.tobytes() for ids in self._ids([texts[n] for n in special])]
            own = dict(zip(special, out))
            others = [t for n, t in enumerate(texts) if n not in own]
            rest = iter(self._encode(others) if others else ())
            return [own[n] if n in own else next(rest) for n in range(len(texts))]
        split = [t.split(" ") for t in texts]
        first = self._ids([s[0] for s in split])
        for s in split:
            s[0] = None
        known[None] = b""
        found = [list(map(known.get, s)) for s in split]
        gaps = [list(compress(range(1, len(f)), map(not_, islice(f, 1, None)))) for f in found]
        new = set().union(*(map(s.__getitem__, g) for s, g in zip(split, gaps)))
        words = set(filter(str.isalpha, new))
        others = new - words
        odd = {p for p in others if not p or p[0].isspace() or p[-1].isspace()}
        self._learn(words, others - odd)
        out, whole = [], []
        for n, (head, s, f, g) in enumerate(zip(first, split, found, gaps)):
            if odd and not odd.isdisjoint(s[i] for i in g) or len(s) > 1 and texts[n][: texts[n].index(" ")][-1:].isspace():
                whole.append(n)
                out.append(b"")
                continue
            for i in g:
                f[i] = known[s[i]]
            out.append(head.tobytes() + b"".join(f))
        for n, ids in zip(whole, self._ids([texts[n] for n in whole])):
            out[n] = ids.tobytes()
        for p in [p for p in new if len(p) > PIECE]:
            known.pop(p, None)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
