"""Token ids of whole texts with the tokenizers library.

A vocabulary that never joins characters across white space and has no capital letters gives a text the ids of its runs
of other characters, one after another. Runs recur; each worker keeps the ids of the runs it has met in a bounded cache,
ASCII runs in lower case, and the library encodes only new ones. A run of letters with punctuation behind it is put
together from its two parts. Whether a vocabulary is of this kind is tried on a probe when it is loaded; with any other
one, and in what the tests compare with, `whole` encodes without any of this."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 500_000
TOGETHER = 6_000_000
#: Letters, then ASCII punctuation but no apostrophe, which may begin a suffix.
_ENDINGS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
_BYTE = np.arange(256, dtype=np.uint8)
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122)
_PUNCTUATION = (_BYTE > 32) & (_BYTE < 127) & ~_LETTER & ~((_BYTE >= 48) & (_BYTE <= 57)) & (_BYTE != 39)
_SOLID = (_BYTE != 32) & ((_BYTE < 9) | (_BYTE > 13))
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE | 32, _BYTE).astype(np.uint8)
_PROBE = "The QUICK brown foxes, jumped.  over 3.14 (lazy) dogs'\tdon't \u00c9t\u00e9\u00df STRASSE \u4f60\u597d \u0130x \n\n#$% e\u0301A_b-C word... \x1f\u00a0x"


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.ids: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.by_runs = True
        self.by_runs = self.encode([_PROBE])[0] == self.whole(_PROBE)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of new runs. Many are encoded at once; if each gives one word's end, the ends tell them apart."""
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.empty(0, int)
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                for w, a, b in zip(some, [0, *cuts[:-1]], cuts, strict=True):
                    self.ids[w] = ids[a:b].tobytes()
            else:
                for w in some:
                    self.ids[w] = self.whole(w)

    def _of(self, runs: list[str]) -> list[bytes]:
        """The ids of distinct runs."""
        if len(self.ids) > CACHE // 2:  # what isn't met again before the next time goes
            self.before, self.ids = self.ids, {}
        known, before = self.ids, self.before
        missing = [r for r in runs if r not in known]
        known.update({r: x for r in missing if (x := before.get(r)) is not None})
        missing = [r for r in missing if r not in known]
        split = {r: m.groups() for r in missing if not r.isascii() and (m := _ENDINGS.fullmatch(r)) and m[1].lower().isalpha()}
        new = {p for p in (*(r for r in missing if r not in split), *(p for m in split.values() for p in m)) if p not in known}
        plain = [w for w in new if w.isalpha()]
        self._learn(plain)
        for w in new.difference(plain):
            self.ids[w] = self.whole(w)
        for r, (letters, end) in split.items():
            known[r] = known[letters] + known[end]
        return [known[r] for r in runs]

    def _runs(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the runs of texts (bytes, and where each text begins, with the end of the last) begin and end, and
        their bytes, ASCII runs in lower case. ASCII letters with punctuation behind them are two runs."""
        solid = _SOLID[data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = at[(at > 0) & (at < len(data))]
        begins[inner] |= solid[inner]
        ends[inner - 1] |= solid[inner - 1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        count = lambda mask: (c := np.concatenate([[0], np.cumsum(mask, dtype=np.int32)]))[ends] - c[begins]
        high = data >= 128
        ascii_ = count(high) == 0 if high.any() else np.ones(len(begins), bool)
        letter, punctuation = _LETTER[data], _PUNCTUATION[data]
        drop = np.zeros(len(data), bool)
        drop[1:] = letter[:-1] & punctuation[1:]
        rise = np.zeros(len(data), bool)
        rise[1:] = punctuation[:-1] & letter[1:]
        rise[begins] = drop[begins] = False
        two = letter[begins] & (count(letter | punctuation) == ends - begins) & (count(drop) == 1) & (count(rise) == 0)
        drops = np.flatnonzero(drop)
        cuts = drops[np.searchsorted(drops, begins[two])]
        low = _LOWER[data]
        if not ascii_.all():  # runs with other letters stay as they are
            for a, b in zip(begins[~ascii_].tolist(), ends[~ascii_].tolist(), strict=True):
                low[a:b] = data[a:b]
        which = np.flatnonzero(two)
        return np.insert(begins, which + 1, cuts), np.insert(ends, which, cuts), low[solid]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) end to end, and where each text's begin, with the end of the last."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not self.by_runs:
            each = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(each), np.uint32), np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])]).astype(np.int64)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        begins, ends, chars = self._runs(data, at)
        places = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
        runs = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(chars)).dictionary_encode()
        each = pa.array(self._of(runs.dictionary.to_pylist()), pa.large_binary()).take(runs.indices)
        ends = np.frombuffer(each.buffers()[1], np.int64)[: len(each) + 1] // 4
        return np.frombuffer(each.buffers()[2] or b"", np.uint32)[: ends[-1]], ends[np.searchsorted(begins, at)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit values."""
        ids, at = self.column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """(index of the first, ids of each) for runs of texts of about TOGETHER bytes."""
        size = pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.cumsum(size) // TOGETHER
        for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(number)) + 1), len(size)], cuts[1:], strict=False):
            if a < b:
                ids, at = self.column(texts.slice(a, b - a))
                yield a, [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary; workers are reused from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
