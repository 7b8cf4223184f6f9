"""Fast exact encoding with a tokenizers file: each distinct space-delimited piece is encoded once for each cache.

The two supported kinds of file never join text across white space before something else: byte-level BPE takes
one space into the next word, word BPE drops white space.  So a text is cut before each space or newline and
the pieces' ids are joined.  Texts with neighbouring or other white space are encoded whole.  New pieces are
encoded many at once: byte-level pieces show by their leading space, others get a mark between them.  Strings of
special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
CACHE = 1_000_000
JOIN = 256
MARK = "\x01"
#: What makes a text be encoded whole: neighbouring or outer white space, what we use between pieces, and
#: whatever else is called white space.
_WHOLE = "[ \\n]{2}|^[ \\n]|[ \\n]$|[\\x00\\x01\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Ids of many texts at once; the cache holds at most about ``CACHE`` pieces and doesn't change results."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.mark = self.tok.encode(f" {MARK}", add_special_tokens=False).ids
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.leads[i] = token[:1] in ("Ġ", "Ċ")  # how byte-level files write space and newline
        #: White space is dropped and case doesn't matter: such pieces need one entry for all their forms.
        self.folds = len(self.mark) == 1 and "Lowercase" in str(self.tok.normalizer)
        self.number = _Numbers()
        self.flat, self.off, self.used = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keep what was used twice, at most half the cache, the most used first."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > CACHE // 2:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: CACHE // 2]])
        pieces, number = list(self.number), _Numbers()
        for n, k in enumerate(keep.tolist()):
            dict.__setitem__(number, pieces[k], n)
        size = self.off[keep + 1] - self.off[keep]
        end = np.cumsum(size)
        self.flat = self.flat[np.arange(int(size.sum())) + np.repeat(self.off[keep] - (end - size), size)]
        self.off, self.used, self.number = np.concatenate([[0], end]), self.used[keep] // 2, number

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``; all pieces begin with white space and hold no other."""
        flat, sizes = [], []
        byte_level = all(self.leads[self.mark[:1]])
        for i in range(0, len(pieces), JOIN):
            some = pieces[i : i + JOIN]
            ids = np.array(self.tok.encode("".join(some) if byte_level else f" {MARK}".join([*some, ""]), add_special_tokens=False).ids, np.uint32)
            if byte_level:
                at = np.flatnonzero(self.leads[ids])
                size = np.diff(np.append(at, len(ids)))
                right = len(at) == len(some) and (not len(at) or at[0] == 0)
            else:
                marked = ids == self.mark[-1]
                at = np.flatnonzero(marked)
                size = np.diff(np.concatenate([[-1], at])) - 1
                right, ids = len(at) == len(some) and len(self.mark) == 1, ids[~marked]
            if not right:
                ids, size = self._each(some)
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self) -> None:
        new = self.number.new
        if not new:
            return
        inner = np.fromiter((p[:1] in (" ", "\n") for p in new), bool, len(new))
        parts = []
        for group, encode in ((inner, self._together), (~inner, self._each)):
            if group.any():
                at = np.flatnonzero(group)
                parts.append((at, *encode([new[i] for i in at.tolist()])))
        size = np.zeros(len(new), np.int64)
        for at, _, s in parts:
            size[at] = s
        off = np.concatenate([[0], np.cumsum(size)])
        flat = np.empty(off[-1], np.uint32)
        for at, ids, s in parts:
            flat[np.arange(len(ids)) + np.repeat(off[at] - (np.cumsum(s) - s), s)] = ids
        self.flat = np.concatenate([self.flat, flat])
        self.off = np.concatenate([self.off, self.off[-1] + off[1:]])
        new.clear()

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end`` appended to each text's, and the offsets of the texts in them; null is empty."""
        if len(self.number) > CACHE:
            self._shrink()
        texts = pc.fill_null(texts, "")
        whole = np.flatnonzero(pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False))
        plain = np.ones(len(texts), bool)
        plain[whole] = False
        plain &= pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        cut = texts.filter(pa.array(plain))
        for space in (" ", "\n"):
            cut = pc.replace_substring(cut, space, f"\0{space}")
        lists = pc.split_pattern(cut, "\0")
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        # a block's distinct pieces, and which each is
        block = pc.list_flatten(lists).dictionary_encode()
        pieces = block.dictionary.to_pylist()
        if self.folds:  # beyond ASCII, case and normalisation may depend on each other
            pieces = [f" {p.strip().lower()}" if p.isascii() else p for p in pieces]
        known = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        inner = known[block.indices.to_numpy(zero_copy_only=False)] if len(block) else np.zeros(0, np.int64)
        used = np.bincount(inner, minlength=len(self.number))
        used[: len(self.used)] += self.used
        self.used = used
        # texts encoded whole and the end id are pieces for this call alone
        flat, first = [self.flat], len(self.number)
        sizes = [np.diff(self.off)]
        if len(whole):
            ids, n = self._each(texts.take(pa.array(whole)).to_pylist())
            flat.append(ids)
            sizes.append(n)
        flat, sizes = np.concatenate([*flat, np.array([end], np.uint32)]), np.concatenate([*sizes, [1]]).astype(np.int32)
        starts = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32)
        counts[whole] = 1
        last = np.cumsum(counts + 1) - 1
        code = np.empty(int(last[-1]) + 1 if len(last) else 0, np.int64)
        mine = np.ones(len(code), bool)
        mine[last] = False
        code[last] = len(sizes) - 1
        if len(whole):
            mine[last[whole] - 1] = False
            code[last[whole] - 1] = first + np.arange(len(whole))
        code[mine] = inner
        size = sizes[code]
        end_at = np.cumsum(size, dtype=np.int64)
        place = np.repeat(starts[code] - (end_at - size).astype(np.int32), size)
        place += np.arange(len(place), dtype=np.int32)
        return flat[place], np.concatenate([[0], end_at[last]])


def encoder(path: str) -> Encoder:
    if path not in C.held:
        C.held.clear()
        C.held[path] = Encoder(path)
    return C.held[path]


def forget() -> None:
    """Free the cache in a worker that goes on with other work."""
    C.held.clear()
    pa.default_memory_pool().release_unused()
