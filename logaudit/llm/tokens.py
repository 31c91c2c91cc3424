"""Token ids of whole texts, by a public tokenizer file.

A byte-level BPE tokenizer splits a text before it merges, and never within a run of white space followed by
other characters, save before that run. So a text is the sequence of its blank-led chunks, and each distinct
chunk is encoded once by the tokenizers library and then looked up. Texts whose white space could be read in
two ways go to the library whole.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a worker remembers, and how many it keeps when there are more or a task ends: those that
#: came first, which are the frequent ones.
CACHE_CHUNKS, KEPT_CHUNKS = 600_000, 100_000
#: Bytes of text that are split at a time.
SLICE_BYTES = 10_000_000

_W = r"[\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Three blanks in a row, two at the end, or the character that marks a text's first chunk here.
_UNSAFE = rf"{_W}{{2}}(?:{_W}|\z)|\x00"


def default_path() -> str:
    """The public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to ids; equal to the library's own result, special tokens included."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(Path(path).read_text(encoding="utf-8"))
        split = about.get("pre_tokenizer") or {}
        self.chunked = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not about.get("normalizer")
        )
        self.special = [x["content"] for x in about.get("added_tokens") or []]
        self.cache: dict[str, bytes] = {}
        if self.chunked:
            newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
            self.chunked, self.newline = len(newline) == 1, newline[0]
            self.marks: dict[str, bytes] = {}
            # Each byte has a printable character: its own, or one of those from 256 on, in order.
            own = [*range(33, 127), *range(161, 173), *range(174, 256)]
            others = [b for b in range(256) if b not in own]
            self.alphabet = {b: chr(256 + i) for i, b in enumerate(others)}
            self.blank = self.alphabet[32]

    def trim(self) -> None:
        """Forgets rare chunks: an idle worker holds little."""
        self.cache = dict(islice(self.cache.items(), KEPT_CHUNKS))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """By the library alone."""
        return [np.asarray(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices of the texts, in order: their ids end to end, and how many each text has. Null: none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield self._encode(texts.slice(a, b - a))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.chunked:
            return self._joined(self.whole(texts.to_pylist()))
        odd = pc.match_substring_regex(texts, _UNSAFE)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._by_chunks(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        for places, how in ((np.flatnonzero(~odd), self._split), (np.flatnonzero(odd), lambda x: self.whole(x.to_pylist()))):
            if len(places):
                for i, ids in zip(places.tolist(), how(texts.take(pa.array(places))), strict=True):
                    out[i] = ids
        return self._joined(out)

    @staticmethod
    def _joined(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([*found, np.empty(0, "<u4")]).astype("<u4"), np.array([len(x) for x in found], dtype=np.int64)

    def _split(self, texts: pa.Array) -> list[np.ndarray]:
        ids, counts = self._by_chunks(texts)
        return np.split(ids, np.cumsum(counts)[:-1])

    def _by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A chunk has its blank before it; one that starts with a newline or, as the first of its text, with
        a null character has none."""
        marked = pc.binary_join_element_wise(pa.scalar("\x00", pa.large_string()), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) > CACHE_CHUNKS:
            self.trim()
        found = list(map(self.cache.get, chunks))
        if None in found:
            self._learn([c for c, x in zip(chunks, found, strict=True) if x is None])
            found = list(map(self.cache.get, chunks))
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(lengths) - lengths
        which = coded.indices.to_numpy(zero_copy_only=False)
        each = lengths[which]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[which] - (ends - each), each) + np.arange(total)]
        at = np.concatenate(([0], ends))[lists.offsets.to_numpy(zero_copy_only=False)]
        return ids, np.diff(at)

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks. One that is letters behind its blank, or without one, is a piece that the tokenizer
        doesn't split, so its model alone takes it, in the byte alphabet. The marks behind letters are a piece
        of their own. All others go through the whole tokenizer."""
        cache, model, alphabet = self.cache, self.tokenizer.model, self.alphabet
        rest, tails = [], []
        for c in chunks:
            body = c[1:] if c[:1] in "\n\x00" and c else c
            letters = body.rstrip(_MARKS)
            tail, body = body[len(letters) :], letters
            if not body.isalpha():
                rest.append(c)
                continue
            head = c[: len(c) - len(tail)]
            if head not in cache:
                word = body if len(body) < len(head) else " " + body
                if not body.isascii():
                    word = word.encode().decode("latin-1").translate(alphabet)
                elif word[0] == " ":
                    word = self.blank + body
                ids = [x.id for x in model.tokenize(word)]
                if head[0] == "\n":
                    ids.insert(0, self.newline)
                cache[head] = array("I", ids).tobytes()
            if tail:
                tails.append((c, head, tail))
        new = sorted({tail for _, _, tail in tails}.difference(self.marks))
        self.marks.update(zip(new, (x.tobytes() for x in self.whole(new)) if new else (), strict=True))
        for c, head, tail in tails:
            cache[c] = cache[head] + self.marks[tail]
        if len(self.marks) > KEPT_CHUNKS:
            self.marks.clear()
        for c, ids in zip(rest, self.whole([self._text(c) for c in rest]) if rest else (), strict=True):
            cache[c] = ids.tobytes()

    @staticmethod
    def _text(chunk: str) -> str:
        return chunk[1:] if chunk[:1] == "\x00" else chunk if chunk[:1] == "\n" else " " + chunk


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
