"""Encoding by a public tokenizer, one distinct chunk of text at a time.

The tokenizer (lower case, white space dropped, words split by a pattern that never crosses white
space) gives a text the ids of its space-separated chunks in turn, so a chunk is encoded once and
its ids are kept. A chunk of plain letters, perhaps with punctuation behind it, has the ids of its
lower-case letters followed by those of the punctuation; new words of that kind are encoded together
in one call, by the same model without the normaliser and the pattern, which would leave such words
as they are. Everything else goes through the whole tokenizer chunk by chunk.

``runs`` does the same for many texts at once: Arrow cuts them, numbers their distinct chunks and
parts letters from punctuation, so that Python sees each distinct word of a run once.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept per Python worker before the store is emptied: bounds memory, changes no result.
MAX_KEPT = 1_000_000
MAX_KEPT_CHARS = 64
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that ``runs`` encodes at once (characters, of a longer text).
RUN_BYTES = 2 << 20
#: Letters below U+0130, then ASCII punctuation.
LETTERS_AND_MARK = r"^(?P<stem>[A-Za-zªµºÀ-ÖØ-öø-į]+)(?P<mark>[!-/:-@\[-`{-~]*)$"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; equal to encoding each text as a whole."""

    def __init__(self, path: str, max_kept: int = MAX_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytewise])
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.ends_word = np.zeros(max(vocabulary.values()) + 3, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.max_kept = max_kept
        self.kept: dict[str, bytes] = {"": b""}

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def _letters(chunk: str) -> bool:
        """Letters below U+0130: they keep their number when lowered and compose with nothing."""
        return chunk.isalpha() and max(chunk) < "İ"

    def _make_room(self, n: int) -> None:
        if len(self.kept) + n > self.max_kept:
            self.kept = {"": b""}

    def _add_others(self, chunks: list[str]) -> None:
        for chunk, found in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)):
            self.kept[chunk] = np.asarray(found.ids, dtype="<u4").tobytes()

    def _add_letters(self, order: list[str]) -> None:
        if not order:
            return
        found = self.letters.encode_batch_fast([" ".join(order)], add_special_tokens=False)[0]
        ids = np.asarray(found.ids, dtype="<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(order):
            raw, start = ids.tobytes(), 0
            for word, end in zip(order, (ends * 4).tolist()):
                self.kept[word] = raw[start:end]
                start = end
        else:
            for word in order:
                self.kept[word] = self._plain(word)

    def _add(self, chunks: set[str]) -> None:
        self._make_room(len(chunks))
        kept, letters, built, others = self.kept, set(), [], []
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha() and chunk.islower():
                letters.add(chunk)
                continue
            stem = chunk.rstrip(string.punctuation)
            if self._letters(stem):
                mark, stem = chunk[len(stem) :], stem.lower()
                built.append((chunk, stem, mark))
                if stem not in kept:
                    letters.add(stem)
            else:
                others.append(chunk)
        self._add_others(others)
        self._add_letters(list(letters))
        for chunk, stem, mark in built:
            if mark and mark not in kept:
                kept[mark] = self._plain(mark)
            kept[chunk] = kept[stem] + kept[mark] if mark else kept[stem]

    def pieces(self, text: str) -> list[bytes]:
        """The ids of each chunk of the text, in order."""
        chunks = text.replace("\n", " ").split(" ")
        found = list(map(self.kept.get, chunks))
        if None in found:
            places = [i for i, ids in enumerate(found) if ids is None]
            self._add({c for i in places if len(c := chunks[i]) <= MAX_KEPT_CHARS})
            get = self.kept.get
            for i in places:
                ids = get(chunks[i])
                found[i] = self._plain(chunks[i]) if ids is None else ids
        return found

    def ids(self, text: str | None) -> bytes:
        return b"".join(self.pieces(text)) if text else b""

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text))) // 4

    def _known(self, units: list[str]) -> list[bytes]:
        """The ids of lower-case words and of chunks of any other kind."""
        found = list(map(self.kept.get, units))
        places = [i for i, ids in enumerate(found) if ids is None]
        if places:
            new = [u for i in places if len(u := units[i]) <= MAX_KEPT_CHARS]
            self._make_room(len(new))
            letters = list(map(self._is_word, new))
            self._add_letters([u for u, word in zip(new, letters) if word])
            self._add_others([u for u, word in zip(new, letters) if not word])
            for i in places:
                ids = self.kept.get(units[i])
                found[i] = self._plain(units[i]) if ids is None else ids
        return found

    @classmethod
    def _is_word(cls, unit: str) -> bool:
        return cls._letters(unit) and unit == unit.lower()

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, LETTERS_AND_MARK)
        stems = pc.utf8_lower(pc.struct_field(parts, "stem"))
        heads = pc.if_else(parts.is_valid(), stems, coded.dictionary).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(parts, "mark"), "").dictionary_encode()
        units = self._known(heads.dictionary.to_pylist()) + self._known(marks.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(units), dtype="<u4")
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units)) // 4
        pairs = np.stack([heads.indices.to_numpy(), marks.indices.to_numpy() + len(heads.dictionary)], axis=1)
        ids, lengths = _gathered(ids, lengths, pairs.ravel())
        ids, lengths = _gathered(ids, lengths.reshape(-1, 2).sum(axis=1), coded.indices.to_numpy())
        before = np.concatenate([[0], np.cumsum(lengths)])
        borders = np.concatenate([[0], np.cumsum(chunks.value_lengths().to_numpy())])
        return ids, np.diff(before[borders])

    def runs(self, texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of the texts in order: their ids one behind the other, and how many each text has.

        A null text has none. A text of more than ``run_bytes`` is a run of its own, encoded in
        stretches that end at white space.
        """
        texts = pc.fill_null(texts, "")
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)])
        start = 0
        while start < len(texts):
            end = int(np.searchsorted(sizes, sizes[start] + run_bytes, side="right")) - 1
            if end > start:
                yield self._run(texts.slice(start, end - start))
            else:
                end = start + 1
                stretches = _stretches(texts[start].as_py(), run_bytes)
                ids = np.concatenate([self._run(pa.array([s], pa.string()))[0] for s in stretches])
                yield ids, np.array([len(ids)], dtype=np.int64)
            start = end


def _gathered(ids: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``ids`` of the given lengths, put one behind the other by ``order``."""
    starts, taken = (np.cumsum(lengths) - lengths)[order], lengths[order]
    at = np.repeat(starts - (np.cumsum(taken) - taken), taken)
    at += np.arange(len(at))
    return ids[at], taken


def _stretches(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters that end behind a blank or a line break."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            end = max(text.rfind(" ", start, end), text.rfind("\n", start, end)) + 1
            if end <= start:
                following = [i for c in " \n" if (i := text.find(c, start + size)) >= 0]
                end = min(following) + 1 if following else len(text)
        yield text[start:end]
        start = end


@cache
def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker."""
    return ChunkEncoder(path)
