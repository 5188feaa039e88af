"""Token counts kept up under edits: a tree of pre-token runs per document, re-encoded where touched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalcube.llm.words import encoder

#: White space that the tokenizer drops and never joins with what follows.
BORDERS = " \n"
LEAF_CHARS = 512
COUNTS = "doc_id long, n_tokens long, edited_tokens long, edited_chars long, encoded_chars long, leaves int"


class CountTree:
    """Leaves are runs of pre-tokens that end with white space; inner nodes sum characters and tokens."""

    def __init__(self, text: str, count: Callable[[str], int], leaf_chars: int = LEAF_CHARS):
        self.count = count
        self.leaves = list(_runs(text, leaf_chars))
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars = np.zeros(2 * self.size, dtype=np.int64)
        self.tokens = np.zeros(2 * self.size, dtype=np.int64)
        n = len(self.leaves)
        self.chars[self.size : self.size + n] = [len(x) for x in self.leaves]
        self.tokens[self.size : self.size + n] = [count(x) for x in self.leaves]
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2
        self.encoded_chars = 0

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and the character's place in it."""
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= int(self.chars[node])
                node += 1
        return node - self.size, at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.size + leaf
        chars, tokens = len(text) - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, at: int, removed: int, added: str) -> None:
        """Replace ``removed`` characters from ``at`` on by ``added``; both are cut to the text.

        Encoded anew: the leaves touched, and those behind them until the last one ends with white
        space, as a pre-token may now reach over the border of a leaf.
        """
        total = int(self.chars[1])
        at = min(max(at, 0), total)
        removed = min(max(removed, 0), total - at)
        if not removed and not added:
            return
        first, start = self._find(at)
        last, end = self._find(at + removed)
        head, tail = self.leaves[first][:start], self.leaves[last][end:]
        text = head + added + tail
        stop = last + 1
        while stop < len(self.leaves) and text and text[-1] not in BORDERS:
            text += self.leaves[stop]
            stop += 1
        for leaf in range(first + 1, stop):
            self._set(leaf, "", 0)
        self._set(first, text, self.count(text))
        self.encoded_chars += len(text)


def _runs(text: str, leaf_chars: int) -> Iterator[str]:
    at = 0
    while at < len(text):
        near = [i for c in BORDERS if (i := text.find(c, at + leaf_chars - 1)) >= 0]
        end = min(near) + 1 if near else len(text)
        yield text[at:end]
        at = end
    if not text:
        yield ""


Edit = tuple[int, int, str]


def count_edited(
    docs: DataFrame, edits: Callable[[str], list[Edit]], path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokens of every whole text before and after its edits, without encoding the text again.

    ``edits`` gives the (position, characters removed, text added) of a text, applied in turn. Returns
    doc_id, n_tokens, edited_tokens, edited_chars, encoded_chars (characters encoded for the edits)
    and leaves. A null text counts as empty (no tokens); repeated rows are counted each; an empty
    table gives no rows; further columns are left aside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], [], []]
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py() or ""
                tree = CountTree(value, count)
                before = tree.total
                for edit in edits(value):
                    tree.edit(*edit)
                row = (doc, before, tree.total, int(tree.chars[1]), tree.encoded_chars, len(tree.leaves))
                for column, cell in zip(out, row):
                    column.append(cell)
            kinds = [pa.int64()] * 5 + [pa.int32()]
            names = [c.split()[0] for c in COUNTS.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, COUNTS)
