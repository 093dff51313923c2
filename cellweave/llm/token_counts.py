"""Token counts of a sentencepiece BPE vocabulary without encoding most words.

If no piece holds a space mark after another character, no merge crosses the start of a run of space marks, so a
text's tokens are those of its parts that begin at such runs. Of these parts, the vocabulary strings that encode
alone as one token are proved once, on the driver before any text is read, by encoding every vocabulary string; a part found
among them counts one.
Only the other parts are merged, each distinct one once (a cache bounded in entries and their length).
"""

from __future__ import annotations

import functools
import re
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellweave.llm.byte_bpe import CACHE_ENTRIES, CACHE_LENGTH, _appended
from cellweave.llm.textblock import slices

_MARK = "▁"
_PARTS = re.compile(" +[^ ]*|[^ ]+")


class Counter:
    """Counts a text's tokens as ``SentencePieceProcessor.encode`` gives them."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        """whole: what another counter of this model has proved."""
        import sentencepiece

        self.pieces = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole, self.known = whole, {}
        if whole is not None:
            self.lone = {"": len(p.encode("a ")) - len(p.encode("a"))}
            return
        vocabulary = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        # The counter relies on these facts of the model; each is checked, not assumed.
        if any(_MARK in v.lstrip(_MARK) for v in vocabulary):
            raise ValueError("a piece holds a space mark inside: parts can't be counted alone")
        sample = ["a  b", "  a b ", "\t a\n b\r", " ", " x ﬁ"]
        lone = len(p.encode("a ")) - len(p.encode("a"))
        if any(len(p.encode(s)) != sum(len(p.encode(x[1:])) if x != " " else lone for x in _PARTS.findall(" " + s)) for s in sample):
            raise ValueError("the model's white space rules aren't those of a dummy prefix alone")
        self.whole = self.proved(vocabulary)
        self.lone = {"": lone}

    def proved(self, vocabulary: list[str]) -> frozenset[str]:
        """Texts of the strings ``mark + letters`` that encode to just themselves; the mark (the space before a part) is left out."""
        texts = [v[1:] for v in vocabulary if v.startswith(_MARK) and len(v) > 1 and v[1] != _MARK]
        return frozenset(t for t, got in zip(texts, self.pieces.encode(texts, num_threads=1)) if len(got) == 1)

    def count_all(self, texts: list[str]) -> list[int]:
        rows = [self._parts(x.replace(_MARK, " ")) if x else [] for x in texts]
        needed = set(chain.from_iterable(rows)) - self.whole
        if len(self.known) > CACHE_ENTRIES:
            self.known = {x: self.known[x] for x in needed if x in self.known}
        self.known |= self.lone
        new = list(needed.difference(self.known))
        self.known.update(zip(new, map(len, self.pieces.encode(new, num_threads=1))))
        # What isn't among the merged parts is a proved one.
        n, ones = self.known.get, repeat(1)
        found = [sum(map(n, row, ones)) for row in rows]
        for x in new:
            if len(x) > CACHE_LENGTH:
                del self.known[x]
        return found

    @staticmethod
    def _parts(text: str) -> list[str]:
        """A text's parts, each without the space that it begins with (the dummy prefix gives the first one's)."""
        if text[0] == " " or text[-1] == " " or "  " in text:
            return [x[1:] for x in _PARTS.findall(" " + text)]
        return text.split(" ")

    def count(self, text: str) -> int:
        return self.count_all([text])[0]


@functools.lru_cache(maxsize=2)
def counter(path: str, whole: frozenset[str] | None = None) -> Counter:
    return Counter(path, whole)


def count_tokens(df: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """All columns, with the number of tokens of each whole text (null or empty: 0).

    The model's path must be readable on every node; a column name that exists already raises ValueError, a model
    whose merges cross spaces too.
    """
    schema = _appended(df, T.StructField(n_tokens, T.LongType()))
    whole = counter(path).whole

    def run(batches):
        tool = counter(path, whole)
        for batch in slices(batches, text):
            found = tool.count_all([x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)
