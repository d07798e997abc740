"""Token counts by a linear longest-match automaton.

The vocabulary is a byte trie. Every node has a failure link to the node that stands for what is left after the
longest pieces on its path are popped, with the number of those pieces computed beforehand. One pass over a word's
bytes then gives the number of pieces that greedy longest match would cut, without cutting any.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import slices, small_batches
from plotline.llm.packing import _byte_of_char, default_tokenizer_path

_CACHE = 200_000  # words whose counts a Python worker remembers


def vocabulary(spec: bytes) -> list[bytes]:
    """Pieces of a byte-level tokenizer file as byte strings, special tokens left out."""
    tree = json.loads(spec)
    byte, special = _byte_of_char(), {t["content"] for t in tree.get("added_tokens", [])}
    return [bytes(byte[c] for c in t) for t in tree["model"]["vocab"] if t not in special]


class Automaton:
    """Nodes are numbers, 0 is the root; ``step[node << 8 | byte]`` is the child."""

    def __init__(self, pieces: Iterable[bytes]):
        self.step: dict[int, int] = {}
        is_piece = [False]
        for p in pieces:
            node = 0
            for c in p:
                child = self.step.get(node << 8 | c)
                if child is None:
                    child = len(is_piece)
                    self.step[node << 8 | c] = child
                    is_piece.append(False)
                node = child
            is_piece[node] = node > 0
        children: list[list[tuple[int, int]]] = [[] for _ in is_piece]
        for k, child in self.step.items():
            children[k >> 8].append((k & 255, child))
        self.link = [-1] * len(is_piece)  # -1: what is left cannot be matched
        self.popped = [0] * len(is_piece)
        todo = deque([0])
        while todo:
            node = todo.popleft()
            for c, child in children[node]:
                todo.append(child)
                if is_piece[child]:
                    self.link[child], self.popped[child] = 0, 1
                    continue
                at, count = self.link[node], self.popped[node]
                while at >= 0 and (at << 8 | c) not in self.step:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[child], self.popped[child] = self.step[at << 8 | c], count

    def count(self, word: bytes) -> int:
        """Pieces of one word; a word that pieces cannot cover is one unknown piece, an empty word none."""
        step, link, popped = self.step, self.link, self.popped
        node = count = 0
        for c in word:
            child = step.get(node << 8 | c)
            while child is None:
                count += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                child = step.get(node << 8 | c)
            node = child
        while node:
            count += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return count


_BUILT: dict[int, tuple[Automaton, dict[bytes, int]]] = {}


def _automaton(spec: bytes) -> tuple[Automaton, dict[bytes, int]]:
    """Built once per Python worker, with the counts of words already seen."""
    key = zlib.crc32(spec)
    if key not in _BUILT:
        _BUILT[key] = Automaton(vocabulary(spec)), {}
    return _BUILT[key]


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of ``docs``, over whole texts.

    Words are parted by ASCII white space; a word is matched with a space before it, as byte-level vocabularies
    mark word starts. Null and empty texts have no words and no tokens; repeated rows get equal results.
    """
    with open(tokenizer_path or default_tokenizer_path(), "rb") as f:
        spec = f.read()
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(spec)
        for batch in slices(batches):
            words, tokens = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                parts = (text or b"").split()
                total = 0
                for w in parts:
                    n = known.get(w)
                    if n is None:
                        n = automaton.count(b" " + w)
                        if len(known) >= _CACHE:
                            known.clear()
                        if len(w) <= 64:
                            known[w] = n
                    total += n
                words.append(len(parts))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))],
                                             names=["doc_id", "n_words", "n_tokens"])

    return (small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(scan, f"doc_id {id_type}, n_words long, n_tokens long"))
