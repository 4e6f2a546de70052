"""Greedy word-piece counts by a linear longest-match automaton, without building the pieces.

After Song et al., "Fast WordPiece Tokenization" (2021). The trie of the vocabulary has a failure link
for each node and the number of pieces that following the link pops. A word is read once, character by
character; where no child fits, the link is followed and its count added.

Vocabulary: the pieces of a SentencePiece model. Those with a leading U+2581 begin a word, others
continue one, which is WordPiece's "##" the other way round. Words are runs outside ASCII white
space. A word that greedy matching cannot finish counts as one unknown token, as in WordPiece.

Scale: one pass, no shuffle; counts of words are kept in a bounded table. Defined results: null or
empty texts have 0 words and 0 tokens; null ids pass through; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.sentencepiece_bpe import SPACE, _fields, once, read_bytes
from pagelathe.runtime import ship_package

KEEP_WORDS = 300_000
KEEP_LENGTH = 64
ROWS = 256
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(source: str | bytes) -> list[str]:
    """The normal pieces of a SentencePiece model, by its path or bytes."""
    blob = read_bytes(source) if isinstance(source, str) else source
    pieces = [dict(_fields(v)) for k, v in _fields(blob) if k == 1]
    return [p[1].decode() for p in pieces if p.get(3, 1) == 1]


class Automaton:
    def __init__(self, pieces: list[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = self.child[node][c] = len(self.child)
                    self.child.append({})
                    final.append(False)
                node = nxt
            final[node] = bool(piece)
        n = len(self.child)
        #: Where to go on after popping, or -1 when the word is unknown; and how many pieces pop.
        self.link, self.pops = [-1] * n, [0] * n
        level = [0]
        while level:
            deeper = []
            for u in level:
                for c, v in self.child[u].items():
                    deeper.append(v)
                    if final[v]:
                        self.link[v], self.pops[v] = 0, 1
                        continue
                    z, pops = self.link[u], self.pops[u]
                    while z >= 0 and c not in self.child[z]:
                        pops += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.child[z][c], pops
            level = deeper
        self._known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of U+2581 + `word`; 1 if there is no greedy segmentation."""
        child, link, pops = self.child, self.link, self.pops
        node = total = 0
        for c in SPACE + word:
            nxt = child[node].get(c)
            while nxt is None:
                if link[node] < 0:
                    return 1
                total += pops[node]
                node = link[node]
                nxt = child[node].get(c)
            node = nxt
        while node:
            if link[node] < 0:
                return 1
            total += pops[node]
            node = link[node]
        return total

    def counts(self, text: str | None) -> tuple[int, int]:
        """(words, tokens) of a whole text."""
        words = _WORD.findall(text or "")
        known = self._known
        if len(known) > KEEP_WORDS:
            known.clear()
        long = {}
        for w in set(words).difference(known):
            (known if len(w) <= KEEP_LENGTH else long)[w] = self.count(w)
        total = sum(known[w] if w in known else long[w] for w in words) if long else sum(map(known.__getitem__, words))
        return len(words), total


def automaton(blob: bytes) -> Automaton:
    return Automaton(vocabulary(blob))


def machine(path: str) -> Automaton:
    return once(automaton, read_bytes(path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_tokens."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = once(automaton, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                done = [m.counts(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64())], ["id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
