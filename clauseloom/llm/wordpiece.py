"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's trie has a failure link and a count of popped tokens at each node: when the next
character has no edge, the tokens that greedy longest match would have taken are counted at once and
matching goes on from the link. So a word takes one pass over its characters and no piece is built.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch, lean, public_id, row_id, worker_cache

#: Words are runs of letters, digits and marks; any other visible character is a word of its own.
WORDS = re.compile(r"\w+|[^\w\s]")
#: Longer words are counted each time; the cache of a task does not hold them.
CACHED = 100


def vocabulary(path: str) -> tuple[set[str], set[str]]:
    """Pieces that begin a word and pieces that go on, from a ranks file in which a leading space marks a word's beginning."""
    import base64

    first, later = set(), set()
    with open(path, "rb") as f:
        for line in f:
            try:
                piece = base64.b64decode(line.split()[0]).decode()
            except UnicodeDecodeError:
                continue
            if len(piece) > 1 and piece[0] == " " and not piece[1:].isspace():
                first.add(piece[1:])
            elif piece and not piece.isspace() and " " not in piece:
                later.add(piece)
                if len(piece) == 1:
                    first.add(piece)
    return first, later


class Automaton:
    """Counts the pieces of greedy longest match; None for a word that cannot be cut."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # 0: where words begin, 1: where they go on
        final = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.edges[at]:
                        self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        final.append(False)
                    at = self.edges[at][c]
                final[at] = at > 1
        self.link: list[int] = [-1] * len(self.edges)
        self.pops: list[int] = [0] * len(self.edges)
        todo = deque((0, 1))
        while todo:
            u = todo.popleft()
            for c, v in self.edges[u].items():
                todo.append(v)
                if final[v]:
                    self.link[v], self.pops[v] = 1, 1
                    continue
                z, n = self.link[u], self.pops[u]
                while z >= 0 and c not in self.edges[z]:
                    n += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.edges[z][c], n

    def count(self, word: str) -> int | None:
        at = n = 0
        edges, link, pops = self.edges, self.link, self.pops
        for c in word:
            while c not in edges[at]:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return None
            at = edges[at][c]
        while at != 1:
            n += pops[at]
            at = link[at]
            if at < 0:
                return None
        return n


def _counts(path: str, cache_words: int):
    out = pa.schema([("did", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache()
        if ("automaton", path) not in kept:
            kept["automaton", path] = Automaton(*vocabulary(path))
        count = kept["automaton", path].count
        known: dict[str, int] = {}

        def tokens(word: str) -> int:
            """Unknown words count one token and 1 << 32 besides."""
            n = count(word)
            n = 1 + (1 << 32) if n is None else n
            if len(word) <= CACHED:
                if len(known) >= cache_words:
                    known.clear()
                known[word] = n
            return n

        for b in batches:
            words, total = [], []
            for text in b["text"]:
                found = WORDS.findall(text.as_py() or "")
                words.append(len(found))
                try:
                    total.append(sum(map(known.__getitem__, found)))
                except KeyError:
                    total.append(sum(known[w] if w in known else tokens(w) for w in found))
            yield batch(out, did=b["did"], n_words=words, n_tokens=[t & (1 << 32) - 1 for t in total], n_unknown=[t >> 32 for t in total])

    return run, "did long, n_words long, n_tokens long, n_unknown long"


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, cache_words: int = 300_000) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row of docs, in one pass without a shuffle.

    A word of any length is cut; one that cannot be is one unknown token. A null or
    empty text has none. Repeated rows give a row each; other columns are not read.
    """
    from .bpe import vocabulary_path

    run, schema = _counts(path or vocabulary_path(), cache_words)
    rows = docs.select(row_id(id_col).alias("did"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)
    return rows.withColumn("did", public_id("did")).withColumnRenamed("did", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
