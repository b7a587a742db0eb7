"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

Each input task cuts its texts into pre-tokens once. It numbers the distinct words of a run of documents (a span: at most
``span_words`` words or ``span_chars`` characters, always whole documents) and keeps, for each position of each document, the
number of its word. A span asks for each of its distinct words once. The asked words shuffle in buckets of their hash, salted by
groups of input tasks so that no word is one task's load; a task streams them in order and encodes each distinct word once. The ids go
back to the spans as packed arrays, where the documents are put together again by position, a block of positions at a
time, and decoding joins the token-byte table by id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch, lean, public_id, row_id, worker_cache

# Letters, numbers and white space below U+0100 by their Unicode categories.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: The pre-token pattern for texts below U+0100, in the faster standard engine.
_LATIN = f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

#: About the characters of a block of positions; a block's arrays are all that assembly holds beside a span's answers.
BLOCK = 1_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(path: str, pat: str):
    """A function from a pre-token to its ids; loaded once a Python worker from the installed vocabulary."""
    import tiktoken

    kept = worker_cache()
    if ("bpe", path, pat) not in kept:
        kept["bpe", path, pat] = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=read_ranks(path), special_tokens={})._encode_single_piece
    return kept["bpe", path, pat]


def _splitter(pat: str):
    """A function from a text to lists of its pre-tokens in order; a long text comes in several lists."""
    import public_tokenizers
    import regex

    general, latin, low = regex.compile(pat), re.compile(_LATIN), re.compile("[^\x00-\xff]").search

    def split(text: str) -> Iterator[list[str]]:
        cut = general if pat != public_tokenizers.PATTERN or low(text) else latin
        if len(text) <= BLOCK:
            yield cut.findall(text)
            return
        found = cut.finditer(text)
        while words := [m.group() for m in islice(found, BLOCK // 8)]:
            yield words

    return split


class _Slots(dict):
    """Numbers words in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _squeezed(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Integer arrays and bytes in little space: the bytes of equal weight stand together."""
    import zstandard

    parts = [np.array([len(a) for a in arrays], "<i4").tobytes()]
    parts += [((a >> s) & 255).astype(np.uint8).tobytes() for a in arrays for s in (0, 8, 16, 24)]
    return zstandard.ZstdCompressor(level=6).compress(b"".join((*parts, tail)))


def _restored(blob: bytes, n: int) -> list:
    """n arrays, and the bytes after them."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, "<i4", n), 4 * n, []
    for size in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).astype(np.int32)
        out.append(planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24)
        at += 4 * size
    return [*out, raw[at:]]


#: Rows of a span. seq -1: its words of one bucket, their sizes and numbers. Others: a block of positions: ids of documents, positions
#: of each, and the word numbers, a word's first position as 0. home is the span of a block; of words it is below 0, for their bucket.
_SPANS = "home long, span long, seq int, dids array<long>, blob binary"
#: Input tasks whose words of a bucket may come to one task.
_TOGETHER = 64


def _pack(pat: str, span_words: int, span_chars: int, buckets: int):
    out = pa.schema([("home", pa.int64()), ("span", pa.int64()), ("seq", pa.int32()), ("dids", pa.list_(pa.int64())), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, task = _splitter(pat), TaskContext.get().partitionId()
        serial = seq = chars = size = known = 0
        slots, ids, counts, parts = _Slots(), [], [], []

        def block() -> pa.RecordBatch:
            nonlocal seq, size, known, ids, counts, parts
            own = np.concatenate(parts)
            # Words are numbered as they come: a new one is greater than all before it.
            new = own > np.maximum.accumulate(np.concatenate(([known - 1], own[:-1])))
            span = (task << 32) + serial
            blob = _squeezed(np.array(counts, np.int32), np.where(new, 0, own + 1), np.array([known], np.int32))
            done = batch(out, home=[span], span=[span], seq=[seq], dids=[ids], blob=[blob])
            seq, size, known, ids, counts, parts = seq + 1, 0, len(slots), [], [], []
            return done

        def words() -> pa.RecordBatch:
            nonlocal serial, seq, chars, known, slots
            coded = [w.encode() for w in slots]
            sizes = np.fromiter(map(len, coded), np.int32, len(coded))
            bucket = np.fromiter(map(zlib.crc32, coded), np.int64, len(coded)) % buckets
            order = np.argsort(bucket, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
            blobs = [_squeezed(np.diff(g, prepend=0), sizes[g], tail=b"".join([coded[i] for i in g.tolist()])) for g in groups]
            homes = [-1 - (int(bucket[g[0]]) << 32) - task // _TOGETHER for g in groups]
            done = batch(out, home=homes, span=[(task << 32) + serial] * len(groups), seq=[-1] * len(groups), dids=[[]] * len(groups), blob=blobs)
            serial, seq, chars, known, slots = serial + 1, 0, 0, 0, _Slots()
            return done

        for b in batches:
            for did, text in zip(b["did"].to_pylist(), b["text"], strict=True):
                text = text.as_py() or ""
                chars += len(text)
                for some in split(text):
                    if size + len(some) > BLOCK // 8 and parts:
                        yield block()
                    ids.append(did)
                    counts.append(len(some))
                    parts.append(np.fromiter(map(slots.__getitem__, some), np.int32, len(some)))
                    size += len(some) + 16
                # A count below 0 ends a document.
                counts[-1] = ~counts[-1]
                if len(slots) >= span_words or chars >= span_chars:
                    yield block()
                    yield words()
        if parts:
            yield block()
        if slots:
            yield words()

    return run, _SPANS


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of a span."""
    out = pa.schema([("word", pa.string()), ("span", pa.int64()), ("slot", pa.int32())])
    for b in batches:
        b = b.filter(pa.compute.less(b["seq"], 0))
        for span, blob in zip(b["span"].to_pylist(), b["blob"], strict=True):
            slot, sizes, data = _restored(blob.as_py(), 2)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            words = pa.StringArray.from_buffers(len(slot), pa.py_buffer(ends), pa.py_buffer(data))
            yield batch(out, word=words, span=np.full(len(slot), span), slot=np.cumsum(slot).astype(np.int32))


def _encode_words(path: str, pat: str, held: int = 100_000):
    """Streams words in order: each distinct word is encoded once. Some answers are held at a time, to go by span as packed arrays."""
    out = pa.schema([("home", pa.int64()), ("blob", pa.binary())])

    def packed(spans: list[np.ndarray], slots: list[np.ndarray], ids: list[list[int]]) -> pa.RecordBatch:
        span, slot = np.concatenate(spans), np.concatenate(slots)
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat, first = np.concatenate([np.array(x, np.int32) for x in ids]), np.cumsum(size) - size
        order = np.lexsort((slot, span))
        cuts = np.flatnonzero(np.diff(span[order])) + 1
        groups = np.split(order, cuts)
        return batch(out, home=span[[g[0] for g in groups]], blob=[_squeezed(np.diff(slot[g], prepend=0), size[g], flat[_ranges(first[g], size[g])]) for g in groups])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, own = encoder(path, pat), None, []
        spans, slots, ids = [], [], []
        for b in batches:
            spans.append(b["span"].to_numpy())
            slots.append(b["slot"].to_numpy())
            for word in b["word"].to_pylist():
                if word != last:
                    last, own = word, encode(word)
                ids.append(own)
            if len(ids) >= held:
                yield packed(spans, slots, ids)
                spans, slots, ids = [], [], []
        if ids:
            yield packed(spans, slots, ids)

    return run, "home long, blob binary"


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The integers of all ranges [first, first + size), end to end."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings as first positions, sizes and bytes laid end to end."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(strings), np.uint8)


def _token_table(path: str):
    """The token-byte table and the decimal names of the ids, both ordered by id."""
    kept = worker_cache()
    if ("tokens", path) not in kept:
        table = {rank: token for token, rank in read_ranks(path).items()}
        every = range(max(table) + 1)
        kept["tokens", path] = _joined([table.get(i, b"") for i in every]), _joined([b" %d" % i for i in every])
    return kept["tokens", path]


def _assemble(path: str, with_ids: bool):
    """A span and the ids of its words: the documents in one table, put together by position."""
    out = pa.schema([("did", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())])

    def look_up(table, keys: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Joins keys with a table: the ends of their strings, and the strings."""
        first, size, data = table
        sizes = size[keys]
        return np.concatenate(([0], np.cumsum(sizes))), data[_ranges(first[keys], sizes)].tobytes()

    def run(spans: pa.Table, answers: pa.Table) -> pa.Table:
        spans = spans.filter(pa.compute.greater_equal(spans["seq"], 0)).sort_by("seq")
        if not spans.num_rows:  # words have been answered
            return out.empty_table()
        tokens, names = _token_table(path)
        parts = [_restored(x.as_py(), 3)[:3] for x in answers["blob"]]
        slot = np.concatenate([np.cumsum(p[0]) for p in parts]) if parts else np.zeros(0, np.int64)
        sizes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
        flat = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int32)
        # Answers by slot: the first position of a word's ids, and their number.
        first, size = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        if len(np.unique(slot)) != len(slot) or (len(slot) and slot.max() >= len(slot)):
            raise RuntimeError("a word of the span has no answer or several")
        first[slot], size[slot] = np.cumsum(sizes) - sizes, sizes
        del parts
        rows: dict[str, list] = {f.name: [] for f in out}
        ids_hash, bytes_hash, n_tokens, packed = hashlib.sha256(), hashlib.sha256(), 0, []
        for dids, blob in zip(spans["dids"].to_pylist(), spans["blob"], strict=True):
            counts, own, (known,), _ = _restored(blob.as_py(), 3)
            own -= 1
            own[own < 0] = np.arange(known, known + np.count_nonzero(own < 0))
            last = counts < 0
            counts = np.where(last, ~counts, counts)
            ids = flat[_ranges(first[own], size[own])].astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(size[own])))[np.concatenate(([0], np.cumsum(counts)))]
            name_at, named = look_up(names, ids)
            byte_at, plain = look_up(tokens, ids)
            named, plain = memoryview(named), memoryview(plain)
            for did, a, b, ended in zip(dids, ends[:-1].tolist(), ends[1:].tolist(), last.tolist(), strict=True):
                skip = 1 if not n_tokens and b > a else 0
                ids_hash.update(named[int(name_at[a]) + skip : int(name_at[b])])
                bytes_hash.update(plain[int(byte_at[a]) : int(byte_at[b])])
                n_tokens += b - a
                if with_ids:
                    packed.append(ids[a:b].astype("<u4").tobytes())
                if ended:
                    for c, x in zip(rows, (did, n_tokens, ids_hash.hexdigest(), bytes_hash.hexdigest(), b"".join(packed) if with_ids else None), strict=True):
                        rows[c].append(x)
                    ids_hash, bytes_hash, n_tokens, packed = hashlib.sha256(), hashlib.sha256(), 0, []
        return pa.Table.from_batches([batch(out, **rows)])

    return run, "did long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pat: str | None = None,
    with_ids: bool = True, span_words: int = 1 << 18, span_chars: int = 32_000_000,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): one row for each row of docs, ids as packed 32-bit integers.

    A null text counts as empty and has no tokens; repeated rows and ids give a row each; other columns are not read. The
    ids are null if with_ids is false. path names the ranks file (installed on every executor), pat the pre-token pattern.
    """
    spark = docs.sparkSession
    path, pat = path or vocabulary_path(), pat or pattern()
    source = docs.select(row_id(id_col).alias("did"), F.col(text_col).cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pack, schema = _pack(pat, span_words, span_chars, 16 * n)
    # One exchange takes blocks to their span and words to their bucket.
    packed = source.mapInArrow(lean(pack), schema).repartition(n, "home")
    asked = packed.mapInArrow(lean(_ask), "word string, span long, slot int").sortWithinPartitions("word")
    fill, schema = _encode_words(path, pat)
    answers = asked.mapInArrow(lean(fill), schema)
    gather, schema = _assemble(path, with_ids)
    done = packed.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(gather, schema)
    return done.select(public_id("did").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256", "ids")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, decoded): the bytes of each row's packed ids, by a join with the token-byte table. Null ids give null."""
    kind, path = dict(encoded.dtypes)[id_col], path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size, data = _token_table(path)[0]
        for b in batches:
            rows = [None if x is None else np.frombuffer(x, "<u4") for x in b["ids"].to_pylist()]
            plain = [None if x is None else data[_ranges(first[x], size[x])].tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays([b[id_col], pa.array(plain, pa.binary())], [id_col, "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(lean(run), f"`{id_col}` {kind}, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")
