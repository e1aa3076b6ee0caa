"""Operator 8: SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the vocabulary holds a white-space marker behind another character, nor a line feed, so a
segmentation never crosses those places.  Texts are cut there, each distinct chunk (a marked word) of the
corpus is segmented once, and its ids are joined back by position:

1. A task cuts its texts, a block of them at a time.  A block is one row: the list of its distinct
   chunks, frequent ones first, and for each text the places of its chunks in that list.
2. The lists are dealt to buckets by the chunks' hashes.  A bucket segments each of its distinct chunks
   once and answers every block that has it.  Only a block's distinct chunks travel, never occurrences.
3. Answers go to the block's place, which is a bucket of its table; the blocks themselves are not shuffled.
   Ids follow from the places.

A block takes ``BLOCK_CHARS`` characters, or one longer text; a bucket about ``BUCKET_CHUNKS`` chunks,
however large the corpus and its vocabulary are.  A vocabulary whose pieces do cross markers is
encoded text by text.

Defined results: a null text counts as empty (no ids, empty decoding); a null ``doc_id`` stays null;
repeated rows each get a result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.arrow import slices
from orrery.llm.packing import pack_numbers, pack_strings, unpack_numbers, unpack_strings
from orrery.llm.vocab import resolve
from orrery.session import written

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters of the texts that are cut together.
BLOCK_CHARS = 20_000_000
#: Chunks, of all blocks, that are answered together.
BUCKET_CHUNKS = 400_000
#: Texts of a batch of results.
ROWS_OUT = 1_000
#: A marked word, a line feed, or markers before one.
CHUNK = re.compile(" *[^ \n]+|\n| +")

KINDS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
SQL = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def cut(text: str) -> Iterable[str]:
    """Chunks of a text.  The library puts one marker before it; a marker in the text is as good as a space."""
    if not text:
        return ()
    marked = " " + text.replace(MARK, " ")
    return CHUNK.findall(marked) if len(text) < BLOCK_CHARS else (m.group() for m in CHUNK.finditer(marked))


class Segmenter:
    """The library, and whether chunks may be segmented on their own."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=resolve(model))
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        #: decoded text of each id, but for bytes and what is unknown
        self.plain = [None if self.sp.is_byte(i) or self.sp.is_unknown(i) or self.sp.is_control(i) else n.replace(MARK, " ") for i, n in enumerate(names)]
        self.whole = any(MARK in p.lstrip(MARK) or "\n" in p for p in names) or self.sp.encode("\n")[:-1] != self.sp.encode("\na")[:1]

    def chunks(self, chunks: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids and decoded text of each chunk as it stands inside a text."""
        # behind a line feed a chunk is segmented without the marker that the library puts before a text
        ids = [x[2:] for x in self.sp.encode(["\n" + c for c in chunks], num_threads=1)]
        feed = self.sp.encode("\n")[-1]
        return ids, [t[1:] for t in self.sp.decode([[feed, *x] for x in ids], num_threads=1)]


_workers: dict[str, Segmenter] = {}


def _segmenter(model: str) -> Segmenter:
    if model not in _workers:
        _workers[model] = Segmenter(model)
    return _workers[model]


def _results(doc_ids: list, found: Iterator[tuple[int, str, str]], outputs: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and ``outputs``; ``found``: number of ids, ids as text, decoded text."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    make = {
        "n_tokens": lambda x: x[0],
        "ids": lambda x: np.fromstring(x[1], np.int32, sep=","),
        "decoded": lambda x: x[2],
        "ids_sha256": lambda x: digest(x[1]),
        "decoded_sha256": lambda x: digest(x[2]),
    }
    ids, rows, size = [], [], 0
    for i, x in zip(doc_ids, found, strict=True):
        ids.append(i)
        rows.append([make[k](x) for k in outputs])
        size += len(x[2])
        if len(ids) >= ROWS_OUT or size >= BLOCK_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[k] for r in rows], KINDS[o]) for k, o in enumerate(outputs))], ["doc_id", *outputs])
            ids, rows, size = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[k] for r in rows], KINDS[o]) for k, o in enumerate(outputs))], ["doc_id", *outputs])


# ---------------------------------------------------------------- the three steps


def cut_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, doc_ids, sizes, places, chunks, n): a row for each block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        home = (context.partitionId() if context else 0) << 32

        def block(ids: list, sizes: list[int], places: array, at: dict[str, int]) -> pa.RecordBatch:
            seen = np.frombuffer(places, np.uint32)
            often = np.argsort(-np.bincount(seen, minlength=len(at)), kind="stable")
            rank = np.empty(len(at), np.uint32)
            rank[often] = np.arange(len(at), dtype=np.uint32)
            chunks = list(at)
            row = (home + number, ids, pack_numbers(np.array(sizes, np.int64)), pack_numbers(rank[seen]), pack_strings([chunks[k] for k in often.tolist()]), len(at))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["block", "doc_ids", "sizes", "places", "chunks", "n"])

        ids, sizes, places, at, chars = [], [], array("I"), {}, 0
        for batch in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = len(places)
                places.extend([at.setdefault(c, len(at)) for c in chunks] if isinstance(chunks := cut(text or ""), list) else (at.setdefault(c, len(at)) for c in chunks))
                ids.append(i)
                sizes.append(len(places) - before)
                chars += len(text or "")
                if chars >= block_chars:
                    yield block(ids, sizes, places, at)
                    number += 1
                    ids, sizes, places, at, chars = [], [], array("I"), {}, 0
        if ids:
            yield block(ids, sizes, places, at)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "block long, doc_ids array<long>, sizes binary, places binary, chunks binary, n long")


def answer_chunks(blocks: DataFrame, model: str, bucket_chunks: int = BUCKET_CHUNKS) -> DataFrame:
    """(block, places, sizes, ids, odd, decoded): ids of a block's chunks, a row for each bucket that it asked."""
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_chunks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunks = unpack_strings(data.as_buffer().to_pybytes())
                home = np.fromiter((zlib.crc32(c.encode()) % buckets for c in chunks), np.int64, len(chunks))
                order = np.argsort(home, kind="stable")
                edges = np.searchsorted(home[order], np.arange(buckets + 1)).tolist()
                rows = [(b, block, order[x:y]) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
                columns = ([r[0] for r in rows], [r[1] for r in rows], [pack_numbers(r[2]) for r in rows], [pack_strings([chunks[k] for k in r[2].tolist()]) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "places", "chunks"])

    def segment(table: pa.Table) -> pa.Table:
        asked = [unpack_strings(data) for data in table.column("chunks").to_pylist()]
        names = list(dict.fromkeys(c for chunks in asked for c in chunks))
        ids, decoded = _segmenter(model).chunks(names)
        plain = _segmenter(model).plain
        same = [None not in (own := [plain[i] for i in x]) and "".join(own) == t for x, t in zip(ids, decoded, strict=True)]
        at = {c: k for k, c in enumerate(names)}
        rows = []
        for chunks in asked:
            own = [at[c] for c in chunks]
            # most chunks are decoded to their pieces; what the others are decoded to is sent along
            odd = [k for k, x in enumerate(own) if not same[x]]
            rows.append((pack_numbers(np.array([len(ids[x]) for x in own], np.int64)), pack_numbers(np.array([i for x in own for i in ids[x]], np.int64)), pack_numbers(np.array(odd, np.int64)), pack_strings([decoded[own[k]] for k in odd])))
        answers = [pa.array([r[k] for r in rows], pa.binary()) for k in range(4)]
        return pa.table([table.column("block"), table.column("places"), *answers], names=["block", "places", "sizes", "ids", "odd", "decoded"])

    asked = blocks.select("block", "chunks").mapInArrow(deal, "bucket long, block long, places binary, chunks binary")
    return asked.groupBy("bucket").applyInArrow(segment, "block long, places binary, sizes binary, ids binary, odd binary, decoded binary")


def join_back(blocks: DataFrame, answers: DataFrame, outputs: tuple[str, ...], model: str = MODEL) -> DataFrame:
    def join(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        plain = _segmenter(model).plain
        names = list(map(str, range(len(plain))))
        for row in left.to_pylist():
            sizes, texts, decoded = [0] * row["n"], [""] * row["n"], [""] * row["n"]
            for a in right.to_pylist():
                places, n, ids = unpack_numbers(a["places"]).tolist(), unpack_numbers(a["sizes"]), unpack_numbers(a["ids"]).tolist()
                ends = np.cumsum(n).tolist()
                for place, k, begin, end in zip(places, n.tolist(), [0, *ends], ends, strict=False):
                    own = ids[begin:end]
                    sizes[place], texts[place], decoded[place] = k, ",".join([names[i] for i in own]), "".join([plain[i] or "" for i in own])
                for k, text in zip(unpack_numbers(a["odd"]).tolist(), unpack_strings(a["decoded"]), strict=True):
                    decoded[places[k]] = text
            places = unpack_numbers(row["places"]).tolist()

            def found(places: list[int] = places, sizes: list[int] = sizes, texts: list[str] = texts, decoded: list[str] = decoded, ends: list[int] = np.cumsum(unpack_numbers(row["sizes"])).tolist()) -> Iterator[tuple[int, str, str]]:
                for begin, end in zip([0, *ends], ends, strict=False):
                    own = places[begin:end]
                    yield sum([sizes[p] for p in own]), ",".join([texts[p] for p in own]), "".join([decoded[p] for p in own])[1:]

            yield from _results(row["doc_ids"], found(), outputs)

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(join(left, right)))

    schema = "doc_id long, " + ", ".join(f"{k} {SQL[k]}" for k in outputs)
    return blocks.drop("chunks").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(whole, schema)


def encode_texts(docs: DataFrame, model: str = MODEL, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the ``outputs`` asked for: n_tokens, ids (array), decoded, ids_sha256, decoded_sha256."""
    if Segmenter(model).whole:
        return _encode_whole(docs, model, outputs)
    blocks = written_blocks(docs)
    return join_back(blocks, answer_chunks(blocks, model), outputs, model)


def written_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The blocks as a table in buckets, about two for each block."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return written(cut_blocks(docs, block_chars), "blocks", "block", max(1, -(-2 * chars // block_chars)))


def _encode_whole(docs: DataFrame, model: str, outputs: tuple[str, ...]) -> DataFrame:
    """Text by text, for vocabularies whose pieces cross markers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _segmenter(model).sp

        def found(texts: list) -> Iterator[tuple[int, str, str]]:
            for t in texts:
                ids = sp.encode(t or "", num_threads=1)
                yield len(ids), ",".join(map(str, ids)), sp.decode(ids)

        for batch in slices(batches):
            yield from _results(batch.column(0).to_pylist(), found(batch.column(1).to_pylist()), outputs)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {SQL[k]}" for k in outputs))
