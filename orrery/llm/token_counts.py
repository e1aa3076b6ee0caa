"""Operator 3: token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their lengths in tokens, of bounded size,
broadcast to all workers.  Tier two is a cache in each worker: a pre-token that is in neither is
encoded once by the library and kept.

The table comes from all documents: each task counts its words in a bounded table and sums it up in
one packed row of its most frequent pre-tokens.  No pre-token is shuffled; where there are more than
``FAN_IN`` tasks their rows, of bounded size, are merged by so many at a time before they reach the driver.

Defined results: a null text counts as empty (0 tokens); a null ``doc_id`` stays null; repeated rows
each get a result; an empty table gives an empty result; a special token's string inside a text is one
token, which is the library's default; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.arrow import slices
from orrery.llm.packing import pack_numbers, pack_strings, unpack_numbers, unpack_strings
from orrery.llm.vocab import resolve
from orrery.session import release, written

MODEL = "word_bpe_49k.json"
LIMIT = 2048
#: The table has so many entries of so many characters at most: a few MB, whatever the corpus.
TABLE_ENTRIES, ENTRY_CHARS = 65_536, 32
#: Words that a task keeps counting; rarer ones are forgotten now and then.  What is counted only decides which
#: tier answers, never the answer.
COUNTED_WORDS = 100_000
#: Pre-tokens that a task sums up its count in, and rows that are merged at a time.
SUMMARY_ENTRIES, FAN_IN = 16_384, 32
#: A worker's cache starts anew beyond so many entries; longer pre-tokens are not kept.
CACHE_ENTRIES, CACHED_CHARS = 400_000, 128

_SAFE = "".join(chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), 0x20AC) if c not in (0xAD, 0x130))
_kind = lambda k: "".join(re.escape(c) for c in _SAFE if unicodedata.category(c)[0] == k)
#: Characters for which lower case, composition and classes are the same in all Unicode versions.
UNSAFE = re.compile(f"[^{re.escape(_SAFE)} \t\n\r\x0b\x0c]")
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_kind('L')}]+|[{_kind('N')}]|[^ \t\n\r\x0b\x0c{_kind('L')}{_kind('N')}]+")


class Lengths(dict):
    """Pre-token -> number of tokens; what is missing is encoded and kept."""

    def __init__(self, model: str, table: dict[str, int] | None = None, most: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        super().__init__(table or {})
        self.tokenizer, self.table, self.most = Tokenizer.from_file(resolve(model)), table or {}, most
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = [s[:2] for s in special]

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) > CACHED_CHARS:
            return n
        if len(self) >= self.most:
            self.clear()
            self.update(self.table)
        self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens.

        White space always separates, so a word with characters outside the safe set is left whole for
        the library, which composes, lowers and splits it itself.
        """
        if not UNSAFE.search(text):
            return PRETOKEN.findall(text.lower())
        found: list[str] = []
        for word in re.split("[ \t\n\r\x0b\x0c]+", text):
            if UNSAFE.search(word):
                found.append(word)
            elif word:
                found += PRETOKEN.findall(word.lower())
        return found

    def count(self, text: str) -> int:
        if self.special and any(m in text for m in self.marks) and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts)
        return sum(map(self.__getitem__, self.pieces(text)))


_workers: dict[str, Lengths] = {}


def _lengths(model: str, table: dict[str, int]) -> Lengths:
    """This worker's cache, kept from task to task; a new table is added to what it has."""
    if model not in _workers:
        _workers[model] = Lengths(model, table)
    lengths = _workers[model]
    if lengths.table is not table:
        lengths.table = table
        lengths.update(table)
    return lengths


def _most_common(seen: Counter, entries: int) -> tuple[bytes, bytes]:
    """The most frequent keys and their counts, packed; ties by key, so that the choice does not depend on order."""
    top = sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))[:entries]
    return pack_strings([k for k, _ in top]), pack_numbers(np.array([min(v, 2**32 - 1) for _, v in top], np.int64))


def _sum(rows: list[dict]) -> Counter:
    seen: Counter = Counter()
    for r in rows:
        for k, v in zip(unpack_strings(r["pieces"]), unpack_numbers(r["seen"]).tolist(), strict=True):
            seen[k] += v
    return seen


def _frequent(words: pa.Table | None, parts: list[pa.Table]) -> pa.Table:
    """(w, n): the most frequent short words of all these counts; ties by word."""
    every = pa.concat_tables([*([] if words is None else [words]), *parts, pa.table({"w": pa.array([], pa.string()), "n": pa.array([], pa.int64())})])
    every = every.filter(pc.less_equal(pc.utf8_length(every["w"]), ENTRY_CHARS)).group_by("w").aggregate([("n", "sum")]).rename_columns(["w", "n"])
    return every.sort_by([("n", "descending"), ("w", "ascending")]).slice(0, COUNTED_WORDS)


def frequent_lengths(docs: DataFrame, model: str = MODEL, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """The table of tier one: pre-token -> number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, n = None, [], 0
        for batch in slices(batches, 2_000):
            # pre-tokens end at white space, so words are counted first
            found = pc.value_counts(pc.list_flatten(pc.ascii_split_whitespace(batch.column(0))))
            parts.append(pa.table({"w": found.field(0), "n": found.field(1)}))
            n += len(found)
            if n > 5 * COUNTED_WORDS:
                words, parts, n = _frequent(words, parts), [], 0
        lengths, seen = _lengths(model, {}), Counter()
        for w, k in zip(*(c.to_pylist() for c in _frequent(words, parts).columns), strict=True):
            for piece in lengths.pieces(w):
                seen[piece] += k
        context = TaskContext.get()
        row = (context.partitionId() if context else 0, *_most_common(seen, min(entries, SUMMARY_ENTRIES)))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["home", "pieces", "seen"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([v], t) for v, t in zip((table.column("home")[0].as_py(), *_most_common(_sum(table.to_pylist()), min(entries, SUMMARY_ENTRIES))), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["home", "pieces", "seen"])

    schema = "home long, pieces binary, seen binary"
    sums = written(docs.select("text").mapInArrow(count, schema), "frequent")
    while sums.count() > FAN_IN:
        fewer = written(sums.withColumn("home", F.floor(F.col("home") / FAN_IN)).groupBy("home").applyInArrow(merge, schema), "frequent")
        release(sums)
        sums = fewer
    seen = _sum([r.asDict() for r in sums.collect()])
    release(sums)
    lengths = Lengths(model)
    return {k: lengths[k] for k, _ in sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))[:entries]}


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, entries: int = TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text)."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model, entries))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(model, table.value)
        for batch in slices(batches):
            n = [lengths.count(text) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return slim.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
