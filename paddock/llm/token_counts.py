"""Token counts of documents: each distinct pre-token's pieces are counted once and joined to the documents' frequencies.

A pre-token here is a run of bytes without ASCII white space. The tokenizer drops white space and never joins pieces
across it, so a text has as many tokens as its runs have, and no ids are kept. Two shuffles do the join: words with
their posting lists meet by word, where a tokenizer counts each word once, and sums go back to the block of documents.
A frequent word's lists are dealt over several shares, so that no task holds all of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paddock.llm import pieces, postings, shared

BLOCK_BYTES = 6_000_000
#: Bytes of posting lists of a word that go to one share; a block's longer lists go to as many shares.
SHARE_BYTES = 64
#: Postings that a task sums before it sends them on.
SUM_POSTINGS = 200_000

_WORDS = pa.schema([("word", pa.binary()), ("share", pa.int32()), ("block", pa.int64()), ("postings", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])
_SUMS = pa.schema([("block", pa.int64()), ("sums", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])
_KINDS = "word binary, share int, block long, postings binary, ids binary, sizes binary"


class _Numbers(defaultdict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _same_tokens(word: bytes) -> bytes:
    """ASCII words count as their lower case, as the tokenizer lowers them; special strings only match as they are."""
    return word.lower() if word.isascii() and b"<|" not in word else word


def _word_rows(lower_case: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in postings.blocks(batches, BLOCK_BYTES):
            numbers = _Numbers()
            found = [np.fromiter(map(numbers.__getitem__, bytes(t).split()), np.int32) for t in texts]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            merged = _Numbers()
            to = np.array([merged[_same_tokens(w) if lower_case else w] for w in numbers], np.int32)
            words = to[np.concatenate(found)] if to.size else np.empty(0, np.int32)
            data, cuts, _ = postings.posting_lists(words, np.repeat(np.arange(len(found), dtype=np.int32), lengths), len(merged))
            share = block % (1 + np.diff(cuts) // SHARE_BYTES)
            n = len(merged)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*merged, b" %d" % block], pa.binary()),  # no word has a space: a row of the block itself
                    pa.array(np.append(share, 0), pa.int32()),
                    pa.array(np.full(n + 1, block), pa.int64()),
                    postings.binary(data, np.append(cuts, cuts[-1])),
                    pa.array([None] * n + [postings.pack_ids(ids)], pa.binary()),
                    pa.array([None] * n + [postings.pack_ids(list(map(len, texts)))], pa.binary()),
                ],
                schema=_WORDS,
            )
            del numbers, merged, found, words, data
            shared.release_memory()

    return task


class _Sums:
    """Sums of (block, document), sent on when many postings have come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, blocks: np.ndarray, column: pa.Array, tokens: np.ndarray) -> None:
        row, doc, counts = postings.read_postings(column)
        self.parts.append((blocks[row], doc, counts * tokens[row]))
        self.held += row.size

    def rows(self) -> pa.RecordBatch:
        block, doc, tokens = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.__init__()
        names, block = np.unique(block, return_inverse=True)
        width = int(doc.max(initial=0)) + 1
        pairs, at = np.unique(block * width + doc, return_inverse=True)
        sums = np.bincount(at, weights=tokens, minlength=pairs.size).astype(np.int64)
        block, doc = pairs // width, pairs % width
        first = np.concatenate(([True], block[1:] != block[:-1])) if block.size else np.empty(0, bool)
        step = np.where(first, doc, np.diff(doc, prepend=0))
        lengths = np.bincount(block, minlength=names.size)
        data, cuts = postings.pack(np.column_stack((step, sums)).ravel(), 2 * np.concatenate(([0], np.cumsum(lengths))))
        nothing = pa.nulls(names.size, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), postings.binary(data, cuts), nothing, nothing], schema=_SUMS)


def _piece_sums(tokenizer: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Tokenizer.from_file(tokenizer)
        sums = _Sums()
        last, tokens_of_last = None, 0
        for batch in batches:
            header = shared.numbers(batch.column("ids").is_valid())
            if header.any():
                own = batch.filter(pa.array(header))
                empty = pa.array([b""] * own.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("block"), empty, own.column("ids"), own.column("sizes")], schema=_SUMS)
                batch = batch.filter(pa.array(~header))
            words = batch.column("word").to_pylist()
            if not words:
                continue
            new = [w for w, before in zip(words, [last, *words], strict=False) if w != before]
            _, counts = pieces.word_ids(encoder, [w.decode("utf-8", "replace") for w in new])
            changed = np.array([w != before for w, before in zip(words, [last, *words], strict=False)])
            tokens = np.append(tokens_of_last, counts)[np.cumsum(changed)]
            last, tokens_of_last = words[-1], int(tokens[-1])
            sums.add(shared.numbers(batch.column("block")), batch.column("postings"), tokens)
            if sums.held >= SUM_POSTINGS:
                yield sums.rows()
        if sums.held:
            yield sums.rows()
        del encoder, sums
        shared.release_memory()

    return task


def _document_rows(limit: int):
    def finished(ids: pa.Array, sizes: pa.Array, parts: list[pa.Array]) -> pa.RecordBatch:
        tokens = np.zeros(len(ids), np.int64)
        for part in parts:
            _, doc, sums = postings.read_postings(part)
            np.add.at(tokens, doc, sums)
        return pa.RecordBatch.from_arrays(
            [ids, sizes, pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sizes, parts = None, None, None, []
        for batch in batches:
            blocks = batch.column("block").to_pylist()
            valid = shared.numbers(batch.column("ids").is_valid())
            for k, b in enumerate(blocks):
                if b != block and ids is not None:
                    yield finished(ids, sizes, parts)
                if b != block:
                    block, ids, sizes, parts = b, None, None, []
                if valid[k]:
                    ids, sizes = (postings.unpack_ids(batch.column(c)[k].as_py()) for c in ("ids", "sizes"))
                else:
                    parts.append(batch.column("sums").slice(k, 1))
        if ids is not None:
            yield finished(ids, sizes, parts)
        shared.release_memory()

    return task


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, lower_case: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of ``docs``; other columns aren't read.

    ``tokenizer``: a file of the tokenizers library, at the same place on all executors, of a kind that drops white
    space; ``lower_case`` says that it lowers ASCII letters. Tokens are counted as the library gives them without added
    special tokens. A null text is empty; null and repeated ids stay as they are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = postings.steady(rows)
    words = rows.mapInArrow(_word_rows(lower_case), _KINDS).repartition("word", "share").sortWithinPartitions("word")
    sums = words.mapInArrow(_piece_sums(tokenizer), "block long, sums binary, ids binary, sizes binary")
    sums = sums.repartition("block").sortWithinPartitions("block")
    return sums.mapInArrow(_document_rows(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
