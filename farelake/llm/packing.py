"""Packing by concatenate and cut.

Pass 1 tokenises each document where it lies and writes its ids with its offset inside its task. The tasks'
token totals (one row a task) are summed to give every task its place in the corpus-wide stream, so pass 2 knows
each document's global offset without moving a document. The stream is cut into windows of ``length`` ids; a
document's pieces are the parts of it in each window. Boundary records (of the windows that reach over a task's edge)
are not built: ``sequences`` groups and shuffles every piece.

All windows are full but the last, so the padding of the whole corpus is less than one window.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; an empty table has
no sequences; order is that of the files. Special-token strings inside a text are ordinary text.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from farelake.llm.tables import stored

LENGTH = 1024
END_ID = 0
#: Pieces in an output batch, and where they carry their ids (at most 4 KiB each).
PIECES, PIECES_WITH_IDS = 20_000, 2_048
#: Beyond Latin letters with marks, general punctuation and plain line ends, texts go to the tokenizer itself.
_UNCOMMON = re.compile(r"[^\n\r\t\x20-\x7e\u00a1-\u024f\u2010-\u2027]")
#: Runs of spaces and line ends that go to the tokenizer, and the length from which texts are searched for them.
_LONG_GAP, _LONG_TEXT = re.compile(r"[ \n\r\t]{64}"), 20_000


def default_vocabulary() -> tuple[str, str]:
    """The tokenizer's file, and the file with the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of whole texts by the given vocabulary, as little-endian unsigned 16-bit bytes.

    Texts of common scripts are cut by the vocabulary's own pattern and merged by the same ranks, without the tokenizer's
    bookkeeping. Every other text goes to the tokenizer, which is loaded with the first of them; so does one with a long run
    of spaces or line ends, which the pattern's search cannot look back over.
    """

    def __init__(self, files: tuple[str, str]):
        import public_tokenizers
        import tiktoken

        self._file, self._whole = files[0], None
        with open(files[1], "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self._merge = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._file)
            self._whole.encode_special_tokens = True
            if self._whole.get_vocab_size() > 1 << 16:
                raise ValueError("ids must fit in 16 bits")
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        if _UNCOMMON.search(text) or len(text) >= _LONG_TEXT and _LONG_GAP.search(text):
            return self.whole(text)
        return np.array(array("H", self._merge(text)), "<u2").tobytes()


def tokens(docs: DataFrame, vocabulary: tuple[str, str], key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Pass 1: task, at (ids before this document in its task), the key, doc_tokens (with the end id) and ids."""
    cols = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = cols.schema["key"].dataType.simpleString()
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, encoder = TaskContext.get().partitionId(), 0, Encoder(vocabulary)
        for batch in batches:
            for a in range(0, len(batch), 512):  # small output batches bound memory
                part = batch.slice(a, 512)
                ids = [encoder(t.as_py() or "") + end for t in part.column(1)]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_pydict({"task": np.full(len(n), task, np.int32), "at": starts, "key": part.column(0), "doc_tokens": n, "ids": pa.array(ids, pa.binary())})

    return cols.mapInArrow(encode, f"task int, at long, key {key_type}, doc_tokens long, ids binary")


def placed(encoded: DataFrame) -> DataFrame:
    """``encoded`` (a stored pass 1) with ``begin``, each document's offset in the whole stream."""
    from pyspark.sql import Window

    totals = encoded.groupBy("task").agg(F.sum("doc_tokens").alias("n"))  # one row a task of pass 1
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("task", F.coalesce(before, F.lit(0)).alias("base"))
    return encoded.join(F.broadcast(bases), "task").select("key", (F.col("base") + F.col("at")).alias("begin"), "doc_tokens", "ids")


def pieces(docs: DataFrame, vocabulary: tuple[str, str], key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, start (ids of the document before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit numbers), doc_tokens, sequence_id, offset (in its sequence); with ``with_ids`` the ids too."""
    stream = placed(stored(tokens(docs, vocabulary, key, text, end_id), "tokens"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [T.StructField("_key", stream.schema["key"].dataType), *(T.StructField(n, T.LongType()) for n in names)]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, n = (batch.column(i).to_numpy() for i in (1, 2))
            first, last = begin // length, (begin + n - 1) // length
            count = last - first + 1
            for a, b in _spans(count, PIECES_WITH_IDS if with_ids else PIECES):
                row = np.repeat(np.arange(a, b), count[a:b])
                k = np.arange(len(row)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
                sequence = first[row] + k
                start = np.maximum(sequence * length - begin[row], 0)
                stop = np.minimum((sequence + 1) * length - begin[row], n[row])
                crc, kept, of, ids = [], [], -1, None
                for r, s, e in zip(row.tolist(), start.tolist(), stop.tolist()):
                    if r != of:
                        of, ids = r, np.frombuffer(batch.column(3)[r].as_buffer(), "<u2")
                    wide = ids[s:e].astype("<u4")
                    crc.append(zlib.crc32(wide.tobytes()))
                    if with_ids:
                        kept.append(wide.view(np.int32))
                out = {"_key": batch.column(0).take(pa.array(row)), "start": start, "length": stop - start, "ids_crc32": np.array(crc, np.int64), "doc_tokens": n[row], "sequence_id": sequence, "offset": begin[row] + start - sequence * length}
                if with_ids:
                    out["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return stream.mapInArrow(cut, T.StructType(fields)).withColumnRenamed("_key", key)


def _spans(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` pieces together."""
    total, a = np.cumsum(count), 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def sequences(cut: DataFrame, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """Whole sequences from pieces with ids: sequence_id, ids (padded to ``length`` unless their number is a
    power of two), n_ids. A sequence has at most ``length`` pieces, so its group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = cut.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(length) - n))
    return whole.select("sequence_id", F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(padded).alias("ids"), n.alias("n_ids"))
