"""Token ids in Arrow stream files: fixed-size lists that are read without a copy.

Each document's ids and one end id follow each other in ascending id order; the
stream of ids is cut into sequences of equal length. A shard is one Arrow stream
file with the columns ``input_ids`` and ``attention_mask`` (fixed-size lists), in
batches of equally many sequences, so sequence ``i`` lies in a known batch at a
known offset and a memory map gives it without decoding. Only a shard's last
sequence is padded; its mask says where. A small index (Parquet) has the place of
every document.

Rows are dealt by ranges of (id, hash of the text), so repeated ids cannot crowd one
shard. A task writes its shard under a name of its own attempt and moves it to the
final name when it is complete: a lost executor leaves no half shard behind, and a
repeated task writes the same bytes again. What reaches the driver is one total per shard.

Files are opened through ``pyarrow.fs`` by URI, so the folder must be one that all
executors share and that pyarrow can reach.

Results for odd input: null and empty texts give the end id alone; null ids come
first; rows with the same id keep their place by text, and equal rows are alike. An
empty table gives no shards and no rows.
"""

from __future__ import annotations

import array
import functools
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.frames import block_count, complete_runs, pick, run_starts, stage, stage_path

#: Ids of a sequence, and sequences of a batch.
LENGTH, BATCH = 2048, 128
#: Entries of a task's memo of encoded words (about 200 bytes each); a full memo is emptied.
MEMO = 1_500_000


class Encoder:
    """Ids of whole texts by the tokenizers library, without special tokens added.

    For byte-level vocabularies, pieces always part at a single space between other
    characters, so the library encodes each such chunk once and texts are put together
    from the encoded chunks. New chunks are encoded many to a text, each after a space, and
    the ids parted where a token begins with one. Other vocabularies, texts with special strings and texts
    with other white space beside a space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.memo: dict[str, bytes | None] = {}
        # By id, whether the token begins with a space ("\u0120" in the file); a special string with a space could arise between chunks.
        vocab = spec["model"]["vocab"] if self.by_chunk else {}
        self.joins = bool(vocab) and not any(" " in s for s in self.special)
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True

    def _pack(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array(self.code, x.ids).tobytes() for x in found]

    def _pack_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk after a space."""
        if self.joins:
            found = self.tokenizer.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)
            ids = np.array(found[0].ids, self.dtype)
            starts = np.flatnonzero(self.opens[ids]) if len(ids) and ids.max() < len(self.opens) else ids[:0]
            if len(starts) == len(chunks) and starts[0] == 0:
                data, size = ids.tobytes(), self.dtype.itemsize
                cuts = [*(starts * size).tolist(), len(data)]
                return [data[a:b] for a, b in itertools.pairwise(cuts)]
        return self._pack([" " + c for c in chunks])

    def encode(self, texts: list[str]) -> list[bytes]:
        rows = [t.split(" ") if self.by_chunk and not any(s in t for s in self.special) else None for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = set(itertools.chain.from_iterable(r[1:] for r in rows if r)).difference(memo)
        memo.update(dict.fromkeys(new))
        plain = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        for at in range(0, len(plain), 1_000):
            part = plain[at:at + 1_000]
            memo.update(zip(part, self._pack_chunks(part), strict=True))
        out: list[bytes | None] = []
        for row in rows:
            packed = None
            if row and row[0] and not row[0][-1].isspace():
                try:
                    packed = b"".join(map(memo.__getitem__, row[1:]))
                except TypeError:
                    packed = None
            out.append(packed)
        first = [i for i, p in enumerate(out) if p is not None]
        for i, head in zip(first, self._pack([rows[i][0] for i in first]), strict=True):
            out[i] = head + out[i]
        whole = [i for i, p in enumerate(out) if p is None]
        for i, p in zip(whole, self._pack([texts[i] for i in whole]), strict=True):
            out[i] = p
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def schema(dtype: np.dtype, length: int) -> pa.Schema:
    ids = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([pa.field("input_ids", pa.list_(ids, length)), pa.field("attention_mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Packs a stream of ids into one Arrow stream file."""

    def __init__(self, uri: str, dtype: np.dtype, length: int = LENGTH, batch: int = BATCH):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.schema, self.dtype, self.length, self.batch = schema(dtype, length), dtype, length, batch
        self.temporary = f"{self.path}.{uuid_of_attempt()}"
        self.file = self.fs.open_output_stream(self.temporary)
        self.stream = pa.ipc.new_stream(self.file, self.schema)
        self.held: list[bytes] = []
        self.size = 0  # bytes held
        self.total = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids) // self.dtype.itemsize
        full = self.length * self.batch * self.dtype.itemsize
        if self.size >= full:
            data = b"".join(self.held)
            whole = len(data) // full * full
            for at in range(0, whole, full):
                self._write(np.frombuffer(data, self.dtype, full // self.dtype.itemsize, at), full // self.dtype.itemsize)
            self.held, self.size = [data[whole:]], len(data) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        if len(ids):
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            padded[:len(ids)] = ids
            self._write(padded, len(ids))
        self.stream.close()
        self.file.close()
        self.fs.move(self.temporary, self.path)


def uuid_of_attempt() -> str:
    context = TaskContext.get()
    return f"attempt-{context.taskAttemptId() if context else os.getpid()}"


class SequenceFile:
    """Random access to the sequences of one shard without a copy (a memory map where the file is local)."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        with pa.ipc.open_stream(source) as reader:
            self.batches = list(reader)
        self.per_batch = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch, at = self.batches[i // self.per_batch], i % self.per_batch
        ids, mask = batch.column(0), batch.column(1)
        length = ids.type.list_size
        return ids.values.slice((ids.offset + at) * length, length).to_numpy(), mask.values.slice((mask.offset + at) * length, length)


def id_chunks(uri: str) -> Iterator[np.ndarray]:
    """The ids of a shard in order, a batch at a time, without the padding."""
    fs, path = pafs.FileSystem.from_uri(uri)
    source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_stream(path)
    with pa.ipc.open_stream(source) as reader:
        for batch in reader:
            real = batch.column(1).flatten().true_count
            yield batch.column(0).flatten().to_numpy()[:real]


def shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.arrows"


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 0, length: int = LENGTH, batch: int = BATCH,
                 id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write the shards of ``docs`` under ``folder``; returns the index (id, shard, place, start, n_tokens).

    ``place`` numbers the documents of a shard, ``start`` counts the ids before the document in its shard.
    """
    narrow = pick(docs, id=id_col, text=text_col)
    narrow = narrow.select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = shards or block_count(narrow)
    dealt = (narrow.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "id", "h")
             .sortWithinPartitions("id", "h", "text").select("id", "text"))
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, place = TaskContext.get().partitionId(), None, 0
        coder = encoder(path)
        end = np.array([end_id], coder.dtype).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                packed = coder.encode(part.column(1).to_pylist())
                if writer is None:
                    writer = ShardWriter(shard_uri(folder, shard), coder.dtype, length, batch)
                start, count = [], []
                for ids in packed:
                    start.append(writer.total)
                    writer.add(ids + end)
                    count.append(writer.total - start[-1])
                n = len(packed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(n, shard, np.int64)), pa.array(np.arange(place, place + n)),
                                                  pa.array(start, pa.int64()), pa.array(count, pa.int64())], ["id", "shard", "place", "start", "n_tokens"])
                place += n
        if writer is not None:
            writer.close()

    kind = dict(narrow.dtypes)["id"]
    return stage(dealt.mapInArrow(write, f"id {kind}, shard long, place long, start long, n_tokens long"), "token-index")


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """Read the shards back: (id, start, n_tokens, ids_crc32), ``start`` counting the ids of all documents before."""
    totals = {r.shard: r.n for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # one number per shard
    before = dict(zip(sorted(totals), itertools.accumulate([0, *(totals[s] for s in sorted(totals))])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_runs(batches, "shard"):
            table = table.combine_chunks()
            shard = table.column("shard").to_numpy()
            cuts = [*run_starts(shard), len(shard)]
            for a, b in itertools.pairwise(cuts):
                part = table.slice(a, b - a)
                counts, crcs = part.column("n_tokens").to_numpy(), []
                chunks, held = id_chunks(shard_uri(folder, int(shard[a]))), np.zeros(0, "<u4")
                for n in counts:
                    crc = 0
                    while n > len(held):
                        crc = zlib.crc32(held.tobytes(), crc)
                        n -= len(held)
                        held = next(chunks).astype("<u4")
                    crcs.append(zlib.crc32(held[:n].tobytes(), crc))
                    held = held[n:]
                start = part.column("start").to_numpy() + before[int(shard[a])]
                yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks(), pa.array(start), pa.array(counts), pa.array(crcs, pa.int64())],
                                                 ["id", "start", "n_tokens", "ids_crc32"])

    kind = dict(index.dtypes)["id"]
    ordered = index.repartition(max(1, len(totals)), "shard").sortWithinPartitions("shard", "place")
    return ordered.mapInArrow(read, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def arrow_tokens(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", **options: int) -> DataFrame:
    """Write ``docs`` as token files and read them back: (id_col, start, n_tokens, ids_crc32)."""
    folder = folder or stage_path(docs.sparkSession, "tokens")
    index = write_tokens(docs, path, folder, end_id, id_col=id_col, text_col=text_col, **options)
    return read_tokens(index, folder).withColumnRenamed("id", id_col)
