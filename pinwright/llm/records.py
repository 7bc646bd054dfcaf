"""Token ids as length-delimited binary records, with an index for shuffled reads.

One record: length (8 bytes), masked checksum of the length (4), payload, masked
checksum of the payload (4), all little-endian. The payload is a flag byte (1: the
document has no id; 2 or 4: bytes per token id), the document id (8 bytes) and the
token ids. The index beside each file has 16 bytes per record: where the record
begins in the file, and how many ids of the same file lie before it.

Every task attempt writes files of its own name and reports them; only what
finished tasks reported is in the manifest, so a lost executor leaves an orphan
file at most. The folder must be one that all machines share.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pinwright.llm.counts import RUN, cut_words
from pinwright.llm.frames import quoted, slices, texts
from pinwright.sources.shared import shared_folder, staged

#: Fixed value: the rotation and offset that mask a checksum of framed records.
MASK = 0xA282EAD8
NO_ID = 1


def masked(raw: bytes) -> int:
    crc = zlib.crc32(raw)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


class DamagedRecord(ValueError):
    """A length or payload does not have its checksum."""


def unframe(stream) -> bytes | None:
    """The next payload of a stream; None at its end."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
        raise DamagedRecord("length")
    body = stream.read(struct.unpack("<Q", head[:8])[0] + 4)
    if len(body) != struct.unpack("<Q", head[:8])[0] + 4 or masked(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise DamagedRecord("payload")
    return body[:-4]


class IdEncoder:
    """Ids by the tokenizers library, one stretch at a time, stretches kept in a memo of two generations.

    A slice holds a bounded number of stretches, and so does the memo: ``limit`` in each generation, or those of one slice.
    """

    def __init__(self, path: str, end_id: int, limit: int = 690_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokens = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokens.get_added_tokens_decoder().values())
        self.kind = np.dtype("<u2" if max(self.tokens.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.size = np.zeros(self.tokens.get_vocab_size(), np.int64)  # a character of an entry stands for one byte
        for entry, i in self.tokens.get_vocab().items():
            self.size[i] = len(entry)
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def raw(self, many: list[str]) -> list[bytes]:
        found = self.tokens.encode_batch_fast(many, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def raw_stretches(self, many: list[str]) -> list[bytes]:
        """As ``raw`` for stretches that ``cut_words`` gave.

        Where no white space meets white space, each one begins anew, so many are encoded as one text
        and its ids are told apart by their bytes.
        """
        made = []
        for at in range(0, len(many), 1024):
            some = many[at:at + 1024]
            joined = "".join(some)
            if RUN.search(joined):
                made += self.raw(some)
                continue
            ids = np.array(self.tokens.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
            ends = np.cumsum([0, *(len(s.encode()) for s in some)])
            cuts = (np.searchsorted(np.cumsum(self.size[ids]), ends, "right") * self.kind.itemsize).tolist()
            packed = ids.tobytes()
            made += [packed[a:b] for a, b in zip(cuts, cuts[1:])]
        return made

    def encode(self, whole: list[str]) -> list[bytes]:
        """The ids of each text with the end id, as packed bytes."""
        cuts = [cut_words(t, self.special) for t in whole]
        heads = self.raw([c[0] if c else t for t, c in zip(whole, cuts)])
        rests = [c[1:] if c else [] for c in cuts]
        known, older = self.known, self.older
        new = set(chain.from_iterable(rests)).difference(known)
        if len(known) + len(new) > self.limit:  # the memo becomes the older one, which words are taken back from
            self.older, self.known = older, known = known, {}
            new = set(chain.from_iterable(rests))
        known.update((w, older[w]) for w in new if w in older)
        lack = [w for w in new if w not in older]
        known.update(zip(lack, self.raw_stretches([w if w[:1] == "\n" else " " + w for w in lack])))
        return [b"".join((head, *map(known.__getitem__, rest), self.end)) for head, rest in zip(heads, rests)]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> IdEncoder:
    return IdEncoder(path, end_id)


MANIFEST = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2,
                  text: str = "text") -> DataFrame:
    """Write ``doc_id`` and the ids of each text to ``folder``; return the manifest.

    Shards hold ascending ranges of doc_id (null first), and so do the records in a
    shard; rows of one id follow each other, ordered by their text. Every row
    becomes a record, repeated rows too; a null or empty text has the end id only.
    Texts, not ids, are dealt out by range: they are encoded once, in the task
    that writes them.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    dealt = (docs.select("doc_id", F.col(quoted(text)).alias("_text"))
             .withColumn("_hash", F.xxhash64("_text"))
             .repartitionByRange(*order).sortWithinPartitions(*order, "_text"))
    schema = to_arrow_schema(MANIFEST)

    def run(batches):
        disk, base = pa.fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"{base}/shard-{shard:05d}-{uuid.uuid4().hex}"
        code = encoder(vocabulary, end_id)
        width, n_docs, n_ids, at = code.kind.itemsize, 0, 0, 0
        out = index = None
        for batch in batches:
            for part in slices(batch, 1):
                if out is None:
                    disk.create_dir(base, recursive=True)
                    out, index = disk.open_output_stream(name), disk.open_output_stream(name + ".idx")
                for key, ids in zip(part.column(0).to_pylist(), code.encode(texts(part.column(1)))):
                    record = frame(struct.pack("<Bq", width | (key is None) * NO_ID, key or 0) + ids)
                    index.write(struct.pack("<QQ", at, n_ids))
                    out.write(record)
                    at, n_docs, n_ids = at + len(record), n_docs + 1, n_ids + len(ids) // width
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip((shard, name, n_docs, n_ids), schema)], schema=schema)

    return staged(dealt.mapInArrow(run, MANIFEST), "record-manifest")


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flag, key = struct.unpack_from("<Bq", payload)
    return None if flag & NO_ID else key, np.frombuffer(payload, f"<u{flag & 6}", offset=9)


RECORD = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
          T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def read_records(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Read the files of a manifest back, each record checked against its checksums.

    ``start`` counts the ids of all records before it over all shards; ``ids_crc32``
    is the checksum of the ids as 32-bit numbers; ``ids`` comes if asked for.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = files.select("path", "base").repartition(parts, "path")
    schema = T.StructType(RECORD + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)
    arrow = to_arrow_schema(schema)

    def rows(disk, path: str, base: int):
        with disk.open_input_stream(path, buffer_size=1 << 20) as stream:
            while (payload := unframe(stream)) is not None:
                key, ids = unpack(payload)
                wide = ids.astype("<u4")
                yield (key, base, len(ids), zlib.crc32(wide.tobytes()), *([wide] * with_ids))
                base += len(ids)

    def run(batches):
        disk = pa.fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                for row in rows(disk, path, base):
                    held.append(row)
                    size += row[2]
                    if len(held) >= 4096 or size >= 1 << 20:
                        yield packed(held, arrow)
                        held, size = [], 0
                if held:
                    yield packed(held, arrow)

    return files.mapInArrow(run, schema)


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def read_shuffled(manifest: DataFrame, folder: str, seed: int) -> DataFrame:
    """All records in an order that depends on ``seed`` only, fetched by the index."""
    places = T.StructType([T.StructField("path", T.StringType()), T.StructField("at", T.LongType())])
    fields = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def listed(batches):
        disk = pa.fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with disk.open_input_stream(path + ".idx") as stream:
                    while raw := stream.read(16 << 12):
                        at = np.frombuffer(raw, "<u8").reshape(-1, 2)[:, 0].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at)],
                                                         schema=to_arrow_schema(places))

    def fetched(batches):
        disk = pa.fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            held, opened = [], {}
            for path, at in zip(*(c.to_pylist() for c in batch.columns)):
                if path not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[path] = disk.open_input_file(path)
                opened[path].seek(at)
                held.append(unpack(unframe(opened[path])))
                if len(held) >= 256:
                    yield packed(held, to_arrow_schema(fields))
                    held = []
            for stream in opened.values():
                stream.close()
            if held:
                yield packed(held, to_arrow_schema(fields))

    where = manifest.select("path").mapInArrow(listed, places)
    return where.sort(F.xxhash64(F.lit(seed), F.regexp_extract("path", r"(shard-\d+)-", 1), "at"),
                      "path", "at").mapInArrow(fetched, fields)


def op5_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "token-records")
    manifest = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                             public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_records(manifest, folder, with_ids=False)
