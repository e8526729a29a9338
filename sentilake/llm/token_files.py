"""Token-id files: documents compressed one by one with a shared zstandard dictionary, an offset index beside them."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentilake.llm.byte_ranges import by_region, file_system, read_entries
from sentilake.llm.common import bounded_batches, scratch, stored

#: File format: magic, id width in bytes, SHA-256 of the dictionary; then one zstandard frame a document.
MAGIC = b"TOKZ0001"
HEAD = len(MAGIC) + 1 + 32
#: Bounds of the sample that the dictionary is trained on: documents, and bytes of text of each.
SAMPLE_DOCS = 2048
SAMPLE_BYTES = 1 << 16
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Words that a worker process keeps; later ones are encoded without being kept.
CACHE = 800_000
END_ID = 2
#: Letters and then ASCII punctuation; not the apostrophe, which begins pieces of its own.
_MARKED = re.compile(r"(\w+?)([!-&(-/:-@\[-`{-~]+)")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class Encoder:
    """Ids of whole texts by the tokenizers library, with a cache of the words between spaces.

    The byte-level pre-tokenizer begins a new piece at every space that is followed by a character other than
    white space, so what stands between two spaces is encoded on its own, once. Letters alone are one
    piece for the model, punctuation after them is another, a line break between them is one as well. Texts with
    other spaces, or a tokenizer of another kind, are encoded whole.
    """

    def __init__(self, path: str, end_id: int | None, width: int | None = None, definition: str | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path) if definition is None else Tokenizer.from_str(definition)
        most = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
        self.width = width or (2 if most < 1 << 16 else 4)
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.tail = b"" if end_id is None else self.packed([end_id])
        pre, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.split = (
            type(pre).__name__ == "ByteLevel"
            and pre.use_regex
            and not pre.add_prefix_space
            and type(model).__name__ == "BPE"
            and self.tokenizer.normalizer is None
            and not any(" " in t.content or t.content.isalpha() or t.lstrip or t.rstrip for t in special)
        )
        self.model = model
        self.letters = byte_letters()
        self.odd = re.compile(r" (?:\s|$)")
        self.cache: dict[str, bytes] = {}

    def packed(self, ids) -> bytes:
        return np.asarray(ids, self.kind).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 16):
            encoded = self.tokenizer.encode_batch_fast(texts[at : at + 16], add_special_tokens=False)
            out += [self.packed(e.ids) for e in encoded]
        return out

    def piece(self, text: str) -> bytes:
        """One piece of the pre-tokenizer, straight to the model."""
        if not text.isascii() or " " in text:
            text = "".join([self.letters[b] for b in text.encode()])
        return self.packed([t.id for t in self.model.tokenize(text)])

    def known(self, lead: str, word: str) -> bytes:
        """Ids of a word that follows a space (``lead`` is one) or a line break or a piece (``lead`` is empty)."""
        name = word if lead else "\n" + word
        found = self.cache.get(name)
        if found is None:
            found = self.ids(lead, word)
            if len(self.cache) < CACHE and "\n" not in word:
                self.cache[name] = found
        return found

    def ids(self, lead: str, word: str) -> bytes:
        if word.isalpha():
            return self.piece(lead + word)
        marked = _MARKED.fullmatch(word)
        if marked and marked[1].isalpha():
            return self.known(lead, marked[1]) + self.known("", marked[2])
        left, line, right = word.partition("\n")
        if line and left and right and not left[-1].isspace() and not right[0].isspace():
            return self.known(lead, left) + self.known("", "\n") + self.known("", right)
        return self.whole([lead + word])[0]

    def encode(self, text: str) -> bytes:
        if not self.split or self.odd.search(text):
            return self.whole([text])[0] + self.tail
        head, *rest = text.split(" ")
        first = self.ids("", head) if head else b""
        cache, new = self.cache, {}
        for word in set(rest).difference(cache):
            found = self.known(" ", word)
            if word not in cache:
                new[word] = found
        if new:
            return first + b"".join([new[w] if w in new else cache[w] for w in rest]) + self.tail
        return first + b"".join(map(cache.__getitem__, rest)) + self.tail


def encoder_of(digest: str, definition: str, end_id: int | None, width: int | None = None) -> Encoder:
    """One encoder for all tasks of a worker process, so that its cache stays warm."""
    held = vars(sys.modules.setdefault("_sentilake_worker", types.ModuleType("_sentilake_worker")))
    key = f"{digest}|{end_id}|{width}"
    if key not in held:
        held[key] = Encoder("", end_id, width, definition)
    return held[key]


def train_dictionary(docs: DataFrame, definition: str, end_id: int | None, id_column: str, text_column: str) -> bytes:
    """A dictionary trained on the id arrays of a bounded sample of documents in hash order, by one task.

    The cut of the sample is found on hashes alone, so no more texts than the sample's reach that task.
    """
    text, key = F.col(text_column), F.xxhash64(id_column, text_column)
    fit = docs.filter(F.octet_length(text).between(1, SAMPLE_BYTES))
    cut = fit.select(key.alias("k")).orderBy("k").limit(SAMPLE_DOCS).agg(F.max("k")).first()[0]
    if cut is None:
        return b""
    sample = fit.filter(key <= cut).select(key.alias("k"), text.alias("text")).orderBy("k", "text").limit(SAMPLE_DOCS).select("text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder("", end_id, None, definition)
        arrays = [encoder.encode(t) for b in batches for t in b.column("text").to_pylist()]
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, arrays, k=200, d=8).as_bytes()
        except zstandard.ZstdError:  # too little to train on: the sample itself serves as the dictionary
            made = b"".join(arrays)[:DICTIONARY_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["dictionary"])

    made = sample.coalesce(1).mapInArrow(train, "dictionary binary").collect()
    return bytes(made[0][0]) if made else b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode every whole text and write the ids in ascending order of the document id; the index.

    The text is sorted by id over the cluster once. A task writes one file under a name of its own and sends the file's index entries;
    the index is a Parquet table that Spark commits, so files of lost attempts are never named. Index: file, path, doc_id, offset, length,
    n_tokens, start (ids of all documents before it).

    Null texts are empty; null ids come first; rows of equal id are ordered by text. An empty table gives an empty
    index. Only id and text are read, whatever other columns there are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # The definition travels with the tasks: executors need not see the driver's files.
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    named = hashlib.sha256(definition.encode()).hexdigest()
    sent = spark.sparkContext.broadcast(definition)
    dictionary = train_dictionary(rows, definition, end_id, "doc_id", "text")
    digest = hashlib.sha256(dictionary).digest()
    system, inner = file_system(path)
    system.create_dir(inner + "/files", recursive=True)
    width = Encoder(tokenizer, end_id, None, definition).width
    spark.createDataFrame(
        [(digest.hex(), bytearray(dictionary), width)], "hash string, dictionary binary, width int"
    ).coalesce(1).write.parquet(f"{path}/dictionary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{path}/files/{part:07d}-{uuid.uuid4().hex}.tok"
        encoder, compressor, out, offset, total = None, None, None, 0, 0
        for batch in batches:
            if out is None:
                encoder = encoder_of(named, sent.value, end_id, width)
                compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
                system, inner = file_system(name)
                out = system.open_output_stream(inner, compression=None)
                offset = out.write(MAGIC + bytes([width]) + digest) or HEAD
            entries = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text)
                frame = compressor.compress(ids)
                out.write(frame)
                entries.append((doc_id, offset, len(frame), len(ids) // width, total))
                offset += len(frame)
                total += len(ids) // width
            if entries:
                ids, *numbers = zip(*entries, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array([name] * len(ids)), pa.array(ids, batch.column("doc_id").type)]
                    + [pa.array(x, pa.int64()) for x in numbers],
                    ["file", "path", "doc_id", "offset", "length", "n_tokens", "file_start"],
                )
        if out is not None:
            out.close()

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"file int, path string, doc_id {kind}, offset long, length long, n_tokens long, file_start long"
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    sorted_ = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    entries = stored(sorted_.mapInArrow(write, schema), "token-entries")
    # One row a file: the running sum over files is small.
    files = entries.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "token-bases")
    entries.join(bases, "file").select(
        "file", "path", "doc_id", "offset", "length", "n_tokens", (F.col("base") + F.col("file_start")).alias("start")
    ).write.parquet(f"{path}/index")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read_token_files(selected: DataFrame, path: str) -> DataFrame:
    """Ids of the documents that index entries name: (doc_id, start, ids), ids as little-endian unsigned 32-bit integers.

    Entries are dealt by file and region, and neighbouring frames are fetched in one read. The dictionary's hash
    must be the one in each file's header.
    """
    spark = selected.sparkSession
    kept = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, digest, width = bytes(kept["dictionary"]), bytes.fromhex(kept["hash"]), kept["width"]
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError("the stored dictionary differs from its hash")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "offset", "length", "doc_id", "start")
        entries = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in names], strict=True))
        tool = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        checked = None
        for group in read_entries(entries):
            if group[0][0][0] != checked:
                checked = group[0][0][0]
                system, inner = file_system(checked)
                with system.open_input_file(inner) as file:
                    if file.read(HEAD) != MAGIC + bytes([width]) + digest:
                        raise ValueError(f"{checked} was written with another dictionary")
            ids = [np.frombuffer(tool.decompress(data), "<u2" if width == 2 else "<u4").astype("<u4").tobytes() for _, data in group]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[3] for e, _ in group], kind), pa.array([e[4] for e, _ in group], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "start", "ids"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(selected.schema["doc_id"].dataType)
    dealt = by_region(selected, ["path", "offset", "length", "doc_id", "start"])
    return dealt.mapInArrow(read, f"doc_id {selected.schema['doc_id'].dataType.simpleString()}, start long, ids binary")


def n_ids(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4)


def new_files(spark: SparkSession) -> str:
    return scratch(spark, "tokens")
