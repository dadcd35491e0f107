"""Training-order materialisation: a keyed permutation gives every sequence a slot; shards of fixed stride hold the slots.

All texts form one stream of token ids, each ended by the end id, cut into sequences of a fixed length. The ids are written
once to a table in the shared folder. Two passes over it: the first counts the ids of each partition (one number a partition
goes to the driver), the second knows from those where its ids stand in the stream and deals whole sequences out. A Feistel network with cycle-walking maps the sequence
numbers onto the slots; partitions that are ranges of slots write one shard file each, so slot ``k`` of the training order is
always found at ``k % shard * stride`` of file ``k // shard`` and a reader can start at any slot.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowtables.llm.stage import new_path, small_batches, stored
from flowtables.llm.tokens import encoder, read_spec

SEQUENCE = 2048
SHARD = 2048
END_ID = 49407  # of word_bpe_49k, the last id; ids are written in 16 bits
ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> np.ndarray:
    return _mix(np.arange(1, ROUNDS + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64))


def _network(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for key in keys:
        left, right = right, left ^ (_mix(right + key) & mask)
    return (left << bits) | right


def _inverse(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for key in keys[::-1]:
        left, right = right ^ (_mix(left + key) & mask), left
    return (left << bits) | right


def _walk(step, x, n: int, seed: int) -> np.ndarray:
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    keys, x = _keys(seed), np.asarray(x, "uint64")
    x = step(x, half, keys)
    while (out := x >= np.uint64(n)).any():  # at most four tries each on average
        x[out] = step(x[out], half, keys)
    return x.astype("int64")


def slots_of(sequences, n: int, seed: int) -> np.ndarray:
    """The slot of each sequence number under ``n``: a permutation of 0 to n - 1."""
    return _walk(_network, sequences, n, seed)


def sequences_of(slots, n: int, seed: int) -> np.ndarray:
    """The inverse of :func:`slots_of`."""
    return _walk(_inverse, slots, n, seed)


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids`` of each row: its ids and the end id as little-endian unsigned 16-bit integers.

    A tokenizer with larger ids than these hold is refused.
    """
    text = read_spec(tokenizer_path)
    last = max(Tokenizer.from_str(text).get_vocab(with_added_tokens=True).values(), default=0)
    if not 0 <= end_id < 1 << 16 or last >= 1 << 16:
        raise ValueError(f"ids do not fit 16 bits: the tokenizer's last id is {last}, the end id {end_id}")
    spec = docs.sparkSession.sparkContext.broadcast({"spec": text})
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        end = np.array([end_id], "<u2").tobytes()
        coder = encoder(spec.value)
        for batch in batches:
            ids = pa.array([x.astype("<u2").tobytes() + end for x in coder.encoded(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids binary")


def _token_counts(tokens: DataFrame) -> list[tuple[int, int]]:
    """Ids of each partition that has rows, end ids included: ``(partition, ids)``."""

    def count(batches):
        total = sum(pc.sum(pc.binary_length(batch.column(1))).as_py() or 0 for batch in batches) // 2
        if total:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [total]})

    return sorted((r["part"], r["n"]) for r in tokens.mapInArrow(count, "part long, n long").collect())


def _sequences(tokens: DataFrame, starts: dict[int, tuple[int, int]], length: int, n: int, seed: int, shard: int) -> DataFrame:
    """``shard, slot, sequence_id, at, ids, doc_ids``: the part of each sequence that a partition has, nearly always all; ids are packed
    small (zstd), as every one of them is shuffled."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def deal(batches):
        begin, expected = starts.value.get(TaskContext.get().partitionId(), (0, 0))
        place, buffer, filled, docs_in = begin, [], 0, []
        id_type, pack = None, zstandard.ZstdCompressor(level=3)

        def rows(found):
            sequence = np.array([f[0] for f in found], "int64")
            slot = slots_of(sequence, n, seed) if found else sequence
            return pa.RecordBatch.from_arrays([
                pa.array(slot // shard, pa.int64()), pa.array(slot, pa.int64()), pa.array(sequence, pa.int64()),
                pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary()),
                pa.array([f[3] for f in found], pa.list_(id_type))], ["shard", "slot", "sequence_id", "at", "ids", "doc_ids"])

        def flush():
            start = place - filled
            return start // length, start % length, pack.compress(b"".join(buffer)), list(dict.fromkeys(docs_in))

        for batch in batches:
            id_type, found = batch.column(0).type, []
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                used = 0
                while used < len(whole):
                    part = whole[used:used + 2 * (length - place % length)]
                    buffer.append(part)
                    docs_in.append(doc)
                    used, place, filled = used + len(part), place + len(part) // 2, filled + len(part) // 2
                    if place % length == 0:
                        found.append(flush())
                        buffer, filled, docs_in = [], 0, []
            if found:
                yield rows(found)
        if filled:
            yield rows([flush()])
        if place - begin != expected:
            raise RuntimeError("the table changed between the two passes")

    schema = f"shard long, slot long, sequence_id long, at int, ids binary, doc_ids array<{kind}>"
    return tokens.mapInArrow(deal, schema)


def materialise(docs: DataFrame, root: str, tokenizer_path: str, seed: int = 0, length: int = SEQUENCE, shard: int = SHARD,
                id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes shard files of 16-bit ids under ``root`` (shared) and returns what they hold, one row a sequence:
    ``slot, sequence_id, shard, offset`` (bytes in the file), ``n_tokens, ids_crc32, doc_ids``.

    Both passes read the table of ids in the same partitions, and the second one fails if it does not meet the first one's
    counts. The last sequence is filled up with end ids in the file; ``n_tokens`` leaves them out.
    A null or empty text is an end id alone; rows without an id or repeated take part; an empty table gives no sequence;
    other columns are not read, whatever their names.
    """
    spark = small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tokens = stored(token_table(texts, tokenizer_path, end_id), "tokens", "zstd")
    counts = _token_counts(tokens)
    begins = np.cumsum([0] + [n for _, n in counts])
    total = int(begins[-1])
    n = -(-total // length)
    starts = spark.sparkContext.broadcast({part: (int(b), m) for (part, m), b in zip(counts, begins, strict=False)})
    dealt = _sequences(tokens, starts, length, n, seed, shard)
    ordered = dealt.repartitionById(max(1, -(-n // shard)), F.col("shard").cast("int")).sortWithinPartitions("slot", "at")
    kind = texts.schema["doc_id"].dataType.simpleString()
    out = "slot long, sequence_id long, shard long, offset long, n_tokens long, ids_crc32 long, doc_ids array<" + kind + ">"
    return stored(ordered.mapInArrow(_writer(root, length, shard, end_id), out), "manifest")


def shard_name(k: int) -> str:
    return f"shard-{k:09d}.bin"


def _writer(root: str, length: int, shard: int, end_id: int):
    def write(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        file = name = None
        held: list = []  # parts of the sequence being gathered
        unpack = zstandard.ZstdDecompressor()

        def close():
            file.close()
            if store.get_file_info(f"{folder}/{name[0]}").type != fs.FileType.NotFound:
                store.delete_file(f"{folder}/{name[0]}")  # of an attempt that was lost: the same bytes
            store.move(f"{folder}/{name[1]}", f"{folder}/{name[0]}")

        def put(parts):
            nonlocal file, name
            slot, sequence = parts[0]["slot"], parts[0]["sequence_id"]
            target = shard_name(slot // shard)
            if name is None or name[0] != target:
                if file:
                    close()
                name = (target, f".{target}.{uuid.uuid4().hex}")
                file = store.open_output_stream(f"{folder}/{name[1]}")
            ids = b"".join(unpack.decompress(p["ids"]) for p in parts)
            file.write(ids + np.full(length - len(ids) // 2, end_id, "<u2").tobytes())
            docs = list(dict.fromkeys(d for p in parts for d in p["doc_ids"]))
            return (slot, sequence, slot // shard, slot % shard * length * 2, len(ids) // 2, zlib.crc32(ids), docs)

        names = ["slot", "sequence_id", "shard", "offset", "n_tokens", "ids_crc32"]

        def rows(found, kind):
            columns = [pa.array(c, pa.int64()) for c in zip(*[f[:6] for f in found], strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([f[6] for f in found], kind)], [*names, "doc_ids"])

        kind = None
        for batch in batches:
            found, kind = [], batch.column("doc_ids").type
            for row in batch.to_pylist():
                if held and held[0]["slot"] != row["slot"]:
                    found.append(put(held))
                    held = []
                held.append(row)
            if found:
                yield rows(found, kind)
        if held:
            last = put(held)
            close()
            yield rows([last], kind)

    return write


def read_slots(root: str, first: int, many: int, length: int = SEQUENCE, shard: int = SHARD):
    """Sequences (arrays of ids) of the training order from slot ``first`` on: one seek, then reading on, file by file."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(root)
    while many > 0:
        with store.open_input_file(f"{folder}/{shard_name(first // shard)}") as file:
            file.seek(first % shard * length * 2)
            for _ in range(min(many, shard - first % shard)):
                data = file.read(length * 2)
                if not data:
                    return
                yield np.frombuffer(data, "<u2")
                first, many = first + 1, many - 1


def new_root(spark: SparkSession) -> str:
    return new_path(spark, "shards")
