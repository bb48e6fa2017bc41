"""Token ids in binary files, coded by a static range asymmetric numeral system.

One frequency table, counted over all documents, serves every file. A file holds the ids of
consecutive documents in blocks that can be decoded by themselves: a block's ids are dealt to
interleaved coder states, so that a step of the coder is one numpy operation over all of them. Each
block records its length, its states and checksums of its bytes and of its ids. The head has the
lengths of documents and the places of blocks, and a block has its coder states again every POINT
steps, so any stretch of ids is decoded from the nearest checkpoint, and blocks by any number of
readers. Files are rows of a Parquet table (so that any store Spark writes to will do):
(part, segment) orders them, the column ``file`` has the bytes described here.

    file  := b"GWRA" version:u1 table_bits:u1 pad:u2 table_crc:u4 n_docs:u4 n_blocks:u4 n_ids:u8
             doc_id:i8[n_docs] has_id:u1[n_docs] length:u4[n_docs] block_at:u8[n_blocks] block[n_blocks]
    block := n:u4 lanes:u4 n_words:u4 n_points:u4 bytes_crc:u4 ids_crc:u4
             used:u4[n_points] state:u8[n_points][lanes] word:u4[n_words]

all little-endian. block_at counts from the file's start; all blocks but the last have BLOCK ids.
Checkpoint k is the coder before step k x POINT, ``used`` the words that it has read until there.
bytes_crc covers everything after the block's head, ids_crc the ids as 32-bit integers.

Defined results: a null or empty text has only the end id; documents come in ascending doc_id order,
null ids first, and rows of one id in the order of their texts' hashes, which also deals out an id with
many rows; an empty table gives no file and an empty result. Only the named columns of the input are read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_prefix, discard, small_side, store, store_path

#: Ids in a block, ids from which a file is closed, most interleaved states, steps between checkpoints.
BLOCK, SEGMENT, LANES, POINT = 1 << 19, 1 << 20, 4096, 64
#: States stay below 2 ** 52, so that their division is exact in floating point, which numpy does faster.
_LOW, _MOST_BITS = np.uint64(1 << 20), 20
_HEAD, _BLOCK = struct.Struct("<4sBBHIIIQ"), struct.Struct("<IIIIII")
#: Runs of letters, digits or marks whose ids a worker keeps; bytes of text that are encoded at once.
CACHED, CHUNK = 600_000, 8 << 20

#: The settings, as the library writes them, of tokenizers that can be taken run by run.
_BY_RUNS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: Words that such a normalizer only lower-cases, the letters among them, and the runs it cuts them into.
_PLAIN, _LETTERS = "^[!-~À-ÖØ-öø-ÿ]*$", "^[a-zß-öø-ÿ]*$"
_RUN = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` one after another, and where each of them ends."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(total)
    return flat[at], ends


class TextEncoder:
    """A tokenizer over Arrow columns; each distinct run of characters goes through its model once.

    Where the tokenizer lower-cases, drops white space and cuts runs of letters, single digits and
    runs of marks (its own settings tell), the ids of a text are those of its words, and the ids of
    a word those of its runs. So texts are split and their words numbered by Arrow, distinct words
    are lower-cased and cut, and only runs that weren't met before go to the library's model. Words
    with other characters than ASCII's and Latin-1's letters go through the whole library, and with
    any other settings all texts do.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        settings = json.loads(self.tokenizer.to_str())
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.by_runs = (
            all(settings.get(k) == v for k, v in _BY_RUNS.items())
            and settings["model"]["type"] == "BPE"
            and not settings["model"].get("dropout")
            and not any(t.normalized or t.lstrip or t.rstrip or t.single_word or t.content.split() != [t.content] for t in added)
        )
        self.model = self.tokenizer.model
        self.added = "|".join(re.escape(t.content) for t in added)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 18, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.used = 0

    def _learn(self, keys: list[str], ids: list[list[int]]) -> None:
        first, count = len(self.place), self.used + sum(map(len, ids))
        while count > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(keys) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat[self.used : count] = np.fromiter(chain.from_iterable(ids), np.uint32, count - self.used)
        self.starts[first : first + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(keys)] = sizes
        self.used = count
        self.place.update(zip(keys, range(first, first + len(keys))))

    def _places(self, keys: list[str], ids_of: Callable[[list[str]], list[list[int]]]) -> np.ndarray:
        """Where the ids of distinct keys are kept; those not met before are tokenized."""
        at = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unseen = [keys[i] for i in missing.tolist()]
            at[missing] = np.arange(len(self.place), len(self.place) + len(unseen))
            self._learn(unseen, ids_of(unseen))
        return at

    def _runs(self, runs: list[str]) -> list[list[int]]:
        tokenize, mapped = self.model.tokenize, self.mapped
        collecting = gc.isenabled()
        gc.disable()  # no cycles here, but many small objects
        try:
            return [[t.id for t in tokenize(r if r.isascii() else r.translate(mapped))] for r in runs]
        finally:
            if collecting:
                gc.enable()

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: all of them, and where each word's begin and how many they are."""
        plain = pc.match_substring_regex(words, _PLAIN)
        if self.added:
            plain = pc.and_not(plain, pc.match_substring_regex(words, self.added))
        low = pc.utf8_lower(words.filter(plain))
        whole = pc.match_substring_regex(low, _LETTERS)
        cut = pc.replace_substring_regex(low.filter(pc.invert(whole)), _RUN, r"\0 ")
        parts = pc.ascii_split_whitespace(pc.replace_with_mask(low, pc.invert(whole), cut))
        runs = parts.flatten().dictionary_encode()
        at = self._places(runs.dictionary.to_pylist(), self._runs)[runs.indices.to_numpy()]
        ids, ends = _gather(self.flat, self.starts[at], self.sizes[at])
        stops = np.concatenate([[0], ends])[parts.offsets.to_numpy()]
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        starts[is_plain], sizes[is_plain] = stops[:-1], np.diff(stops)
        if not is_plain.all():
            rest = words.filter(pc.invert(plain)).to_pylist()
            # a run has no blank, so keys with one can't be taken for a run
            at = self._places([" " + w for w in rest], lambda keys: self._whole([k[1:] for k in keys]))
            starts[~is_plain], sizes[~is_plain] = len(ids) + self.starts[at], self.sizes[at]
            ids = np.concatenate([ids, self.flat[: self.used]])
        return ids, starts, sizes

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and how many each text has."""
        texts = pc.fill_null(texts, "")
        if not self.by_runs:
            found = self._whole(texts.to_pylist())
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids, ends = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), np.cumsum(counts)
            return np.insert(ids, ends, end_id).astype(np.uint32), counts + 1
        if len(self.place) > CACHED:
            self.clear()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        kept, starts, sizes = self._words(words.dictionary)
        at = words.indices.to_numpy()
        ids, ends = _gather(kept, starts[at], sizes[at])
        stops = np.concatenate([[0], ends])[split.offsets.to_numpy()[1:]]
        return np.insert(ids, stops, end_id).astype(np.uint32), np.diff(stops, prepend=0) + 1


def _chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Rows from-to that hold about ``most`` bytes; a longer text is one by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, stop
        first = stop


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


class Table:
    """Frequencies scaled to a power of two; every symbol counted has one at least."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.bits = int(freq.sum()).bit_length() - 1
        if int(freq.sum()) != 1 << self.bits or self.bits > _MOST_BITS:
            raise ValueError(f"frequencies must sum to a power of two, of 2 ** {_MOST_BITS} at most")
        self.start = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def of(cls, counts: np.ndarray) -> "Table":
        """From counts: shares rounded down but to one at least; the most frequent make up for it."""
        present = int((counts > 0).sum())
        bits = max(18, (2 * present).bit_length())
        total = int(counts.sum()) or 1
        freq = np.array([max(1, (int(c) << bits) // total) if c else 0 for c in counts], np.int64)
        if not present:
            freq[0] = 1
        missing = (1 << bits) - int(freq.sum())
        for k in np.argsort(-freq, kind="stable"):
            change = missing if missing > 0 else -min(-missing, int(freq[k]) // 2)
            freq[k] += change
            missing -= change
            if not missing:
                break
        return cls(freq)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    lanes = 1
    while lanes < LANES and lanes * 128 <= len(ids):
        lanes *= 2
    bits, up = np.uint64(table.bits), np.uint64(52 - table.bits)
    mask, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    state, words, points, done = np.full(lanes, _LOW), [], [], 0
    freqs, starts = table.freq[ids], table.start[ids]
    if len(ids) and not freqs.all():
        raise ValueError("an id that the table doesn't have")
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        f, s = freqs[at : at + lanes], starts[at : at + lanes]
        x = state[: len(f)]
        over = np.flatnonzero(x >= (f << up))
        if len(over):
            full = x[over]
            words.append((full & mask).astype("<u4"))
            done += len(over)
            x[over] = full >> half
        q = (x / f).astype(np.uint64)  # both are exact as floating point, and so is the whole part
        state[: len(f)] = (q << bits) + (x - q * f) + s
        if at and at // lanes % POINT == 0:
            points.append((done, state.copy()))
    points = [(done, state), *points[::-1]]
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    used = np.array([done - n for n, _ in points], "<u4")
    body = used.tobytes() + np.stack([x for _, x in points]).astype("<u8").tobytes() + stream.tobytes()
    return _BLOCK.pack(len(ids), lanes, len(stream), len(points), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode_block(data: memoryview, at: int, table: Table, first: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids first-stop of the block at a place of the file; all of them by default.

    Decoding starts at the checkpoint before ``first``; a block that is decoded whole is held
    against the checksum of its ids too.
    """
    n, lanes, n_words, n_points, bytes_crc, ids_crc = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    states, words = at + 4 * n_points, at + 4 * n_points + 8 * n_points * lanes
    if zlib.crc32(data[at : words + 4 * n_words]) != bytes_crc:
        raise ValueError("damaged block")
    stop = n if stop is None else min(stop, n)
    point = min(first // (lanes * POINT), n_points - 1)
    used = int(np.frombuffer(data, "<u4", n_points, at)[point])
    state = np.frombuffer(data, "<u8", lanes, states + 8 * lanes * point).copy()
    words = np.frombuffer(data, "<u4", n_words, words).astype(np.uint64)
    bits, half, mask = np.uint64(table.bits), np.uint64(32), np.uint64((1 << table.bits) - 1)
    base = point * lanes * POINT
    out = np.empty(max(0, -(-(stop - base) // lanes) * lanes), np.uint32)
    for i in range(base, stop, lanes):
        x = state[: min(lanes, n - i)]
        slot = x & mask
        out[i - base : i - base + len(x)] = own = table.symbol[slot]
        x = table.freq[own] * (x >> bits) + slot - table.start[own]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << half) | words[used : used + len(low)]
            used += len(low)
        state[: len(x)] = x
    out = out[first - base : stop - base]
    if (first, stop) == (0, n) and (used != n_words or (state != _LOW).any() or zlib.crc32(out.astype("<u4").tobytes()) != ids_crc):
        raise ValueError("a block doesn't decode to the ids that it was made of")
    return out


def encode_file(doc_ids: np.ndarray, has_id: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    blocks = [encode_block(ids[i : i + BLOCK], table) for i in range(0, len(ids), BLOCK)]
    head = _HEAD.pack(b"GWRA", 2, table.bits, 0, table.crc, len(lengths), len(blocks), len(ids))
    at = len(head) + 13 * len(lengths) + 8 * len(blocks) + np.cumsum([0, *map(len, blocks)], dtype=np.int64)[: len(blocks)]
    return head + doc_ids.astype("<i8").tobytes() + has_id.astype(np.uint8).tobytes() + lengths.astype("<u4").tobytes() + at.astype("<u8").tobytes() + b"".join(blocks)


def decode_head(data: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, has_id, lengths, places of the blocks, number of ids."""
    magic, version, bits, _, crc, n_docs, n_blocks, n_ids = _HEAD.unpack_from(data)
    if (magic, version, bits, crc) != (b"GWRA", 2, table.bits, table.crc):
        raise ValueError("not a file of this format and table")
    at = _HEAD.size
    kinds = [("<i8", n_docs), (np.uint8, n_docs), ("<u4", n_docs), ("<u8", n_blocks)]
    out = []
    for kind, n in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    if int(out[2].sum(dtype=np.int64)) != n_ids or n_blocks != -(-n_ids // BLOCK):
        raise ValueError("a file's checkpoints and blocks disagree")
    return *out, n_ids


def decode_file(data: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, has_id, lengths, ids."""
    doc_ids, has_id, lengths, places, n_ids = decode_head(data, table)
    return doc_ids, has_id, lengths, decode_ids(data, table, 0, n_ids)


def decode_ids(data: bytes, table: Table, first: int, stop: int) -> np.ndarray:
    """The ids first-stop of a file, from the checkpoints before them."""
    places, view = decode_head(data, table)[3], memoryview(data)
    parts = [decode_block(view, int(places[b]), table, max(0, first - b * BLOCK), stop - b * BLOCK) for b in range(first // BLOCK, -(-stop // BLOCK))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


_SEGMENTS = "part int, segment int, doc_ids binary, has_id binary, lengths binary, ids binary"


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Tokenize a sorted partition; a row for each run of documents of about SEGMENT ids."""
    code, part, number = encoder(path), TaskContext.get().partitionId(), 0
    width = "<u2" if code.size <= 1 << 16 else "<u4"
    held: list[tuple[np.ndarray, ...]] = []
    names = [x.split()[0] for x in _SEGMENTS.split(", ")]

    def close() -> pa.RecordBatch:
        doc_ids, has_id, lengths, ids = map(np.concatenate, zip(*held))
        cells = [doc_ids.astype("<i8"), has_id.astype(np.uint8), lengths.astype("<u4"), ids.astype(width)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=names)

    for batch in batches:
        for at, stop in _chunks(batch.column(1)):
            rows = batch.slice(at, stop - at)
            ids, counts = code.encode(rows.column(1), end_id)
            own = rows.column(0)
            held.append((own.fill_null(0).to_numpy(zero_copy_only=False), ~own.is_null().to_numpy(zero_copy_only=False), counts, ids))
            if sum(len(h[3]) for h in held) >= SEGMENT:
                yield close()
                held, number = [], number + 1
    if held:
        yield close()


def _ids_of(cell: pa.Scalar, width: str) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), width)


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Table]:
    """Write the files of all documents; returns them as read from the store, and their table."""
    text = F.col(text_col)
    # equal rows may come in any order, so they are told apart by where they are read
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    held = store_path(docs.sparkSession, "token-ids")
    segments = store(rows.mapInArrow(lambda b: _segments(b, tokenizer_path, end_id), _SEGMENTS), "token-ids", held)
    size = max(encoder(tokenizer_path).size, end_id + 1)
    width = "<u2" if encoder(tokenizer_path).size <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.bincount(_ids_of(cell, width), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    # one row for each id of the vocabulary, which bounds what comes to the driver
    counts = np.zeros(size, np.int64)
    for r in segments.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]
    table = Table.of(counts)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, has_id, lengths = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, "<i8"), (3, np.uint8), (4, "<u4")))
                ids = _ids_of(batch.column(5)[i], width).astype(np.uint32)
                data = encode_file(doc_ids, has_id, lengths, ids, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["part", "segment", "n_ids", "file"])

    files = store(segments.mapInArrow(encode, "part int, segment int, n_ids long, file binary"), "token-files", path)
    discard(docs.sparkSession, held)
    return files, table


def read_files(files: DataFrame, table: Table) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    shared = files.sparkSession.sparkContext.broadcast(table)
    schema = "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, has_id, lengths, ids = decode_file(batch.column(2)[i].as_py(), shared.value)
                ends = np.cumsum(lengths, dtype=np.int64)
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends - lengths, ends)]
                n = len(lengths)
                cells = [np.full(n, batch.column(0)[i].as_py(), np.int32), np.full(n, batch.column(1)[i].as_py(), np.int32)]
                arrays = [*map(pa.array, cells), pa.array(doc_ids, mask=has_id == 0), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    docs = files.select("part", "segment", "file").mapInArrow(decode, schema)
    offsets = bucket_prefix(files.select("part", "segment", "n_ids"), [], "part", ["segment"], "n_ids", "base")
    rows = docs.join(small_side(offsets.select("part", "segment", "base")), ["part", "segment"])
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
