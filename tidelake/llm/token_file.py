"""Token ids in binary files of Simple-8b words.

A file is a run of blocks, each behind the other and independent of the others; all parts are little-endian 64-bit
words, so a block begins at a multiple of 8 bytes. A block has

* a head of 6 words: MAGIC, file number, ids in the file before this block, document parts, ids, id words;
* two words for each document part: the document's id, and its number of ids here * 4 + 2 if the id is null + 1 if the
  part goes on with the document of the part before;
* the ids as Simple-8b words: the top 4 bits are a selector, the other 60 hold as many ids as the selector's width lets
  in; selector 0 is an escape, and the next word is one id of any size;
* END, one word.

Files are written by Spark's text writer, whose commit makes a lost executor's task harmless: a block is a line, which
the writer passes on byte by byte, and END is the line separator. Lines are never searched for: the head tells lengths.
The n-th range of documents is file number n, so a document's place among all ids follows from the sums of the files.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_column, doc_chunks, materialize, prefix_sums, shared_dir, small_batches, span_hash

#: Bits of an id and ids of a word, by selector 1 to 14 (fixed values of the method).
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
MOST = int(COUNTS.max())
ESCAPE = len(WIDTHS)

MAGIC = int.from_bytes(b"S8BLOCK1", "little")
END = "S8BEND.\n"
HEAD = 6
#: Ids of a block, blocks that are coded together, and bytes of text whose ids a file holds on average.
BLOCK_IDS, BLOCKS_AT_ONCE = 8192, 64
FILE_BYTES = 32 << 20
#: Slots in which a worker remembers pieces (16 bytes each, and some 16 for a piece's ids), and words encoded together.
SLOTS, AT_ONCE = 1 << 20, 200


# ---------------------------------------------------------------- words


def encode_blocks(ids: np.ndarray, block: int = BLOCK_IDS) -> list[np.ndarray]:
    """The Simple-8b words of each run of `block` ids. All runs advance together, one word of each at a step."""
    n = len(ids)
    if not n:
        return []
    rows = -(-n // block)
    padded = np.zeros((rows, block + MOST), np.uint64)
    flat = np.zeros(rows * block, np.uint64)
    flat[:n] = ids
    padded[:, :block] = flat.reshape(rows, block)
    size = np.full(rows, block)
    size[-1] = n - (rows - 1) * block
    # the smallest width that holds an id, then the widest id of the next 1, 2, 3 ... 60: each window from the one before
    widest = np.searchsorted(np.uint64(1) << WIDTHS.astype(np.uint64), padded, side="right").astype(np.uint8)
    selector = np.full((rows, block), ESCAPE, np.uint8)
    held = 1
    for s in range(len(WIDTHS) - 1, -1, -1):
        step = int(COUNTS[s]) - held
        if step:
            grown = widest.copy()
            np.maximum(widest[:, :-step], widest[:, step:], out=grown[:, :-step])
            widest, held = grown, int(COUNTS[s])
        selector[widest[:, :block] <= s] = s
    takes = np.append(COUNTS, 1)
    at = np.zeros(rows, np.int64)
    live = np.arange(rows)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        chosen = selector[live, at[live]]
        found.append((live, at[live], chosen))
        at[live] += takes[chosen]
        live = live[at[live] < size[live]]
    row, start, chosen = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, row))
    row, start, chosen = row[order], start[order], chosen[order]
    words = np.zeros(len(row), np.uint64)
    for s in np.unique(chosen[chosen < ESCAPE]).tolist():
        here = np.flatnonzero(chosen == s)
        place = np.arange(COUNTS[s])
        cells = padded[row[here, None], start[here, None] + place] << (place * WIDTHS[s]).astype(np.uint64)
        words[here] = np.bitwise_or.reduce(cells, axis=1) | np.uint64(s + 1 << 60)
    escaped = np.flatnonzero(chosen == ESCAPE)
    if len(escaped):  # the escape word is 0, the id follows
        words = np.insert(words, escaped + 1, padded[row[escaped], start[escaped]])
        row = np.insert(row, escaped + 1, row[escaped])
    return np.split(words, np.searchsorted(row, np.arange(1, rows)))


def decode_words(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of Simple-8b words: all words of a selector at once."""
    code = (words >> np.uint64(60)).astype(np.int64) - 1
    zeros = np.flatnonzero(code == -1)
    raw = np.zeros(len(words), bool)
    if len(zeros):
        last = -2
        for x in zeros.tolist():  # what follows an escape is no word of its own, even if it begins like an escape
            if x != last:
                last = x + 1
                raw[last] = True
        code[raw] = ESCAPE
    takes = np.append(COUNTS, [1, 0])[code]
    ends = np.cumsum(takes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(code[code >= 0]).tolist():
        here = np.flatnonzero(code == s)
        start = ends[here] - takes[here]
        if s == ESCAPE:
            out[start] = words[here]
            continue
        place = np.arange(COUNTS[s])
        out[start[:, None] + place] = (words[here, None] >> (place * WIDTHS[s]).astype(np.uint64)) & np.uint64((1 << int(WIDTHS[s])) - 1)
    return out[:n]


# ---------------------------------------------------------------- tokens

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 4
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_ASCII = np.zeros(256, bool)
_ASCII[33:127] = True
#: First bytes of the characters beyond ASCII that are no white space.
_PLAIN = _ASCII.copy()
_PLAIN[0xC3:0xE1] = True
_PLAIN[0xE4:0xF5] = True


class PieceTokenizer:
    """A byte-level tokenizers file, with the ids of pieces met before remembered.

    Texts are cut only where the file's pattern ends a piece whatever lies around: in front of the last space before a
    word, in front of white space behind a visible ASCII character, and between ASCII letters, digits and marks other
    than '. The library encodes each different piece once. Pieces are remembered by a 64-bit hash in either of two
    slots; when half the slots have been filled, all are emptied.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.encoder = Tokenizer.from_file(path)
        if "ByteLevel" not in repr(self.encoder.pre_tokenizer) or self.encoder.normalizer is not None:
            raise ValueError(f"{path} is no byte-level file without a normalizer")
        # tokens that begin with a space
        self.spaced = np.zeros(self.encoder.get_vocab_size(), bool)
        self.spaced[[i for token, i in self.encoder.get_vocab().items() if token[0] == "\u0120"]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.start, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.end, self.filled = np.zeros(1 << 20, np.uint32), 0, 0

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, the order in which they come, and how many each has in that order."""
        # a word with a space before it is one piece of the pattern, so such may stand together
        words = [i for i, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        alone = np.ones(len(pieces), bool)
        alone[words] = False
        rest = np.flatnonzero(alone).tolist()
        ids, order, counts = [], [], []
        parts = [words[i : i + AT_ONCE] for i in range(0, len(words), AT_ONCE)]
        for part, found in zip(parts, self.encoder.encode_batch_fast(["".join([pieces[i] for i in part]) for part in parts], add_special_tokens=False), strict=True):
            own = np.array(found.ids, np.uint32)
            starts = np.flatnonzero(self.spaced[own])
            if len(starts) != len(part):  # the library takes some letter for none
                rest += part
                continue
            ids.append(own)
            order.append(part)
            counts.append(np.diff(np.append(starts, len(own))))
        for found in self.encoder.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False):
            ids.append(np.array(found.ids, np.uint32))
            counts.append([len(ids[-1])])
        return np.concatenate(ids), np.concatenate([*order, rest]).astype(np.int64), np.concatenate(counts).astype(np.int32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode new pieces and remember them: where each one's ids begin, and how many there are."""
        ids, order, counts = self._encoded(pieces)
        if self.end + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), np.uint32)])
        self.pool[self.end : self.end + len(ids)] = ids
        size, start = np.empty(len(pieces), np.int32), np.empty(len(pieces), np.int32)
        size[order], start[order] = counts, self.end + np.cumsum(counts) - counts
        self.end += len(ids)
        self.filled += len(pieces)
        a, b = _slots(hashes)
        slot = np.where(self.keys[a] == 0, a, b)
        self.keys[slot], self.start[slot], self.size[slot] = hashes, start, size
        # of two new pieces for one slot the last is there, with its own figures
        order = np.unique(slot[::-1], return_index=True)[1]
        last = len(slot) - 1 - order
        self.keys[slot[last]], self.start[slot[last]], self.size[slot[last]] = hashes[last], start[last], size[last]
        return start, size

    def __call__(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other in buf, and the n + 1 offsets of each text's ids."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        raw = buf.tobytes()
        cuts = np.zeros(len(buf), bool)
        cuts[:-1] |= (buf[:-1] == 0x20) & _PLAIN[buf[1:]]
        cuts[1:] |= _GAP[buf[1:]] & _ASCII[buf[:-1]]
        if b"<|" not in raw:  # the file's own marks stay whole
            kind = _KIND[buf]
            cuts[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        cuts[bounds[:-1][bounds[:-1] < len(buf)]] = True
        s = np.flatnonzero(cuts)
        e = np.append(s[1:], len(buf))
        h = span_hash(prefix_sums(buf), s, e)
        if self.filled > SLOTS // 2:
            self._forget()
        a, b = _slots(h)
        slot = np.where(self.keys[a] == h, a, b)
        start, size = self.start[slot], self.size[slot]
        new = np.flatnonzero(self.keys[slot] != h)
        if len(new):
            uniq, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[first]
            learned = self._learn(uniq, [raw[x:y].decode("utf-8", "replace") for x, y in zip(s[one].tolist(), e[one].tolist(), strict=True)])
            start[new], size[new] = learned[0][back], learned[1][back]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.pool[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(s, bounds)]


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(64 - SLOTS.bit_length() + 1)
    return (hashes >> bits).astype(np.int64), (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> PieceTokenizer:
    """One tokenizer for a worker, whose memory of pieces serves one task after another."""
    return PieceTokenizer(path)


# ---------------------------------------------------------------- files


def block_bytes(number: int, before: int, parts: list[tuple[int | None, int, bool]], words: np.ndarray) -> bytes:
    """A block without END; parts: (document, ids, whether it goes on) in order."""
    head = np.array([MAGIC, number, before, len(parts), sum(n for _, n, _ in parts), len(words)], "<i8")
    listed = np.array([[doc or 0, n * 4 + 2 * (doc is None) + on] for doc, n, on in parts], "<i8")
    return head.tobytes() + listed.tobytes() + words.astype("<u8").tobytes()


def _blocks(tokenizer: str, end_id: int):
    return lambda batches: _file(pieces_of(tokenizer), end_id, batches)


def _file(encode: PieceTokenizer, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in order to a file's blocks. A few blocks of ids are held at a time besides a text's own."""
    number = TaskContext.get().partitionId()
    waiting: list[np.ndarray] = []
    parts: list[tuple[int | None, int, bool]] = []
    held = before = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, parts, held, before
        ids = np.concatenate(waiting) if waiting else np.zeros(0, np.uint64)
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        out, of_block, room = [], [], BLOCK_IDS
        blocks = encode_blocks(ids[:whole])
        left: list[tuple[int | None, int, bool]] = []
        for doc, n, on in parts:
            while n and len(out) < len(blocks):
                take = min(n, room)
                of_block.append((doc, take, on))
                n, room, on = n - take, room - take, True
                if not room or (last and len(out) == len(blocks) - 1 and sum(x[1] for x in of_block) == whole - BLOCK_IDS * len(out)):
                    out.append(block_bytes(number, before, of_block, blocks[len(out)]))
                    before += sum(x[1] for x in of_block)
                    of_block, room = [], BLOCK_IDS
            if n:
                left.append((doc, n, on))
        waiting, parts, held = ([ids[whole:]] if whole < len(ids) else []), left, len(ids) - whole
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["block"])

    for batch in batches:
        docs = batch.column(0).to_pylist()
        buf, off = byte_column(batch.column(1))
        for i, j in doc_chunks(off):
            ids, at = encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            closed = np.insert(ids.astype(np.uint64), at[1:], np.uint64(end_id))
            waiting.append(closed)
            parts += [(doc, n, False) for doc, n in zip(docs[i:j], (np.diff(at) + 1).tolist(), strict=True)]
            held += len(closed)
            if held >= BLOCK_IDS * BLOCKS_AT_ONCE:
                yield from flush(False)
    yield from flush(True)


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Write the ids of all texts, each closed by end_id, as files in ascending order of the ids of the documents.

    A null text is an empty one. Null ids come first; rows of one id are in order of a hash of their texts, and rows equal
    in both in any order, which shows nowhere. One id may have any share of the rows. An empty table gives no blocks.
    Texts are dealt to files by ranges of (id, hash, row number), sorted there and tokenized once.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("at"))
    files = max(1, -(-(docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0) // FILE_BYTES))
    key = ["id", "h", "at"]
    blocks = rows.repartitionByRange(files, *key).sortWithinPartitions(*key).select("id", "text").mapInArrow(_blocks(tokenizer, end_id), "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", END).text(path)


def file_blocks(content: bytes) -> Iterator[tuple[int, int, list[tuple[int | None, int, bool]], np.ndarray]]:
    """(file number, ids before, parts, ids) of each block of a file."""
    data = np.frombuffer(content, "<u8")
    at = 0
    while at < len(data):
        magic, number, before, parts, ids, words = data[at : at + HEAD].astype(np.int64).tolist()
        if magic != MAGIC:
            raise ValueError("no block where one must begin")
        at += HEAD
        listed = data[at : at + 2 * parts].astype(np.int64).reshape(parts, 2).tolist()
        at += 2 * parts
        yield number, before, [(None if n & 2 else doc, n >> 2, bool(n & 1)) for doc, n in listed], decode_words(data[at : at + words].astype(np.uint64), ids)
        at += words
        if data[at : at + 1].tobytes() != END.encode():
            raise ValueError("a block does not end where its head says")
        at += 1


_READ = "file long, id long, first long, n long, crc long, ids binary"


def _read(keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows: list[list] = []
                for number, before, parts, ids in file_blocks(content.as_buffer()):
                    raw, at = ids.astype("<u4"), 0
                    for doc, n, on in parts:
                        own = raw[at : at + n].tobytes()
                        if on:
                            rows[-1][3] += n
                            rows[-1][4] = zlib.crc32(own, rows[-1][4])
                            rows[-1][5].append(own)
                        else:
                            rows.append([number, doc, before + at, n, zlib.crc32(own), [own]])
                        if not keep_ids:
                            rows[-1][5] = []
                        at += n
                    if len(rows) > 2000:  # the last one may go on
                        yield _rows(rows[:-1], names, kinds)
                        rows = rows[-1:]
                if rows:
                    yield _rows(rows, names, kinds)

    return run


def _rows(rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(r[j]) if j == 5 else r[j] for r in rows], kinds[j]) for j in range(6)], names)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Read such files: id_col, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of the ids as
    little-endian 32-bit integers), and with keep_ids the ids so written. Files may be read in any order."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(files.mapInArrow(_read(keep_ids), _READ), "read")
    # a row for each file
    sums = rows.groupBy("file").agg(F.sum("n").alias("ids_of_file"))
    before = sums.select("file", F.coalesce(F.sum("ids_of_file").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    kept = ["ids"] if keep_ids else []
    return rows.join(before, "file").select(F.col("id").alias(id_col), (F.col("before") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), *kept)


def token_file_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """What read_token_files gives of the files that write_token_files makes of docs, in a new folder of the shared one."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer, path, id_col, text_col, end_id)
    return read_token_files(docs.sparkSession, path, id_col)
