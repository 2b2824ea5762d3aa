"""Packing tokenised documents into fixed-length sequences by first-fit decreasing.

Each document is cut into pieces of the full length and one remainder. Randomised groups of pieces
(a seeded hash of the document and of the block of pieces) are packed independently: a group sorts
its pieces by length, and a tournament tree over the bins' free room finds the first bin that holds
the next piece. Only (document, start, length) rows are grouped, never the tokens.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift.llm.common import cut_lineage, small_batches, trimmed

SEQUENCE = 2048
END_ID = 1
COPIES = 4096           # equal pieces that are numbered at a time
END = END_ID.to_bytes(4, "little")
CACHE_WORDS, CACHE_PARTS = 300_000, 300_000  # of which a task remembers the ids
SPECIAL = b"<|"
LETTERS = re.compile("[a-zß-öø-ÿ]+")  # composed letters, as normalising leaves them
BYTE_LETTERS = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}  # byte-level BPE's letters for other bytes
PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27)  # the apostrophe opens suffixes
ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class _Ids(dict):
    """word (no white space) -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer splits letters from ASCII punctuation, so a word's ids are those of its leading
    punctuation, its core and its trailing punctuation in turn; the cores, far fewer than the words,
    are remembered by themselves. Apostrophes and special tokens are left to the tokenizer."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.path, self.tokenizer, self.parts = path, Tokenizer.from_file(path), {}
        made = json.loads(self.tokenizer.to_str())
        kinds = lambda key, parts: [x["type"] for x in (made[key] or {}).get(parts, [])]
        #: lower-cased letters are one piece, and reach the model as they are, byte by byte
        self.plain = kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]

    def ids(self, part: bytes) -> list[int]:
        text = part.decode()
        if self.plain and LETTERS.fullmatch(low := text.lower()):
            return [t.id for t in self.tokenizer.model.tokenize(low.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, part: bytes) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) > CACHE_PARTS:
                self.parts.clear()
            found = self.ids(part)
            ids = self.parts[part] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(PUNCTUATION)
        tail, head = word[len(core):], b""
        if core and core[0] not in PUNCTUATION or not core or SPECIAL in word:
            pass
        elif (rest := core.lstrip(PUNCTUATION))[0] in ALNUM:  # what follows cannot join the punctuation
            head, core = core[:len(core) - len(rest)], rest
        if not core or SPECIAL in word or not (core[-1] in ALNUM or core[-1] >= 0x80 and core.decode()[-1].lower().isalpha()):
            ids = self.encode(word)
        else:
            ids = (self.encode(head) if head else b"") + self.encode(core) + (self.encode(tail) if tail else b"")
        self[word] = ids
        return ids


def token_bytes(text: bytes | None, known: _Ids) -> bytes:
    """The ids of a whole text and the end id. The tokenizer drops white space, never joins across
    it and lower-cases, so the ids of a text are those of its lower-cased words in turn (special
    tokens alone tell cases apart)."""
    if not text:
        return END
    return b"".join(map(known.__getitem__, (text if SPECIAL in text else text.lower()).split())) + END


def pieces_of(ids: bytes, length: int = SEQUENCE) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of each piece."""
    step = 4 * length
    for at in range(0, len(ids), step):
        part = ids[at:at + step]
        yield at // 4, len(part) // 4, zlib.crc32(part)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. ``tree`` holds in each node the most free room of its bins:
    going left wherever the left child has room enough finds the first bin that fits."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def padded(length: int, capacity: int = SEQUENCE) -> int:
    """A sequence is padded to the capacity, but for one whose length is a power of two."""
    return length if length & (length - 1) == 0 else capacity


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
               length: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): one row per piece of each document."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in
                          ("start", "length", "ids_crc32", "doc_tokens"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Ids(tokenizer_path)  # for one task: a worker that goes on to other work must not hold it
        for b in batches:
            if len(known) > CACHE_WORDS:
                known.clear()
            take, cols = [], ([], [], [], [])
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                ids = token_bytes(text, known)
                for start, size, crc in pieces_of(ids, length):
                    take.append(i)
                    for c, v in zip(cols, (start, size, crc, len(ids) // 4), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(trimmed(cut), schema)


def pack(pieces: DataFrame, length: int = SEQUENCE, group_pieces: int = 2048, seed: int = 17) -> DataFrame:
    """``pieces`` plus ``sequence_id``, ``offset`` and ``padded_length``. ``pieces`` must be a
    written table: its row count sets the number of groups, about ``group_pieces`` pieces each.

    A document whose rows repeat is packed as often as it occurs. Reruns agree: groups come from a
    hash of (doc_id, start, ids_crc32, doc_tokens), equal pieces are numbered and the number is
    hashed too, and ties in a group go by doc_id, start and crc32. So no id, null or not, and no
    repeated row fills one group.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    equal = pieces.groupBy(*[f"`{c}`" for c in pieces.columns]).agg(F.count("*").alias("_n"))  # combined before the shuffle
    blocks = equal.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPIES})")))
    numbered = blocks.withColumn("_copy", F.explode(F.expr(f"sequence(_block * {COPIES}, least(_n, (_block + 1) * {COPIES}) - 1)")))
    own = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", "_copy", F.lit(seed))
    dealt = numbered.select(*[f"`{c}`" for c in pieces.columns], F.pmod(own, F.lit(groups)).alias("_group"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
                           T.StructField("padded_length", T.LongType())])

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.drop_columns("_group").sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), length)
        used = np.bincount(bins, weights=table["length"].to_numpy()).astype(np.int64)
        return (table.append_column("sequence_id", pa.array((int(key[0].as_py()) << 32) + bins))
                .append_column("offset", pa.array(offsets))
                .append_column("padded_length", pa.array([padded(int(x), length) for x in used[bins]], pa.int64())))

    return dealt.groupBy("_group").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   length: int = SEQUENCE, group_pieces: int = 2048) -> DataFrame:
    """Tokenise, cut and pack all ``docs``. A null or empty text is the end id alone; an empty
    table gives no rows; a null id is an id like any other. Other columns are not read."""
    with small_batches(docs.sparkSession):
        pieces = cut_lineage(cut_pieces(docs, tokenizer_path, id_col, text_col, length), "pieces")
    return pack(pieces, length, group_pieces)
