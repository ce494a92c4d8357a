"""Token ids of whole texts by a public byte-level tokenizer.

Texts of up to BLOCK characters are encoded as they are. Longer ones are cut into blocks that any
executor encodes, and put together by a tree of joins: at each join the ids of a window that grows
on both sides are computed anew, until its two outer edges lie where both sides agree for certain.
An edge is certain

* between characters where the tokenizer's pattern always splits and looks at nothing beyond
  (blank after non-blank; letter, digit and mark beside each other, but for an apostrophe), or
* inside an unbroken run of one kind of character, between two ids that the merges keep apart: a
  sequence of ids is the encoding of its bytes exactly if each two neighbours encode to themselves.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the tokenizers' files; a parameter of everything that encodes.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern by which byte_bpe_50k splits text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters of a block.
BLOCK = 4096

_KINDS = regex.compile(r"(?P<L>\p{L})|(?P<N>\p{N})|(?P<S>\s)|(?P<O>.)", regex.DOTALL)


@functools.lru_cache(maxsize=8)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tiktoken.Encoding:
    """The tokenizer of folder/name.tiktoken, loaded once per process."""
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kind(c: str) -> str:
    return _KINDS.match(c).lastgroup


def certain(text: str, at: int) -> bool:
    """Whether text[:at] and text[at:] are encoded independently, whatever is beyond."""
    if at <= 0 or at >= len(text):
        return at in (0, len(text))
    a, b = _kind(text[at - 1]), _kind(text[at])
    if a == "S" or a == b:
        return False
    return not (a == "O" and b == "L" and text[at - 1] in "'")


class Part:
    """A piece of text with the ids of its encoding by itself."""

    __slots__ = ("text", "ids")

    def __init__(self, text: str, ids: list[int]) -> None:
        self.text, self.ids = text, ids


def _cut_back(enc: tiktoken.Encoding, part: Part, least: int) -> tuple[int, int]:
    """(characters, ids) of the shortest tail of part of at least least characters that begins at a certain edge."""
    at = max(0, len(part.text) - least)
    while at > 0 and not certain(part.text, at):
        at -= 1
    # ids of the tail: count back whole tokens until their bytes are the tail's
    want = len(part.text[at:].encode("utf-8", "replace"))
    n = have = 0
    while have < want:
        n += 1
        have += len(enc.decode_single_token_bytes(part.ids[-n]))
    return (len(part.text) - at, n) if have == want else (len(part.text), len(part.ids))


def _cut_ahead(enc: tiktoken.Encoding, part: Part, least: int) -> tuple[int, int]:
    """The same of the shortest head that ends at a certain edge."""
    at = min(len(part.text), least)
    while at < len(part.text) and not certain(part.text, at):
        at += 1
    want = len(part.text[:at].encode("utf-8", "replace"))
    n = have = 0
    while have < want:
        have += len(enc.decode_single_token_bytes(part.ids[n]))
        n += 1
    return (at, n) if have == want else (len(part.text), len(part.ids))


def _merge_ids(enc: tiktoken.Encoding, left: list[int], right: list[int]) -> list[int]:
    """Ids of one unbroken run from those of its two sides."""

    def apart(a: int, b: int) -> bool:
        return enc._encode_single_piece(enc.decode_single_token_bytes(a) + enc.decode_single_token_bytes(b)) == [a, b]

    w = 4
    while True:
        l, r = left[-w:], right[:w]
        mid = enc._encode_single_piece(b"".join(map(enc.decode_single_token_bytes, l + r)))
        rest_l, rest_r = left[: -len(l)] if l else left, right[len(r) :]
        if (not rest_l or apart(rest_l[-1], mid[0])) and (not rest_r or apart(mid[-1], rest_r[0])):
            return rest_l + mid + rest_r
        w *= 2


def join(enc: tiktoken.Encoding, left: Part, right: Part, window: int = 16, run: int = 512) -> Part:
    """The encoding of left and right together."""
    text = left.text + right.text
    if not left.text or not right.text:
        return Part(text, left.ids + right.ids)
    lc, ln = _cut_back(enc, left, 1)
    rc, rn = _cut_ahead(enc, right, 1)
    tail, head = left.text[len(left.text) - lc :], right.text[:rc]
    kinds = {_kind(tail[0]), _kind(tail[-1]), _kind(head[0]), _kind(head[-1])}
    if lc + rc > run and len(kinds) == 1 and "S" not in kinds and "'" not in (tail[0], head[0]):
        # one unbroken run across the join: both sides are parts of the same piece
        mid = _merge_ids(enc, left.ids[len(left.ids) - ln :], right.ids[:rn])
    else:
        lc, ln = _cut_back(enc, left, window) if lc < window else (lc, ln)
        rc, rn = _cut_ahead(enc, right, window) if rc < window else (rc, rn)
        mid = enc.encode_ordinary(left.text[len(left.text) - lc :] + right.text[:rc])
    return Part(text, left.ids[: len(left.ids) - ln] + mid + right.ids[rn:])


def join_all(enc: tiktoken.Encoding, parts: list[Part]) -> list[int]:
    """Pairs are joined until one is left: each id is moved as often as the tree is deep."""
    while len(parts) > 1:
        parts = [join(enc, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0].ids if parts else []


def encode_column(df: DataFrame, text: str, keys: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS, block: int = BLOCK) -> DataFrame:
    """keys and ids (array<int>) of every row of df; null and empty texts have an empty list.

    Long texts: their blocks are spread over all tasks and gathered by a row number, so a group is one
    value of one row. keys must be columns of fixed types or strings.
    """
    fields = list(df.select(*keys).schema.fields)
    ids_field = T.StructField("ids", T.ArrayType(T.IntegerType()))
    short = F.col(text).isNull() | (F.length(text) <= block)
    kept = df.select(*keys, F.col(text).cast("string").alias("_text"))
    out = T.StructType([*fields, ids_field])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for b in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(ids, pa.list_(pa.int32()))], names=[*keys, "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for b in batches:
            ids = [enc.encode_ordinary(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("_seq"), *[b.column(k) for k in keys], b.column("_text"), pa.array(ids, pa.list_(pa.int32()))], names=["_row", "_seq", *keys, "_text", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        # one text: what is in memory is bounded by the largest of them, not by a batch of many
        table = table.sort_by("_seq")
        ids = join_all(encoding(name, folder), [Part(t, i) for t, i in zip(table["_text"].to_pylist(), table["ids"].to_pylist())])
        return pa.table([*[table[k].slice(0, 1) for k in keys], pa.array([ids], pa.list_(pa.int32()))], names=[*keys, "ids"])

    direct = kept.where(short).mapInArrow(whole, out)
    long = kept.where(~short).withColumn("_row", F.monotonically_increasing_id())
    pieces = long.select("_row", *keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("_text") - 1) / block).cast("int")), lambda i: F.col("_text").substr(i * block + 1, F.lit(block)))).alias("_seq", "_text"))
    coded_schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_seq", T.IntegerType()), *fields, T.StructField("_text", T.StringType()), ids_field])
    coded = pieces.repartition("_row", "_seq").mapInArrow(blocks, coded_schema)
    return direct.unionByName(coded.groupBy("_row").applyInArrow(joined, out))


def document_ids(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, block: int = BLOCK) -> DataFrame:
    """doc_id, ids of every document, without special tokens, whose strings are ordinary text.

    Empty and null texts give an empty list, a blank text is encoded as it is. Repeated rows each
    give a row. An empty table gives no rows; columns of other names are ignored.
    """
    return encode_column(documents.select(F.col("doc_id").cast("long"), F.col("text")), "text", ["doc_id"], name, folder, block)
