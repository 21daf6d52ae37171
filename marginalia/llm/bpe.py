"""BPE encoding and decoding by a distinct-word table.

Split. A text is cut into words before each blank or line end that follows a character which is no white space. There the byte-level
pre-tokenizer always cuts, so a word (white space and what follows it) covers whole pre-tokens and is encoded the same alone as in its text.
One pass over the texts makes a table. It has a row for each document, with the places of its words in the list of its block's distinct words; and it
has the lists themselves, cut by a hash of the word into the parts of the word table: a row (block, part, places, words) for each part that a
block has words of. A block is up to BLOCK_BYTES of texts that one task reads one after the other. Words are placed by falling frequency, so
that places compress well; texts themselves are never dealt out.

Table. A part of the table gathers its lists, and encodes each distinct word once. What goes back are the ids of each list.

Join. Documents meet the lists of their block; ids come back by place in the block's list, and by position in the text. Decoding takes the ids to
their pieces through the vocabulary's table, whose size the tokenizer fixes, and concatenates the bytes.

Growth. There is a part for each PART_BYTES of text, so a part stays as large as it is. A block has at most one row a part and at most one
a word, so rows grow with the words of the input and not with blocks times parts. A task holds a block, or a part, or one larger document.

Edge cases: a null text counts as empty and has no ids; a text larger than a block is a block's whole content; null and repeated ids and equal
texts are rows like any other; the tokenizer's special token is found in texts as its library does; an empty table gives no rows. Columns of the input
with the names of results give way to them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import giving_way, handing_back

BLOCK_BYTES, PART_BYTES = 24 << 20, 16 << 20
#: Words a call of the library's batch encoder; documents whose ids and texts are Python's objects at a time.
BATCH, SLICE = 20_000, 256
LONG_SPACE = 20_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")

_WORDS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space of Python's \s other than the blank and the line end, and what some tables count to it (fixed values); it includes all that the tokenizer takes for white space.
_OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_WIDE_SPACE = "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SURE = re.compile(rf"(?<=[^ \n{_OTHER_SPACE}{_WIDE_SPACE}])(?=[ \n])")


def split_words(text: str) -> list[str]:
    """Words whose concatenation is the text."""
    if any(c in text for c in _OTHER_SPACE) or not text.isascii() and any(c in text for c in _WIDE_SPACE):
        return _SURE.split(text)
    return _WORDS.findall(text)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def vocabulary_size(path: str) -> int:
    """Ids are below this number."""
    return _tokenizer(path).get_vocab_size(with_added_tokens=True)


@cache
def pieces(path: str) -> list[bytes]:
    """The bytes of each id: the table that decoding joins with."""
    t = _tokenizer(path)
    # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes are shifted past 255 in order.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    out = [b""] * t.get_vocab_size(with_added_tokens=True)
    for piece, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return out


#: The pattern of the byte-level pre-tokenizer (fixed value), with the same matches but without steps back inside a run.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@cache
def _ranked(path: str):
    """An encoder of plain text by ranks that gives the tokenizer's ids three times as fast; None if the tokenizer is of another kind.

    It is of this kind if it is a byte-level BPE without normalizer or added blank whose ids are the bytes and then the merges in order.
    """
    import tiktoken

    t = _tokenizer(path)
    said = json.loads(t.to_str())
    kind, model = said["pre_tokenizer"] or {}, said["model"]
    if said["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if any(model["vocab"].get(m.replace(" ", "", 1)) != 256 + i for i, m in enumerate(merges)) or len(model["vocab"]) not in (256 + len(merges), 257 + len(merges)):
        return None
    table = pieces(path)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={table[i]: i for i in range(256 + len(merges))}, special_tokens={})


def decode(ids: np.ndarray, path: str) -> str:
    table = pieces(path)
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encode_texts(texts: list[str], path: str) -> list[list[int]]:
    """The ids of each text, for those who want ids where the texts are read and need no table of words."""
    return _encode(texts, path)


def _encode(words: list[str], path: str) -> list[list[int]]:
    """The ids of each word; words that hold an added token, or more white space in a row than the ranks' pattern can step back in, go to the tokenizer's library in any case."""
    t, fast = _tokenizer(path), _ranked(path)
    if fast is None:
        return [e.ids for at in range(0, len(words), BATCH) for e in t.encode_batch(words[at : at + BATCH], add_special_tokens=False)]
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    plain = fast.encode_ordinary
    return [t.encode(w, add_special_tokens=False).ids if any(a in w for a in added) or len(w) >= LONG_SPACE and _LONG_SPACE.search(w) else plain(w) for w in words]


def _pack(values) -> bytes:
    """Unsigned numbers by planes of bytes, compressed: high bytes are alike and cost next to nothing."""
    planes = np.ascontiguousarray(np.asarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[str]) -> bytes:
    """A list of words: their number, the lengths and the bytes, compressed."""
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), dtype="<u4", count=len(raw)).tobytes()
    return zstandard.ZstdCompressor(level=6).compress(len(raw).to_bytes(4, "little") + sizes + b"".join(raw))


def _unpack_words(data: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b].decode() for a, b in zip([4 + 4 * n, *ends], ends)]


class _Places(dict):
    """Gives each new word the next place."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def _ordered(words: list[str], counts: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(the words' order: falling count, then part, then word; the part of each word)."""
    part = np.fromiter((zlib.crc32(w.encode()) for w in words), dtype=np.int64, count=len(words)) % parts
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return np.lexsort((rank, part, -counts)), part


def _own_rows(table: pa.Table, names: list[str], first: int, stop: int) -> pa.Table:
    """The named columns of these rows, copied: a slice would hold its whole batch, texts included, as long as its block lasts."""
    return table.select(names).take(pa.array(np.arange(first, stop)))


def _split(docs: DataFrame, names: list[str], block_bytes: int, parts: int) -> DataFrame:
    """docs: text and names. block, part, places, words and names: a row for each document (no part) and one for each part of each block's list."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = ["block", "part", "places", "words", *names]

    @handing_back
    def run(batches):
        task, number, words, size = TaskContext.get().partitionId(), 0, _Places(), 0
        held: list[np.ndarray] = []  # of each document, the places by first sight
        rows: list[pa.Table] = []

        def ended():
            flat, listed, kept = np.concatenate(held), list(words), pa.concat_tables(rows)
            order, part = _ordered(listed, np.bincount(flat, minlength=len(listed)), parts)
            to = np.empty(len(listed), dtype="<u4")
            to[order] = np.arange(len(listed))
            block = task << 32 | number
            for at in range(0, len(held), 2000):
                own = kept.slice(at, 2000)
                n = len(own)
                yield from pa.Table.from_arrays(
                    [pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), pa.array([_pack(to[x]) for x in held[at : at + 2000]], pa.binary()), pa.nulls(n, pa.binary()), *own.columns], columns
                ).to_batches()
            order = order[np.argsort(part[order], kind="stable")]
            starts = np.concatenate([np.nonzero(np.diff(part[order], prepend=-1))[0], [len(order)]]).tolist()
            for at in range(0, len(starts) - 1, 2000):
                cut = [order[a:b] for a, b in zip(starts[at : at + 2000], starts[at + 1 : at + 2001])]
                n = len(cut)
                yield from pa.Table.from_arrays(
                    [pa.array(np.full(n, block)), pa.array([int(part[c[0]]) for c in cut], pa.int32()), pa.array([_pack(np.diff(to[c].astype(np.int64), prepend=0)) for c in cut], pa.binary()), pa.array([_pack_words([listed[i] for i in c.tolist()]) for c in cut], pa.binary()), *[pa.nulls(n, kept.schema.field(c).type) for c in names]],
                    columns,
                ).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts, first = batch.column("text"), 0
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                own = split_words(text)
                held.append(np.fromiter(map(words.__getitem__, own), dtype="<u4", count=len(own)))
                size += len(text)
                if size >= block_bytes:
                    rows.append(_own_rows(table, names, first, i + 1))
                    yield from ended()
                    held, rows, first, words, size, number = [], [], i + 1, _Places(), 0, number + 1
            if first < len(texts):
                rows.append(_own_rows(table, names, first, len(texts)))
        if held:
            yield from ended()

    return docs.mapInArrow(run, ", ".join(["block long, part int, places binary, words binary", *[f"{n} {kinds[n]}" for n in names]]))


def _encoded(lists: DataFrame, path: str) -> DataFrame:
    """lists: block, part, places, words. block, places, sizes, ids (packed): the ids of the words, each distinct word encoded once."""
    @handing_back
    def run(table: pa.Table) -> pa.Table:
        number = _Places()
        own = [np.fromiter(map(number.__getitem__, _unpack_words(x.as_py())), dtype="<u4") for x in table["words"]]
        distinct, size, flat = list(number), [np.empty(0, np.int64)], [np.empty(0, "<u4")]
        # Words and ids are Python's objects a batch at a time; the part as a whole is held in numbers.
        for at in range(0, len(distinct), BATCH):
            ids = _encode(distinct[at : at + BATCH], path)
            size.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), dtype="<u4"))
        size, flat = np.concatenate(size), np.concatenate(flat)
        starts = np.cumsum(size) - size
        sizes = [_pack(size[x]) for x in own]
        flat = [_pack(_gathered(starts[x], size[x], flat)) for x in own]
        return pa.table({"block": table["block"], "places": table["places"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(flat, pa.binary())})

    return lists.groupBy("part").applyInArrow(run, "block long, places binary, sizes binary, ids binary")


def _gathered(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs flat[s : s + n] for each start and size, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]


def encode_documents(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, digests: bool = False, decoded: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """All columns of docs but text; with n_tokens, ids (little-endian unsigned 32-bit) and, if decoded, decoded (text); or, if digests, with n_tokens, ids_sha256 and decoded_sha256."""
    docs = giving_way(docs, "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    keep = [c for c in docs.columns if c != "text"]
    names, decoded = [f"k{i}" for i in range(len(keep))], decoded or digests
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // part_bytes))
    split = _split(docs.select("text", *[F.col(c).alias(n) for c, n in zip(keep, names)]), names, block_bytes, parts)

    @handing_back
    def lists_of(table: pa.Table) -> pa.Table:
        return table.filter(pc.is_valid(table["part"])).select(["block", "part", "places", "words"])

    # Both uses deal the same rows out by block, so the texts are split once and the exchange is used twice.
    coded = _encoded(split.groupBy("block").applyInArrow(lists_of, "block long, part int, places binary, words binary"), path)

    @handing_back
    def join_ids(texts: pa.Table, lists: pa.Table) -> pa.Table:
        # A list's places are kept as steps from one to the next.
        places = np.concatenate([np.cumsum(_unpack(x.as_py()), dtype=np.int64) for x in lists["places"]] or [np.empty(0, np.int64)])
        sizes, flat = (np.concatenate([_unpack(x.as_py()) for x in lists[c]] or [np.empty(0, "<u4")]) for c in ("sizes", "ids"))
        by_place, starts, size = np.argsort(places), np.cumsum(sizes, dtype=np.int64) - sizes, sizes.astype(np.int64)
        starts, size = starts[by_place], size[by_place]
        texts = texts.filter(pc.is_null(texts["part"]))
        counts, codes, said = [], [pa.array([], pa.string() if digests else pa.binary())], [pa.array([], pa.string())]
        # A slice at a time, so that a block's ids and texts are held once, packed, and not as Python's objects too.
        for first in range(0, len(texts), SLICE):
            rows = [_unpack(x.as_py()) for x in texts["places"].slice(first, SLICE)]
            ids = [_gathered(starts[at], size[at], flat).astype("<u4") for at in rows]
            counts += map(len, ids)
            codes.append(pa.array([hashlib.sha256(x.tobytes()).hexdigest() if digests else x.tobytes() for x in ids], codes[0].type))
            if decoded:
                own = (decode(x, path) for x in ids)
                said.append(pa.array([hashlib.sha256(x.encode()).hexdigest() if digests else x for x in own], pa.string()))
        out = texts.select(names).append_column("n_tokens", pa.array(counts, pa.int64())).append_column("ids", pa.chunked_array(codes))
        return out.append_column("decoded", pa.chunked_array(said)) if decoded else out

    fields = split.select(*names).schema
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "n_tokens long", "ids string" if digests else "ids binary", *["decoded string"] * decoded])
    out = split.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(join_ids, schema)
    ends = {"ids": "ids_sha256", "decoded": "decoded_sha256"} if digests else {}
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *[F.col(c).alias(ends.get(c, c)) for c in ("n_tokens", "ids", *["decoded"] * decoded)])
