"""Byte-pair encoding and decoding over a table of distinct words.

Documents are dealt to blocks by a hash of id and text. Each block lists its distinct words (the pieces that the tokenizer's own
pattern cuts a text into). Spark brings equal words of all blocks together by hash, each distinct word is encoded once, and its ids
go back to the blocks that hold it, where they are joined to the words' positions. So a word travels once for each block, not for
each occurrence, and a frequent word is as many entries as there are blocks at most.

A row that travels is one block's words of one part (a part is a share of all words, by hash), in the order of their hashes; the
answer holds their ids in that order, so neither needs a key for each word. A row is only sent where a block has words of a part: rows are never
more than words, and hold hundreds of words up to some 100 GB. Texts and words are compressed columns, as the task's disk bound is
1.5 x input, and rows of single words with Spark's own row headers would take twice that.

Decoding joins ids with the vocabulary's id-to-piece table. Ids are dense numbers and the table is as large as the tokenizer (about 50,000
rows), so every task holds it, and the join is a gather by id; pieces are put together by position.

The tokenizer file must be at the given path on every machine; it is only read.

Defined results: null is encoded as the empty text: no ids; the special string of the tokenizer becomes its id,
as in the tokenizers library; repeated rows are each encoded; a text of one very long word is one word.
Documents of one doc_id may differ in text; doc_id may be null and of any type that can be sorted; an empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, dealt, give_back, mix, squeeze, tidy, unpacked, unsqueeze, utf8, word_hashes

BLOCK_CHARS = 5 << 20
#: The special string, and the pattern of the byte-level pre-tokenizer with its spaces spelt out.
SPECIAL = "<|endoftext|>"
_S = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def _tidied(f, *tables: pa.Table) -> pa.Table:
    """A group function that gives memory back after each group."""
    try:
        return f(*tables)
    finally:
        give_back()


def _splitter():
    import regex

    find = regex.compile(PATTERN).findall

    def split(text: str) -> list[str]:
        if SPECIAL not in text:
            return find(text)
        out: list[str] = []
        for k, part in enumerate(text.split(SPECIAL)):
            out += [SPECIAL, *find(part)] if k else find(part)
        return out

    return split


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    """Read once by a Python worker, not for each group."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: A space beside other white space, where a text can't be cut at spaces.
_WIDE_SPACE = rf" [{_S}]|[{_S}] |^ | $"


def _chunker():
    """Cut a text into chunks whose words don't depend on what is around them. The pattern never looks back, and looks ahead only
    from white space; so between two other characters a space starts a new chunk. Texts with wider spaces, NUL or the special string are one chunk."""
    import regex

    wide = regex.compile(_WIDE_SPACE).search

    def chunks(text: str) -> list[str]:
        """The first chunk, marked by a leading NUL, then the others without their space."""
        if SPECIAL in text or "\0" in text or wide(text):
            return ["\0" + text]
        parts = text.split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    return chunks


def _listed(rows: pa.Table) -> tuple[dict[str, int], Iterator[list[str]]]:
    """Distinct chunks of a block's texts with their numbers in order, and the words of each."""
    chunks, split, seen = _chunker(), _splitter(), {}
    for text in rows["text"].to_pylist():
        if text:
            seen.update(dict.fromkeys(chunks(text)))
    for i, c in enumerate(seen):
        seen[c] = i

    return seen, (split(c[1:]) if c[:1] == "\0" else split(" " + c) for c in seen)


def _spread(size: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Indices begin[i], begin[i] + 1, ... of size[i] items each, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _parted(words: dict[str, int], parts: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A block's words in order of (part, hash), the number each had, and the parts and row bounds of them."""
    listed = pa.array(words, pa.string())
    data, offsets = utf8(listed)
    h = mix(word_hashes(data, offsets[:-1], offsets[1:]))
    part = (h % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((h, part))
    part = part[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return listed.take(pa.array(order)), order, part[cut], np.r_[cut, len(part)]


def _encode(docs: DataFrame, tokenizer_path: str, block_chars: int, decoded: bool) -> DataFrame:
    docs = docs.select("doc_id", "text")
    n = block_count(docs, block_chars)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def list_words(rows: pa.Table) -> pa.Table:
        numbers: dict[str, int] = {}
        for words in _listed(unpacked(rows))[1]:
            numbers.update(dict.fromkeys(words))
        words, _, parts, bounds = _parted(numbers, n)
        del numbers
        data, offsets = utf8(words)
        sent = [(squeeze(data[offsets[a] : offsets[b]]), squeeze(np.diff(offsets[a : b + 1]).astype(np.uint32))) for a, b in zip(bounds[:-1], bounds[1:])]
        block = pa.array([rows["block"][0].as_py()] * len(parts), pa.int32())
        return pa.table({"part": pa.array(parts, pa.int32()), "block": block, "words": pa.array([w for w, _ in sent], pa.binary()), "sizes": pa.array([x for _, x in sent], pa.binary())})

    def encode_words(rows: pa.Table) -> pa.Table:
        tokenizer = _tokenizer(tokenizer_path)
        sizes = [unsqueeze(x.as_buffer(), np.uint32) for x in rows["sizes"]]
        ends = np.r_[0, np.cumsum(np.concatenate(sizes), dtype=np.int64)]
        text = pa.py_buffer(b"".join(unsqueeze(x.as_buffer(), np.uint8).tobytes() for x in rows["words"]))
        words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), text).dictionary_encode()
        size, flat = [], []
        for i in range(0, len(words.dictionary), 2000):
            encoded = [x.ids for x in tokenizer.encode_batch(words.dictionary[i : i + 2000].to_pylist(), add_special_tokens=False)]
            size.append(np.fromiter(map(len, encoded), np.int64, len(encoded)))
            flat.append(np.array([t for ids in encoded for t in ids], np.uint32))
        size, flat = np.concatenate(size), np.concatenate(flat)
        begin, index, at, counts, ids = np.cumsum(size) - size, words.indices.to_numpy(), 0, [], []
        for x in sizes:
            own = index[at : at + len(x)]
            at += len(x)
            counts.append(squeeze(size[own].astype(np.uint32)))
            ids.append(squeeze(flat[_spread(size[own], begin[own])]))
        return pa.table({"block": rows["block"], "part": rows["part"], "counts": pa.array(counts, pa.binary()), "ids": pa.array(ids, pa.binary())})

    def join_ids(rows: pa.Table, encoded: pa.Table) -> pa.Table:
        rows = unpacked(rows)
        chunk, chunk_words = _listed(rows)
        number: dict[str, int] = {}
        codes, cuts = [], [0]  # words of each distinct chunk
        for words in chunk_words:
            codes += [number.setdefault(w, len(number)) for w in words]
            cuts.append(len(codes))
        codes, cuts = np.array(codes, np.int64), np.array(cuts)
        _, order, parts, bounds = _parted(number, n)
        encoded = encoded.sort_by("part")
        counts = [unsqueeze(x.as_buffer(), np.uint32) for x in encoded["counts"]]
        if encoded["part"].to_pylist() != parts.tolist() or [len(x) for x in counts] != np.diff(bounds).tolist():
            raise ValueError(f"{sum(map(len, counts))} of {len(number)} words of a block were encoded")
        size = np.zeros(len(number), np.int64)
        begin = np.zeros(len(number), np.int64)
        every = np.concatenate([np.zeros(0, np.uint32), *counts]).astype(np.int64)
        size[order], begin[order] = every, np.cumsum(every) - every
        flat = np.concatenate([np.zeros(0, "<u4"), *(unsqueeze(x.as_buffer(), np.uint32) for x in encoded["ids"])]).astype("<u4")
        del number, encoded, counts
        # Ids of each distinct chunk, one after another; a text is a run of chunks.
        own = size[codes]
        flat = flat[_spread(own, begin[codes])]
        at = np.r_[0, np.cumsum(own)][cuts]
        size, begin = np.diff(at), at[:-1]
        chunks, get = _chunker(), chunk.__getitem__
        text_of = _decoder(tokenizer_path) if decoded else None
        out, lengths, texts = [], [], []
        for text in rows["text"]:
            text = text.as_py()
            c = np.fromiter(map(get, chunks(text)), np.int64) if text else np.zeros(0, np.int64)
            ids = flat[_spread(size[c], begin[c])]
            out.append(ids.tobytes())
            lengths.append(len(ids))
            if decoded:
                texts.append(text_of(ids))
        more = {"decoded": pa.array(texts, pa.string())} if decoded else {}
        return pa.table({"doc_id": rows["doc_id"], "n_tokens": pa.array(lengths, pa.int64()), "ids": pa.array(out, pa.binary()), **more})

    blocked = dealt(docs, n)
    words = blocked.groupBy("block").applyInArrow(lambda rows: _tidied(list_words, rows), "part int, block int, words binary, sizes binary")
    encoded = words.groupBy("part").applyInArrow(lambda rows: _tidied(encode_words, rows), "block int, part int, counts binary, ids binary")
    fields = f"doc_id {id_type}, n_tokens long, ids binary" + ", decoded string" * decoded
    return blocked.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(lambda left, right: _tidied(join_ids, left, right), fields)


def encode(docs: DataFrame, tokenizer_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    return _encode(docs, tokenizer_path, block_chars, decoded=False)


def round_trip(docs: DataFrame, tokenizer_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`decode(encode(docs))` in one Python worker for each task instead of two."""
    return _encode(docs, tokenizer_path, block_chars, decoded=True)


@functools.lru_cache(maxsize=1)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces' bytes, and where each id's begin."""
    tokenizer = _tokenizer(path)
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    to_byte = {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items()}
    size = tokenizer.get_vocab_size()
    pieces = [(t.encode() if i in special else bytes(to_byte[c] for c in t)) if (t := tokenizer.id_to_token(i)) is not None else b"" for i in range(size)]
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])


def _decoder(path: str):
    data, begin = _pieces(path)
    size = np.diff(begin)
    return lambda ids: data[_spread(size[ids], begin[ids])].tobytes().decode("utf-8", "replace")


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """Add `decoded`, the text of `ids`; bytes that are no UTF-8 become U+FFFD. Null ids are none."""
    keep = [c for c in tokens.columns if c != "decoded"]
    tokens = tokens.select(*keep)
    at_ids = keep.index("ids")

    def run(batches):
        text_of = _decoder(tokenizer_path)
        for batch in batches:
            out = [text_of(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(at_ids)]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*keep, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(tidy(run), f"{fields}, decoded string")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
