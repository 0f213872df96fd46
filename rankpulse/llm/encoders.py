"""Vocabulary encoders that work on the distinct chunks of a batch of texts.

A chunk lies between two places that no token of the vocabulary can cross, so the ids of a text are the ids of its chunks in
order. Arrow splits a batch and finds its distinct chunks; only those that this worker has not met lately are encoded. Texts
whose white space makes such places unsure are encoded whole. Memory is bounded by `SLICE` characters of text and by two
generations of `CACHE` chunks a worker; chunks over `LONG` characters are never kept.
"""

from __future__ import annotations

import base64
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4_000_000
CACHE = 150_000
LONG = 64
#: White space other than the space and the line feed, as Unicode has it.
ODD_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0  -     　"
#: Stands before the first chunk of a byte-level text, which has no space before it.
FIRST = "\x01"


class Cache:
    """Two generations of chunk -> value: what is used again moves to the young one, the old one is dropped."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = CACHE):
        self.encode, self.limit = encode, limit
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def values(self, chunks: list[str]) -> list:
        out = list(map(self.young.get, chunks))
        gaps = [i for i, v in enumerate(out) if v is None]
        if gaps:
            names = [chunks[i] for i in gaps]
            found = list(map(self.old.get, names))
            missing = [k for k, v in enumerate(found) if v is None]
            if missing:
                for k, v in zip(missing, self.encode([names[k] for k in missing]), strict=True):
                    found[k] = v
            for i, v in zip(gaps, found, strict=True):
                out[i] = v
            self.young.update((n, v) for n, v in zip(names, found, strict=True) if len(n) <= LONG)
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
        return out


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a column of strings, nulls as empty texts, of about limit bytes each (one text at least)."""
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, column.slice(start, stop - start)
        start = stop


def chunked(part: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks between single spaces, the chunk numbers in order, and where each text starts among them."""
    lists = pc.split_pattern(part, " ")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    words = lists.flatten().dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


class ChunkEncoder:
    """Base: split() says how a text becomes chunks, encode() encodes chunks, whole() encodes a text on its own.

    Values are packed bytes; packed() gives those of each text, one after the other.
    """

    #: Texts that match, after split's replacements, are encoded whole.
    unsure: str | None = None

    def __init__(self):
        self.cache = Cache(self.encode)

    def split(self, part: pa.Array) -> pa.Array:
        raise NotImplementedError

    def encode(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def packed(self, part: pa.Array) -> Iterator[memoryview | bytes]:
        """The value of each text of a part."""
        cut = self.split(part)
        odd = pc.match_substring_regex(cut, self.unsure).to_numpy(zero_copy_only=False) if self.unsure else np.zeros(len(part), bool)
        if odd.any():
            cut = pc.if_else(pa.array(odd), "", cut)
        distinct, numbers, starts = chunked(cut)
        values = pa.array(self.cache.values(distinct), pa.binary()).take(pa.array(numbers))
        data, offsets = values.buffers()[2], np.frombuffer(values.buffers()[1], np.int32)
        raw, ends = memoryview(data or b""), offsets[starts].tolist()
        for i, strange in enumerate(odd.tolist()):
            yield self.whole(part[i].as_py()) if strange else raw[ends[i] : ends[i + 1]]

    def each(self, column: pa.Array) -> Iterator[memoryview | bytes]:
        """The value of each text of a column of any length."""
        for _, part in slices(column):
            yield from self.packed(part)


# --- a sentencepiece model out of a vocabulary ------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """A protobuf field: an int as varint, a float as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def bpe_model(pieces: list[str]) -> bytes:
    """A serialised sentencepiece BPE model: piece i has id i and score -i, text is taken as it is.

    The unknown piece follows the pieces; every character of what is encoded must be a piece, so it never shows.
    """
    normal, unknown, bpe, none = 1, 2, 2, -1
    entries = [_field(1, _field(1, p.encode()) + _field(2, -float(i)) + _field(3, normal)) for i, p in enumerate(pieces)]
    entries.append(_field(1, _field(1, "<unk>".encode()) + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(k, none) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(entries) + _field(2, trainer) + _field(3, normalizer)


def byte_characters(first: int = 0x100) -> list[str]:
    """A printable character for each byte: the 188 visible Latin-1 ones stand for themselves, the others follow from `first`."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(first, first + 256))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Pieces:
    """Encodes strings of byte characters by a model of bpe_model()."""

    def __init__(self, pieces: list[str]):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=bpe_model(pieces))

    def ids(self, strings: list[str]) -> list[list[int]]:
        return self.processor.encode(strings, num_threads=1)


class RankedBytes(ChunkEncoder):
    """Byte-level BPE by a rank file: matches of `pattern` are encoded one by one. Values are packed uint32 ids."""

    unsure = f"  |\n \n|[{ODD_SPACE}]|.{FIRST}|\n{FIRST}"

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("the ranks aren't 0, 1, 2 and so on")
        self.ranks = ranks
        self.characters = byte_characters()
        self.table = {b: self.characters[b] for b in range(256)}
        self.tokens = pa.array(sorted(ranks, key=ranks.get), pa.binary())
        mapped = [x.as_py().decode("latin-1").translate(self.table) for x in self.tokens]
        self.pieces = Pieces(mapped)
        self.match = regex.compile(pattern).findall
        self.words = Cache(self._ids)
        super().__init__()

    def split(self, part: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise(FIRST, pc.replace_substring(part, "\n", " \n"), "")

    def _ids(self, words: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens; one that is a token as a whole needs no merges."""
        out, rest = [None] * len(words), []
        for i, w in enumerate(words):
            raw = w.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                out[i] = struct.pack("<I", rank)
            else:
                rest.append((i, raw.decode("latin-1").translate(self.table)))
        for (i, _), ids in zip(rest, self.pieces.ids([x for _, x in rest]) if rest else [], strict=True):
            out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, chunks: list[str]) -> list[bytes]:
        found = [self.match(c[1:] if c[:1] == FIRST else c if c[:1] == "\n" else f" {c}") for c in chunks]
        values, at, out = self.words.values([w for f in found for w in f]), 0, []
        for f in found:
            out.append(b"".join(values[at : at + len(f)]))
            at += len(f)
        return out

    def whole(self, text: str) -> bytes:
        return b"".join(self.words.values(self.match(text)))

    def decode(self, ids: np.ndarray) -> memoryview | bytes:
        """The bytes of ids, by the inverse of the vocabulary."""
        out = self.tokens.take(pa.array(ids))
        offsets = np.frombuffer(out.buffers()[1], np.int32)
        return memoryview(out.buffers()[2] or b"")[offsets[0] : offsets[len(ids)]] if len(ids) else b""


class ByteLevel:
    """Ids of a byte-level `tokenizers` file, packed uint32, by tiktoken with the same vocabulary as a rank file.

    tiktoken takes whole texts and keeps nothing between them. Texts that hold a special string of the file, whose ids stand for it
    there, and those that tiktoken's pattern gives up on (very long white space) go to the `tokenizers` library. Without specials
    those strings are plain text.
    """

    def __init__(self, path: str, ranks: str, pattern: str, specials: bool = True):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.path, self.tokenizer, self.known = path, None, known
        marks = [t["content"] for t in spec["added_tokens"]]
        self.marks = marks if specials else []
        plain = {k: v for k, v in spec["model"]["vocab"].items() if k not in marks}
        table = {b: c for b, c in enumerate(byte_characters())}
        if len(plain) != len(known) or any(plain.get(k.decode("latin-1").translate(table)) != v for k, v in known.items()):
            raise ValueError("the two files don't hold the same vocabulary")
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def each(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column, nulls as empty texts."""
        for text in column.to_pylist():
            yield self.packed(text or "")

    def packed(self, text: str) -> bytes:
        if any(m in text for m in self.marks):
            return self.whole(text)
        try:
            return self.coder.encode_to_numpy(text, disallowed_special=()).tobytes()
        except ValueError:  # the pattern's stack
            return self.whole(text)

    def whole(self, text: str) -> bytes:
        from tokenizers import Tokenizer

        if self.tokenizer is None:
            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = not self.marks
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def tokens(self) -> pa.Array:
        """The bytes of each id."""
        return pa.array(sorted(self.known, key=self.known.get), pa.binary())


class WordEnds(ChunkEncoder):
    """Ids of a `tokenizers` file whose BPE marks word ends and whose pre-tokens hold no white space, packed as uint16.

    A word's last byte gets a character of its own, which stands for the byte with the end mark, so that the vocabulary
    serves as a sentencepiece model. Chunks with special strings go to the library.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not all("<" in m for m in self.marks):
            raise ValueError("a special string has no <")
        spec = json.loads(self.tokenizer.to_str())
        self.match = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        end, self.characters = spec["model"]["end_of_word_suffix"], byte_characters()
        last = {c: chr(0xE000 + b) for b, c in enumerate(self.characters)}
        self.final = [last[c] for c in self.characters]
        vocabulary = {v: k for k, v in spec["model"]["vocab"].items() if k not in self.marks}
        if sorted(vocabulary) != list(range(len(vocabulary))) or len(vocabulary) > 65536:
            raise ValueError("the ids aren't 0, 1, 2 and so on, of 16 bits")
        pieces = [vocabulary[i] for i in range(len(vocabulary))]
        self.pieces = Pieces([p[: -len(end) - 1] + last[p[-len(end) - 1]] if p.endswith(end) and len(p) > len(end) else p for p in pieces])
        self.table = {b: self.characters[b] for b in range(256)}
        super().__init__()

    def split(self, part: pa.Array) -> pa.Array:
        return pc.replace_substring(part, "\n", " ")

    def encode(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(chunks)
        words: list[str] = []
        count = [1] * len(chunks)
        final, match, table = self.final, self.match, self.table
        for i, c in enumerate(chunks):
            if c.isascii():
                plain = c.lower()
                if plain.isalpha():
                    words.append(plain[:-1] + final[ord(plain[-1])])  # letters stand for themselves
                    continue
                if "<" in c and any(m in c for m in self.marks):
                    out[i], count[i] = self.whole(c), 0
                    continue
                found = match(plain)
                words += [w[:-1].translate(table) + final[ord(w[-1])] for w in found]
            else:
                if "<" in c and any(m in c for m in self.marks):
                    out[i], count[i] = self.whole(c), 0
                    continue
                plain = "".join([x.lower() for x in unicodedata.normalize("NFC", c)])
                found = [plain] if plain.isalpha() else match(plain)
                for w in found:
                    raw = w.encode("utf-8", "surrogatepass")
                    words.append(raw[:-1].decode("latin-1").translate(table) + final[raw[-1]])
            count[i] = len(found)
        ids, at = self.pieces.ids(words) if words else [], 0
        for i, n in enumerate(count):
            if n == 1:
                out[i] = array("H", ids[at]).tobytes()
            elif out[i] is None:
                out[i] = array("H", chain.from_iterable(ids[at : at + n])).tobytes()
            at += n
        return out

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)


class PieceCounts(ChunkEncoder):
    """Token counts of a sentencepiece BPE file, packed as one uint32 a chunk.

    Exact as no piece holds the space mark after another character; else, or where the model changes text, texts go whole.
    """

    unsure = "  |^ | $|▁"

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        plain = self.processor.encode("\nx a  b", out_type=str)
        self.splits = not any("▁" in n.lstrip("▁") or ("\n" in n and len(n) > 1) for n in names) and "".join(plain).count("▁") == 4
        super().__init__()

    def split(self, part: pa.Array) -> pa.Array:
        return pc.replace_substring(part, "\n", " \n")

    def encode(self, chunks: list[str]) -> list[bytes]:
        return [struct.pack("<I", max(0, len(x) - (c[:1] == "\n"))) for c, x in zip(chunks, self.processor.encode(chunks, num_threads=1), strict=True)]

    def whole(self, text: str) -> bytes:
        return struct.pack("<I", len(self.processor.encode(text, num_threads=1)))

    def counts(self, column: pa.Array) -> list[int]:
        if not self.splits:
            return [len(x) for _, part in slices(column) for x in self.processor.encode(part.to_pylist(), num_threads=1)]
        return [int(np.frombuffer(x, "<u4").sum()) for x in self.each(column)]


class PieceIds(PieceCounts):
    """Ids of a sentencepiece BPE file, packed uint32."""

    def encode(self, chunks: list[str]) -> list[bytes]:
        # a chunk that starts with a line feed has no space before it in the text: the mark it got goes
        found = self.processor.encode(chunks, num_threads=1)
        return [array("I", x[1:] if c[:1] == "\n" else x).tobytes() for c, x in zip(chunks, found, strict=True)]

    def whole(self, text: str) -> bytes:
        return array("I", self.processor.encode(text, num_threads=1)).tobytes()

    def each(self, column: pa.Array) -> Iterator[memoryview | bytes]:
        if self.splits:
            return super().each(column)
        return (self.whole(t or "") for t in column.to_pylist())

    def tokens(self) -> pa.Array:
        """The bytes of each id: the space mark is a space, a byte piece its byte."""
        p, out = self.processor, []
        for i in range(p.get_piece_size()):
            name = p.id_to_piece(i)
            out.append(bytes([int(name[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) or p.is_unknown(i) else name.replace("▁", " ").encode())
        return pa.array(out, pa.binary())


_ENCODERS: dict[tuple, object] = {}


def shared(make: Callable, *args):
    """One encoder a Python worker, with its cache; workers are used again by later tasks."""
    key = (make, *args)
    if key not in _ENCODERS:
        _ENCODERS[key] = make(*args)
    return _ENCODERS[key]
