"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library does the encoding. Its pre-tokens never cross a space that
a non-space follows, so a text is cut there and each distinct unit of a worker is
encoded once, in a cache that starts anew when it is full; long units are not kept.
Before that it is cut at line ends between non-spaces. Units of Latin letters and ASCII
marks are two pre-tokens at most, each looked up on its own, and go straight to the
library's BPE model; all other units go through its whole pipeline, as do whole texts where the
tokenizer is not known to cut at spaces.
Decoding joins the bytes of the ids; characters that tokens split come together
again in the bytes, and ``errors="replace"`` handles what stays incomplete.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Memory that a worker's cache takes at most, about; what a unit takes besides its characters;
#: characters of the longest unit that is kept; documents that are looked at together.
CACHE_BYTES, UNIT_BYTES, KEPT_CHARS = 192 << 20, 160, 256
DOCS_AT_ONCE = 128
#: Splits text as GPT-2 does; a fixed value that the ranks file goes with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Letters in every version of Unicode, then marks that are neither letters, digits, spaces nor apostrophes.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]*)")
_LINE_END = re.compile(r"(?<=\S)\n(?=\S)")
_UNSURE = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _parts(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """What merges of rank under ``below`` make of the bytes of a token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def tokenizer_from_ranks(path: str, pattern: str = PATTERN):
    """A tokenizers object with the ranks of a tiktoken file: the merge that makes a
    token is the pair that the lower ranks leave of it."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, spelt = read_ranks(path), byte_alphabet()
    text = {t: "".join(spelt[b] for b in t) for t in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = _parts(token, ranks, rank)
            if len(parts) == 2:
                merges.append((text[parts[0]], text[parts[1]]))
    made = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return made


_SHORT = [struct.Struct(f"<{n}I").pack for n in range(16)]


def pack(ids: list[int]) -> bytes:
    return _SHORT[len(ids)](*ids) if len(ids) < 16 else array("I", ids).tobytes()


class _Units(dict):
    """Ids of units, each encoded when it is first asked for."""

    def __init__(self, encoder: Encoder, lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, unit: str) -> bytes:
        plain = None if unit.isalpha() else _PLAIN.fullmatch(unit)
        if plain and plain[2]:  # often the letters are known without these marks
            got = self[plain[1]] + self.encoder.first[plain[2]]
        else:
            got = self.encoder.encode_unit(self.lead, unit)
        if len(unit) <= KEPT_CHARS:
            self[unit] = got
            self.encoder.cached += UNIT_BYTES + 2 * len(unit) + len(got)
        return got


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    ``path``: a tokenizers ``.json`` (special strings in texts become their ids,
    the library's default) or a ``.tiktoken`` ranks file (no special strings).
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.specials: dict[str, int] = {}
        if path.endswith(".tiktoken"):
            self.tokenizer, self.cut = tokenizer_from_ranks(path), True
        else:
            self.tokenizer = Tokenizer.from_file(path)
            spec = json.loads(self.tokenizer.to_str())
            pre = spec["pre_tokenizer"] or {}
            plain = all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in spec["added_tokens"])
            self.cut = (
                spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
                and plain and len(spec["added_tokens"]) <= 1
            )
            self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.model = self.tokenizer.model
        self.cache_bytes, self.cached = cache_bytes, 0
        self.after_space, self.first = _Units(self, " "), _Units(self, "")
        alphabet = byte_alphabet()
        self.spell = str.maketrans({chr(b): c for b, c in alphabet.items()})
        self.space = alphabet[32]
        self.line_end = array("I", self.tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()

    def encode_unit(self, lead: str, unit: str) -> bytes:
        if unit.isascii() and unit.isalpha():
            return pack([x.id for x in self.model.tokenize(self.space + unit if lead else unit)])
        plain = _PLAIN.fullmatch(unit)
        if plain is None:
            head, *lines = _LINE_END.split(unit)
            if lines:  # a line end between non-spaces is a pre-token of its own
                return self.line_end.join([(self.after_space if lead else self.first)[head], *map(self.first.__getitem__, lines)])
            return pack(self.tokenizer.encode(lead + unit, add_special_tokens=False).ids)
        letters, marks = plain.groups()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.spell)
        found = self.model.tokenize(self.space + letters if lead else letters)
        if marks:
            found += self.model.tokenize(marks)
        return pack([x.id for x in found])

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens as ``segments`` gives them, with the space before them if any."""
        out = []
        for p in pieces:
            self.make_room()
            out.append(self.encode_unit(" ", p[1:]) if p[:1] == " " else self.encode_unit("", p))
        return out

    def make_room(self) -> None:
        if self.cached > self.cache_bytes:
            self.forget()

    def forget(self) -> None:
        self.after_space.clear()
        self.first.clear()
        self.cached = 0

    def segments(self, text: str) -> list[tuple[list[str], int | None]]:
        """Units of each stretch between special strings, with the id that ends it.
        The first unit of a stretch stands alone, a space goes before each other."""
        return [(self.units(p), number) for p, number in self._stretches(text)]

    def _stretches(self, text: str) -> list[tuple[str, int | None]]:
        out = []
        rest = text
        for special, number in self.specials.items():
            if special in rest:
                *parts, rest = rest.split(special)
                out += [(p, number) for p in parts]
        return [*out, (rest, None)]

    @staticmethod
    def units(text: str) -> list[str]:
        return _CUT.split(text) if _UNSURE.search(text) else text.split(" ")

    @staticmethod
    def lines(text: str) -> list[str]:
        """The text cut at line ends between non-spaces."""
        found = text.split("\n")
        if all(x and not (x[0].isspace() or x[-1].isspace()) for x in found):
            return found
        return _LINE_END.split(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.cut:
            whole = (self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts)
            return [array("I", ids).tobytes() for ids in whole]
        out = []
        for text in texts:
            self.make_room()
            parts = []
            for stretch, number in self._stretches(text or ""):
                for line in self.lines(stretch):
                    head, *units = self.units(line)
                    if head:
                        parts.append(self.first[head])
                    parts += map(self.after_space.__getitem__, units)
                    parts.append(self.line_end)
                parts[-1] = b"" if number is None else pack([number])
            out.append(b"".join(parts))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


@lru_cache(maxsize=2)
def byte_table(path: str) -> list[bytes]:
    """Bytes of each id of a tiktoken ranks file."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, memoryview(ids).cast("I")))


def char_offsets(ids: bytes, table: list[bytes]) -> list[tuple[int, int]]:
    """Start and end of each token in code points; a token that holds a part of a
    character covers that character."""
    raw = decode(ids, table)
    at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum([len(table[i]) for i in memoryview(ids).cast("I")])
    starts = ends - [len(table[i]) for i in memoryview(ids).cast("I")]
    return [(int(at[s]), int(at[e - 1]) + 1) for s, e in zip(starts, ends, strict=True)]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = DOCS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32-bit), and with ``with_offsets``
    (for a ranks file) ``starts, ends`` of each token in code points; a token that holds a
    part of a character covers that character. Null texts have no ids. Rows are
    independent and no row moves."""

    def run(batches):
        for b in small_batches(batches):
            ids = encoder(path).encode(b.column(1).to_pylist())
            columns = {"doc_id": b.column(0), "ids": pa.array(ids, pa.binary())}
            if with_offsets:
                found = [char_offsets(x, byte_table(path)) for x in ids]
                columns |= {name: pa.array([[o[i] for o in each] for each in found], pa.list_(pa.int32())) for i, name in enumerate(("starts", "ends"))}
            yield pa.RecordBatch.from_pydict(columns)

    kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary" + ", starts array<int>, ends array<int>" * with_offsets
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; incomplete characters become U+FFFD."""

    def run(batches):
        table = byte_table(path)
        for b in small_batches(batches):
            texts = [decode(x or b"", table).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep_units: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``:
    encode, then decode the ids. Null texts count as empty; rows are independent. Without
    ``keep_units`` a worker's cache is emptied after each task, for what runs there next."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches):
        enc, table = encoder(path), byte_table(path)
        for b in small_batches(batches):
            ids = enc.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(decode(x, table)).hexdigest() for x in ids], pa.string()),
                    *[pa.array(ids, pa.binary())] * with_ids,
                ],
                names,
            )
        if not keep_units:
            enc.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    )
