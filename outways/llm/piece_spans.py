"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

A text is first normalised by longest-prefix matches in the model's compiled character map (a double-array
trie over UTF-8 bytes, each leaf naming a replacement; a model without a map leaves characters as they
are). Each normalised character remembers the byte of the original at which what it came from begins. The
library then merges the normalised text, its own normalisation switched off, and each piece is
projected through that alignment to a span of original bytes. The spans of a text meet end to end; a character of several
byte pieces belongs to the last of these, as in the library.

Spark deals the rows; nothing is shuffled. A task cuts normalised texts before each run of spaces,
as no piece of such models reaches over one, and remembers the pieces of at most ``KNOWN`` stretches
(the later half gives way to new ones); a model with pieces across spaces gets whole texts.

Cases: null and empty texts have no piece and decode to the empty text. Repeated rows and ids are encoded
once per row. An empty table gives an empty result. Texts without any space are one stretch. Other
columns are passed over, whatever their names. Byte pieces that are no UTF-8 decode to U+FFFD each.
"""

from __future__ import annotations

import codecs
import itertools
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Stretches remembered by a task.
KNOWN = 400_000
#: Bytes of text encoded before a batch of rows is handed on.
BATCH_BYTES = 4_000_000
#: Fixed values of the model format: fields of its messages and kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message; values of four or eight bytes stay bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled map, with the source of each normalised character."""

    def __init__(self, compiled: bytes, dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True):
        self.dummy_prefix, self.squeeze, self.space = dummy_prefix, squeeze, SPACE if escape else " "
        self.units, self.replacements = None, b""
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
            self.replacements = compiled[4 + size :]
        self.seen: dict[str, str | None] = {}

    def longest(self, source: bytes, start: int) -> tuple[int, str] | None:
        """(bytes matched, replacement) of the longest entry that ``source`` has at ``start``."""
        units, found = self.units, None
        # A unit holds its label in the low byte, bit 8 for a leaf below it, bit 9 for a wide offset, and the offset.
        step = lambda unit: (unit >> 10) << ((unit >> 6) & 8)
        place = step(units[0])
        for at in range(start, len(source)):
            place ^= source[at]
            if place >= len(units) or units[place] & 0x800000FF != source[at]:
                break
            unit = units[place]
            place ^= step(unit)
            if unit >> 8 & 1:
                found = at + 1 - start, units[place] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])].decode()

    def mapped(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the byte of ``text`` it comes from."""
        source = text.encode()
        firsts = np.flatnonzero((np.frombuffer(source, "u1") & 0xC0) != 0x80)
        if self.units is None and not self.squeeze:
            if not text:
                return "", np.zeros(1, "i8")
            out = text.replace(" ", self.space)
            if self.dummy_prefix:
                return self.space + out, np.concatenate([[0], firsts, [len(source)]])
            return out, np.append(firsts, len(source))
        parts, origins = [], []
        at = 0
        while at < len(source):
            match = self.longest(source, at) if self.units is not None else None
            if match is None:
                width = 1 + (source[at] >= 0xC0) + (source[at] >= 0xE0) + (source[at] >= 0xF0)
                match = width, source[at : at + width].decode()
            for char in match[1]:
                parts.append(char)
                origins.append(at)
            at += match[0]
        if self.squeeze:
            # Spaces at both ends go, and of a run the first stays; at the end, the sign for a space is one.
            kept = [i for i, c in enumerate(parts) if c != " " or (i and parts[i - 1] != " ")]
            while kept and parts[kept[-1]] in (" ", self.space):
                at = origins[kept.pop()]
            parts, origins = [parts[i] for i in kept], [origins[i] for i in kept]
        if not parts:
            return "", np.zeros(1, "i8")
        out = "".join(parts).replace(" ", self.space)
        if self.dummy_prefix:
            out, origins = self.space + out, [origins[0], *origins]
        return out, np.array([*origins, at], "i8")


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("outways-each-byte", _each_byte)


class Pieces:
    """A BPE model read from a SentencePiece model file: its character map, its pieces and its merges.

    The library merges stretches of normalised text; its own normalisation is switched off, so that
    every character of a piece is one of the normalised text, whose source is known.
    """

    def __init__(self, model: str | None = None):
        from sentencepiece import SentencePieceProcessor

        if model is None:
            import public_tokenizers

            model = public_tokenizers.path(MODEL)
        with open(model, "rb") as f:
            whole = f.read()
        parts = list(fields(whole))
        trainer, normalizer = (dict(fields(b"".join(v for k, v in parts if k == n))) for n in (TRAINER, NORMALIZER))
        if trainer.get(3, 1) != BPE:
            raise ValueError("only BPE models are encoded")
        entries = [dict(fields(v)) for k, v in parts if k == PIECES]
        self.texts = [e.get(1, b"").decode() for e in entries]
        self.kinds = [e.get(3, NORMAL) for e in entries]
        if USER_DEFINED in self.kinds:
            raise ValueError("models with user-defined pieces are not encoded")
        self.unknown = self.kinds.index(UNKNOWN)
        self.control = {i for i, kind in enumerate(self.kinds) if kind == CONTROL}
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        dummy_prefix, squeeze, escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        self.strip_first, self.squeezed = dummy_prefix or squeeze, squeeze
        self.map = CharacterMap(normalizer.get(2, b""), dummy_prefix, squeeze, escape)
        # A later message of the same field overrides: no map, no prefix, spaces as they are.
        self.library = SentencePieceProcessor(model_proto=whole + bytes([NORMALIZER << 3 | 2, 8, 0x12, 0, 0x18, 0, 0x20, 0, 0x28, 0]))
        across = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.texts)
        self.stretches = (lambda text: [text] if text else []) if across else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.known: dict[str, bytes] = {}
        # Characters a piece stands for: of a character's bytes, the last; an unknown piece is counted by its text.
        self.chars = np.array([len(t) if k in (NORMAL, UNUSED) else 0 for t, k in zip(self.texts, self.kinds, strict=True)], "i8")
        self.byte = np.array([int(t[3:5], 16) if k == BYTE else -1 for t, k in zip(self.texts, self.kinds, strict=True)])

    def learn(self, stretches: set[str]) -> None:
        """Merge the stretches not known yet, in one call."""
        new = list(stretches - self.known.keys())
        if len(self.known) + len(new) > KNOWN:
            # The first half, met early, holds the frequent ones.
            for old in list(itertools.islice(self.known, KNOWN // 2, None)):
                del self.known[old]
            new = list(stretches - self.known.keys())
        self.known.update(zip(new, (np.array(ids, "<i4").tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}i", *ids) for ids in self.library.encode(new, num_threads=1)), strict=True))

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text: its pieces, and the bytes of the text that each comes from."""
        mapped = [self.map.mapped(text) for text in texts]
        cut = [self.stretches(normal) for normal, _ in mapped]
        self.learn(set(itertools.chain.from_iterable(cut)))
        found = []
        for (normal, origin), stretches in zip(mapped, cut, strict=True):
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, stretches)), "<i4")
            ends = np.cumsum(self.widths(ids, normal, stretches))
            starts = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
            found.append((ids, origin[starts].astype("i4"), origin[ends].astype("i4")))
        return found

    def widths(self, ids: np.ndarray, normal: str, stretches: list[str]) -> np.ndarray:
        """Characters of the normalised text that each piece stands for."""
        chars, byte = self.chars[ids], self.byte[ids]
        # A character's bytes are the first and those that continue it; its last is followed by another character's.
        of_bytes = byte >= 0
        if of_bytes.any():
            follows = np.append(byte[1:], -1)
            chars[of_bytes & ~((follows >= 0x80) & (follows < 0xC0))] = 1
        unknown = ids == self.unknown
        if unknown.any():
            # One piece for neighbouring unknown characters of a stretch: what the others leave of the stretch.
            at = 0
            for stretch in stretches:
                n = len(self.known[stretch]) // 4
                mine = slice(at, at + n)
                lost = np.flatnonzero(unknown[mine])
                if len(lost) == 1:
                    chars[at + lost[0]] = len(stretch) - chars[mine].sum()
                elif len(lost):
                    chars[mine] = [len(p) for p in self.library.encode(stretch, out_type=str)]
                at += n
        return chars

    @cached_property
    def surfaces(self) -> list[bytes]:
        special = {UNKNOWN: self.unknown_text.encode(), CONTROL: b""}
        return [bytes([int(t[3:5], 16)]) if k == BYTE else special.get(k, t.replace(SPACE, " ").encode()) for t, k in zip(self.texts, self.kinds, strict=True)]

    def decoded(self, ids: list[int]) -> str:
        """The text of ``ids``; the space that encoding put before it is taken off."""
        runs = [ids]
        if not self.control.isdisjoint(ids):
            # Bytes on both sides of a control piece make no character.
            runs = [list(run) for apart, run in itertools.groupby(ids, self.control.__contains__) if not apart]
        text = "".join(b"".join(map(self.surfaces.__getitem__, run)).decode(errors="outways-each-byte") for run in runs)
        if not self.strip_first:
            return text
        # Control pieces have no text; what follows them still is the beginning.
        for i in ids:
            if self.kinds[i] == NORMAL and self.texts[i].startswith(SPACE):
                text = text[1:]
                if self.squeezed and len(self.texts[i]) == 1:
                    continue
                break
            if self.kinds[i] != CONTROL:
                break
        return text


@lru_cache(maxsize=2)
def pieces_of(model: str | None) -> Pieces:
    """A task's model; what it has learned serves the worker's later tasks too."""
    return Pieces(model)


ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"
DECODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype("i4")))


def encoded(documents: DataFrame, model: str | None = None, decode: bool = False) -> DataFrame:
    """(doc_id, ids, starts, ends): the pieces of each whole text, and the bytes of the text's UTF-8 form
    that each stands for; with ``decode`` also ``decoded``, the text that these ids decode to. ``model``
    is a path that all executors see; the public one if None."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text")
            sizes = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in texts)])
            cuts = np.flatnonzero(np.diff(sizes[:-1] // BATCH_BYTES, prepend=-1))
            for at, to in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                done = pieces.encoded([t or "" for t in texts[at:to].to_pylist()])
                out = [keys[at:to], *(_lists([d[k] for d in done]) for k in range(3))]
                if decode:
                    out.append(pa.array([pieces.decoded(ids.tolist()) for ids, _, _ in done], pa.string()))
                yield pa.record_batch(out, names=["doc_id", "ids", "starts", "ends", "decoded"][: len(out)])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, DECODED if decode else ENCODED)


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the texts of stored ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            texts = [pieces.decoded(ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []) for ids in batch.column("ids")]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id long, ids array<int>, decoded string")


def round_trip(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes: digests of each text's ids and of what these
    decode to, and the bytes of the text that the pieces' spans cover."""
    return encoded(documents, model, decode=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )
