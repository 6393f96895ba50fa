"""Byte-level BPE through a sentencepiece model serialised straight from a rank vocabulary.

Each token's bytes are written as one printable character a byte, its score is the negative rank, and
normalisation is the identity, so sentencepiece's "highest score first" merges are the rank merges.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import lean

#: Pre-tokens, and stretches between single spaces, that a Python worker remembers at most, and their longest.
REMEMBERED = 150_000
LONGEST = 64
#: Characters of texts whose new stretches are encoded in one call.
GROUP = 1_000_000


def byte_characters() -> list[str]:
    """One character for each byte: itself where it is printable Latin-1, else one from U+0100 on, in byte order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a rank file (base64 token and rank on each line)."""
    by_rank = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                by_rank[int(rank)] = base64.b64decode(token)
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError("the ranks must be 0, 1, 2, ... without gaps")
    return [by_rank[k] for k in range(len(by_rank))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is <unk>, piece k + 1 is the token of rank k."""
    chars = byte_characters()
    # ModelProto: 1 pieces (1 piece, 2 score, 3 type), 2 trainer (3 model type, 4 size, 40 unk id), 3 normaliser
    unknown, normal, bpe = 2, 1, 2
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        if piece == b"<unk>":
            raise ValueError("the vocabulary has a token that is spelled <unk>")
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal)))
    out.append(_field(2, _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, 0)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


#: Characters of every kind that a pattern may tell apart, around single spaces.
_PROBES = [f"{a}{b} {c}{d}" for a in "aÉ9².'_日" for b in "aÉ9².'_日" for c in "aÉ9².'_日" for d in "sÉ9².'_日"]


def _cut_at_spaces(split, text: str) -> bool:
    """Whether the pattern's pre-tokens make up the text, and a single space inside it opens one of them."""
    pieces = split(text)
    left, right = text.split(" ")
    return "".join(pieces) == text and pieces == split(left) + split(" " + right)


class Codec:
    """Encodes pre-tokens with the serialised model and decodes ids by the inverse byte mapping."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self._split = regex.compile(pattern).findall
        #: Whether a single space between two words always opens a pre-token, so that stretches can be looked up apart.
        self._apart = all(_cut_at_spaces(self._split, text) for text in _PROBES)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._chars = dict(enumerate(byte_characters()))
        self._whole = {token: rank for rank, token in enumerate(tokens)}
        inverse = {ord(c): b for b, c in self._chars.items()}
        self._raw = [self._model.id_to_piece(k + 1).translate(inverse).encode("latin-1") for k in range(len(tokens))]
        self._shown = [b"%d" % k for k in range(len(tokens))]
        self._pre: dict[str, tuple[bytes, bytes]] = {}
        self._stretches: dict[str, tuple[bytes, bytes]] = {}

    def _learn(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """Ids and decoded bytes of each text's pre-tokens; the model gets all new pre-tokens in one call."""
        split = [self._split(text) for text in texts]
        if len(self._pre) > REMEMBERED:
            self._pre.clear()
        known, fresh = self._pre, {}
        rest, spelled = [], []
        for pre in {p for pieces in split for p in pieces if p not in known}:
            raw = pre.encode()
            # a pre-token that is itself a token gets its id even where merges would not reach it
            if (rank := self._whole.get(raw)) is not None:
                fresh[pre] = self._shown[rank], self._raw[rank]
            else:
                rest.append(pre)
                plain = pre.isascii() and pre.isprintable()
                spelled.append(pre.replace(" ", self._chars[32]) if plain else raw.decode("latin-1").translate(self._chars))
        if rest:
            for pre, ids in zip(rest, self._model.encode(spelled, out_type=int, num_threads=1), strict=True):
                ids = [k - 1 for k in ids]
                fresh[pre] = b" ".join([self._shown[k] for k in ids]), self.decode(ids)
        out = [[known[p] if p in known else fresh[p] for p in pieces] for pieces in split]
        known.update(fresh if max(map(len, rest), default=0) <= LONGEST else {p: x for p, x in fresh.items() if len(p) <= LONGEST})
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self._raw[k] for k in ids])

    def run(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text, the ids as decimal text with single spaces, and the bytes decoded from them.

        No pre-token spans a single space between two characters that are no white space, other than as its
        first character: so the stretches between such spaces are looked up, and new ones of all texts encoded at once.
        """
        if not self._apart:
            yield from map(_joined, self._learn(texts))
            return
        seen = self._stretches
        if len(seen) > REMEMBERED:
            seen.clear()
        split = [text.split(" ") for text in texts]
        firsts = self._learn([parts[0] for parts in split])
        known = [list(map(seen.get, parts)) for parts in split]
        new = {p for parts, rows in zip(split, known, strict=True) if None in rows for p, row in zip(parts, rows, strict=True) if row is None}
        apart = [p for p in new if p and len(p) <= LONGEST and not p[0].isspace() and not p[-1].isspace()]
        seen.update((p, _joined(x)) for p, x in zip(apart, self._learn([" " + p for p in apart]), strict=True))
        for parts, rows, first in zip(split, known, firsts, strict=True):
            rows = list(map(seen.get, parts)) if None in rows else rows
            rows[0] = _joined(first)
            if None in rows or not parts[0] or parts[0][-1].isspace():
                rows = self._run_apart(parts)
            yield _joined(rows)

    def run_all(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """run() over stretches of about GROUP characters of texts; null counts as empty."""
        group, chars = [], 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars > GROUP:
                yield from self.run(group)
                group, chars = [], 0
        yield from self.run(group)

    def _run_apart(self, parts: list[str]) -> list[tuple[bytes, bytes]]:
        """As run() does, where some stretches touch other white space or are long."""
        stretches, now = [], [parts[0]]
        for part in parts[1:]:
            before = now[-1]
            if part and not part[0].isspace() and before and not before[-1].isspace():
                stretches.append(" ".join(now))
                now = ["", part]
            else:
                now.append(part)
        stretches.append(" ".join(now))
        seen = self._stretches
        known = [seen.get(s[1:]) if s[:1] == " " else None for s in stretches]
        rest = self._learn([s for s, row in zip(stretches, known, strict=True) if row is None])
        learned = iter([_joined(x) for x in rest])
        return [row or next(learned) for row in known]

    def encode(self, text: str) -> list[int]:
        return [int(k) for k in next(self.run([text]))[0].split()]


def _joined(rows: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """Of consecutive stretches, of which only one that is alone may be empty."""
    if len(rows) < 2:
        return rows[0] if rows else (b"", b"")
    ids, raw = zip(*rows, strict=True)
    return b" ".join(ids), b"".join(raw)


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, one row for each input row.

    A map without a shuffle; a worker holds the vocabulary (fixed size) and a bounded memory of pre-tokens.
    Null and empty texts have no tokens (the hash of nothing). Null ids stay null, repeated rows stay repeated,
    other columns are not read, an empty table gives an empty result. ``vocabulary`` is read on the driver.
    """
    tokens = read_ranks(vocabulary)
    model = serialise_model(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, tokens, pattern)
        gc.freeze()  # what is remembered holds no cycles; else each collection would walk all of it
        gc.disable()
        try:
            for batch in batches:
                counts, ids_hash, decoded_hash = [], [], []
                for ids, decoded in codec.run_all(batch.column(1).to_pylist()):
                    counts.append(ids.count(b" ") + 1 if ids else 0)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    decoded_hash.append(hashlib.sha256(decoded).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        finally:  # the worker serves other tasks after this one
            gc.enable()
            gc.unfreeze()

    slim = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(lean(run), SCHEMA)
