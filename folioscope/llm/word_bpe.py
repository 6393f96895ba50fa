"""BPE with word ends, merged over a contiguous array of adjacent ranks.

A tokenizer file names its vocabulary, its merges by rank, its special tokens and its normalisation. Each word holds the
boundaries of its parts and the ranks of adjacent parts; the least rank is found by a scan, its boundary deleted and the
neighbouring ranks looked up again. Words too long for repeated scans take a heap of ranks instead, with the same result.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters
from .shared import lean

#: Symbols of a word up to which its ranks are scanned; a scan a merge is quadratic in the word's length.
SCANNED = 64
#: Stretches between white space, and words, that a Python worker remembers at most (twice over), and their longest.
REMEMBERED = 150_000
LONGEST = 64
#: Bytes of rows that go out in one batch.
GROUP = 1_000_000
#: Rank of two parts that no merge joins.
NEVER = 1 << 60

#: Lower-cased letters of ASCII, Latin-1 and Latin Extended-A; what the fixed pre-tokenizer takes from text of these, digits and signs.
_LETTERS = "a-z\xdf-\xf6\xf8-\u017f"
_LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_LATIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+")
#: Python takes these for white space, the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Merges:
    """Merges by the ids of two parts: a * 2**32 + b gives the rank, the rank gives the id of both together."""

    def __init__(self, ids: dict[str, int], pairs: list[tuple[str, str]]):
        self.rank = {ids[a] << 32 | ids[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]

    def scan(self, parts: list[int], bounds: list[int]) -> None:
        """Merge adjacent parts until none of them have a rank: the least rank first, of equal ranks the leftmost.

        parts are ids and bounds where they begin, with the end of the last; both shrink in place.
        """
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != NEVER:
            at = ranks.index(least)
            parts[at] = part = made[least]
            del parts[at + 1], bounds[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 32 | part, NEVER)
            if at < len(ranks):
                ranks[at] = rank(part << 32 | parts[at + 1], NEVER)

    def heap(self, parts: list[int], bounds: list[int]) -> None:
        """As scan(), in time that follows the length: for words of any length."""
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            following = after[at]
            if following < n and (r := self.rank.get(parts[at] << 32 | parts[following])) is not None:
                heapq.heappush(heap, (r, at, parts[at], parts[following]))

        for at in range(n - 1):
            offer(at)
        while heap:
            r, at, left, right = heapq.heappop(heap)
            if parts[at] != left or (gone := after[at]) >= n or parts[gone] != right:  # one of the two has been merged meanwhile
                continue
            parts[at], parts[gone], after[at] = self.made[r], -1, after[gone]
            if after[at] < n:
                before[after[at]] = at
                offer(at)
            if before[at] >= 0:
                offer(before[at])
        kept = [at for at in range(n) if parts[at] >= 0]
        bounds[:] = [*(bounds[at] for at in kept), bounds[-1]]
        parts[:] = [parts[at] for at in kept]


class _Remembered(dict):
    """Rows by text. When full it starts anew, with what it held as the second look-up, so that what is frequent stays."""

    def __init__(self, make):
        super().__init__()
        self._make, self._old = make, {}

    def __missing__(self, text: str) -> tuple[bytes, bytes]:
        row = self._old.get(text) or self._make(text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self._old = dict(self)
                self.clear()
            self[text] = row
        return row


class WordCodec:
    """Ids of a text's words and the text that decoding gives, by a tokenizer file of this kind."""

    def __init__(self, tokenizer: str):
        """tokenizer: the file's text. Raises ValueError for a file of another kind."""
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer)
        model = spec["model"]
        if model["type"] != "BPE" or model["unk_token"] or model["continuing_subword_prefix"] or model["dropout"] or model["byte_fallback"] or model["ignore_merges"] or spec["decoder"]:
            raise ValueError("not a plain BPE tokenizer with word ends")
        end, chars, vocabulary = model["end_of_word_suffix"] or "", byte_characters(), model["vocab"]
        if not all(c + e in vocabulary for c in chars for e in ("", end)):
            raise ValueError("the vocabulary must have every byte, alone and at a word's end")
        self._merges = Merges(vocabulary, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self._inside, self._last = {c: vocabulary[c] for c in chars}, {c: vocabulary[c + end] for c in chars}
        self._packed = {k: struct.pack("<I", k) for k in vocabulary.values()}
        self._shown = {k: token.encode() for token, k in vocabulary.items()}
        self._bytes = dict(enumerate(chars))
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or _WHITE_SPACE.search(t["content"]) for t in spec["added_tokens"]):
            raise ValueError("special tokens must be plain strings without white space")
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        # the file's own normaliser and pre-tokenizer, for what Python's Unicode tables may know otherwise
        rules = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self._normalize, self._pre_tokenize = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        known = [chr(c) for c in range(0x21, 0x180) if _LATIN.fullmatch(chr(c))]
        probes = ["it's", "I'LL", "don't", "THEY'RE", "'d", "'s've", "x_1", "12ab--cd", "a'b''s", "'Sa", "''"] + [a + c + b for c in known for a, b in ("aa", "1É", "!'")]
        self._latin = all(self._split_latin(p) == self._split_any(p) for p in probes)
        self._words, self._stretches = _Remembered(self._word), _Remembered(self._stretch)

    def _split_latin(self, text: str) -> list[str]:
        words = _LATIN_WORDS.findall(text.lower())
        return words if text.isascii() else [w if w.isascii() else w.encode().decode("latin-1").translate(self._bytes) for w in words]

    def _split_any(self, text: str) -> list[str]:
        return [w for w, _ in self._pre_tokenize(self._normalize(text))]

    def parts(self, word: str) -> tuple[list[int], list[int]]:
        """The ids of one pre-tokenised word (in byte characters), and where their parts begin, with the word's end."""
        parts, bounds = [self._inside[c] for c in word[:-1]], [*range(len(word) + 1)]
        parts.append(self._last[word[-1]])
        (self._merges.scan if len(word) <= SCANNED else self._merges.heap)(parts, bounds)
        return parts, bounds

    def _word(self, word: str) -> tuple[bytes, bytes]:
        ids, _ = self.parts(word)
        return b"".join([self._packed[k] for k in ids]), b" ".join([self._shown[k] for k in ids])

    def _stretch(self, stretch: str) -> tuple[bytes, bytes]:
        """Ids and decoded bytes of text without white space."""
        rows, pieces = [], [stretch]
        if self._specials and self._specials.search(stretch):
            pieces = self._specials.split(stretch)
        for k, text in enumerate(pieces):
            if k % 2:
                rows.append((struct.pack("<I", self._special[text]), text.encode()))
            elif text:
                rows += map(self._words.__getitem__, self._split_latin(text) if self._latin and _LATIN.fullmatch(text) else self._split_any(text))
        if len(rows) == 1:
            return rows[0]
        ids, shown = zip(*rows, strict=True)
        return b"".join(ids), b" ".join(shown)

    def run(self, text: str | None) -> tuple[bytes, bytes]:
        """The ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8.

        White space ends every word and composes with nothing, so that stretches between it are looked up apart.
        """
        if not text:
            return b"", b""
        stretches = text.split() if not _SEPARATORS.search(text) else [s for s in _WHITE_SPACE.split(text) if s]
        if not stretches:
            return b"", b""
        ids, shown = zip(*map(self._stretches.__getitem__, stretches), strict=True)
        return b"".join(ids), b" ".join(shown)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about GROUP bytes each."""
    group, held = [], 0
    for row in rows:
        group.append(row)
        held += len(row[1]) + len(row[2])
        if held > GROUP:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*group, strict=True), schema.types, strict=True)], schema=schema)
            group, held = [], 0
    if group:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*group, strict=True), schema.types, strict=True)], schema=schema)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (text) of every whole text, one row for each input row.

    tokenizer: path of the file, read on the driver. A map without a shuffle; a worker holds the vocabulary (fixed size)
    and a bounded memory of words. Special tokens inside a text are encoded as such. Null and empty texts, and texts of
    white space, have no ids and decode to the empty text. Null ids stay null, repeated rows stay repeated, other columns
    are not read, an empty table gives an empty result.
    """
    with open(tokenizer, encoding="utf-8") as lines:
        spec = lines.read()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordCodec(spec)
        gc.freeze()  # what is remembered holds no cycles; else each collection would walk all of it
        gc.disable()
        try:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                yield from _batches(((i, *codec.run(text.as_py())) for i, text in zip(ids, batch.column(1), strict=True)), schema)
        finally:  # the worker serves other tasks after this one
            gc.enable()
            gc.unfreeze()

    slim = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(lean(run), "doc_id bigint, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the rows of encode()."""
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
