"""BPE encoding and decoding with a contiguous array of adjacent ranks.

A word is a list of part boundaries; beside it stands the rank of each adjacent pair of parts. The smallest rank is
found by scanning, its boundary is deleted and the two neighbouring ranks are looked up again. Words longer than
``LONG_WORD`` symbols would make that quadratic and use a heap over linked parts, which gives the same merges.

Null and empty texts have no tokens. Specials written out in a text are encoded as their own ids, as the tokenizer
file asks for. Letters newer than the Unicode version of the tokenizers library (16) may be split otherwise than there. Rows are independent: repeated rows get equal results, an empty table an empty result, and columns other
than the text column are never looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

LONG_WORD = 200
CACHE_WORDS = 200_000
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
NO_RANK = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256))
    return [chr(b) if b in printable else chr(256 + next(spare)) for b in range(256)]


def merge_short(ids: list[int], pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Merged ids of a word and their boundaries (byte offsets). ``pairs``: see ``Vocabulary.pairs``."""
    get = pairs.get
    bounds = list(range(len(ids) + 1))
    adjacent = [get(left << ID_BITS | right, NO_RANK) for left, right in zip(ids, ids[1:], strict=False)]
    while adjacent and (best := min(adjacent)) != NO_RANK:
        k = adjacent.index(best)
        ids[k] = best & ID_MASK
        del ids[k + 1], bounds[k + 1], adjacent[k]
        if k:
            adjacent[k - 1] = get(ids[k - 1] << ID_BITS | ids[k], NO_RANK)
        if k < len(adjacent):
            adjacent[k] = get(ids[k] << ID_BITS | ids[k + 1], NO_RANK)
    return ids, bounds


def merge_long(ids: list[int], pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """The same for a word of any length in O(n log n): linked parts and a heap of (rank and merged id, position)."""
    n = len(ids)
    ids, after, before = [*ids], list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(k: int) -> None:
        if k >= 0 and after[k] < n and (merge := pairs.get(ids[k] << ID_BITS | ids[after[k]])) is not None:
            heapq.heappush(heap, (merge, k, ids[k], ids[after[k]]))

    for k in range(n):
        offer(k)
    while heap:
        merge, k, left, right = heapq.heappop(heap)
        if ids[k] != left or (nxt := after[k]) >= n or ids[nxt] != right:
            continue  # one of the two has been merged since
        ids[k], ids[nxt] = merge & ID_MASK, -1
        after[k] = after[nxt]
        if after[k] < n:
            before[after[k]] = k
        offer(before[k])
        offer(k)
    kept = [k for k in range(n) if ids[k] >= 0]
    return [ids[k] for k in kept], [*kept, n]


class Vocabulary:
    """A word-end BPE tokenizer file: NFC, lower case, split into words, bytes as characters, ranked merges."""

    def __init__(self, definition: str):
        model = json.loads(definition)
        kinds = [n["type"] for n in model["normalizer"]["normalizers"]]
        split, as_bytes = model["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or as_bytes["type"] != "ByteLevel" or model["decoder"]:
            raise ValueError("this tokenizer file is not of the word-end kind")
        # \s of the file is Unicode white space; Python's \s also has the separators U+001C to U+001F
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.separators = regex.compile("[\x1c-\x1f]")
        ids, end = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        if max(ids.values()) > ID_MASK:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        #: (left id, right id) -> (rank, merged id), both packed into one number, so that the smallest has the lowest rank
        self.pairs = {
            ids[left] << ID_BITS | ids[right]: rank << ID_BITS | ids[left + right]
            for rank, (left, right) in enumerate(model["model"]["merges"])
        }
        self.inner = [ids[c] for c in byte_alphabet()]
        self.last = [ids[c + end] for c in byte_alphabet()]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tokens = {str(k): t for t, k in [*ids.items(), *self.special.items()]}
        self.of_word = _Cache(self._word)
        self.of_chunk = _Cache(self._chunk)

    def encode_word(self, word: str) -> tuple[list[int], list[int]]:
        """Ids of a word and the byte offsets of their boundaries."""
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return (merge_short if len(ids) <= LONG_WORD else merge_long)(ids, self.pairs)

    def _word(self, word: str) -> str:
        return " ".join(map(str, self.encode_word(word)[0]))

    def _chunk(self, chunk: str) -> str:
        return " ".join(map(self.of_word.__getitem__, self.word.findall(chunk)))

    def _ordinary(self, text: str) -> str:
        if not text.isascii():
            # the file lower-cases character by character, so a sigma at a word's end stays an ordinary one
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # no word goes over white space, so equal runs between white space have equal ids
        chunks = self.word.findall(text) if self.separators.search(text) else text.split()
        return " ".join(map(self.of_chunk.__getitem__, chunks))

    def encode(self, text: str | None) -> str:
        """Ids of a text as decimal numbers joined by a space."""
        if not text:
            return ""
        if self.specials is None or "<" not in text or not self.specials.search(text):
            return self._ordinary(text)
        ids = [str(self.special[s]) if k % 2 else self._ordinary(s) for k, s in enumerate(self.specials.split(text))]
        return " ".join(filter(None, ids))

    def decode(self, ids: str) -> str:
        """The tokens of ids written as ``encode`` writes them, joined by a space; unknown ids are left out."""
        return " ".join([t for t in map(self.tokens.get, ids.split(" ")) if t is not None])


class _Cache(dict):
    """Text -> what ``find`` makes of it; starts anew when it is full, and keeps no long texts."""

    def __init__(self, find: Callable[[str], str]):
        super().__init__()
        self.find = find

    def __missing__(self, text: str) -> str:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self.find(text)
        if len(text) <= LONG_WORD:
            self[text] = found
        return found


@lru_cache(maxsize=4)
def vocabulary(definition: str) -> Vocabulary:
    """Parsed once per Python worker."""
    return Vocabulary(definition)


def definition(path: str) -> str:
    """The tokenizer file, read on the driver; executors get its text with the task, so they need no such file."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(text: Column, path: str) -> Column:
    """Ids of a text column as array<int>; null and empty texts give an empty array."""
    model = definition(path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        bpe = vocabulary(model)
        rows = [np.array(ids.split(" "), np.int32) if ids else np.empty(0, np.int32) for ids in map(bpe.encode, texts.to_pylist())]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an array<int> column: tokens joined by a space, specials kept. Null ids give an empty text."""
    model = definition(path)

    @F.arrow_udf(T.StringType())
    def run(rows: pa.Array) -> pa.Array:
        bpe = vocabulary(model)
        return pa.array([bpe.decode(" ".join(map(str, r))) if r else "" for r in rows.to_pylist()], pa.string())

    return run(ids)


DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def digests(text: Column, path: str) -> Column:
    """Struct of n_tokens, ids_sha256, decoded_sha256: encodes each whole text and decodes the ids again."""
    model = definition(path)

    @F.arrow_udf(DIGESTS)
    def run(texts: pa.Array) -> pa.Array:
        bpe = vocabulary(model)
        n_tokens, encoded, decoded = [], [], []
        for text in texts.to_pylist():
            ids = bpe.encode(text)
            n_tokens.append(ids.count(" ") + 1 if ids else 0)
            encoded.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(n_tokens, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
            fields=[pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())],
        )

    return run(text)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``."""
    return docs.select("doc_id", digests(F.col("text"), path).alias("d")).select("doc_id", "d.*")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids for each row of ``docs``."""
    return docs.select("doc_id", encode(F.col("text"), path).alias("ids")).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids"
    )
