"""SentencePiece (BPE) encoding and decoding by merge rounds over flat arrays.

The stretches of text that a batch has not met before lie one behind the other in one array of symbols. Each round finds the
smallest rank of an adjacent pair in every stretch, merges that pair wherever it stands there (leftmost first where two
overlap), drops what has been merged and goes on with the stretches that still have a pair. A merge may make a pair of a
smaller rank than its own only for some pieces; those are merged once a round, so the order is always that of one merge
after the other.

Stretches end before a space and between two characters that no piece holds side by side; no merge can go over such a place,
so a stretch's ids do not depend on what is around it. Characters that are no piece become the ids of their bytes.

Null and empty texts have the end id only and decode to an empty text. Very long texts are stretches like any other; a long
text without a space is one stretch. Rows are independent: repeated rows get equal results, an empty table an empty result,
and columns other than the id and the text are never looked at. Pieces of one score, between which the place in the text
decides, are taken for runs of spaces only, which are joined when no other pair is left; a model file with others is refused,
as are files with user-defined or unused pieces or a normaliser.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches between spaces that a worker remembers; it starts anew when there are more, and keeps no long ones.
CACHE_CHUNKS = 400_000
LONG_CHUNK = 200
#: Characters of unknown stretches that are merged at once.
FLAT_CHARS = 1 << 20


class PairTable:
    """(left, right) -> number, for arrays of both; ``absent`` where there is none."""

    def __init__(self, found: dict[tuple[int, int], int], width: int, absent: int):
        self.width, self.absent = width, absent
        keys = np.array([left * width + right for left, right in found], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(list(found.values()), np.int32)[order], absent).astype(np.int32)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], self.absent)


class Model:
    """A BPE model file. Symbols are numbered by falling score, so the number of a merged piece is its rank."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as files

        model = files.ModelProto()
        model.ParseFromString(data)
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if (
            model.trainer_spec.model_type != model.trainer_spec.BPE
            or not model.trainer_spec.byte_fallback
            or model.trainer_spec.treat_whitespace_as_suffix
            or spec.precompiled_charsmap
            or spec.remove_extra_whitespaces
            or not spec.add_dummy_prefix
            or kinds & {USER_DEFINED, UNUSED}
        ):
            raise ValueError("this model file is not of the kind with byte fallback and without normaliser")
        self.end = model.trainer_spec.eos_id
        normal = {p.piece: (-p.score, k) for k, p in enumerate(model.pieces) if p.type == NORMAL}
        blank = sorted((p for p in normal if set(p) == {SPACE} and len(p) > 1), key=len)
        merged = sorted((p for p in normal if len(p) > 1 and p not in blank), key=normal.__getitem__)
        if len({normal[p][0] for p in merged}) < len(merged):
            raise ValueError("two pieces of this model file have one score")
        if any(SPACE in p[1:] for p in merged):
            raise ValueError("a piece of this model file goes over a space")
        lowest = max((normal[p][0] for p in merged), default=0)
        if len({normal[p][0] for p in blank}) > 1 or any(normal[p][0] <= lowest for p in blank):
            raise ValueError("runs of spaces are not merged last and alike")
        chars = sorted({c for p in normal for c in p})
        symbols = {piece: k for k, piece in enumerate([*merged, *chars, *blank])}
        #: The symbol of a run of spaces by its length.
        self.blank = {len(p): symbols[p] for p in [*blank, SPACE] if p in symbols}
        self.blank_runs = lru_cache(maxsize=1000)(self._blank_run)
        self.known, self.none = len(symbols), len(symbols) + 0x110000

        splits = {
            (symbols[p[:k]], symbols[p[k:]]): symbols[p]
            for p in merged
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        }
        self.merge = PairTable(splits, self.none, self.none)
        beside = {(ord(a), ord(b)): 1 for p in [*merged, *blank] for a, b in zip(p, p[1:], strict=False)}
        self.beside = PairTable(beside, 0x110000, 0)
        # a merge into one of these can make a pair that ranks before it
        self.early = np.zeros(self.none, bool)
        for parts, whole in splits.items():
            self.early[[part for part in parts if whole < part < len(merged)]] = True
        # characters of no piece keep their code point behind the known symbols
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.known
        self.symbol[[ord(c) for c in chars]] = [symbols[c] for c in chars]

        self.byte = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        #: The id of each known symbol, -1 for a character that is no piece itself.
        self.id = np.array([normal[p][1] if p in normal else -1 for p in symbols], np.int32)
        self.spelling = [*symbols]
        self.decimal = [str(k) for k in range(len(model.pieces))]
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        #: What each id decodes to: a text, or a byte.
        self.decoded = [
            int(p.piece[1:-1], 16) if p.type == BYTE
            else "" if p.type == CONTROL
            else UNKNOWN_TEXT if p.type == UNKNOWN
            else p.piece.replace(SPACE, " ")
            for p in model.pieces
        ]
        self.spaced = regex.compile(f"{SPACE}+[^{SPACE}]*")
        self.chunk_ids: dict[str, str] = {}
        self.chunk_text: dict[str, str] = {}

    def merge_rounds(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of stretches that begin at ``starts``, and the length of each."""
        n = len(starts)
        lengths = np.diff(np.append(starts, len(symbols)))
        stretch, done = np.arange(n), []
        rank = np.full(len(symbols), self.none, np.int32)
        rank[:-1] = self.merge(symbols[:-1], symbols[1:])
        rank[starts + lengths - 1] = self.none  # no pair goes over the end of a stretch
        while len(stretch):
            best = np.minimum.reduceat(rank, starts)
            open_ = best < self.none
            if not open_.all():
                kept = np.repeat(open_, lengths)
                done.append((stretch[~open_], lengths[~open_], symbols[~kept]))
                symbols, rank = symbols[kept], rank[kept]
                stretch, lengths, best = stretch[open_], lengths[open_], best[open_]
                if not len(stretch):
                    break
                starts = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(stretch)), lengths)
            at = np.flatnonzero(rank == best[owner])
            # of pairs that overlap one another every second one is merged, from the left
            place = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) == 1, 0, place))
            at = at[(place - run) % 2 == 0]
            once = self.early[best]
            if once.any():
                first = np.diff(owner[at], prepend=-1) != 0
                at = at[first | ~once[owner[at]]]
            symbols[at] = rank[at]
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            ends = starts + lengths - 1
            lengths = lengths - np.bincount(owner[at], minlength=len(stretch))
            last = np.zeros(len(symbols), bool)
            last[ends] = True
            last[at] |= last[at + 1]
            at = at - np.arange(len(at))  # each merge before it has taken one place
            symbols, rank, last = symbols[left], rank[left], last[left]
            starts = np.cumsum(lengths) - lengths
            near = np.zeros(len(symbols) + 1, bool)
            near[at] = near[at - 1] = True  # place -1 is the spare one at the end
            changed = np.flatnonzero(near[:-1] & ~last)
            rank[at] = self.none
            rank[changed] = self.merge(symbols[changed], symbols[changed + 1])
        sizes = np.zeros(n, np.int64)
        for which, size, _ in done:
            sizes[which] = size
        begin = np.cumsum(sizes) - sizes
        merged = np.empty(sizes.sum(), np.int32)
        for which, size, found in done:
            inside = np.arange(len(found)) - np.repeat(np.cumsum(size) - size, size)
            merged[np.repeat(begin[which], size) + inside] = found
        return merged, sizes

    def _blank_run(self, n: int) -> list[int]:
        """Symbols of a run of ``n`` spaces. All its pairs rank alike, so the leftmost is merged as long as there is one."""
        sizes: list[int] = []
        for _ in range(n):
            sizes.append(1)
            while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.blank:
                sizes[-2:] = [sizes[-2] + sizes[-1]]
        return [self.blank[k] for k in sizes]

    def join_blanks(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged runs of spaces, whose pieces rank after all others."""
        at = np.flatnonzero(symbols == self.blank.get(1, -1))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        head = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(owner[at], prepend=-1) != 0))
        sizes = np.diff(np.append(head, len(at)))
        symbols, kept = symbols.copy(), np.ones(len(symbols), bool)
        for begin, n in zip(at[head[sizes > 1]].tolist(), sizes[sizes > 1].tolist(), strict=True):
            run = self.blank_runs(n)
            symbols[begin : begin + len(run)] = run
            kept[begin + len(run) : begin + n] = False
        return symbols[kept], np.bincount(owner[kept], minlength=len(lengths))

    def spelt(self, symbol: int) -> list[int]:
        """The ids of the bytes of a character."""
        char = self.spelling[symbol] if symbol < self.known else chr(symbol - self.known)
        return [self.byte[b] for b in char.encode()]

    def ids_of(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids instead of symbols: characters that are no piece become one id for each of their bytes."""
        odd = np.flatnonzero((symbols >= self.known) | (self.id[np.minimum(symbols, self.known - 1)] < 0))
        if not len(odd):
            return self.id[symbols], lengths
        spelt = [self.spelt(s) for s in symbols[odd].tolist()]
        extra = np.zeros(len(symbols), np.int64)
        extra[odd] = np.fromiter(map(len, spelt), np.int64, len(spelt)) - 1
        owner = np.repeat(np.arange(len(lengths)), lengths)
        ids = np.repeat(self.id[np.minimum(symbols, self.known - 1)], extra + 1)
        begin = (np.arange(len(symbols)) + np.cumsum(extra) - extra)[odd]
        size = extra[odd] + 1
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ids[at] = np.concatenate(spelt)
        return ids, lengths + np.bincount(owner, extra, len(lengths)).astype(np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Ids and text of each chunk, which a space goes before."""
        points = np.frombuffer((SPACE + SPACE.join(chunks)).encode("utf-32-le"), np.uint32).astype(np.int32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        begin = np.cumsum(sizes) - sizes
        border = np.ones(len(points), bool)
        border[1:] = self.beside(points[:-1], points[1:]) == 0
        border[begin] = True
        starts = np.flatnonzero(border)
        ids, lengths = self.ids_of(*self.join_blanks(*self.merge_rounds(self.symbol[points], starts)))
        ends = np.cumsum(np.add.reduceat(lengths, np.searchsorted(starts, begin)))
        bytes_before = np.concatenate([[0], np.cumsum(self.is_byte[ids])])
        number, decoded, ids, at = self.decimal.__getitem__, self.decoded.__getitem__, ids.tolist(), 0
        has_bytes = (np.diff(bytes_before[np.append(0, ends)]) > 0).tolist()
        for chunk, end, spelt in zip(chunks, ends.tolist(), has_bytes, strict=True):
            found = ids[at:end]
            self.chunk_ids[chunk] = " ".join(map(number, found))
            self.chunk_text[chunk] = self.text_of(found) if spelt else "".join(map(decoded, found))
            at = end

    def split(self, text: str) -> list[str]:
        """A text cut before its spaces, each part without the space it begins with."""
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [part[1:] for part in self.spaced.findall(SPACE + text.replace(" ", SPACE))]

    def encode_batch(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Of each text the ids in decimal, joined by a space, without the end id; and what they decode to."""
        if len(self.chunk_ids) >= CACHE_CHUNKS:
            self.chunk_ids.clear()
            self.chunk_text.clear()
        parts = [self.split(t) if t else [] for t in texts]
        new, chars, long = [], 0, []
        for chunk in set().union(*parts).difference(self.chunk_ids):
            new.append(chunk)
            chars += len(chunk) + 1
            if len(chunk) > LONG_CHUNK:
                long.append(chunk)
            if chars >= FLAT_CHARS:
                self._learn(new)
                new, chars = [], 0
        if new:
            self._learn(new)
        ids, text = self.chunk_ids.__getitem__, self.chunk_text.__getitem__
        rows = [(" ".join(map(ids, p)), "".join(map(text, p))[1:]) for p in parts]
        for chunk in long:
            del self.chunk_ids[chunk], self.chunk_text[chunk]
        return rows

    def text_of(self, ids) -> str:
        """The texts of ids one behind the other; bytes that make no character are shown as U+FFFD each."""
        parts, pending = [], bytearray()
        for k in ids:
            what = self.decoded[k]
            if isinstance(what, int):
                pending.append(what)
                continue
            if pending:
                parts.append(_utf8(pending))
                pending = bytearray()
            parts.append(what)
        if pending:
            parts.append(_utf8(pending))
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts before a text is taken away again."""
        first = next((k for k in ids if self.decoded[k] != ""), None)
        text = self.text_of(ids)
        spaced = first is not None and isinstance(self.decoded[first], str) and self.decoded[first] != UNKNOWN_TEXT
        return text[1:] if spaced and text.startswith(" ") else text


def _utf8(data: bytearray) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as error:
        return data[: error.start].decode() + "�" + _utf8(data[error.start + 1 :])


@lru_cache(maxsize=4)
def model(data: bytes) -> Model:
    """Parsed once per Python worker."""
    return Model(data)


def definition(path: str) -> bytes:
    """The model file, read on the driver; executors get it with the task."""
    with open(path, "rb") as file:
        return file.read()


def encode(text: Column, path: str) -> Column:
    """Ids of a text column as array<int>, the end id last."""
    data = definition(path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        pieces = model(data)
        rows = [np.array(f"{ids} {pieces.end}".split(), np.int32) for ids, _ in pieces.encode_batch(texts.to_pylist())]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an array<int> column. Null ids give an empty text."""
    data = definition(path)

    @F.arrow_udf(T.StringType())
    def run(rows: pa.Array) -> pa.Array:
        pieces = model(data)
        return pa.array([pieces.decode(r) if r else "" for r in rows.to_pylist()], pa.string())

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
    data = definition(path)

    @F.arrow_udf(DIGESTS)
    def run(texts: pa.Array) -> pa.Array:
        pieces = model(data)
        n_tokens, encoded, decoded = [], [], []
        for ids, text in pieces.encode_batch(texts.to_pylist()):
            ids = f"{ids} {pieces.end}".lstrip()
            n_tokens.append(ids.count(" ") + 1)
            encoded.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded.append(hashlib.sha256(text.encode()).hexdigest())
        arrays = [pa.array(n_tokens, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
        return pa.StructArray.from_arrays(arrays, names=DIGESTS.names)

    return run(text)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``."""
    return docs.select("doc_id", digests(F.col("text"), path).alias("d")).select("doc_id", "d.*")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids for each row of ``docs``."""
    return docs.select("doc_id", encode(F.col("text"), path).alias("ids")).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids"
    )
