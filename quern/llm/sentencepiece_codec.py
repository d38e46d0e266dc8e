"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

Operator 12. A model file's pieces and scores are read; encoding is done here. A text is cut before each run of
U+2581 that follows another character: no piece crosses such a place (checked on the model), so the words between are
merged apart, and each distinct word of a task once. Many words lie in one flat array of symbols. A round finds each word's
minimum pair rank by a segmented minimum, merges the leftmost occurrences of that pair in all words at once, compacts
the arrays, and takes out the words without a pair.

The library takes one best pair after another, the leftmost of equals. Merging all occurrences of a word's best pair in one
round gives the same, unless a merge makes a pair that is as good as the one just merged or better; such a
word merges its leftmost occurrence alone in that round. A run of more than two longest blank pieces gives up whole
ones in front, as the library's leftmost rule does, so that it isn't merged in as many rounds as it has blanks.

Characters without a piece become byte pieces. The normaliser must be the identity; another model raises an error.

Defined results: a null text is an empty one, whose ids are the end id alone. Null ids decode to an empty text. Byte pieces
that are no UTF-8 give U+FFFD each, the unknown id its surface. Repeated rows give repeated results, no rows none. The
input row comes back whole, as the column ``row``, so that none of its columns can clash with the results.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import table

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
#: Words and ids that a task remembers before it forgets all, and characters of words that are merged together.
WORDS, CHARACTERS, TOGETHER = 400_000, 8_000_000, 1_000_000
NONE = np.iinfo(np.int32).max

#: Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _fields(message: bytes):
    """(number, value) of a protocol buffer message."""

    def number(at):
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out, at

    at = 0
    while at < len(message):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            if tag & 7 == 2:
                n, at = number(at)
            else:
                n = {1: 8, 5: 4}[tag & 7]
            value, at = message[at : at + n], at + n
        yield tag >> 3, value


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each start, one after the other."""
    return values[np.repeat(starts - _starts(lengths), lengths) + np.arange(lengths.sum())]


class PieceModel:
    """Pieces of a BPE model with byte fallback, and the ranks of pairs of symbols.

    Symbols are piece ids; a character without a piece has a symbol of its own from len(pieces) on.
    """

    def __init__(self, path: str):
        self.pieces: list[str] = []
        kinds, scores = [], []
        trainer, normaliser = {}, {}
        with open(path, "rb") as file:
            for field, value in _fields(file.read()):
                if field == 1:
                    piece = dict(_fields(value))
                    self.pieces.append(piece[1].decode())
                    scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                    kinds.append(piece.get(3, NORMAL))
                elif field == 2:
                    trainer = dict(_fields(value))
                elif field == 3:
                    normaliser = dict(_fields(value))
        self.kinds = np.array(kinds)
        known = {p: k for k, p in enumerate(self.pieces) if kinds[k] == NORMAL}
        if trainer.get(3) != 2 or not trainer.get(35) or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("only BPE models with byte fallback, identity normaliser, escaped blanks and a blank in front are supported")
        if set(kinds) & {USER_DEFINED, UNUSED} or any(BLANK in p.lstrip(BLANK) for p in known):
            raise ValueError("pieces that cross words, are unused or user defined aren't supported")
        self.known = known
        self.unknown = kinds.index(UNKNOWN)
        self.end = self.pieces.index(trainer.get(47, b"</s>").decode())
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if kinds[k] == BYTE}
        # Equal scores share a rank; the best is 0.
        order = {s: r for r, s in enumerate(sorted({scores[k] for k in known.values()}, reverse=True))}
        self.rank = np.array([order[scores[k]] if kinds[k] == NORMAL else NONE for k in range(len(kinds))], np.int32)
        pairs = {}
        for piece, k in known.items():
            for cut in range(1, len(piece)):
                a, b = known.get(piece[:cut]), known.get(piece[cut:])
                # Parts longer than a character must be pieces; single characters have to be, for their symbols to be ids.
                if a is not None and b is not None:
                    pairs[a << 32 | b] = k
                elif (a is None and cut == 1) or (b is None and cut == len(piece) - 1):
                    raise ValueError("a piece has a character that is no piece")
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        blanks = [len(p) for p in known if set(p) == {BLANK} and len(p) > 1]
        alike = {scores[known[BLANK * n]] for n in blanks}
        worst = blanks and len(alike) == 1 and alike == {min(scores[k] for k in known.values())}
        pure = all(p.count(BLANK) < 2 or set(p) == {BLANK} for p in known)
        #: Blanks of the longest piece of blanks, if runs of them may be cut; else 0.
        self.longest_blank = max(blanks) if worst and pure else 0
        surface = [p.replace(BLANK, " ") if k == NORMAL else "" for p, k in zip(self.pieces, kinds, strict=True)]
        surface[self.unknown] = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.surface = [s.encode() for s in surface]
        self.control = {k for k, kind in enumerate(kinds) if kind == CONTROL}
        for byte, k in self.bytes.items():
            self.surface[k] = bytes([byte])

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece of each pair of symbols, or -1."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], np.int32(-1))

    def ranks(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.rank[piece], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words one after the other, and how many each word has; words are merged apart."""
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        characters, at = np.unique(points, return_inverse=True)
        texts = [chr(c) for c in characters]
        symbols = np.array([self.known.get(c, len(self.pieces) + k) for k, c in enumerate(texts)], np.int32)[at]
        which, sizes, runs = zip(*self._rounds(symbols, _starts(lengths), np.arange(len(words))), strict=True)
        which, sizes = np.concatenate(which), np.concatenate(sizes)
        order = np.argsort(which)
        flat = _gather(np.concatenate(runs), _starts(sizes)[order], sizes[order])
        sizes = sizes[order]
        strange = flat >= len(self.pieces)
        if strange.any():
            # A character without a piece becomes the pieces of its bytes.
            spelt = [np.array([self.bytes[b] for b in t.encode("utf-8", "surrogatepass")], np.int32) for t in texts]
            wide = np.array([len(x) for x in spelt], np.int64)
            table, first = np.concatenate(spelt), _starts(wide)
            which = np.where(strange, flat - len(self.pieces), 0)
            source = np.concatenate((table, flat))
            width = np.where(strange, wide[which], 1)
            sizes = np.add.reduceat(width, _starts(sizes))
            flat = _gather(source, np.where(strange, first[which], len(table) + np.arange(len(flat))), width)
        return flat, sizes

    def _rounds(self, sym: np.ndarray, starts: np.ndarray, word: np.ndarray):
        """(words, their sizes, their symbols) as words come to rest."""

        def pair_column(sym, starts):
            made = np.full(len(sym), -1, np.int32)
            made[:-1] = self.merged(sym[:-1], sym[1:])
            made[starts[1:] - 1] = -1
            return made, self.ranks(made)

        made, rank = pair_column(sym, starts)
        while len(word):
            least = np.minimum.reduceat(rank, starts)
            ends = np.append(starts[1:], len(sym))
            rest = least == NONE
            if rest.any():
                lengths = ends - starts
                keep = np.repeat(~rest, lengths)
                yield word[rest], lengths[rest], sym[~keep]
                sym, made, rank = sym[keep], made[keep], rank[keep]
                word, least, lengths = word[~rest], least[~rest], lengths[~rest]
                if not len(word):
                    return
                starts = _starts(lengths)
                ends = np.append(starts[1:], len(sym))
            best = np.repeat(least, ends - starts)
            hit = np.flatnonzero(rank == best)
            # Of a run of neighbours every second, from its left.
            run = np.concatenate(([True], np.diff(hit) != 1))
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            hit = hit[self._safe(sym, made, least, starts, ends, hit)]
            sym[hit] = made[hit]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            lengths = (ends - starts) - np.add.reduceat(gone, starts)
            kept = np.cumsum(~gone) - 1
            sym, made, rank = sym[~gone], made[~gone], rank[~gone]
            starts = _starts(lengths)
            # Only pairs beside a merge are new.
            at = kept[hit]
            new, last = np.zeros(len(sym), bool), np.zeros(len(sym), bool)
            new[at] = new[np.maximum(at - 1, 0)] = True
            last[starts[1:] - 1] = last[-1] = True
            at, closed = np.flatnonzero(new & ~last), np.flatnonzero(new & last)
            made[at] = self.merged(sym[at], sym[at + 1])
            rank[at] = self.ranks(made[at])
            made[closed], rank[closed] = -1, NONE

    def _safe(self, sym, made, least, starts, ends, hit):
        """Which merges may be done in this round: all of a word, or its leftmost if one makes a pair as good or better."""
        of = np.searchsorted(starts, hit, "right") - 1
        lead = np.concatenate(([True], of[1:] != of[:-1]))
        several = np.zeros(len(starts), bool)
        several[of[~lead]] = True
        look = np.flatnonzero(several[of])
        if not len(look):
            return slice(None)
        h, w = hit[look], of[look]
        piece = made[h]
        bound = least[w]
        right = h + 2 < ends[w]
        left = h > starts[w]
        # The neighbour on the left may have been merged before, on the right it hasn't yet been, or has.
        merged = np.full(len(sym) + 1, -1, np.int32)
        merged[hit] = made[hit]
        before = np.maximum(h - 1, 0)
        left_new = np.where((h > 1) & (merged[np.maximum(h - 2, 0)] >= 0), merged[np.maximum(h - 2, 0)], sym[before])
        after = np.minimum(h + 2, len(sym) - 1)
        right_new = np.where(merged[after] >= 0, merged[after], sym[after])
        bad = left & (self.ranks(self.merged(left_new, piece)) <= bound)
        bad |= right & (self.ranks(self.merged(piece, sym[after])) <= bound)
        bad |= right & (self.ranks(self.merged(piece, right_new)) <= bound)
        unsafe = np.zeros(len(starts), bool)
        unsafe[w[bad]] = True
        return lead | ~unsafe[of]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library's decode gives it: one blank in front is dropped."""
        if not ids:
            return ""
        out, bare = [], True
        kinds = self.kinds
        for k, i in enumerate(ids):
            # Up to the first text: control pieces give none, and only a piece that opens the text loses a blank.
            if kinds[i] == BYTE:
                return self._decoded(b"".join(out), ids[k:])
            s = self.surface[i]
            if s.startswith(b" ") and kinds[i] == NORMAL:
                s, bare = s[1:], False
            out.append(s)
            if s or not bare:
                return self._decoded(b"".join(out), ids[k + 1 :])
        return b"".join(out).decode()

    def _decoded(self, head: bytes, ids: list[int]) -> str:
        while ids and ids[-1] in self.control:
            ids = ids[:-1]
        # A control piece inside parts the bytes on its sides.
        if self.control.isdisjoint(ids):
            try:
                return (head + b"".join(map(self.surface.__getitem__, ids))).decode()
            except UnicodeDecodeError:
                pass
        return self._repaired(head, ids)

    def _repaired(self, head: bytes, ids: list[int]) -> str:
        out, run = [head.decode()], bytearray()

        def close():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                    except UnicodeDecodeError:
                        continue
                    at += n
                    break
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                run.extend(self.surface[i])
            else:
                close()
                out.append(self.surface[i].decode())
        close()
        return "".join(out)


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Encodes texts; remembers the ids of words."""

    _WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

    def __init__(self, model: PieceModel):
        self.model = model
        self.forget()
        self.long_run = BLANK * 3 * model.longest_blank

    def forget(self) -> None:
        self.held: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        whole = BLANK + text.replace(" ", BLANK)
        if not text:
            return []
        found = self._WORD.findall(whole)
        if self.long_run and self.long_run in whole:
            found = list(chain.from_iterable(map(self._cut, found)))
        return found

    def _cut(self, word: str) -> list[str]:
        long = self.model.longest_blank
        blanks = len(word) - len(word.lstrip(BLANK))
        whole = max(0, blanks // long - 2)
        return [BLANK * long] * whole + [word[whole * long :]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each text has, without an end."""
        if len(self.held) > WORDS or len(self.ids) > CHARACTERS:
            self.forget()
        split = [self.words(t) for t in texts]
        words = list(chain.from_iterable(split))
        new = list(set(words).difference(self.held))
        ids, sizes = [self.ids], [self.sizes]
        for a, b in _runs(new, TOGETHER):
            self.held.update(zip(new[a:b], range(len(self.held), len(self.held) + b - a), strict=True))
            flat, size = self.model.encode_words(new[a:b])
            ids.append(flat)
            sizes.append(size)
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        at = np.fromiter(map(self.held.__getitem__, words), np.int64, len(words))
        size = self.sizes[at]
        flat = _gather(self.ids, _starts(self.sizes)[at], size)
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum([len(w) for w in split])]
        return flat, np.diff(ends, prepend=0)


def _runs(texts, most: int = 2_000_000):
    """(first, past last) of neighbours of up to so many characters, one at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < most or end == at):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def encode(docs: DataFrame, model: str | None = None, end: bool = True) -> DataFrame:
    """row (the input row) and ids (array<int>) of its text. The model's path must be readable on every executor."""
    path = model or default_model()
    slim = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        encoder = Encoder(model_of(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _runs(texts):
                flat, sizes = encoder.encode(texts[a:b])
                if end:
                    flat, sizes = np.insert(flat, np.cumsum(sizes), encoder.model.end), sizes + 1
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["row", "ids"])

    return slim.mapInArrow(run, slim.select("row").schema.add("ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """row (the input row) and decoded (string) of its column ids."""
    path = model or default_model()
    slim = encoded.select(F.struct("*").alias("row"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        held = model_of(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids, ends = part.column(1).flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum(part.column(1).value_lengths().to_numpy(zero_copy_only=False)).tolist()
                texts = [held.decode(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "decoded"])

    return slim.mapInArrow(run, slim.select("row").schema.add("decoded", "string"))


def report(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = encode(docs.select("doc_id", "text"), model).select("row.doc_id", "ids")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    # Only the digests of the ids go on beside the ids that are decoded.
    out = decode(ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids"), model)
    return out.select("row.doc_id", "row.n_tokens", "row.ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
