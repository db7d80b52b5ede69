"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback."""

from __future__ import annotations

import gc
import re
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows, resident, without

SPACE = "▁"
#: A chunk: no piece has a space mark after another character, so no merge crosses the start of a run of marks.
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Chunks of up to so many characters are merged side by side and kept between batches.
SHORT = 64
#: The rank of a pair that is no piece.
NONE = np.iinfo(np.int32).max


class Codec:
    """Encoder and decoder for one model; chunks' ids are kept between batches (``keep`` chunks, in two generations).

    ``checked`` compares the ids of every newly encoded chunk, and every decoded text, with the sentencepiece library.
    """

    def __init__(self, model: bytes, checked: bool = True, keep: int = 200_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.checked, self.keep = checked, keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []
        self.bytes: list[int] = [-1] * 256
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif self.library.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            elif self.library.is_control(i):
                self.surface.append(b"")
            else:
                scores[piece] = self.library.get_score(i)
                self.ids[piece] = i
                self.surface.append(piece.replace(SPACE, " ").encode())
                if re.search(f"[^{SPACE}]{SPACE}", piece):
                    raise ValueError(f"piece {piece!r} has a space after its start; chunks would not be independent")
        order = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[score] for piece, score in scores.items()}
        self.pairs = {piece[i : i + 2] for piece in scores for i in range(len(piece) - 1)}
        self.parts: dict[str, list[int]] = {}
        self.lead = [x.startswith(b" ") and not self.library.is_unknown(i) for i, x in enumerate(self.surface)]
        # Symbols: pieces by id, then every character by its code. Pairs: all splits of a piece into two symbols.
        size = len(self.surface)
        number = {c: size + ord(c) for piece in scores for c in piece} | self.ids
        pairs = {}
        for piece in scores:
            for i in range(1, len(piece)):
                if piece[:i] in number and piece[i:] in number:
                    pairs[number[piece[:i]], number[piece[i:]]] = piece
        self.symbols = size + 0x110000
        ordered = sorted(pairs.items())
        self.keys = np.array([a * self.symbols + b for (a, b), _ in ordered] + [self.symbols**2], dtype=np.int64)
        self.ranks = np.array([self.rank[p] for _, p in ordered] + [NONE], dtype=np.int32)
        self.merged = np.array([self.ids[p] for _, p in ordered] + [-1], dtype=np.int64)
        self.of_char = np.arange(size, size + 0x110000, dtype=np.int64)
        for c, i in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        if -1 in self.bytes:
            raise ValueError("the vocabulary has no byte fallback")

    def pieces(self, chunk: str) -> list[str]:
        """Merge adjacent symbols, the pair of highest score first (of equal ones the leftmost), while any pair is a piece."""
        symbols: list[str] = list(chunk)
        n = len(symbols)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        # An entry packs rank, left position and size. A pair is as it was if it still has that size, for sizes only grow.
        rank, bits = self.rank.get, n.bit_length()
        low, both = (1 << bits) - 1, 2 * bits
        agenda = []
        for i in range(n - 1):
            if (r := rank(symbols[i] + symbols[i + 1])) is not None:
                agenda.append(r << both | i << bits | 2)
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry >> bits & low
            own, right = symbols[left], after[left]
            if not own or right < 0:
                continue
            own += symbols[right]
            if len(own) != entry & low:
                continue
            symbols[left] = own
            symbols[right] = ""
            after[left] = follows = after[right]
            if follows >= 0:
                before[follows] = left
                pair = own + symbols[follows]
                if (r := rank(pair)) is not None:
                    heappush(agenda, r << both | left << bits | len(pair))
            leads = before[left]
            if leads >= 0:
                pair = symbols[leads] + own
                if (r := rank(pair)) is not None:
                    heappush(agenda, r << both | leads << bits | len(pair))
        return [s for s in symbols if s]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk: of its parts between character pairs that no piece has, for no merge crosses these."""
        inside, out, start = self.pairs, [], 0
        known = self.parts
        for end in [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in inside] + [len(chunk)]:
            part = chunk[start:end]
            ids = known.get(part)
            if ids is None:
                ids = []
                for piece in self.pieces(part):
                    i = self.ids.get(piece)
                    ids.extend([self.bytes[b] for b in piece.encode()] if i is None else [i])
                if len(part) <= SHORT:
                    known[part] = ids
            out += ids
            start = end
        return out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair of symbols stands in the table of pairs; the last place is that of no pair."""
        key = left * self.symbols + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids, as 32-bit integers, of chunks of up to ``SHORT`` characters: all agendas at once, in matrices.

        Rows of one width hold a chunk's symbols and its agenda: the rank of each adjacent pair. Each step takes the
        head of every agenda (the best score, of equal ones the leftmost), merges that pair and ranks the two pairs
        that it makes; all rows that go on are one symbol narrower. A row without a pair is done.
        """
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        out: list[bytes] = [b""] * len(chunks)
        row, symbol, agenda = np.zeros(0, dtype=np.int64), None, None
        for width in range(int(size.max(initial=0)), 0, -1):
            new = np.flatnonzero(size == width)
            if len(new):
                code = np.frombuffer("".join([chunks[k] for k in new]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                fresh = self.of_char[code].reshape(-1, width)
                ranks = self.ranks[self._lookup(fresh[:, :-1], fresh[:, 1:])]
                row, symbol, agenda = (np.concatenate([row, new]), np.concatenate([symbol, fresh]), np.concatenate([agenda, ranks])) if len(row) else (new, fresh, ranks)
            if not len(row):
                continue
            best = agenda.argmin(1) if width > 1 else np.zeros(len(row), dtype=np.int64)
            on = agenda[np.arange(len(row)), best] < NONE if width > 1 else np.zeros(len(row), dtype=bool)
            done = np.flatnonzero(~on)
            if len(done):
                plain = symbol[done]
                raw, odd = plain.astype(np.int32).tobytes(), (plain >= len(self.surface)).any(1)
                for k, (r, o) in enumerate(zip(row[done].tolist(), odd.tolist())):
                    out[r] = raw[4 * width * k : 4 * width * (k + 1)] if not o else self._with_bytes(plain[k])
            row, symbol, agenda, best = row[on], symbol[on], agenda[on], best[on]
            if not len(row):
                continue
            n = np.arange(len(row))
            symbol[n, best] = self.merged[self._lookup(symbol[n, best], symbol[n, best + 1])]
            keep = np.ones(symbol.shape, dtype=bool)
            keep[n, best + 1] = False
            symbol = symbol[keep].reshape(len(row), width - 1)
            keep = np.ones(agenda.shape, dtype=bool)
            keep[n, best] = False
            agenda = agenda[keep].reshape(len(row), width - 2)
            for off in (0, -1):
                at = np.flatnonzero((best + off >= 0) & (best + off < width - 2))
                p = best[at] + off
                agenda[at, p] = self.ranks[self._lookup(symbol[at, p], symbol[at, p + 1])]
        return out

    def _with_bytes(self, symbols: np.ndarray) -> bytes:
        """Ids of symbols of which some are characters without a piece, which fall back to their bytes."""
        ids: list[int] = []
        for s in symbols.tolist():
            ids.extend([s] if s < len(self.surface) else [self.bytes[b] for b in chr(s - len(self.surface)).encode("utf-8", "surrogatepass")])
        return array("i", ids).tobytes()

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids, as 32-bit integers, of chunks that aren't known yet, held against the library's."""
        short = [c for c in chunks if len(c) <= SHORT]
        new = dict(zip(short, self.encode_chunks(short)))
        new |= {c: array("i", self.encode_chunk(c)).tobytes() for c in chunks if len(c) > SHORT}
        if self.checked:
            # The library itself puts a mark before a text; a lone mark can't be had from it that way.
            asked = [c for c in new if c != SPACE]
            theirs = self.library.encode([c[1:].replace(SPACE, " ") for c in asked], num_threads=1)
            sizes = list(map(len, theirs))
            flat = np.fromiter(chain.from_iterable(theirs), dtype=np.int32, count=sum(sizes))
            # All at once: the same numbers, cut at the same places.
            if flat.tobytes() != b"".join([new[c] for c in asked]) or any(4 * n != len(new[c]) for n, c in zip(sizes, asked)):
                chunk, ids = next((c, x) for c, x in zip(asked, theirs) if array("i", x).tobytes() != new[c])
                raise ValueError(f"ids differ from the library's for {chunk!r}: {array('i', new[chunk]).tolist()} and {ids}")
        return new

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none, like an empty one."""
        parts = [CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        young, old = self.young, self.old
        missing = set()
        for part in parts:
            missing.update(set(part).difference(young))
        young |= {c: old[c] for c in missing if c in old}
        missing.difference_update(young)
        fresh = self.learn(missing)
        long = {c: fresh.pop(c) for c in missing if len(c) > SHORT}
        young |= fresh
        get = young.__getitem__ if not long else lambda c: young[c] if c in young else long[c]
        out = [b"".join(map(get, part)) for part in parts]
        if len(young) > self.keep // 2:
            self.old, self.young = young, {}
        if len(self.parts) > self.keep // 2:
            self.parts = {}
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces' surfaces joined, without the space that encoding puts before a text."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " and self.lead[next(i for i in ids if self.surface[i])] else text

    def decode_batch(self, found: list[bytes], texts: list[str | None] | None = None) -> list[str]:
        """Text of each text's ids, held against the library's.

        The library's ids were held against these when they were made, and what it decodes is its pieces' surfaces:
        one of ``texts`` that comes back whole is right, and only those that don't are asked for again.
        """
        ids = [array("i", raw).tolist() for raw in found]
        out = list(map(self.decode, ids))
        if self.checked:
            asked = [k for k in range(len(out)) if texts is None or out[k] != (texts[k] or "")]
            theirs = self.library.decode([ids[k] for k in asked], num_threads=1) if asked else []
            for k, text in zip(asked, theirs):
                if out[k] != text:
                    raise ValueError(f"decoded text differs from the library's: {out[k]!r} and {text!r}")
        return out


def codec(model: bytes, checked: bool = True) -> Codec:
    """This process's codec for a model; tasks that follow each other share it."""
    return resident(("codec", len(model), hash(model), checked), lambda: Codec(model, checked))


def _ids_array(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None, checked: bool = True, rows: int = 1024) -> DataFrame:
    """Append the token ids of every whole text (and, if named, the text decoded from these ids).

    Ids are those of the sentencepiece library for the model file at ``model`` (a path on the driver), without begin
    and end ids or sampling. A text is cut where a run of spaces begins, for merges never cross that; each distinct
    chunk is merged by an agenda ordered by score and checked against the library. Null and empty texts have no ids
    and decode to the empty text. The model goes to the tasks (its size doesn't depend on the data).
    """
    with open(model, "rb") as f:
        proto = f.read()
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def make():
        coder = codec(proto, checked)

        def part(column: pa.Array) -> list[pa.Array]:
            texts = column.to_pylist()
            found = coder.encode_batch(texts)
            out = [_ids_array(found)]
            if decoded:
                out.append(pa.array(coder.decode_batch(found, texts), pa.string()))
            return out

        def work(batch: pa.RecordBatch) -> dict:
            column = batch.column(batch.schema.get_field_index(text))
            gc.disable()  # millions of small lists of numbers, without a cycle among them
            try:
                parts = [part(column.slice(a, rows)) for a in range(0, batch.num_rows, rows)]
            finally:
                gc.enable()
            return {f.name: pa.concat_arrays([p[k] for p in parts]) for k, f in enumerate(fields)}

        return work

    return map_rows(docs, fields, make)


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Append the text of each array of ids; a null array gives a null text, null ids count for nothing."""
    with open(model, "rb") as f:
        proto = f.read()

    def make():
        coder = codec(proto)

        def work(batch: pa.RecordBatch) -> dict:
            column = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            return {text: pa.array([None if x is None else coder.decode([i for i in x if i is not None]) for x in column], pa.string())}

        return work

    return map_rows(without(rows, text), [T.StructField(text, T.StringType())], make)
