"""SentencePiece encoding and decoding for merge-type vocabularies, checked against the sentencepiece library batch by batch.

A text's symbols are its characters; an agenda holds the adjacent pairs whose union is a piece, by falling score and then from the left.
The best pair becomes one symbol, which makes new pairs with its neighbours, until no pair is left; characters that are no piece become
byte pieces. Where no piece of the vocabulary holds two neighbouring characters next to each other, no union can cross between them, so
texts are cut there and each distinct part of a batch goes through the agenda once.
"""

from __future__ import annotations

import codecs
import heapq
import operator
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceatlas.llm.common import give_back, slices, small_batches
from priceatlas.llm.pack import ranges

#: Parts, and ids, that a worker remembers; it begins anew with the next batch beyond.
CACHE_PARTS, CACHE_IDS = 500_000, 8_000_000
#: The sign for a space inside pieces.
SPACE = "▁"

# each byte that is not UTF-8 decodes to one replacement character
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A merge-type vocabulary with byte pieces, a space before each text and no other normalisation; one of a path in a worker."""

    _made: dict[str, Pieces] = {}

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        self.id_of, score, self.bytes = {}, {}, [-1] * 256
        shown: list[bytes] = []
        joins = np.zeros((256, 256), bool)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                shown.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i):
                shown.append(" ⁇ ".encode())
            elif sp.is_control(i):
                shown.append(b"")
            elif sp.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            else:
                self.id_of[piece], score[piece] = i, sp.get_score(i)
                plain = piece.replace(SPACE, " ")
                shown.append(plain.encode())
                for a, b in zip(plain, plain[1:], strict=False):
                    joins[a.encode()[-1], b.encode()[0]] = True
        if -1 in self.bytes:
            raise ValueError("the vocabulary must have all byte pieces")
        order = {v: k for k, v in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[v] for p, v in score.items()}  # equal scores have one rank
        self.joins, self.begin, self.end = joins, sp.bos_id(), sp.eos_id()
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_n = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_n) - self.shown_n
        self.silent = np.array([sp.is_control(i) for i in range(len(shown))])
        self.spaced = np.array([not sp.is_byte(i) and not sp.is_unknown(i) and s[:1] == b" " for i, s in enumerate(shown)])
        self.forget()

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes, self.right = array("I"), array("q"), array("q"), array("B")

    def agenda(self, text: str) -> list[int]:
        """Ids of a text whose spaces are SPACE already. An entry of the agenda is a pair's rank and the place of its left symbol."""
        rank, push, pop = self.rank, heapq.heappush, heapq.heappop
        symbols: list[str | None] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        pairs = [rank[u] << 32 | i for i, u in enumerate(map(operator.add, symbols, symbols[1:])) if u in rank]
        heapq.heapify(pairs)
        while pairs:
            entry = pop(pairs)
            left = entry & 0xFFFFFFFF
            a, right = symbols[left], after[left]
            if a is None or right < 0:
                continue
            union = a + symbols[right]
            if rank.get(union) != entry >> 32:
                continue  # one of the two has changed since
            symbols[left], symbols[right] = union, None
            after[left] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = left
                found = rank.get(union + symbols[beyond])
                if found is not None:
                    push(pairs, found << 32 | left)
            back = before[left]
            if back >= 0:
                found = rank.get(symbols[back] + union)
                if found is not None:
                    push(pairs, found << 32 | back)
        id_of, ids = self.id_of, []
        for s in symbols:
            if s is not None:
                known = id_of.get(s)
                if known is None:
                    ids.extend([self.bytes[x] for x in s.encode()])
                else:
                    ids.append(known)
        return ids

    def _places(self, parts: list[bytes], verify: bool) -> np.ndarray:
        """Where the ids of each part are. New parts are checked against the library behind a line break, which no piece joins to anything."""
        place, new = self.place, [p for p in parts if p not in self.place]
        texts = [p.decode() for p in new]
        want = self.library.encode(["\n" + t for t in texts], num_threads=1) if verify and not self.joins[10].any() else None
        for k, (p, t) in enumerate(zip(new, texts, strict=True)):
            found = self.agenda(t.replace(" ", SPACE))
            place[p] = len(self.starts)
            self.starts.append(len(self.ids))
            self.sizes.append(len(found))
            self.ids.extend(found)
            self.right.append(want is None or want[k][2:] == found)
        return np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))

    def encode(self, texts: pa.Array, verify: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts with begin and end, where each text's begin and the last one's end, whether all parts of a text agree with the library).

        texts: large strings without nulls."""
        if len(self.place) > CACHE_PARTS or len(self.ids) > CACHE_IDS:
            self.forget()
        plain = pc.replace_substring(texts, SPACE, " ")
        plain = pc.if_else(pc.equal(plain, ""), plain, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), plain, pa.scalar("", pa.large_string())))
        bounds = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cut = np.ones(len(data), bool)
        if len(data):
            cut[1:] = ((data[1:] & 0xC0) != 0x80) & ~self.joins[data[:-1], data[1:]]
            cut[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        places = self._places(coded.dictionary.to_pylist(), verify)
        ids, first, sizes = np.frombuffer(self.ids, np.uint32) if self.ids else np.empty(0, np.uint32), np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.int64)
        at = places[coded.indices.to_numpy()] if len(starts) else np.empty(0, np.int64)
        body, n = ids[ranges(first[at], sizes[at])], np.concatenate([[0], np.cumsum(sizes[at])])
        part = np.searchsorted(starts, bounds)  # parts before each text
        wrong = np.concatenate([[0], np.cumsum(np.frombuffer(self.right, np.uint8)[at] == 0)]) if len(at) else np.zeros(1, np.int64)
        inner = n[part]
        ends = inner + 2 * np.arange(len(inner))
        out = np.empty(ends[-1], np.uint32)
        out[ends[:-1]], out[ends[1:] - 1] = self.begin, self.end
        mask = np.ones(len(out), bool)
        mask[ends[:-1]] = mask[ends[1:] - 1] = False
        out[mask] = body
        return out, ends, np.diff(wrong[part]) == 0

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of runs of ids: pieces in a row, the first one without its space, control ids silent, bytes that are no UTF-8 replaced."""
        ids = ids.astype(np.int64)
        n = self.shown_n[ids]
        raw = self.shown[ranges(self.shown_at[ids], n)].tobytes()
        at = np.concatenate([[0], np.cumsum(n)])
        quiet = np.flatnonzero(self.silent[ids])
        some = np.searchsorted(quiet, bounds)
        out = []
        for k, (z, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
            text, fresh, a = "", True, z
            for cut in (*quiet[some[k] : some[k + 1]], end):  # bytes on both sides of a control id are no character together
                if cut > a:
                    begin = at[a] + (1 if fresh and self.spaced[ids[a]] else 0)
                    text, fresh = text + raw[begin : at[cut]].decode("utf-8", "each_byte"), False
                a = cut + 1
            out.append(text)
        return out


def _encode_task(path: str, verify: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for b in slices(batches):
            texts = b.column("text").cast(pa.large_string())
            ids, bounds, agrees = pieces.encode(texts, verify == "parts")
            decoded = pieces.decode(ids, bounds)
            if verify == "texts":
                want = pieces.library.encode(texts.to_pylist(), add_bos=True, add_eos=True, num_threads=1)
                again = pieces.library.decode(want, num_threads=1)
                agrees = [np.array_equal(ids[bounds[i] : bounds[i + 1]], w) and decoded[i] == t for i, (w, t) in enumerate(zip(want, again, strict=True))]
            raw = ids.astype("<u4")
            packed = pa.array([raw[bounds[i] : bounds[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())
            agrees = pa.array(agrees, pa.bool_()) if verify else pa.nulls(b.num_rows, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), packed, pa.array(decoded, pa.string()), agrees], names=["doc_id", "ids", "decoded", "agrees"])

    return run


def encode_documents(docs: DataFrame, vocabulary: str | None = None, verify: str | None = "parts", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 32-bit, with begin and end), decoded text, agrees with the library.

    verify `parts`: each distinct part is encoded by the library too when a worker first meets it; `texts`: so is each whole text, and decoded;
    None: nothing is, and agrees is null.
    A null text is an empty one: begin and end only. Texts of any length are encoded whole; repeated rows come as often as in docs, null ids
    stay null, an empty table gives no rows. Equal scores go from the left. Other columns of docs, whatever their names, are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return small_batches(rows).mapInArrow(_encode_task(vocabulary or default_vocabulary(), verify), "doc_id long, ids binary, decoded string, agrees boolean")


def _decode_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for b in slices(batches):
            lists = [np.frombuffer(x or b"", "<u4") for x in b.column("ids").to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = pieces.decode(np.concatenate([*lists, np.empty(0, np.uint32)]), bounds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])
        give_back()

    return run


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts of any ids (little-endian 32-bit), as the library decodes them; null ids are an empty text."""
    rows = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return small_batches(rows).mapInArrow(_decode_task(vocabulary or default_vocabulary()), "doc_id long, text string")
