"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens (dot-product heuristic).

Texts are tokenized inside tasks; a full length of tokens becomes a sequence of its own and the rest goes to a pool. From a pool,
a bin takes the piece with the largest weighted dot product of its demand and the bin's remaining room (Panigrahy et al. 2011)
until none fits; if more than SLACK of its tokens is still free, a piece is cut to fill it. What an unfilled last bin holds goes
back to the pool; a task ends with one padded bin. Packing needs no shuffle and a pool's size is bounded.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceatlas.llm.common import give_back, small_batches

#: Tokens and pieces of a pool.
POOL_TOKENS = 4_000_000
POOL_PIECES = 6_000
#: Share of a sequence that may stay empty before a piece is cut.
SLACK = 0.02
#: Bytes of text that are tokenized at once (one longer text: as many as it has).
CHUNK_BYTES = 2 << 20
#: Words that a worker remembers with their ids, in Arrow and numpy arrays (about 40 bytes each); it begins anew beyond.
CACHE_WORDS = 300_000
#: Latin letters that lower-casing keeps letters and that no normal form takes apart.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: How byte-level vocabularies write bytes: printable ones as themselves, the others in order from 256 on.
_ODD = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTES = {b: 256 + i for i, b in enumerate(_ODD)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of the first length, then of the next."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Token ids of texts. The pre-tokenizer never joins across white space, so each distinct word of a chunk is encoded once.

    Words of Latin letters go to the tokenizer's model as they are in lower case: its normalizer and pre-tokenizer leave them whole, and a
    full stop or comma behind them is one token. All other words, and texts with an added token, go through the whole tokenizer.
    """

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Known keys: words of letters in lower case, others as they are; the first two are the stops."""
        self.keys, self.starts, self.lengths, self.ids = pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        for c in ".,":
            self._learn(pa.array([c], pa.large_string()))

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _learn(self, keys: pa.Array) -> pa.Array:
        """Adds distinct keys to the known ones; returns them in the order in which they were added."""
        plain = pc.match_substring_regex(keys, f"^[{_LETTERS}]+$")
        simple, rest = keys.filter(plain), keys.filter(pc.invert(plain))
        tokenize, flat, n = self.model.tokenize, array("I"), []
        for w in simple.to_pylist():
            found = tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))
            flat.extend([t.id for t in found])
            n.append(len(found))
        words = rest.to_pylist()
        for at in range(0, len(words), 4096):
            for e in self.tok.encode_batch_fast(words[at : at + 4096], add_special_tokens=False):
                flat.extend(e.ids)
                n.append(len(e.ids))
        n = np.array(n, np.int64)
        new = pa.concat_arrays([simple, rest])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.ids = np.concatenate([self.ids, np.frombuffer(flat, np.uint32)])
        self.keys = pa.concat_arrays([self.keys, new])
        return new

    def _places(self, keys: pa.Array) -> np.ndarray:
        """Where in starts and lengths each of the distinct keys is."""
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        at = pc.index_in(keys, value_set=self.keys)
        if at.null_count:
            base = len(self.keys)
            new = self._learn(keys.filter(pc.is_null(at)))
            at = pc.coalesce(at, pc.add(pc.index_in(keys, value_set=new), pa.scalar(base, pa.int32())))
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words, their number for each). Two parts a word: its letters and its stop, or all of it and nothing."""
        base = pc.replace_substring_regex(words, f"^([{_LETTERS}]+)[.,]$", r"\1")
        plain = pc.match_substring_regex(base, f"^[{_LETTERS}]+$")
        keys = pc.if_else(plain, pc.utf8_lower(base), words).dictionary_encode()
        stopped = pc.not_equal(pc.binary_length(base), pc.binary_length(words))
        stop = np.where(np.asarray(stopped), np.where(np.asarray(pc.ends_with(words, ".")), 0, 1), -1)
        parts = np.column_stack([self._places(keys.dictionary)[keys.indices.to_numpy()], stop]).ravel()
        sizes = np.where(parts < 0, 0, self.lengths[parts])
        return self.ids[ranges(self.starts[parts], sizes)], sizes.reshape(-1, 2).sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end); texts: large strings without nulls."""
        odd = pa.array(np.zeros(len(texts), bool))
        for a in self.added:  # words would tear added tokens
            odd = pc.or_(odd, pc.match_substring(texts, a))
        whole = {i: self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        if whole:
            texts = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        known, sizes = self._words(coded.dictionary)
        word = coded.indices.to_numpy()
        n = sizes[word]
        ids = known[ranges((np.cumsum(sizes) - sizes)[word], n)]
        bounds = np.concatenate([[0], np.cumsum(n)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if whole:
            parts, sizes = [], np.diff(bounds)
            for i in range(len(texts)):
                parts.append(np.array(whole[i], np.uint32) if i in whole else ids[bounds[i] : bounds[i + 1]])
                sizes[i] = len(parts[-1])
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        return ids, bounds


class Packer:
    """Pieces are (document, its tokens, its loss start, start, little-endian ids)."""

    def __init__(self, tokens: int, segments: int, loss: int):
        self.size, self.limits = tokens, np.array([tokens, segments, loss], float)
        self.pool: list[tuple] = []
        self.held = 0

    @staticmethod
    def demand(pieces: list[tuple]) -> np.ndarray:
        ends = [a + len(raw) // 4 for _, _, _, a, raw in pieces]
        return np.array([[z - p[3], 1, max(0, z - max(p[3], p[2]))] for p, z in zip(pieces, ends, strict=True)], float).reshape(-1, 3)

    def add(self, doc: int | None, start: int, raw: bytes) -> Iterator[list[tuple]]:
        """Full sequences of a document; its other pieces go to the pool."""
        n, a, most = len(raw) // 4, 0, int(self.limits[2])
        while n - a >= self.size and min(self.size, max(0, a + self.size - max(a, start))) <= most:
            yield [(doc, n, start, a, raw[4 * a : 4 * (a + self.size)])]
            a += self.size
        while a < n:
            z = min(n, a + self.size)
            if z - max(a, start) > most:  # a piece alone must fit the loss limit
                z = max(a, start) + most
            self.pool.append((doc, n, start, a, raw[4 * a : 4 * z]))
            self.held += z - a
            a = z

    def pack(self, last: bool) -> Iterator[list[tuple]]:
        """Bins of the pool; the last, not full one stays in the pool unless it is the task's end."""
        pieces, self.pool, self.held = self.pool, [], 0
        need = np.asfortranarray(self.demand(pieces))
        alive = np.ones(len(pieces), bool)
        weights = need.mean(0) / self.limits**2 if len(pieces) else self.limits
        while alive.any():
            room, held = self.limits.copy(), []
            while True:
                fits = alive & (need[:, 0] <= room[0]) & (need[:, 1] <= room[1]) & (need[:, 2] <= room[2])
                if not fits.any():
                    break
                best = int(np.argmax(np.where(fits, need @ (weights * room), -1.0)))
                held.append(pieces[best])
                alive[best] = False
                room -= need[best]
            free = int(min(room[0], room[2]))
            if free > SLACK * self.size and room[1] >= 1 and alive.any():
                big = int(np.argmax(np.where(alive, need[:, 0], -1)))
                doc, n, start, a, raw = pieces[big]
                held.append((doc, n, start, a, raw[: 4 * free]))
                pieces[big] = (doc, n, start, a + free, raw[4 * free :])
                need[big] = self.demand([pieces[big]])[0]
            elif not alive.any() and not last:
                self.pool, self.held = held, sum(len(p[4]) // 4 for p in held)
                return
            yield held


def _pack_task(tokens: int, segments: int, loss: int, eos: int, path: str, with_ids: bool):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def rows_of(bins: Iterator[list[tuple]], base: int, count: list[int]) -> pa.RecordBatch:
        rows = []
        for held in bins:
            offset = 0
            for doc, n, _, a, raw in held:
                rows.append((doc, a, len(raw) // 4, zlib.crc32(raw), n, base + count[0], offset, raw))
                offset += len(raw) // 4
            count[0] += 1
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = WordEncoder.of(path), Packer(tokens, segments, loss)
        base, count = TaskContext.get().partitionId() << 36, [0]
        end = np.array([eos], np.uint32).tobytes()
        for b in batches:
            ids, prompts, texts = b.column("id").to_pylist(), b.column("prompt"), b.column("text")
            size = np.cumsum(np.asarray(pc.add(pc.binary_length(texts), pc.binary_length(prompts)), np.int64))
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
                (x, p), (y, q) = (encoder.encode(c.slice(at, to - at).cast(pa.large_string())) for c in (prompts, texts))
                x, y = x.astype("<u4"), y.astype("<u4")
                for k in range(to - at):
                    raw = x[p[k] : p[k + 1]].tobytes() + y[q[k] : q[k + 1]].tobytes() + end
                    bins = list(packer.add(ids[at + k], int(p[k + 1] - p[k]), raw))
                    if bins:
                        yield rows_of(bins, base, count)
                    if len(packer.pool) >= POOL_PIECES or packer.held >= POOL_TOKENS:
                        yield rows_of(packer.pack(False), base, count)
                at = to
            give_back()
        yield rows_of(packer.pack(True), base, count)
        give_back()

    return run


def pack_documents(docs: DataFrame, tokens: int = 4096, segments: int | None = None, loss: int | None = None, eos: int = 2, vocabulary: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian 32-bit): one row per piece.

    A null text is an empty one; every document ends with eos, so an empty one is one token. prompt_col: text before text_col whose tokens
    bear no loss, for instruction data (default: none, all tokens bear loss). loss: most loss-bearing tokens of a sequence (default:
    tokens); segments: most pieces (default: tokens, so none too few for any text). Repeated rows are packed as often as they come; a null id stays null. An empty table gives no rows.
    sequence_id is unique, not gapless. Other columns of docs, whatever their names, are not read.
    """
    prompt = F.lit("") if prompt_col is None else F.coalesce(F.col(prompt_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), prompt.alias("prompt"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return small_batches(rows).mapInArrow(_pack_task(tokens, segments or tokens, loss or tokens, eos, vocabulary or default_vocabulary(), with_ids), schema)
