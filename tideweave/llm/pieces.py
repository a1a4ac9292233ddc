"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Only the model's tables are read from its file (pieces, scores, kinds); the
merges are done here.  All words of a batch lie in flat arrays of symbols.  A
round finds for every word the best pair by a segmented minimum, merges its
leftmost occurrences in all words at once and compacts the arrays, until no
word has a pair left.  No piece has a space mark after another character, so
words are merged apart; words already encoded are kept in a bounded table.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm.batches import arrow_map, sliced, strings

MARK = "▁"
#: Words kept per worker, and the longest one that is kept.
KEPT_WORDS = 400_000
KEPT_CHARS = 64
#: Words of more symbols whose ties forbid simultaneous merges go to a heap.
LONG_WORD = 256
NONE = np.iinfo(np.int64).max
Table = tuple[dict[str, str], dict[str, str]]


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each-byte", _each_byte)


class PieceModel:
    """The tables of a BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.eos = sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        plain = [i for i in range(n) if not (byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unknown = {i for i in range(n) if sp.is_unknown(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if byte[i]}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.symbol = {self.pieces[i]: i for i in plain}
        self.is_piece = [False] * n
        for i in plain:
            self.is_piece[i] = True
        scores = {i: -sp.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted(set(scores.values())))}
        lefts, rights, ranks, into = [], [], [], []
        for piece, i in self.symbol.items():
            for cut in range(1, len(piece)):
                a, b = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    ranks.append(order[scores[i]])
                    into.append(i)
        self.base = n
        keys = np.array(lefts, np.int64) * n + np.array(rights, np.int64)
        at = np.argsort(keys)
        self.keys = keys[at]
        self.ranks = np.array(ranks, np.int64)[at]
        self.into = np.array(into, np.int64)[at]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.symbol):
            raise ValueError("a piece holds a newline, or a space mark after another character")
        # Words split after a newline, and after a letter before the ASCII signs
        # and digits that no piece has after a letter.
        joined = set("".join(c for p in self.symbol for c in re.findall(r"(?<=[a-zA-Z\u00c0-\u024f])[!-@\[-`{-~]", p)))
        apart = "".join(re.escape(chr(c)) for c in range(33, 127) if not chr(c).isalpha() and chr(c) not in joined)
        self.boundary = re.compile(rf"(?<=[a-zA-Z\u00c0-\u024f])(?=[{apart}])|(?<=\n)(?=.)" if apart else r"(?<=\n)(?=.)", re.S)
        self.id_text = [f" {i}" for i in range(n)]
        self.id_surface = [self.pieces[i].replace(MARK, " ") if self.is_piece[i] else None for i in range(n)]
        # Of words and of parts inside words, two generations each: ids and surface.
        self.words, self.old_words = ({}, {}), ({}, {})
        self.inner, self.old_inner = ({}, {}), ({}, {})

    # ------------------------------------------------------------- merges
    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; ``NONE`` where there is no such piece."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.into[at]

    def by_heap(self, symbols: list[int]) -> list[int]:
        """The same merges one at a time, for long words full of ties."""
        n, sym = len(symbols), list(symbols)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        table = self._pairs()
        heap = [(*table[p], i, *p) for i, p in enumerate(zip(sym, sym[1:], strict=False)) if p in table]
        heap = [(rank, i, a, b, into) for rank, into, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, into = heapq.heappop(heap)
            j = nxt[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue
            sym[i], sym[j], nxt[i] = into, None, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (sym[x], sym[y]) in table:
                    rank, made = table[sym[x], sym[y]]
                    heapq.heappush(heap, (rank, x, sym[x], sym[y], made))
        return [s for s in sym if s is not None]

    def _pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_table"):
            a, b = np.divmod(self.keys, self.base)
            self._table = dict(
                zip(
                    zip(a.tolist(), b.tolist(), strict=True),
                    zip(self.ranks.tolist(), self.into.tolist(), strict=True),
                    strict=True,
                )
            )
        return self._table

    def merge(self, words: list[str]) -> list[list[int]]:
        """The symbols of each word (``-1 - code point`` if in no piece)."""
        get = self.symbol.get
        flat = [get(c, -1 - ord(c)) for w in words for c in w]
        lengths = np.array([len(w) for w in words], np.int64)
        sym = np.array(flat, np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        ended, endings = [], []
        while len(sym):
            rank, into = self.look_up(sym[:-1], sym[1:])
            same = word[:-1] == word[1:]
            rank = np.append(np.where(same, rank, NONE), NONE)
            into = np.append(into, 0)
            first = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            top = np.repeat(best, count)
            done = top == NONE
            hit = np.flatnonzero((rank == top) & ~done)
            if len(hit):
                # Of overlapping occurrences every other one, from the left.
                run = np.append(True, np.diff(hit) != 1)
                start = hit[np.flatnonzero(run)][np.cumsum(run) - 1]
                hit = hit[(hit - start) % 2 == 0]
                hit, heaped = self._exact(sym, word, top, into, hit)
                for w in heaped:
                    mine = word == w
                    ready = self.by_heap(sym[mine].tolist())
                    ended.append(np.full(len(ready), w))
                    endings.append(np.array(ready, np.int64))
                    word, sym = np.where(mine, -1, word), np.where(mine, -1, sym)
                    hit = hit[~mine[hit]]
            ended.append(word[done])
            endings.append(sym[done])
            sym[hit] = into[hit]
            keep = ~done & (word >= 0)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        if not ended:
            return [[] for _ in words]
        ended = np.concatenate(ended)
        order = np.argsort(ended, kind="stable")
        flat = np.concatenate(endings)[order].tolist()
        ends = np.cumsum(np.bincount(ended, minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _exact(
        self, sym: np.ndarray, word: np.ndarray, top: np.ndarray, into: np.ndarray, hit: np.ndarray
    ) -> tuple[np.ndarray, list[int]]:
        """A word's occurrences up to the first whose merge makes a pair as good as its own.

        One at a time the leftmost best pair is merged; doing a word's
        occurrences together is the same as long as no new pair comes before
        the next of them.
        """
        owner = word[hit]
        several = np.flatnonzero(np.append(False, owner[1:] == owner[:-1]) | np.append(owner[1:] == owner[:-1], False))
        if not len(several):
            return hit, []
        mine = hit[several]
        made, n = into[mine], len(sym)
        bad = np.zeros(len(mine), bool)

        def check(left: np.ndarray, right: np.ndarray, valid: np.ndarray) -> None:
            rank, _ = self.look_up(left, right)
            bad[:] |= valid & (rank <= top[mine])

        after = np.minimum(mine + 2, n - 1)
        check(made, sym[after], (mine + 2 < n) & (word[after] == word[mine]))
        before = np.maximum(mine - 1, 0)
        check(sym[before], made, (mine > 0) & (word[before] == word[mine]))
        joined = np.append(False, (np.diff(mine) == 2) & (np.diff(word[mine]) == 0))
        check(np.append(0, made[:-1]), made, joined)
        if not bad.any():
            return hit, []
        tied = np.unique(word[mine[bad]])
        sizes = np.bincount(word, minlength=int(tied.max()) + 1)[tied]
        before = np.cumsum(bad) - bad
        start = np.append(True, word[mine[1:]] != word[mine[:-1]])
        before -= before[np.flatnonzero(start)][np.cumsum(start) - 1]
        keep = np.ones(len(hit), bool)
        keep[several] = before == 0
        return hit[keep], tied[sizes > LONG_WORD].tolist()

    # ------------------------------------------------------------ decoding
    def ids_of(self, symbols: list[int]) -> list[int]:
        """Symbols as ids; a character in no piece falls back to its bytes."""
        out = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            else:
                out += [self.byte_id[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")]
        return out

    def surface(self, ids: list[int]) -> str:
        """The text of ids with spaces for marks, its leading space not removed."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "each-byte"))
                held.clear()
            if i in self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.pieces[i].replace(MARK, " "))
        if held:
            out.append(held.decode("utf-8", "each-byte"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """As the library's ``decode(ids)``."""
        for at, i in enumerate(ids):
            if i not in self.control:
                text = self.surface(ids[at:])
                return text[1:] if self.is_piece[i] and self.pieces[i].startswith(MARK) else text
        return ""

    # ------------------------------------------------------------ encoding
    def parts(self, text: str) -> list[str]:
        """Keys of a text's words: a word without its one space mark, or as it is.

        A key that starts with a mark or a newline is the word itself.
        """
        if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " " or MARK in text:
            return self._odd_parts(text)
        return text.replace("\n", " \n").split(" ")

    def _odd_parts(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        return [
            w[1:] if w[0] == MARK and len(w) > 1 and w[1] not in (MARK, "\n") else w
            for w in re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+", marked)
        ]

    def _store(self, table: Table, keys: list[str], words: list[str]) -> None:
        ids, surfaces = table
        text_of, surface_of = self.id_text, self.id_surface
        for key, symbols in zip(keys, self.merge(words), strict=True):
            if min(symbols) >= 0:
                ids[key] = "".join([text_of[s] for s in symbols])
                surfaces[key] = "".join([surface_of[s] for s in symbols])
            else:
                got = self.ids_of(symbols)
                ids[key] = "".join([text_of[i] for i in got])
                surfaces[key] = self.surface(got)

    @staticmethod
    def _revive(young: Table, old: Table, keys: set[str]) -> list[str]:
        """Keys in neither generation; those of the old one become young."""
        missing = []
        for k in keys.difference(young[0]):
            if k in old[0]:
                young[0][k], young[1][k] = old[0][k], old[1][k]
            else:
                missing.append(k)
        return missing

    def encode_parts(self, keys: set[str]) -> None:
        """Have all parts in the table of words."""
        missing = self._revive(self.words, self.old_words, keys)
        if not missing:
            return
        split = {k: self.boundary.split(k) for k in missing}
        heads = {v[0] for v in split.values()}
        inner = {x for v in split.values() for x in v[1:]}
        new = self._revive(self.words, self.old_words, heads)
        self._store(self.words, new, [self.full(k) for k in new])
        new = self._revive(self.inner, self.old_inner, inner)
        self._store(self.inner, new, new)
        for words, parts in zip(self.words, self.inner, strict=True):
            for k, v in split.items():
                if len(v) > 1:
                    words[k] = words[v[0]] + "".join([parts[x] for x in v[1:]])
        self.long = [k for k in missing if len(k) > KEPT_CHARS]

    def _forget(self) -> None:
        """Drop long words; a full young generation becomes the old one."""
        for k in self.long:
            for table in self.words:
                table.pop(k, None)
        self.long = []
        for young, old in (("words", "old_words"), ("inner", "old_inner")):
            table = getattr(self, young)
            if len(table[0]) > KEPT_WORDS // 2:
                setattr(self, old, table)
                setattr(self, young, ({}, {}))

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """``(n_ids, ids joined by a space, decoded text)`` per text, end id included."""
        split = [self.parts(t) if t else [] for t in texts]
        out, end, self.long = [], f" {self.eos}", []
        self.encode_parts(set().union(*split))
        ids_of, surface_of = self.words[0].__getitem__, self.words[1].__getitem__
        for parts in split:
            ids = "".join(map(ids_of, parts)) + end
            text = "".join(map(surface_of, parts))
            out.append((ids.count(" "), ids[1:], text[1:]))
        self._forget()
        return out

    @staticmethod
    def full(part: str) -> str:
        return part if part[0] in (MARK, "\n") else MARK + part

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_batch([text])[0][1].split(" ")]


@lru_cache(maxsize=4)
def piece_model(name: str = "piece_bpe_32k.model") -> PieceModel:
    """One model per worker process and file; ``name`` may be a path."""
    return PieceModel(name if "/" in name else public_tokenizers.path(name))


def encode_pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model"
) -> DataFrame:
    """``(id, ids, decoded)``: ids joined by a space, the end id last.

    Whole texts; null is empty and encodes as the end id alone.  Repeated rows
    and null ids pass through; an empty table gives an empty result; other
    columns of ``df`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_model(model)
        for part in sliced(batches):
            done = encoder.encode_batch(strings(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([d[1] for d in done]), pa.array([d[2] for d in done])],
                names=["id", "ids", "decoded"],
            )

    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(kept, run, "id long, ids string, decoded string")


def piece_digests(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model"
) -> DataFrame:
    """``(<id_col>, n_tokens, ids_sha256, decoded_sha256)`` of :func:`encode_pieces`.

    The digests are taken where the ids are made, so these never leave the
    worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_model(model)
        for part in sliced(batches):
            done = encoder.encode_batch(strings(part.column(1)))
            sha = hashlib.sha256
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([d[0] for d in done], pa.int64()),
                    pa.array([sha(d[1].encode()).hexdigest() for d in done], pa.string()),
                    pa.array([sha(d[2].encode("utf-8", "replace")).hexdigest() for d in done], pa.string()),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = arrow_map(kept, run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op4_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_sentencepiece_codec": op4_sentencepiece_codec}
ORACLES: dict[str, str] = {}
