"""SentencePiece encoding and decoding for merge-type (BPE) models, by a score-ordered agenda of adjacent symbol pairs.

A text is normalised as its model says, and cut where no piece can reach across: before a run of the space mark, if no
piece has the mark behind another character, and around the model's own symbols, which never merge. A segment starts as
its characters; the agenda holds every adjacent pair that makes a piece, best score first and of equal scores the
leftmost; the pair on top merges, and its two new neighbours enter. An entry whose pair has changed meanwhile is passed
over. Characters without a piece become bytes, or the unknown id.

A worker keeps the ids of short segments, in bounded number. Each segment that it hasn't kept is also encoded by the
sentencepiece library, one call for all of an Arrow batch, and the ids are compared; the column ``agrees`` tells whether
all segments of a text came out equal. The library's call on a whole text isn't needed for that, so the check costs as
much as the distinct segments, not as the text. (A model whose pieces reach over spaces, or with symbols of its own, has its texts
compared whole.)

Defined results: a null or empty text has no ids but the end id; repeated rows and ids of any type, null ones too, are
kept as they are; an empty table gives none; further columns are ignored. Texts are encoded whole, a segment without any
white space too (it is not kept, its agenda is n log n). A model of another type raises.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import small_batches
from lumenframe.llm.tokens import public_path

MODEL = "piece_bpe_32k.model"
#: Segments a worker keeps in each of two turns, the longest one that it keeps, and the rows that are checked together.
CACHE_SEGMENTS, CACHE_CHARS, CHECK_ROWS = 400_000, 48, 200
#: Symbols up to which the agenda is a plain list.
SHORT = 48
SPACE = "▁"
#: Bits of an agenda entry below its rank: the place of the left symbol.
PLACE = 32


class MergeEncoder:
    """Ids of one model file; ``encode_many`` gives each text's ids and whether the library agrees."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as layout

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = layout.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        kinds = layout.ModelProto.SentencePiece
        if model.trainer_spec.model_type != layout.TrainerSpec.BPE:
            raise ValueError("the model is not of the merge type")
        rules = model.normalizer_spec
        self.plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.end, self.unknown = model.trainer_spec.eos_id, model.trainer_spec.unk_id
        merging = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)}
        self.unused = {i for i, p in enumerate(model.pieces) if p.type == kinds.UNUSED}
        self.own = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.USER_DEFINED}
        byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes = [byte[f"<0x{b:02X}>"] for b in range(256)] if model.trainer_spec.byte_fallback else None
        order = {s: k for k, s in enumerate(sorted({model.pieces[i].score for i in merging.values()}, reverse=True))}
        self.size = len(model.pieces)
        self.single = {p: i for p, i in merging.items() if len(p) == 1}
        # A symbol is its piece's id, or ``size`` without a piece. A pair is one number; those that make a piece have the rank of its score.
        self.ranks: dict[int, int] = {}
        self.makes: dict[int, int] = {}
        for p, i in merging.items():
            for at in range(1, len(p)):
                left, right = merging.get(p[:at]), merging.get(p[at:])
                if left is not None and right is not None:
                    self.ranks[left * (self.size + 1) + right] = order[model.pieces[i].score]
                    self.makes[left * (self.size + 1) + right] = i
        self.split = bool(self.plain) and not any(SPACE in p.lstrip(SPACE) for p in merging)
        self.segment = self._borders(merging) if self.split else re.compile(r"(?s).+")
        self.cut_own = re.compile("(" + "|".join(map(re.escape, sorted(self.own, key=len, reverse=True))) + ")") if self.own else None
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.halves: dict[int, tuple[int, int]] = {}  # of merged unused pieces

    @staticmethod
    def _borders(merging: dict[str, int]) -> re.Pattern:
        """Segments end where no piece reaches on: before a space mark, and around ASCII characters that stand alone in all pieces."""
        joined = {c for p in merging if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        return re.compile((f"[{alone}]|" if alone else "") + f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return self.prefix + text.replace(" ", SPACE) if self.plain else self.library.normalize(text)

    def merge(self, segment: str) -> list[int]:
        """The ids of a segment, by the agenda."""
        none = self.size
        symbols = [self.single.get(c, none) for c in segment]
        symbols = self._short(symbols) if len(symbols) <= SHORT else self._long(symbols)
        if none not in symbols and not self.unused:
            return symbols
        out: list[int] = []
        lone = (c for c in segment if c not in self.single)
        for symbol in symbols:
            if symbol != none:
                self._spell(symbol, out)
            else:
                c = next(lone)
                out.extend([self.bytes[b] for b in c.encode("utf-8")] if self.bytes else [self.unknown])
        return out

    def _made(self, pair: int) -> int:
        made = self.makes[pair]
        if made in self.unused:
            self.halves[made] = divmod(pair, self.size + 1)
        return made

    def _short(self, symbols: list[int]) -> list[int]:
        """Of few symbols the agenda is the list of the pairs' ranks, whose first least entry is on top."""
        rank, made_of, wide, never = self.ranks.get, self._made if self.unused else self.makes.__getitem__, self.size + 1, 1 << 60
        agenda = [rank(a * wide + b, never) for a, b in zip(symbols, symbols[1:])]
        while agenda and (top := min(agenda)) != never:
            at = agenda.index(top)
            made = made_of(symbols[at] * wide + symbols[at + 1])
            symbols[at : at + 2] = [made]
            del agenda[at]
            if at:
                agenda[at - 1] = rank(symbols[at - 1] * wide + made, never)
            if at < len(agenda):
                agenda[at] = rank(made * wide + symbols[at + 1], never)
        return symbols

    def _long(self, symbols: list[int]) -> list[int]:
        """A heap of (rank, place of the left symbol), each entry one number."""
        rank, wide, n, gone = self.ranks.get, self.size + 1, len(symbols), -1
        agenda = [found << PLACE | at for at in range(n - 1) if (found := rank(symbols[at] * wide + symbols[at + 1])) is not None]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            top = heapq.heappop(agenda)
            left = top & (1 << PLACE) - 1
            right = after[left]
            if symbols[left] == gone or right == n or rank(symbols[left] * wide + symbols[right]) != top >> PLACE:
                continue
            made = symbols[left] = self._made(symbols[left] * wide + symbols[right])
            symbols[right] = gone
            after[left] = following = after[right]
            previous = before[left]
            if following < n:
                before[following] = left
                if (found := rank(made * wide + symbols[following])) is not None:
                    heapq.heappush(agenda, found << PLACE | left)
            if previous >= 0 and (found := rank(symbols[previous] * wide + made)) is not None:
                heapq.heappush(agenda, found << PLACE | previous)
        return [s for s in symbols if s != gone]

    def _spell(self, symbol: int, out: list[int]) -> None:
        """An unused piece is given back as the parts that it was merged from."""
        if symbol in self.unused and symbol in self.halves:
            for part in self.halves[symbol]:
                self._spell(part, out)
        else:
            out.append(symbol)

    def _parts(self, text: str) -> list[str]:
        whole = self.normalised(text)
        if self.cut_own is None:
            return self.segment.findall(whole)
        return [s for k, piece in enumerate(self.cut_own.split(whole)) for s in ([piece] if k % 2 else self.segment.findall(piece))]

    def _library(self, segments: list[str]) -> list[list[int]]:
        """The library's ids of segments. It puts the prefix before a text itself, so one that begins otherwise goes behind a new line, whose ids are cut off."""
        lead = [s.startswith(self.prefix) and len(s) > len(self.prefix) for s in segments]
        start = self.library.encode("\n") if self.prefix else []
        texts = [(s[len(self.prefix) :] if own else ("\n" if self.prefix else "") + s).replace(SPACE, " ") for s, own in zip(segments, lead)]
        return [ids if own else ids[len(start) :] for ids, own in zip(self.library.encode(texts, num_threads=1), lead)]

    def encode_many(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        if len(self.kept) > CACHE_SEGMENTS:  # what was seen since the last change stays for another turn
            self.kept, self.older = {}, self.kept
        kept, older, parts = self.kept, self.older, [self._parts(t) if t else [] for t in texts]
        by_segment = self.split and self.cut_own is None
        found = [list(map(kept.get, p)) for p in parts]
        holes = [[i for i, raw in enumerate(row) if raw is None] if None in row else [] for row in found]
        new = []
        for s in {p[i] for p, hole in zip(parts, holes) for i in hole}:
            if s in older:
                kept[s] = older[s]
            else:
                new.append(s)
        made = [[self.own[s]] if s in self.own else self.merge(s) for s in new]
        checked = self._library(new) if by_segment and new else made
        wrong, fresh = set(), {}
        for s, ids, theirs in zip(new, made, checked):
            raw = array("I", ids).tobytes()
            if ids != theirs:
                wrong.add(s)
            if len(s) <= CACHE_CHARS and ids == theirs:
                kept[s] = raw
            else:
                fresh[s] = raw
        out, agrees = [], []
        for text, p, row, hole in zip(texts, parts, found, holes):
            for i in hole:
                row[i] = fresh[p[i]] if p[i] in fresh else kept[p[i]]
            ids = np.frombuffer(b"".join(row), "<u4")
            if self.bytes is None and len(ids):  # a run of unknown characters is one id
                ids = ids[~((ids == self.unknown) & (np.concatenate([[-1], ids[:-1].astype(np.int64)]) == self.unknown))]
            out.append(ids)
            agrees.append((not wrong or wrong.isdisjoint(p)) if by_segment else ids.tolist() == self.library.encode(text or ""))
        return out, agrees


@lru_cache(maxsize=2)
def shared_merger(model: str) -> MergeEncoder:
    """The encoder of a model (a public name or a path), kept between the tasks of a Python worker."""
    return MergeEncoder(model if "/" in model else public_path(model))


def _with_end(ids: np.ndarray, end: int) -> np.ndarray:
    return np.append(ids, np.uint32(end)).astype("<u4")


def encode(docs: DataFrame, model: str = MODEL, add_end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, agrees boolean)`` of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_merger(model)
        for batch in batches:
            ids, agrees = encoder.encode_many(batch.column(1).to_pylist())
            if add_end:
                ids = [_with_end(x, encoder.end) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(agrees, pa.bool_())], [id_col, "ids", "agrees"])

    return rows.mapInArrow(small_batches(run, CHECK_ROWS), f"`{id_col}` {kind}, ids array<int>, agrees boolean")


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of id lists, by the library's ``decode``; no ids or null: the empty text. An id outside the vocabulary raises."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = shared_merger(model).library
        for batch in batches:
            texts = [library.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(small_batches(run, CHECK_ROWS), f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256, agrees)``: :func:`encode` and :func:`decode` in one Arrow stage, so that the ids of a corpus don't travel."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    digest = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_merger(model)
        shown = list(map(str, range(encoder.size)))
        for batch in batches:
            found, agrees = encoder.encode_many(batch.column(1).to_pylist())
            counts, of_ids, of_texts = [], [], []
            for ids in found:
                ids = _with_end(ids, encoder.end).tolist()
                counts.append(len(ids))
                of_ids.append(digest(" ".join([shown[i] for i in ids])))
                of_texts.append(digest(encoder.library.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string()), pa.array(agrees, pa.bool_())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return rows.mapInArrow(small_batches(run, CHECK_ROWS), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")
