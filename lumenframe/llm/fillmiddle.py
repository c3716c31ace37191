"""Fill-in-the-middle: a text is cut in three and given out of order, with cuts found by a run-length code of its characters.

A text is stored as its maximal runs of characters of one class; the class of a character is the number of its bytes in
UTF-8. A run has its first byte and the number of units (code points) up to its end. The run that holds a cut is found by
binary search in the cumulative counts, and the cut's byte by arithmetic: first byte of the run + (units into it) x width.
So a cut of a text of one script costs a search over one run, however long the text is.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain`` the
text itself: for empty texts, texts that hold a marker, and 10 % of all. Cuts and form come from the SHA-256 of ``1:`` and
the id, so they don't depend on the order of rows or files.

Defined results: null and empty texts are plain and empty; null ids are drawn as the id ``null``; repeated rows come out
alike, once each; ids of any type are drawn by their text; an empty table gives none; further columns are ignored. Long
texts are cut whole: memory is their bytes and their runs, scanned in blocks of ``BLOCK`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts these many are rearranged, and of 100 rearranged ones these many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Bytes scanned at once, and rows of a slice.
BLOCK, ROWS = 1 << 20, 200

#: Bytes of a character by its first byte; 0 inside a character.
WIDTH = np.zeros(256, np.uint8)
WIDTH[0x00:0x80], WIDTH[0xC0:0xE0], WIDTH[0xE0:0xF0], WIDTH[0xF0:0xF8] = 1, 2, 3, 4


class Runs:
    """Maximal runs of equal width of one UTF-8 text: ``width``, ``start`` (first byte) and ``until`` (units up to the run's end)."""

    def __init__(self, text: np.ndarray):
        widths, starts = [], []
        before = 0
        for at in range(0, len(text), BLOCK):
            block = WIDTH[text[at : at + BLOCK]]
            heads = np.flatnonzero(block)
            kinds = block[heads]
            new = np.flatnonzero(np.concatenate([[before], kinds[:-1]]) != kinds) if len(kinds) else heads
            widths.append(kinds[new])
            starts.append(heads[new] + at)
            before = kinds[-1] if len(kinds) else before
        self.width = np.concatenate([np.zeros(0, np.uint8), *widths]).astype(np.int64)
        self.start = np.concatenate([np.zeros(0, np.int64), *starts])
        self.until = np.cumsum(np.diff(np.append(self.start, len(text))) // np.maximum(self.width, 1))
        self.bytes = len(text)

    def __len__(self) -> int:
        """Units of the text."""
        return int(self.until[-1]) if len(self.until) else 0

    def byte_of(self, unit: int) -> int:
        """The first byte of a unit; of the unit after the last, the text's size."""
        run = int(np.searchsorted(self.until, unit, side="right"))
        if run == len(self.until):
            return self.bytes
        return int(self.start[run] + (unit - (self.until[run - 1] if run else 0)) * self.width[run])


def draws(key: str) -> list[int]:
    """Four 32-bit numbers of an id."""
    found = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(text: bytes, key: str) -> tuple[int, str, int | None, int | None, bytes]:
    """``(units, form, units of the prefix, of the middle, output)`` of one text."""
    runs = Runs(np.frombuffer(text, np.uint8))
    n, (a, b, c, d) = len(runs), draws(key)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or p in text or s in text or m in text or c % 100 >= REARRANGED:
        return n, "plain", None, None, text
    first, second = sorted((a % (n + 1), b % (n + 1)))
    at, to = runs.byte_of(first), runs.byte_of(second)
    prefix, middle, suffix = text[:at], text[at:to], text[to:]
    if d % 100 < SUFFIX_FIRST:
        return n, "spm", first, second - first, b"".join([s, suffix, p, prefix, m, middle])
    return n, "psm", first, second - first, b"".join([p, prefix, s, suffix, m, middle])


def restore(output: bytes, form: str) -> bytes:
    """The text again, from an output and its form alone. An output that isn't of the form raises."""
    if form == "plain":
        return output
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError(f"not an output of the form {form}")
    one, two = output.index(second), output.index(m)
    a, b, middle = output[len(first) : one], output[one + len(second) : two], output[two + len(m) :]
    return a + middle + b if form == "psm" else b + middle + a


def class_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored code itself: ``(id, widths array<int>, starts array<long>, until array<long>)``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Runs(np.frombuffer(t.as_buffer() if t.is_valid else b"", np.uint8)) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.width.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r.start for r in rows], pa.list_(pa.int64())), pa.array([r.until for r in rows], pa.list_(pa.int64()))],
                [id_col, "widths", "starts", "until"],
            )

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(small_batches(run, ROWS), f"`{id_col}` {kind}, widths array<int>, starts array<long>, until array<long>")


def _stage(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.col(f"`{text_col}`").cast("string").cast("binary"))
    kind = docs.schema[id_col].dataType.simpleString()
    last = {"output_sha256": pa.string(), "restored_sha256": pa.string()} if digest else {"output": pa.string()}
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", *last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(1), batch.column(2)):
                n, form, first, middle, output = rearrange(text.as_py() or b"", key.as_py())
                ends = (hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest()) if digest else (output.decode("utf-8"),)
                out.append((n, form, first, middle, *ends))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *last.values()]
            columns = [[row[i] for row in out] for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    ends = ", ".join(f"{name} string" for name in last)
    return rows.mapInArrow(small_batches(run, ROWS), f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, {ends}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` of every text."""
    return _stage(docs, id_col, text_col, digest=False)


def fill_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like :func:`fill_in_middle`, with digests of the output and of the text that is rebuilt from it."""
    return _stage(docs, id_col, text_col, digest=True)


SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256(concat('1:', coalesce(cast(doc_id as varchar), 'null'))) as h from documents
), k as (
  select doc_id, t, n, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2, ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4 from d
), c as (
  select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from k
), p as (
  select *, substring(t, 1, a) as x, substring(t, a + 1, b - a) as y, substring(t, b + 1) as z from c
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then concat('<P>', x, '<S>', z, '<M>', y) else concat('<S>', z, '<P>', x, '<M>', y) end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
