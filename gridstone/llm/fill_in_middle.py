"""Fill-in-middle transformation with bit sets: a text's tokens are counted and cut without a list of them.

A token is a run of A-Z and a-z or one other code point. ``bytes.translate`` turns the UTF-8 bytes into rows of 0 and 1, read as
one big integer a class (letters; further bytes of a code point), bit i for byte i. Shifted boolean operations mark the bytes
that open a token; ``bit_count`` gives their number n, and the place of the token of a given rank is found by halving the
integer and keeping the half that holds it, so that all steps together are linear in the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = bytes(b"01"[65 <= b <= 90 or 97 <= b <= 122] for b in range(256))
FURTHER = bytes(b"01"[128 <= b < 192] for b in range(256))
#: Prefix, suffix and middle marks.
MARKS = ("<P>", "<S>", "<M>")
#: Rows and bytes of texts that are answered as one batch, about.
ROWS, BYTES = 2000, 8 << 20


def bit_sets(data: bytes) -> tuple[int, int]:
    """(bytes that open a token, further bytes of a code point) as bit sets, bit i for byte i."""
    if not data:
        return 0, 0
    back = data[::-1]
    letters, further = int(back.translate(LETTERS), 2), int(back.translate(FURTHER), 2)
    others = letters ^ ((1 << len(data)) - 1)
    return letters & ~(letters << 1) | others & ~further, further


def ranked(bits: int, width: int, rank: int) -> int:
    """Place of the set bit of a rank (from 0) among the lowest ``width`` bits; ``width`` if there are not so many."""
    if rank >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        held = low.bit_count()
        if rank < held:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - held, at + half
    return at


def draws(doc_id, epoch: int) -> list[int]:
    """Four unsigned 32-bit numbers of an id: the first groups of the hex sha256 of ``epoch:id``."""
    h = hashlib.sha256(f"{epoch}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[i:i + 4], "big") for i in range(0, 16, 4)]


def transformed(data: bytes, numbers: list[int], plain: int, spm: int, marks: tuple[bytes, bytes, bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix, of the middle, output) of a text."""
    starts, further = bit_sets(data)
    n = starts.bit_count()
    h1, h2, h3, h4 = numbers
    if not data or h3 % 100 >= 100 - plain or any(m in data for m in marks):
        return n, "plain", None, None, data
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a = ranked(starts, len(data), lo)
    b = ranked(starts, len(data), hi)
    points = lambda i, j: j - i - (further >> i & ((1 << (j - i)) - 1)).bit_count()
    p, s, m = marks
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm:
        return n, "spm", points(0, a), points(a, b), s + suffix + p + prefix + m + middle
    return n, "psm", points(0, a), points(a, b), p + prefix + s + suffix + m + middle


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    if len({*marks}) < 3 or any(not m or any(m[0] in o[1:] for o in marks) for m in marks):
        raise ValueError("marks must be three, and what one starts with must not stand inside one")
    return marks


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epoch: int = 1, plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row for each row of ``docs``: id, n (tokens), form, prefix_chars, middle_chars, output.

    The cuts and the form are drawn from the sha256 of ``epoch:id``: ``plain`` percent of the texts stay as they are, and so do empty
    texts and those that hold a mark; ``spm`` percent of the others are put as suffix, prefix, middle, the rest as prefix,
    suffix, middle. prefix_chars and middle_chars are null for a plain text. A null text counts as empty, a null id as an
    empty one. Rows that repeat an id are cut by the same numbers. Whole texts of any length are cut, in time linear
    in them. Only the two columns are read, so names of others can't clash; an empty table gives no rows.
    """
    encoded = tuple(m.encode() for m in _checked(marks))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                           T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo, held, rows = batch["_text"].cast(pa.large_binary()), 0, 0, []
            for i in range(batch.num_rows):
                data = texts[i].as_py()
                rows.append(transformed(data, draws(batch["_key"][i].as_py(), epoch), plain, spm, encoded))
                held += len(data)
                if held > BYTES or len(rows) == ROWS or i == batch.num_rows - 1:
                    n, form, prefix, middle, output = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch["_id"].slice(lo, len(rows)), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], schema.names)
                    lo, held, rows = i + 1, 0, []

    base = docs.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return base.mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text that an output of ``fill_in_middle`` was made from. Each mark stands there once, as no text with one is cut and none can arise at a seam."""
    p, s, m = (F.lit(x) for x in _checked(marks))
    after = lambda x: F.split_part(output, x, F.lit(2))
    psm = F.concat(F.split_part(after(p), s, F.lit(1)), after(m), F.split_part(after(s), m, F.lit(1)))
    spm = F.concat(F.split_part(after(p), m, F.lit(1)), after(m), F.split_part(after(s), p, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
