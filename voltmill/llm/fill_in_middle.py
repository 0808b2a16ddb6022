"""Fill-in-middle documents by in-place block rotation, and the way back.

A document is cut twice between its units (runs of ASCII letters, and single other characters). A sentinel is put into
a byte buffer before each of the three parts, and two neighbouring blocks change places by three reversals: middle and
suffix for the order prefix, suffix, middle (``psm``), all but the suffix and the suffix for ``spm``. Restoring turns
the same blocks back and takes the sentinels out, so it needs the output and its form alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmill.llm import arrays

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Documents of a hundred that are transformed, and of a hundred of these that lead with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes that a reversal moves at a time.
BLOCK = 64 << 10

_LETTERS = ~arrays.byte_class((65, 90), (97, 122))


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse a stretch of bytes in place, blocks from both its ends at a time."""
    while end - start > 1:
        step = min(BLOCK, (end - start) // 2)
        head = view[start : start + step].copy()
        view[start : start + step] = view[end - step : end][::-1]
        view[end - step : end] = head[::-1]
        start, end = start + step, end - step


def rotate(view: np.ndarray, start: int, middle: int, end: int) -> None:
    """Exchange the neighbouring blocks ``start:middle`` and ``middle:end`` in place."""
    reverse(view, start, middle)
    reverse(view, middle, end)
    reverse(view, start, end)


def arrange(text: bytes, first: int, second: int, form: str, sentinels: Sequence[bytes]) -> bytearray:
    """A text cut at two byte positions, with sentinels, in the order of ``form``."""
    prefix, suffix, middle = sentinels
    buffer = bytearray(text)
    for at, mark in ((second, suffix), (first, middle), (0, prefix)):  # from the back, so that positions hold
        buffer[at:at] = mark
    begin = len(prefix) + first
    turn = begin + len(middle) + second - first
    rotate(np.frombuffer(buffer, np.uint8), 0 if form == "spm" else begin, turn, len(buffer))
    return buffer


def rearrange(output: bytes, form: str, sentinels: Sequence[bytes]) -> bytearray:
    """The text that :func:`arrange` has made ``output`` of."""
    prefix, suffix, middle = sentinels
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    begin, turn = (0, buffer.index(prefix)) if form == "spm" else (buffer.index(suffix), buffer.index(middle))
    rotate(np.frombuffer(buffer, np.uint8), begin, turn, len(buffer))
    for mark in (suffix, middle, prefix):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return buffer


def _checked(sentinels: Sequence[str]) -> tuple[bytes, ...]:
    """Sentinels as bytes; none may begin with the end of another, or finding them again would be ambiguous."""
    marks = tuple(s.encode() for s in sentinels)
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("sentinels overlap")
    return marks


def numbers(id_column: str = "doc_id", seed: str = "1") -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of seed, colon and id; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def transform(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: str = "1",
    sentinels: Sequence[str] = SENTINELS,
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """``id_column``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every whole text.

    Cuts, and whether and how a document is transformed, follow from ``seed`` and id alone, so equal ids with equal
    texts have equal outputs. A null or empty text, and one that holds a sentinel, is ``plain``: its output is the text,
    its lengths are null. A null id counts as empty. A long text is one buffer of its own size; repeated rows are
    transformed each; an empty table gives an empty table; other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    marks = _checked(sentinels)
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = arrays.text_bytes(batch.column(1))
            drawn = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2, 6)]
            for begin, end, part, edges in arrays.pieces(data, bounds):
                h1, h2, h3, h4 = (h[begin:end] for h in drawn)
                whole = (part & 0xC0) != 0x80
                letter = _LETTERS[part]
                joined = np.zeros(len(part), bool)
                joined[1:] = letter[1:] & letter[:-1]
                joined[edges[:-1][edges[:-1] < len(part)]] = False
                units = np.flatnonzero(whole & ~joined)
                first = np.searchsorted(units, edges)
                n = np.diff(first)
                places = np.append(units, len(part))
                cuts = [np.where(k < n, places[np.minimum(first[:-1] + k, len(units))], edges[1:]) for k in (h1 % (n + 1), h2 % (n + 1))]
                low, high = np.minimum(*cuts), np.maximum(*cuts)
                chars = np.concatenate(([0], np.cumsum(whole)))
                raw = part.tobytes()
                forms, outputs = [], []
                for s, e, a, b, keep, lead in zip(edges[:-1].tolist(), edges[1:].tolist(), low.tolist(), high.tolist(), (h3 % 100 >= transformed).tolist(), (h4 % 100 < suffix_first).tolist(), strict=True):
                    text = raw[s:e]
                    form = "plain" if keep or not text or any(m in text for m in marks) else "spm" if lead else "psm"
                    forms.append(form)
                    outputs.append(text if form == "plain" else bytes(arrange(text, a - s, b - s, form, marks)))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        pa.array(n.astype(np.int64)),
                        pa.array(forms, pa.string()),
                        pa.array(chars[low] - chars[edges[:-1]], pa.int64(), mask=plain),
                        pa.array(chars[high] - chars[low], pa.int64(), mask=plain),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    names,
                )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), *numbers(id_column, seed))
    found = rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return found.withColumnRenamed("id", id_column)


def restore(outputs: DataFrame, form_column: str = "form", output_column: str = "output", sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``outputs`` with the exact texts, as ``restored``, from output and form alone; a null output or form gives null."""
    marks = _checked(sentinels)
    names = [*outputs.columns, "restored"]
    form, output = names.index(form_column), names.index(output_column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema.fields) + ", restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(output).cast(pa.binary())
            data, bounds = arrays.text_bytes(batch.column(output))
            for begin, end, _, _ in arrays.pieces(data, bounds):
                part = batch.slice(begin, end - begin)
                pairs = zip(part.column(form).to_pylist(), values.slice(begin, end - begin).to_pylist(), strict=True)
                texts = [None if f is None or o is None else bytes(rearrange(o, f, marks)) for f, o in pairs]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names)

    return outputs.mapInArrow(run, schema)
