"""Problem 3: rows that fail to parse.

Lines of delimited files are parsed in blocks on a columnar path: masks over whole blocks take out what is broken in its
quoting or width, Arrow's CSV reader parses the rest, and masks over its columns take out invalid cells. A block that fails
is bisected until the bad records stand alone. What stands apart is diagnosed strictly, character by character.

Defined results
* NULL or empty lines have one empty cell: `column_count` (unless the header has one column).
* A line whose file has no header line (or no name) comes out apart with the reason `no_header`.
* A header without a value column makes every well-formed line of its file `invalid_value`; without a flag column the
  flag counts as empty.
* Repeated lines are judged one by one; other columns of the input pass through untouched, and columns that clash with
  the operator's own (`value`, `is_anomaly`, `reason`) are replaced.
"""

from __future__ import annotations

import io
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header names in lower case, and cells that are valid flags.
VALUE_NAMES = ("value", "val")
FLAG_NAMES = ("is_anomaly", "anomaly", "isanomaly")
FLAGS = {"": 0, "0": 0, "0.0": 0, "1": 1, "1.0": 1}
DELIMITERS = (",", ";", "\t")

NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_NUMBER = re.compile(NUMBER)


def split_strict(line: str, delimiter: str) -> tuple[list[str], bool]:
    """The cells of one line and whether its quoting is sound; cells come without quotes and without outer blanks."""
    blanks = " " if delimiter == "\t" else " \t"
    cells, at, n = [], 0, len(line)
    while True:
        while at < n and line[at] in blanks:
            at += 1
        if at < n and line[at] == '"':
            at += 1
            buf = []
            while True:
                end = line.find('"', at)
                if end < 0:
                    return cells, False
                buf.append(line[at:end])
                at = end + 1
                if at < n and line[at] == '"':
                    buf.append('"')
                    at += 1
                    continue
                break
            while at < n and line[at] in blanks:
                at += 1
            if at < n and line[at] != delimiter:
                return cells, False
            cells.append("".join(buf).strip(" \t"))
        else:
            end = line.find(delimiter, at)
            end = n if end < 0 else end
            cell = line[at:end]
            if '"' in cell:
                return cells, False
            cells.append(cell.strip(" \t"))
            at = end
        if at >= n:
            return cells, True
        at += 1


def parse_header(line: str | None) -> tuple[str, int, int, int] | None:
    """(delimiter, columns, index of the value, index of the flag), indexes -1 where absent; None without a line."""
    if line is None:
        return None
    line = line.lstrip("﻿")
    line = line[:-1] if line.endswith("\r") else line
    delimiter = max(DELIMITERS, key=lambda d: (len(split_strict(line, d)[0]), -DELIMITERS.index(d)))
    names = [c.lower() for c in split_strict(line, delimiter)[0]]
    at = lambda wanted: next((i for i, c in enumerate(names) if c in wanted), -1)
    return delimiter, len(names), at(VALUE_NAMES), at(FLAG_NAMES)


def number(cell: str) -> float | None:
    if _NUMBER.fullmatch(cell) and math.isfinite(x := float(cell)):
        return x
    return None


def diagnose(line: str | None, fmt: tuple[str, int, int, int]) -> tuple[float | None, int | None, str | None]:
    """(value, flag, reason) of one line; reason is None for a valid line."""
    delimiter, columns, vi, fi = fmt
    line = line or ""
    cells, sound = split_strict(line[:-1] if line.endswith("\r") else line, delimiter)
    if not sound:
        return None, None, "quoting"
    if len(cells) != columns:
        return None, None, "column_count"
    value = number(cells[vi]) if vi >= 0 else None
    flag = FLAGS.get(cells[fi]) if fi >= 0 else 0
    if value is None or flag is None:
        return None, None, "invalid_value"
    return value, flag, None


def _sound_pattern(delimiter: str) -> str:
    d = "\\t" if delimiter == "\t" else re.escape(delimiter)
    b = "[ ]*" if delimiter == "\t" else "[ \\t]*"
    cell = f'{b}(?:"(?:[^"]|"")*"{b}|[^"{d}]*)'
    return f"^{cell}(?:{d}{cell})*$"


def bulk(lines: pa.Array, fmt: tuple[str, int, int, int], masked: bool = False) -> tuple[pa.Array, pa.Array] | None:
    """Values and flags of a block of lines on the columnar path, NULL where a cell is not valid.

    None if the block does not parse as one table of the header's width, or holds no valid line. masked: the lines have come
    through stripped() and plausible()."""
    delimiter, columns, vi, fi = fmt
    if not masked:
        lines = stripped(lines)
    if vi < 0 or len(lines) == 0 or not (masked or pc.all(plausible(lines, fmt)).as_py()):
        return None
    names = [f"c{i}" for i in range(columns)]
    block = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_py()
    if block is None:
        return None
    block = block.encode()
    try:
        cells = pacsv.read_csv(
            io.BytesIO(block),
            read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(block) + 1, 1024)),
            parse_options=pacsv.ParseOptions(delimiter=delimiter, double_quote=True, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types={c: pa.string() for c in names}, include_columns=sorted({names[vi], *([names[fi]] if fi >= 0 else [])}), strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if len(cells) != len(lines):
        return None
    text = pc.utf8_trim(cells[names[vi]].combine_chunks(), " \t")
    text = pc.if_else(pc.match_substring_regex(text, f"^{NUMBER}$"), pc.replace_substring_regex(text, r"^\+", ""), pa.scalar(None, pa.string()))
    values = pc.cast(text, pa.float64())
    flags = pa.array([0] * len(lines), pa.int32())
    if fi >= 0:
        place = pc.index_in(pc.utf8_trim(cells[names[fi]].combine_chunks(), " \t"), pa.array(list(FLAGS)))
        flags = pa.array(list(FLAGS.values()), pa.int32()).take(place)
    ok = pc.and_(pc.fill_null(pc.is_finite(values), False), pc.is_valid(flags))
    if not pc.any(ok).as_py():
        return None
    return pc.if_else(ok, values, pa.scalar(None, pa.float64())), pc.if_else(ok, flags, pa.scalar(None, pa.int32()))


def stripped(lines: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(lines, r"\r$", "")


def plausible(lines: pa.Array, fmt: tuple[str, int, int, int]) -> pa.Array:
    """Which lines may stand in a block: one line each, sound in their quoting and of the header's width."""
    delimiter, columns, _, _ = fmt
    odd = pc.or_(pc.match_substring(lines, "\n"), pc.match_substring(lines, "\r"))
    good = pc.fill_null(pc.and_(pc.equal(pc.count_substring(lines, delimiter), columns - 1), pc.and_(pc.invert(odd), pc.not_equal(lines, ""))), False)
    quoted = pc.fill_null(pc.match_substring(lines, '"'), False)
    if pc.any(quoted).as_py():
        part = lines.filter(quoted)
        bare = pc.replace_substring_regex(part, '"(?:[^"]|"")*"', "")
        sound = pc.and_(pc.match_substring_regex(part, _sound_pattern(delimiter)), pc.equal(pc.count_substring(bare, delimiter), columns - 1))
        good = pc.replace_with_mask(good, quoted, pc.and_(sound, pc.invert(odd.filter(quoted))))
    return good


def parse_array(lines: pa.Array, fmt: tuple[str, int, int, int], leaf: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, flags, reasons, lines that the bulk path took) of all lines; reason None and a value for a valid line.

    Column-wise masks keep lines apart that cannot parse; the rest is parsed in bulk, blocks that fail are bisected down to
    `leaf` lines, and what no block took is diagnosed strictly."""
    n = len(lines)
    values, flags, reasons = np.full(n, np.nan), np.zeros(n, np.int32), np.full(n, None, object)
    bare = stripped(lines)
    at = np.flatnonzero(plausible(bare, fmt).to_numpy(zero_copy_only=False))
    left = np.ones(n, bool)
    stack = [at] if len(at) else []
    while stack:
        part = stack.pop()
        done = bulk(bare.take(pa.array(part)), fmt, masked=True)
        if done is not None:
            taken = part[done[0].is_valid().to_numpy(zero_copy_only=False)]
            left[taken] = False
            values[taken], flags[taken] = done[0].drop_null().to_numpy(), done[1].drop_null().to_numpy()
        elif len(part) > leaf:
            stack += [part[: len(part) // 2], part[len(part) // 2 :]]
    rest = np.flatnonzero(left)
    for i, line in zip(rest.tolist(), lines.take(pa.array(rest, pa.int64())).to_pylist()):
        value, flag, reasons[i] = diagnose(line, fmt)
        if reasons[i] is None:
            values[i], flags[i] = value, flag
    return values, flags, reasons, n - len(rest)


def parse_block(lines: list[str | None], fmt: tuple[str, int, int, int], leaf: int = 1):
    """(values, flags, reasons) of all lines as lists, NULL values and flags where there is a reason."""
    values, flags, reasons, _ = parse_array(pa.array(lines, pa.string()), fmt, leaf)
    bad = [r is not None for r in reasons]
    return [None if b else v for b, v in zip(bad, values.tolist())], [None if b else f for b, f in zip(bad, flags.tolist())], reasons.tolist()


def rescue_lines(
    lines: DataFrame,
    file_col: str = "file_name",
    number_col: str = "line_no",
    line_col: str = "line",
    block_rows: int = 4096,
    hot_share: float = 0.001,
) -> DataFrame:
    """All lines but headers, with value DOUBLE, is_anomaly INT and reason STRING (NULL for valid lines).

    Files that hold more than hot_share of all lines (at most 1 / hot_share of them) meet their headers where they lie, by a
    broadcast of that many rows; their lines are dealt out by content. The others meet them in a join by file. Nothing is
    gathered per file."""
    out = T.StructType([f for f in lines.schema.fields if f.name.lower() not in ("value", "is_anomaly", "reason")])
    keep = [f.name for f in out.fields]
    out = out.add("value", T.DoubleType()).add("is_anomaly", T.IntegerType()).add("reason", T.StringType())

    first = (F.col(number_col) == 1) & F.col(file_col).isNotNull()
    heads = lines.where(first).groupBy(F.col(file_col).alias("__file")).agg(F.min(line_col).alias("__header"))
    total = lines.agg(F.count(F.lit(1))).scalar()
    hot = lines.groupBy(F.col(file_col).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__hot").isNotNull() & (F.col("__n") > total * hot_share)).select("__hot")
    hot = hot.join(heads, F.col("__hot") == F.col("__file"), "left").select("__hot", F.coalesce("__header", F.lit(None).cast("string")).alias("__hot_header"))
    body = lines.select(*keep).where(~F.coalesce(first, F.lit(False)))
    body = body.join(F.broadcast(hot), body[file_col] == F.col("__hot"), "left")
    body = body.withColumn("__salt", F.when(F.col("__hot").isNotNull() | F.col(file_col).isNull(), F.xxhash64(number_col, line_col)).otherwise(0))
    heads = heads.withColumn("__none", F.lit(0).cast("bigint"))
    met = body.join(heads, (body[file_col] == heads["__file"]) & (F.col("__salt") == F.col("__none")), "left")
    met = met.select(*[body[c] for c in keep], F.coalesce("__hot_header", "__header").alias("__header"))

    def parse(batches):
        for batch in batches:
            n = batch.num_rows
            values, flags, reasons = np.full(n, np.nan), np.zeros(n, np.int32), np.full(n, "no_header", object)
            heads = batch.column("__header").dictionary_encode()
            lines = batch.column(line_col).cast(pa.string())
            formats = [parse_header(h) for h in heads.dictionary.to_pylist()]
            kinds = {f: k for k, f in enumerate(dict.fromkeys(formats))}
            kind = np.array([kinds[f] for f in formats] + [-1])[pc.fill_null(heads.indices, len(formats)).to_numpy()]
            for fmt, k in kinds.items():
                rows = np.flatnonzero(kind == k)
                for at in range(0, len(rows), block_rows):
                    part = rows[at : at + block_rows]
                    values[part], flags[part], reasons[part], _ = parse_array(lines.take(pa.array(part)), fmt)
            bad = reasons.astype(bool)
            more = [pa.array(values, mask=bad), pa.array(flags, mask=bad), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], [*keep, "value", "is_anomaly", "reason"])

    return met.mapInArrow(parse, out)


def split_lines(lines: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(valid rows with value and is_anomaly, rejected rows with their reason)."""
    judged = rescue_lines(lines, **kw)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull()).drop("value", "is_anomaly")
