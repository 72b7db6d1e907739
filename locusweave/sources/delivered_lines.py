"""Delivered text lines, of which some do not parse: loaded rows and failures with a reason.

Each block of lines goes through a bulk parser that works on whole Arrow columns and says which
lines it refuses. A block with a refused line is halved, and so are its halves, until each of those
lines stands alone; what a half would say if it were parsed again is known from the running number
of refused lines, so that a half costs a subtraction and not another pass. The lines that stand
alone are read strictly, field by field, which names the reason. The bulk parsers may refuse a good
line (the strict reader then loads it) but never pass a bad one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block has as many lines, or less where they are long; a longer line is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
INT_MAX = 2147483647
#: How a missing state is written, in lower case.
MISSING = ("", "na", "nan", "null", ".")

PILEUP_TYPE = "struct<chrom:string,pos:int,ref:string,inputs:array<struct<depth:int,symbols:string,quals:string,names:array<string>>>>"
CN_TYPE = (
    "struct<chrom:string,start_pos:int,end_pos:int,hp1_coverage:double,hp1_state:double,hp1_confidence:double,"
    "hp2_coverage:double,hp2_state:double,hp2_confidence:double,extra:array<string>>"
)
_INPUT = pa.struct([("depth", pa.int32()), ("symbols", pa.string()), ("quals", pa.string()), ("names", pa.list_(pa.string()))])
_PILEUP = pa.struct([("chrom", pa.string()), ("pos", pa.int32()), ("ref", pa.string()), ("inputs", pa.list_(_INPUT))])
_TRACKS = ("hp1_coverage", "hp1_state", "hp1_confidence", "hp2_coverage", "hp2_state", "hp2_confidence")
_CN = pa.struct(
    [("chrom", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]
    + [(t, pa.float64()) for t in _TRACKS]
    + [("extra", pa.list_(pa.string()))]
)


def _integer(text: str, least: int) -> int | None:
    """ASCII digits only, from ``least`` to the largest int; else null."""
    if not text or not text.isascii() or not text.isdigit():
        return None
    text = text.lstrip("0") or "0"
    value = int(text) if len(text) <= 10 else INT_MAX + 1
    return value if least <= value <= INT_MAX else None


def _integers(column: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values, and which of them are integers from ``least`` on of up to ten digits."""
    shaped = pc.match_substring_regex(column, r"\A[0-9]{1,10}\z")
    values = pc.cast(pc.if_else(shaped, column, pa.scalar("0")), pa.int64()).to_numpy()
    return values, _mask(shaped) & (values >= least) & (values <= INT_MAX)


def _mask(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _cells(lines: pa.Array, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All fields between tabs, where each line's first one lies, and how many it has. A line of
    less than ``least`` fields is given the place of the first line that has them, or -1."""
    fields = pc.split_pattern(lines, "\t")
    width = pc.list_value_length(fields).to_numpy()
    at = fields.offsets.to_numpy()[:-1].astype(np.int64)
    at = at - at[0] if len(at) else at
    wide = np.flatnonzero(width >= least)
    return fields.flatten(), np.where(width >= least, at, at[wide[0]] if len(wide) else -1), width


# ---------------------------------------------------------------- pileup lines


#: A read's start with its mapping quality, a read's end, the head of an insertion or deletion, or
#: a run of bases.
_PIECE = re.compile(r"\^.|\$|[-+]([0-9]+)|[^-+^$]+", re.DOTALL)
#: The same syntax in one go, for insertions and deletions of up to so many bases.
_LONGEST = 40
_SYNTAX = r"(?s)\^.|\$|[-+]0*(?:" + "|".join(rf"{n}[^0-9].{{{n - 1}}}" for n in range(1, _LONGEST + 1)) + ")"


def base_symbols(raw: str) -> str | None:
    """The base letters of a pileup string without its control syntax; null if it is malformed."""
    kept, end = [], 0
    while end < len(raw):
        piece = _PIECE.match(raw, end)
        if piece is None:
            return None
        end = piece.end()
        if piece[1] is not None:
            end += _integer(piece[1], 1) or len(raw) + 1
        elif piece[0][0] not in "^$":
            kept.append(piece[0])
    return "".join(kept) if end == len(raw) else None


def bulk_pileup(lines: pa.Array) -> tuple[np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """Which lines are refused, and a function that makes the rows of given other ones."""
    flat, at, width = _cells(lines, 7)
    refused = (width < 7) | (width % 4 != 3)
    if (at < 0).any():
        return refused, lambda keep: pa.array([], _PILEUP)
    pos, whole = _integers(flat.take(pa.array(at + 1)), 1)
    refused |= ~whole
    inputs = np.where(refused, 0, (width - 3) // 4)
    row = np.repeat(np.arange(len(width)), inputs)
    first = np.cumsum(inputs) - inputs
    depth_at = at[row] + 3 + 4 * (np.arange(len(row)) - first[row])
    depth, counted = _integers(flat.take(pa.array(depth_at)), 0)
    size, commas = pc.utf8_length(flat).to_numpy(), pc.count_substring(flat, ",").to_numpy()
    plain = pc.replace_substring_regex(flat.take(pa.array(depth_at + 1)), _SYNTAX, "")
    clean = ~_mask(pc.match_substring_regex(plain, r"[-+^]")) & (pc.utf8_length(plain).to_numpy() == depth)
    fits = (commas[depth_at + 3] + 1 == depth) & clean & (size[depth_at + 2] == depth)
    refused[row[~(counted & (fits | (depth == 0)))]] = True

    def rows(keep: np.ndarray) -> pa.Array:
        mine = np.flatnonzero(~refused[row])
        own = pa.array(depth_at[mine])
        used = pa.array(depth[mine] > 0)
        empty = pa.scalar("", pa.string())
        quals, names = (flat.take(pc.add(own, k)) for k in (2, 3))
        listed = pc.split_pattern(names, ",")
        packed = pa.StructArray.from_arrays(
            [
                pa.array(depth[mine], pa.int32()),
                pc.if_else(used, plain.take(pa.array(mine)), empty),
                pc.if_else(used, quals, empty),
                pc.if_else(used, listed, pa.scalar([], listed.type)),
            ],
            fields=list(_INPUT),
        )
        offsets = pa.array(np.append(0, np.cumsum(inputs[keep])).astype(np.int32))
        chrom, ref = (flat.take(pa.array(at[keep] + k)) for k in (0, 2))
        return pa.StructArray.from_arrays([chrom, pa.array(pos[keep], pa.int32()), ref, pa.ListArray.from_arrays(offsets, packed)], fields=list(_PILEUP))

    return refused, rows


def strict_pileup(line: str) -> tuple[str | None, dict | None]:
    fields = line.split("\t")
    if len(fields) < 7 or len(fields) % 4 != 3:
        return "columns", None
    if (pos := _integer(fields[1], 1)) is None:
        return "position", None
    groups = [fields[i : i + 4] for i in range(3, len(fields), 4)]
    depths = [_integer(g[0], 0) for g in groups]
    if None in depths:
        return "depth", None
    covered = [(d, *g[1:]) for d, g in zip(depths, groups, strict=True) if d]
    if any(len(names.split(",")) != d for d, _, _, names in covered):
        return "names", None
    for d, bases, _, _ in covered:
        if (symbols := base_symbols(bases)) is None or len(symbols) != d:
            return "bases", None
    if any(len(quals) != d for d, _, quals, _ in covered):
        return "quals", None
    inputs = [
        {"depth": d, "symbols": base_symbols(g[1]) if d else "", "quals": g[2] if d else "", "names": g[3].split(",") if d else []}
        for d, g in zip(depths, groups, strict=True)
    ]
    return None, {"chrom": fields[0], "pos": pos, "ref": fields[2], "inputs": inputs}


# ---------------------------------------------------------------- copy-number lines

_BLANKS = " \t\r\n\f\v"
_STATE = re.compile(r"[0-9]+(?:\.[0-9]+)?", re.ASCII)
_ANY_STATE = r"(?i)\A(?:" + "|".join(map(re.escape, MISSING)) + r"|[0-9]+(?:\.[0-9]+)?)\z"
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def quoted_fields(line: str) -> list[str] | None:
    """The fields of a line; null if a quoted field does not end right before a tab or the end."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            text, i = [], i + 1
            while True:
                close = line.find('"', i)
                if close < 0:
                    return None
                text.append(line[i:close])
                i = close + 1
                if i < n and line[i] == '"':
                    text.append('"')
                    i += 1
                    continue
                break
            if i < n and line[i] != "\t":
                return None
            fields.append("".join(text))
        else:
            stop = line.find("\t", i)
            stop = n if stop < 0 else stop
            fields.append(line[i:stop])
            i = stop
        if i >= n:
            return fields
        i += 1


def _number(text: str) -> float | None:
    text = text.strip(_BLANKS)
    return float(text) if re.fullmatch(_NUMBER, text, re.ASCII) else None


def bulk_cn(lines: pa.Array) -> tuple[np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """As :func:`bulk_pileup`, for lines of a copy-number profile."""
    flat, at, width = _cells(lines, 9)
    refused = width < 9
    if (at < 0).any():
        return refused, lambda keep: pa.array([], _CN)
    quoted = pc.starts_with(flat, '"')
    if pc.any(quoted).as_py():
        # Quoted fields with a tab or a quote inside are the strict reader's business.
        simple = pc.match_substring_regex(flat, r'\A"[^"]*"\z')
        refused[np.repeat(np.arange(len(width)), width)[_mask(pc.and_not(quoted, simple))]] = True
        flat = pc.if_else(pc.and_(quoted, simple), pc.utf8_slice_codeunits(flat, 1, -1), flat)
    column = lambda k, lines_at=at: pc.utf8_trim(flat.take(pa.array(lines_at + k)), characters=_BLANKS)
    refused |= _mask(pc.equal(column(0), ""))
    start, from_ok = _integers(column(1), 0)
    end, to_ok = _integers(column(2), 0)
    refused |= ~(from_ok & to_ok & (end > start))
    for k in (4, 7):
        refused |= ~_mask(pc.match_substring_regex(column(k), _ANY_STATE))

    def rows(keep: np.ndarray) -> pa.Array:
        own = at[keep]
        out = [column(0, own), pa.array(start[keep], pa.int32()), pa.array(end[keep], pa.int32())]
        for k in range(3, 9):
            text = column(k, own)
            number = pc.match_substring_regex(text, rf"\A{_NUMBER}\z")
            out.append(pc.cast(pc.if_else(number, text, pa.scalar(None, pa.string())), pa.float64()))
        # The optional columns are what is left of each line's run of fields.
        extra = width[keep] - 9
        ends = np.cumsum(extra)
        take = np.repeat(own + 9 - (ends - extra), extra) + np.arange(ends[-1] if len(ends) else 0)
        rest = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat.take(pa.array(take)))
        return pa.StructArray.from_arrays([*out, rest], fields=list(_CN))

    return refused, rows


def strict_cn(line: str) -> tuple[str | None, dict | None]:
    fields = quoted_fields(line)
    if fields is None:
        return "quoting", None
    if len(fields) < 9:
        return "columns", None
    chrom = fields[0].strip(_BLANKS)
    if not chrom:
        return "chrom", None
    start, end = (_integer(f.strip(_BLANKS), 0) for f in fields[1:3])
    if start is None or end is None or end <= start:
        return "coordinates", None
    for text in (fields[4], fields[7]):
        state = text.strip(_BLANKS)
        if state.lower() not in MISSING and not _STATE.fullmatch(state):
            return "state", None
    values = {name: _number(text) for name, text in zip(_TRACKS, fields[3:9], strict=True)}
    return None, {"chrom": chrom, "start_pos": start, "end_pos": end, **values, "extra": fields[9:]}


# ---------------------------------------------------------------- blocks


def isolated(refused: np.ndarray) -> list[int]:
    """The places of the refused lines of a block, found by halving it."""
    upto = np.append(0, np.cumsum(refused)).tolist()
    found, todo = [], [(0, len(refused))]
    while todo:
        lo, hi = todo.pop()
        if upto[lo] == upto[hi]:
            continue
        if hi - lo == 1:
            found.append(lo)
        else:
            middle = (lo + hi) // 2
            todo += [(middle, hi), (lo, middle)]  # the left half is taken first
    return found


def parse_block(lines: pa.Array, bulk: Callable, strict: Callable, packed: pa.DataType | None) -> tuple[list[str | None], pa.Array | None]:
    """Reasons (null where the line is valid) and, if their type is given, parsed rows (null where
    it is not), in order."""
    refused, rows = bulk(lines)
    alone = isolated(refused)
    read = [strict(line) for line in lines.take(pa.array(alone, pa.int64())).to_pylist()]
    reasons: list[str | None] = [None] * len(lines)
    for at, (reason, _) in zip(alone, read, strict=True):
        reasons[at] = reason
    if packed is None:
        return reasons, None
    keep = np.flatnonzero(~refused)
    both = pa.concat_arrays([rows(keep), pa.array([row for _, row in read], packed)])
    return reasons, both.take(pa.array(np.argsort(np.concatenate([keep, np.array(alone, np.int64)]), kind="stable")))


def _blocks(lines: pa.Array) -> Iterator[tuple[int, int]]:
    upto = np.append(0, np.cumsum(pc.binary_length(lines).to_numpy()))
    lo = 0
    while lo < len(lines):
        hi = min(len(lines), lo + BLOCK_ROWS, int(np.searchsorted(upto, upto[lo] + BLOCK_BYTES, "right")) - 1)
        yield lo, max(lo + 1, hi)
        lo = max(lo + 1, hi)


def _loader(bulk: Callable, strict: Callable, packed: pa.DataType | None) -> Callable:
    """Loads all lines, or without a type of rows only tells the failing ones."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.columns
            for lo, hi in _blocks(text):
                reasons, rows = parse_block(text.slice(lo, hi - lo), bulk, strict, packed)
                out = pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(reasons, pa.string())], names=["line_id", "reason"])
                yield out.filter(pc.is_valid(out.column(1))) if rows is None else out.append_column("row", rows)

    return load


def _content(raw: DataFrame) -> DataFrame:
    line = F.col("line").cast("string")
    kept = raw.where(line.isNotNull() & line.rlike(r"\S") & ~line.startswith("#"))
    return kept.select(F.col("line_id").cast("bigint").alias("line_id"), line.alias("line"))


def _parsed(raw: DataFrame, bulk: Callable, strict: Callable, packed: pa.DataType, ddl: str) -> DataFrame:
    return _content(raw).mapInArrow(_loader(bulk, strict, packed), f"line_id bigint, reason string, row {ddl}")


def parse_pileup(raw: DataFrame) -> DataFrame:
    """``line_id, reason, row`` of each pileup line: ``reason`` null and ``row`` set, or the other
    way round. Null and blank lines and lines that start with ``#`` are left out; a null
    ``line_id`` stays null; repeated lines come out as often as they came in. Lines of any length
    are read whole."""
    return _parsed(raw, bulk_pileup, strict_pileup, _PILEUP, PILEUP_TYPE)


def parse_copy_number(raw: DataFrame) -> DataFrame:
    """As :func:`parse_pileup`, for lines of a copy-number profile."""
    return _parsed(raw, bulk_cn, strict_cn, _CN, CN_TYPE)


def failures(pileup_raw: DataFrame, cn_profile_raw: DataFrame) -> DataFrame:
    """``raw_table, line_id, reason`` of every line of either table that does not load."""
    found = [
        _content(raw).mapInArrow(_loader(bulk, strict, None), "line_id bigint, reason string").select(F.lit(name).alias("raw_table"), "line_id", "reason")
        for name, raw, bulk, strict in (("pileup_raw", pileup_raw, bulk_pileup, strict_pileup), ("cn_profile_raw", cn_profile_raw, bulk_cn, strict_cn))
    ]
    return found[0].unionByName(found[1])
