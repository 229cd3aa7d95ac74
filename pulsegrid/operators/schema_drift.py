"""Problem 6: schemas that drift between files.

Each file is read into a tagged union: per column (path) the alternatives among integer, decimal, boolean, datetime and
text that its cells show, with their counts and a small profile of the content. The unions of successive files of a feed
are fused: columns are matched by name, then by content together with role and stem of the name (a rename), and what is
left over was added or removed. A path keeps the type it last had and every alternative it has shown; a file that shows
another type is a change, and whether that alternative appears for the first time is reported with it. The alternatives of
all files of a feed stay side by side in the fused schema; rows come out with typed branches per path next to the canonical
conversion (timestamp, value, is_anomaly, extras).

Defined results
* NULL or empty content, or a header without cells, is a file without columns.
* Empty cells have no type. A column without any typed cell has no type; a change to it is no type change, and the last
  known type of the path goes on counting: integer, no type, text is a change in the third file.
* The type of a column is that of its cells; of several, decimal covers integer, and other mixtures count as text if
  text is among them, else as the commonest type.
* Of several files of one feed and file_seq only the one with the smallest file_id counts (re-delivery). Files without
  feed or file_seq are read but have no predecessor.
* Two columns of one name are told apart by a suffix #2, #3, ….
"""

from __future__ import annotations

import csv
import io
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import materialize

#: Words for a boolean, and the names of the three canonical columns in reduced form.
BOOLEAN_WORDS = {"true": 1, "false": 0, "yes": 1, "no": 0, "t": 1, "f": 0, "y": 1, "n": 0, "on": 1, "off": 0}
ROLES = {
    "timestamp": ("timestamp", "timestamps", "ts", "time", "datetime", "date"),
    "value": ("value", "val", "values", "reading", "readings", "measurement"),
    "is_anomaly": ("isanomaly", "anomaly", "anomalyflag", "anomalous"),
}
_ROLE_OF = {name: role for role, names in ROLES.items() for name in names}

_INTEGER = re.compile(r"[+-]?\d+")
_DECIMAL = re.compile(r"[+-]?(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][+-]?\d+)?")
_DATETIME = re.compile(r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?")

PROFILE = "name string, kind string, cells bigint, alternatives map<string,bigint>, low double, high double, mean double, words array<string>"


def kind_of(cell: str) -> str | None:
    """The tag of one cell; None for an empty one."""
    cell = cell.strip()
    if not cell:
        return None
    if _INTEGER.fullmatch(cell):
        return "integer"
    if _DECIMAL.fullmatch(cell):
        return "decimal"
    if cell.lower() in BOOLEAN_WORDS:
        return "boolean"
    if _DATETIME.fullmatch(cell):
        return "datetime"
    return "text"


def union_kind(tags: dict[str, int]) -> str | None:
    """The type of a column from its alternatives."""
    if not tags:
        return None
    if len(tags) == 1:
        return next(iter(tags))
    if set(tags) == {"integer", "decimal"}:
        return "decimal"
    if "text" in tags:
        return "text"
    return max(sorted(tags), key=tags.get)


def read_file(content: str | None) -> tuple[list[str], list[list[str]]]:
    """(column names, rows) of a small delimited file, whatever its delimiter, line ends, quoting and byte-order mark."""
    text = (content or "").lstrip("﻿")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    head = text.split("\n", 1)[0]
    if not head.strip():
        return [], []
    delimiter = max(",;\t|", key=lambda d: (_outside_quotes(head, d), d == ","))
    csv.field_size_limit(2**31 - 1)  # cells may be long
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter, strict=False))
    names, seen = [], Counter()
    for cell in rows[0]:
        name = cell.strip().strip('"').strip()
        seen[name] += 1
        names.append(name if seen[name] == 1 else f"{name}#{seen[name]}")
    return names, [r for r in rows[1:] if any(c.strip() for c in r)]


def _outside_quotes(line: str, d: str) -> int:
    return sum(part.count(d) for part in line.split('"')[::2])


SKETCH = 24  #: distinct words of a text column that stand for its content: those of the smallest checksums


def _sketch(words: set[str]) -> list[str]:
    return sorted(sorted(words, key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))[:SKETCH])


def profile_file(content: str | None) -> list[dict]:
    """The tagged union of one file: a profile per column."""
    names, rows = read_file(content)
    out = []
    for i, name in enumerate(names):
        cells = Counter(r[i].strip() for r in rows if i < len(r))
        cells.pop("", None)
        tags: Counter[str] = Counter()
        numbers, low, high = 0, math.inf, -math.inf
        total = 0.0
        for c, n in cells.items():
            tag = kind_of(c)
            tags[tag] += n
            if tag in ("integer", "decimal") and math.isfinite(x := float(c)):
                numbers, total, low, high = numbers + n, total + x * n, min(low, x), max(high, x)
        out.append(
            {
                "name": name,
                "kind": union_kind(tags),
                "cells": sum(tags.values()),
                "alternatives": dict(tags),
                "low": low if numbers else None,
                "high": high if numbers else None,
                "mean": total / numbers if numbers else None,
                "words": _sketch({c.lower() for c in cells}),
            }
        )
    return out


def reduced(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def name_affinity(a: str, b: str) -> float:
    """1 for the same name written differently, 0.9 for the same role, else the share of a common stem; 0 if unrelated."""
    x, y = reduced(a), reduced(b)
    if x == y:
        return 1.0
    if _ROLE_OF.get(x) and _ROLE_OF.get(x) == _ROLE_OF.get(y):
        return 0.9
    if _ROLE_OF.get(x) or _ROLE_OF.get(y):
        return 0.0
    stem = 0
    while stem < min(len(x), len(y)) and x[stem] == y[stem]:
        stem += 1
    if stem >= 4 or (stem >= 3 and stem == min(len(x), len(y))):
        return 0.5 + 0.4 * stem / max(len(x), len(y))
    tokens = [set(re.findall(r"[a-z]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1_\2", n).lower())) for n in (a, b)]
    return 0.6 if any(len(t) >= 3 for t in tokens[0] & tokens[1]) else 0.0


def content_affinity(a: dict, b: dict) -> float:
    """How well the content of b goes on that of a, in [0, 1]."""
    x, y = set(a["words"]), set(b["words"])
    if x and y and a["kind"] == b["kind"] and (max(len(x), len(y)) < SKETCH or a["mean"] is None):
        return len(x & y) / min(len(x), len(y))
    if a["mean"] is not None and b["mean"] is not None:
        low, high = min(a["low"], b["low"]), max(a["high"], b["high"])
        return max(0.0, (min(a["high"], b["high"]) - max(a["low"], b["low"])) / (high - low)) if high > low else 1.0
    return 0.5 if None in (a["kind"], b["kind"]) or a["kind"] != b["kind"] else 0.3


def same_content(a: dict, b: dict) -> bool:
    """The cells themselves go on: most of at least three distinct ones come again in a column of the same type."""
    x, y = set(a["words"]), set(b["words"])
    return a["kind"] == b["kind"] and min(len(x), len(y)) >= 3 and len(x & y) >= 0.8 * min(len(x), len(y))


def match(before: list[dict], after: list[dict]) -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """(pairs of names that are one path, names that were added, names that were removed) between two successive files."""
    old, new = {p["name"]: p for p in before}, {p["name"]: p for p in after}
    pairs = [(n, n) for n in new if n in old]
    gone, come = [n for n in old if n not in new], [n for n in new if n not in old]
    scored = []
    for i, a in enumerate(gone):
        for j, b in enumerate(come):
            affinity = name_affinity(a, b)
            if affinity > 0 or same_content(old[a], new[b]):
                scored.append((-(affinity + 0.5 * content_affinity(old[a], new[b])), i, j, a, b))
    left, right = dict.fromkeys(gone), dict.fromkeys(come)
    for _, _, _, a, b in sorted(scored):
        if a in left and b in right:
            del left[a], right[b]
            pairs.append((a, b))
    return pairs, list(right), list(left)


@dataclass
class Known:
    """What is known of a path: the type it last had, and every alternative it has shown; inherited from `origin`, a path
    at the start of the stretch of files, where that is not known yet."""

    kind: str | None
    seen: frozenset[str]
    origin: str | None = None

    def followed(self, column: dict) -> Known:
        return Known(column["kind"] or self.kind, self.seen | frozenset(column["alternatives"]), self.origin)


def start(columns: list[dict]) -> dict[str, Known]:
    return {p["name"]: Known(p["kind"], frozenset(p["alternatives"])) for p in columns}


def advance(state: dict[str, Known], before: list[dict], after: list[dict]) -> tuple[list[tuple], dict[str, Known]]:
    """(changes, state after it) of one file after another one.

    A change is (change, field, type before, type after, whether that alternative is new on the path, the path at the start of
    the stretch that this depends on or None)."""
    pairs, come, gone = match(before, after)
    new = {p["name"]: p for p in after}
    out = [("renamed", b, None, None, None, None) for a, b in pairs if a != b]
    out += [("added", b, None, None, None, None) for b in come] + [("removed", a, None, None, None, None) for a in gone]
    for a, b in pairs:
        was, now = state[a].kind, new[b]["kind"]
        if now is not None and was != now and (was is not None or state[a].origin is not None):
            out.append(("type_changed", b, was, now, now not in state[a].seen, state[a].origin))
    follow = start([new[b] for b in come]) | {b: state[a].followed(new[b]) for a, b in pairs}
    return out, {p["name"]: follow[p["name"]] for p in after}


def fuse(before: list[dict], after: list[dict]) -> list[tuple[str, str]]:
    """(change, field) between two successive files."""
    return [c[:2] for c in advance(start(before), before, after)[0]]


def file_schemas(files: DataFrame, file_id: str = "file_id", content: str = "content", keep: tuple[str, ...] = ("feed", "file_seq")) -> DataFrame:
    """The tagged union of each file: (file_id, kept columns, schema ARRAY<STRUCT>)."""
    fields = [f"`{c}` {dict(files.dtypes)[c]}" for c in (file_id, *keep)]

    def profile(batches):
        for pdf in batches:
            yield pdf.drop(columns=content).assign(schema=[profile_file(c if isinstance(c, str) else None) for c in pdf[content]])

    return files.select(file_id, *keep, content).mapInPandas(profile, ", ".join(fields) + f", schema array<struct<{_nested(PROFILE)}>>")


def _nested(fields: str) -> str:
    return re.sub(r"(\w+) (\w+<[^>]*>|\w+)(, |$)", r"\1:\2\3", fields)


def schema_changes(files: DataFrame, file_id: str = "file_id", feed: str = "feed", seq: str = "file_seq", content: str = "content", bucket: int = 256) -> DataFrame:
    """(file_id, change, field, was, now, appears) of each change of a file against the previous ones of its feed; was, now
    and appears (the alternative is new on its path) belong to type changes.

    Contents are parsed once, where they lie; profiles are shuffled once, into stretches of `bucket` file numbers per feed.
    A stretch is fused from its start with the paths' earlier types left open, and ends in one row of its own. A running
    fusion over these rows (one per stretch, in the order of the feed, one batch at a time) gives every stretch the types its
    paths had before, which settle what was left open."""
    profiles = file_schemas(files, file_id, content, (feed, seq)).where(F.col(feed).isNotNull() & F.col(seq).isNotNull())
    kinds = dict(files.dtypes)
    stretch = profiles.withColumn("__b", F.floor(F.col(seq) / bucket)).repartition(feed, "__b").sortWithinPartitions(feed, "__b", seq, file_id)
    head = f"feed {kinds[feed]}, b bigint, file_id {kinds[file_id]}, "
    record = f"struct<{_nested(PROFILE)}>"
    own = head + f"change string, field string, was string, now string, appears boolean, origin string, first array<{record}>, last array<{record}>, paths array<{_KNOWN}>"

    def fuse_stretch(batches):
        at, state, first, last, number, first_id = None, {}, None, None, None, None
        blank = dict.fromkeys(("change", "field", "was", "now", "appears", "origin", "first", "last", "paths"))

        def end():
            return blank | {"feed": at[0], "b": at[1], "file_id": first_id, "first": first, "last": last, "paths": _rows_of(state)}

        for pdf in batches:
            out = []
            for fd, b, q, fid, schema in zip(pdf[feed], pdf["__b"], pdf[seq], pdf[file_id], pdf["schema"]):
                if (fd, b) == at and q == number:
                    continue  # a re-delivery
                columns = _plain(schema)
                if (fd, b) != at:
                    if at is not None:
                        out.append(end())
                    at, first, first_id = (fd, b), columns, fid
                    state = {n: Known(k.kind, k.seen, n) for n, k in start(columns).items()}
                else:
                    changes, state = advance(state, last, columns)
                    out += [blank | {"feed": fd, "b": b, "file_id": fid} | dict(zip(("change", "field", "was", "now", "appears", "origin"), c)) for c in changes]
                last, number = columns, q
            yield pd.DataFrame(out, columns=_OWN)
        if at is not None:
            yield pd.DataFrame([end()], columns=_OWN)

    fused = materialize(stretch.select(feed, "__b", seq, file_id, "schema").mapInPandas(fuse_stretch, own), "stretches")
    borders = fused.where("change is null").select("feed", "b", "file_id", "first", "last", "paths").repartition("feed").sortWithinPartitions("feed", "b")
    carried = head + "change string, field string, was string, now string, appears boolean, kind string, seen array<string>"

    def fuse_borders(batches):
        at, state, last = None, {}, None
        for pdf in batches:
            out = []
            for fd, b, fid, first, end, paths in zip(*(pdf[c] for c in ("feed", "b", "file_id", "first", "last", "paths"))):
                first, end = _plain(first), _plain(end)
                come: dict[str, Known] = {}
                if fd == at:
                    changes, follow = advance(state, last, first)
                    out += [(fd, b, fid, *c[:5], None, None) for c in changes]
                    pairs = {y: x for x, y in match(last, first)[0]}
                    come = {y: state[x] for y, x in pairs.items()}
                    out += [(fd, b, fid, None, n, None, None, None, k.kind, sorted(k.seen)) for n, k in come.items()]
                at, last = fd, end
                empty = Known(None, frozenset())
                state = {p["name"]: Known(p["kind"] or come.get(p["origin"], empty).kind, frozenset(p["seen"]) | come.get(p["origin"], empty).seen) for p in map(dict, paths)}
            yield pd.DataFrame(out, columns=["feed", "b", "file_id", "change", "field", "was", "now", "appears", "kind", "seen"])

    running = materialize(borders.mapInPandas(fuse_borders, carried), "borders")
    before = running.where("change is null").select(F.col("feed").alias("__f"), F.col("b").alias("__b"), F.col("field").alias("__o"), "kind", "seen")
    found = fused.where("change is not null")
    met = found.join(before, (F.col("feed") == F.col("__f")) & (F.col("b") == F.col("__b")) & (F.col("origin") == F.col("__o")), "left")
    met = met.withColumn("was", F.coalesce("was", "kind")).withColumn("appears", F.col("appears") & ~F.coalesce(F.array_contains("seen", F.col("now")), F.lit(False)))
    settled = met.where("change <> 'type_changed' or (was is not null and was <> now)")
    names = [F.col("file_id").alias(file_id), "change", "field", "was", "now", "appears"]
    return settled.select(*names).unionByName(running.where("change is not null").select(*names))


_KNOWN = "struct<name:string,kind:string,seen:array<string>,origin:string>"
_OWN = ["feed", "b", "file_id", "change", "field", "was", "now", "appears", "origin", "first", "last", "paths"]


def _rows_of(state: dict[str, Known]) -> list[dict]:
    return [{"name": n, "kind": k.kind, "seen": sorted(k.seen), "origin": k.origin} for n, k in state.items()]


def _plain(schema) -> list[dict]:
    return [p | {"words": list(p["words"]) if p["words"] is not None else [], "alternatives": dict(p["alternatives"])} for p in map(dict, schema)]


def fused_schema(files: DataFrame, file_id: str = "file_id", feed: str = "feed", content: str = "content") -> DataFrame:
    """The fused schema: per feed and path (canonical role, or stem of the extra) every alternative with its count.

    `alternative` is the tag, `spelling` the name it came under; first_file and last_file bound its appearance."""
    path = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _ROLE_OF.items() for x in kv]), F.col("reduced")), F.col("reduced"))
    return (
        file_schemas(files, file_id, content, (feed,))
        .select(feed, file_id, F.inline("schema"))
        .select(feed, file_id, F.col("name").alias("spelling"), F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").alias("reduced"), F.explode("alternatives").alias("alternative", "n"))
        .withColumn("path", path)
        .groupBy(feed, "path", "spelling", "alternative")
        .agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("files"), F.min(file_id).alias("first_file"), F.max(file_id).alias("last_file"))
    )


ROWS = (
    "row_no int, ts timestamp_ntz, value double, is_anomaly int, ts_integer bigint, ts_text string, value_integer bigint, value_decimal double, value_text string, "
    "flag_integer bigint, flag_decimal double, flag_boolean boolean, flag_text string, extras map<string,string>"
)

_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d/%m/%Y %H:%M", "%Y/%m/%d %H:%M:%S", "%Y-%m-%d", "%d.%m.%Y")


def parse_time(cell: str):
    """Canonical time of a cell: epoch seconds or one of the known date-time texts; None otherwise."""
    import datetime as dt

    cell = cell.strip()
    if _INTEGER.fullmatch(cell):
        try:
            return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(cell))
        except OverflowError:
            return None
    bare = re.sub(r"\s*(?:Z|UTC)$", "", cell)
    for f in _FORMATS:
        try:
            return dt.datetime.strptime(bare, f)
        except ValueError:
            continue
    return None


def unify_rows(files: DataFrame, file_id: str = "file_id", feed: str = "feed", seq: str = "file_seq", content: str = "content") -> DataFrame:
    """All rows of all files in one table: typed branches per path, canonical ts, value and is_anomaly, extras by stem.

    Re-delivered files are left out (smallest file_id of a feed and file_seq stays); rows that repeat within a file stay."""
    kept = files.select(file_id, feed, seq, content)
    numbered = files.where(F.col(feed).isNotNull() & F.col(seq).isNotNull()).groupBy(F.col(feed).alias("__f"), F.col(seq).alias("__q"))
    again = numbered.agg(F.min(file_id).alias("__i"), F.collect_list(file_id).alias("__all")).where(F.size("__all") > 1)
    again = again.select(F.explode(F.filter("__all", lambda x: x > F.col("__i"))).alias("__again"))
    once = kept.join(again, F.col(file_id) == F.col("__again"), "left_anti")
    fields = [f"`{c}` {dict(files.dtypes)[c]}" for c in (file_id, feed, seq)]

    def load(batches):
        for pdf in batches:
            out = []
            for fid, fd, sq, text in zip(pdf[file_id], pdf[feed], pdf[seq], pdf[content]):
                names, rows = read_file(text if isinstance(text, str) else None)
                roles = [_ROLE_OF.get(reduced(n)) for n in names]
                for k, r in enumerate(rows):
                    rec = dict.fromkeys(_ROW_NAMES)
                    rec |= {file_id: fid, feed: fd, seq: sq, "row_no": k + 1, "extras": {}}
                    for name, role, cell in zip(names, roles, r):
                        _branch(rec, name, role, cell.strip())
                    out.append(rec)
            frame = pd.DataFrame(out, columns=[file_id, feed, seq, *_ROW_NAMES])
            for c in ("ts_integer", "value_integer", "flag_integer"):
                frame[c] = frame[c].astype("Int64")
            frame["is_anomaly"] = frame["is_anomaly"].astype("Int32")
            frame["ts"] = pd.to_datetime(frame["ts"])
            for c in ("value", "value_decimal", "flag_decimal"):
                frame[c] = frame[c].astype("Float64")
            frame["flag_boolean"] = frame["flag_boolean"].astype("boolean")
            yield frame

    return once.mapInPandas(load, ", ".join(fields) + ", " + ROWS)


_ROW_NAMES = [part.split(" ")[0] for part in re.sub(r"<[^>]*>", "", ROWS).split(", ")]


def _branch(rec: dict, name: str, role: str | None, cell: str) -> None:
    tag = kind_of(cell)
    if tag is None:
        return
    if role is None:
        rec["extras"][reduced(name) or name] = cell
    elif role == "timestamp":
        rec["ts"] = parse_time(cell)
        rec["ts_integer" if tag == "integer" and abs(int(cell)) < 2**63 else "ts_text"] = int(cell) if tag == "integer" and abs(int(cell)) < 2**63 else cell
    else:
        prefix = "value" if role == "value" else "flag"
        plain = tag if f"{prefix}_{tag}" in _ROW_NAMES and not (tag == "integer" and abs(int(cell)) >= 2**63) else "text"
        rec[f"{prefix}_{plain}"] = {"integer": int, "decimal": float, "boolean": lambda c: bool(BOOLEAN_WORDS[c.lower()])}.get(plain, str)(cell)
        if role == "value":
            rec["value"] = float(cell) if tag in ("integer", "decimal") else None
        else:
            rec["is_anomaly"] = int(float(cell) != 0) if tag in ("integer", "decimal") else BOOLEAN_WORDS.get(cell.lower())
