"""Schemas that drift between files (problem 6).

Each file is read once into tagged fields (path, JSON type, value).  The files
of a line are fused, in order, into unions: a union knows the fields it begins
and ends with, the alternatives that occur under each path and what a path's
type was last.  Unions of neighbouring runs of files fuse to the union of both,
and every alternative that appears, goes, moves or changes type between them is
reported, so a line of any length is cut into runs that are folded in parallel
and fused as a tree.  A path with conflicting types is split into one typed
branch per type next to one canonical column.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.session import cut_table

TYPES = ("boolean", "number", "string", "array")
CHUNK = 1024  # versions of a line, or unions of its runs, that one task fuses at most
FIELD = "struct<path:string,type:string,value:string>"
OPAQUE = ("meta.cost_per_1k_input_usd",)

Tags = list[tuple[str, str | None, str | None]]


def _number(v: float) -> str:
    if isinstance(v, int) and abs(v) >= 1 << 53:
        return str(v)
    return repr(float(v))


def tag_fields(text: str | None, root: str, opaque: Sequence[str]) -> list[tuple[str, str | None, str | None]] | None:
    """(path, type, value) of every value under ``root`` that is no object; None where the text is not readable.

    The value is in one form for equal JSON values; a JSON null has neither
    type nor value.  Objects named in ``opaque`` hold keys that are data, so
    nothing under them is a field.  An empty object has no fields.
    """
    if text is None:
        return None
    try:
        doc = json.loads(text.lstrip("﻿").strip())
    except (ValueError, RecursionError):
        return None
    out: list[tuple[str, str | None, str | None]] = []
    stack = [(root, doc.get(root))] if isinstance(doc, dict) and root in doc else []
    while stack:
        path, v = stack.pop()
        if path in opaque:
            continue
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}", x) for k, x in v.items())
        elif v is None:
            out.append((path, None, None))
        elif isinstance(v, bool):
            out.append((path, "boolean", "true" if v else "false"))
        elif isinstance(v, (int, float)):
            out.append((path, "number", _number(v)))
        elif isinstance(v, str):
            out.append((path, "string", v))
        else:
            out.append((path, "array", json.dumps(v, sort_keys=True, ensure_ascii=False)))
    return sorted(dict((p, (p, t, x)) for p, t, x in out).values())


def tagged_files(files: DataFrame, line: str, seq: str, file_id: str, text: str, root: str = "meta", opaque: Sequence[str] = OPAQUE) -> DataFrame:
    """line, seq, file_id, tags of readable deliveries: a JSON list of [path, type, value].

    Null, empty and cut-off texts are not readable.  Rows with a null line, seq
    or id can't be placed in a sequence and are left out.  Of the deliveries of
    one (line, seq) in a batch only the one with the smallest id goes on, so a
    version that is delivered very often is thinned before it is shuffled.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values("file_id", ignore_index=True)
            tags: list[str | None] = []
            done: set[tuple[str, int]] = set()
            for ln, sq, t in zip(pdf["line"], pdf["seq"], pdf.pop("text")):
                one = None if (ln, sq) in done else tag_fields(t, root, opaque)
                tags.append(None if one is None else json.dumps(one, ensure_ascii=False))
                if one is not None:
                    done.add((ln, sq))
            yield pdf.assign(tags=tags)[[t is not None for t in tags]]

    src = files.select(F.col(line).cast("string").alias("line"), F.col(seq).cast("long").alias("seq"), F.col(file_id).cast("long").alias("file_id"), F.col(text).alias("text"))
    return src.where(F.col("line").isNotNull() & F.col("seq").isNotNull() & F.col("file_id").isNotNull() & F.col("text").isNotNull()).mapInPandas(parse, "line string, seq long, file_id long, tags string")


def readable_files(tagged: DataFrame) -> DataFrame:
    """line, seq, file_id, fields of the readable delivery with the smallest id of each (line, seq)."""
    one = tagged.groupBy("line", "seq").agg(F.min(F.struct("file_id", "tags")).alias("f"))
    fields = F.transform(F.from_json("f.tags", "array<array<string>>"), lambda x: F.struct(x[0].alias("path"), x[1].alias("type"), x[2].alias("value")))
    return one.select("line", "seq", "f.file_id", fields.alias("fields"))


# -- unions of the files of a line --------------------------------------------

INHERIT = "^"  # the type that a path had before the run: it holds only nulls in all of it

_UNION = "line string, chunk long, is_change boolean, file_id long, seq long, field_path string, change_kind string, old_path string, old_type string, new_type string, body string"
_CHANGE = ("file_id", "line", "seq", "field_path", "change_kind", "old_path", "old_type", "new_type")


@dataclass
class Union:
    """What a run of a line's files holds, as far as its neighbours and the fused schema need it."""

    first: tuple[int, int]  # file_id, seq
    last: int  # seq of the last file
    head: dict[str, tuple[str | None, str | None]]  # fields of the first file
    tail: dict[str, tuple[str | None, str | None]]  # and of the last one
    # path -> (type, file_id, seq) of the first value that is not null, of paths that are there since the first file; None while there is none
    pending: dict[str, tuple[str, int, int] | None]
    state: dict[str, str | None]  # path of the last file -> type of its last value since it appeared, None or INHERIT
    kinds: dict[str, list] = field(default_factory=dict)  # path, a tab and its type -> [files, first seq, last seq]

    @classmethod
    def of(cls, file_id: int, seq: int, tags: Tags) -> Union:
        fields = {p: (t, v) for p, t, v in tags}
        return cls(
            (file_id, seq), seq, fields, fields, {p: (t, file_id, seq) if t else None for p, (t, _) in fields.items()},
            {p: t or INHERIT for p, (t, _) in fields.items()}, {f"{p}\t{t or ''}": [1, seq, seq] for p, (t, _) in fields.items()},
        )

    def dump(self) -> str:
        return json.dumps([self.first, self.last, self.head, self.tail, self.pending, self.state, self.kinds], ensure_ascii=False)

    @classmethod
    def load(cls, body: str) -> Union:
        first, last, head, tail, pending, state, kinds = json.loads(body)
        pair = lambda d: {p: (t, v) for p, (t, v) in d.items()}
        return cls(tuple(first), last, pair(head), pair(tail), {p: tuple(x) if x else None for p, x in pending.items()}, state, kinds)

    def fuse(self, right: Union, report: list[tuple]) -> None:
        """Takes in the union of the files behind; reports what appears, goes, moves or changes type."""
        at = right.first
        if self.tail.keys() != right.head.keys():
            new = [p for p in right.head if p not in self.tail]
            gone: dict[tuple, list[str]] = {}
            for p in self.tail:
                if p not in right.head:
                    gone.setdefault(self.tail[p], []).append(p)
            used = set()
            for p in new:
                olds = gone.get(right.head[p], ()) if right.head[p][0] is not None else ()
                used.update(olds)
                report.append((*at, p, "renamed" if olds else "added", min(olds, default=None), None, right.head[p][0]))
            report += [(*at, p, "removed", None, self.tail[p][0], None) for olds in gone.values() for p in olds if p not in used]
        for p, found in right.pending.items():
            old = self.state.get(p) if p in self.tail else None
            if found and old and old != INHERIT and old != found[0]:
                report.append((found[1], found[2], p, "retyped", None, old, found[0]))
        for p, found in self.pending.items():
            # still without a value, and there in all files up to here
            if found is None and self.state.get(p) == INHERIT and p in right.head:
                self.pending[p] = right.pending[p]
        self.state = {p: (self.state[p] if p in self.tail else None) if t == INHERIT else t for p, t in right.state.items()}
        self.tail, self.last = right.tail, right.last
        for k, (n, lo, hi) in right.kinds.items():
            one = self.kinds.setdefault(k, [0, lo, hi])
            one[0], one[1], one[2] = one[0] + n, min(one[1], lo), max(one[2], hi)


def _fuse_sorted(batches: Iterator[pd.DataFrame], part: Callable[..., Union | None]) -> Iterator[pd.DataFrame]:
    """Rows of _UNION from rows (line, chunk, ...) that come sorted: the changes of each (line, chunk) and then its union."""
    columns = [c.split()[0] for c in _UNION.split(", ")]
    key: tuple | None = None
    whole: Union | None = None
    out: list[tuple] = []

    def frame() -> pd.DataFrame:
        return pd.DataFrame(out, columns=columns).astype({"file_id": "Int64", "seq": "Int64"})

    for pdf in batches:
        for line, chunk, *rest in pdf.itertuples(index=False, name=None):
            if key != (line, chunk):
                if whole is not None:
                    out.append((*key, False, *[None] * 7, whole.dump()))
                key, whole = (line, chunk), None
            one = part(whole, *rest)
            if whole is None:
                whole = one
            elif one is not None:
                report: list[tuple] = []
                whole.fuse(one, report)
                out += [(line, chunk, True, *r, None) for r in report]
        yield frame()
        out = []
    if whole is not None:
        out.append((*key, False, *[None] * 7, whole.dump()))
    yield frame()


def fused_unions(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unions, changes): one fused union for each line, and all that was reported on the way.

    Runs of CHUNK versions are folded first; a task then fuses CHUNK unions of
    one line at a time, level by level, until each line has one.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def part(whole: Union | None, seq: int, file_id: int, tags: str) -> Union | None:
            # the first of several deliveries of one version has the smallest id
            return None if whole is not None and whole.last == seq else Union.of(int(file_id), int(seq), json.loads(tags))

        return _fuse_sorted(batches, part)

    def fuse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _fuse_sorted(batches, lambda whole, body: Union.load(body))

    runs = tagged.select("line", F.floor(F.col("seq") / CHUNK).alias("chunk"), "seq", "file_id", "tags")
    level = cut_table(runs.repartition("line", "chunk").sortWithinPartitions("line", "chunk", "seq", "file_id").mapInPandas(fold, _UNION))
    changes = level.where("is_change").select(*_CHANGE)
    while True:
        unions = level.where("not is_change").select("line", "chunk", "body")
        r = unions.groupBy("line").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()
        if (r["n"] or 0) <= 1:
            return unions.select("line", "body"), changes
        up = unions.withColumn("up", F.floor(F.col("chunk") / CHUNK)).repartition("line", "up").sortWithinPartitions("line", "up", "chunk")
        level = cut_table(up.select("line", "up", "body").mapInPandas(fuse, _UNION))
        changes = changes.unionByName(level.where("is_change").select(*_CHANGE))


def schema_changes(tagged: DataFrame) -> DataFrame:
    """file_id, line, seq, field_path, change_kind, old_path, old_type, new_type of every change of a file against the one before it.

    ``renamed``: a new path with the type and the not null value of a path
    that is gone; ``added``/``removed``: other new and gone paths; ``retyped``:
    the JSON type differs from that of the last value that was not null since
    the path appeared.  The first readable file of a line has no changes.
    Where several gone paths fit a rename, the smallest is given as old_path.
    """
    return fused_unions(tagged)[1]


def union_types(unions: DataFrame) -> DataFrame:
    """path, type, n_files, first_seq, last_seq: the alternatives that occur under each path of the fused unions, nulls as type null."""
    kinds = F.from_json(F.get_json_object("body", "$[6]"), "map<string,array<bigint>>")
    f = unions.select(F.explode(kinds).alias("k", "x"))
    kind = F.substring_index("k", "\t", -1)
    return f.groupBy(F.left("k", F.length("k") - F.length(kind) - 1).alias("path"), F.nullif(kind, F.lit("")).alias("type")).agg(F.sum(F.col("x")[0]).alias("n_files"), F.min(F.col("x")[1]).alias("first_seq"), F.max(F.col("x")[2]).alias("last_seq"))


def fold_path(col: Column | str) -> Column:
    """One name for spellings of a path: its words in lower case, joined by underscores, without the root."""
    col = F.col(col) if isinstance(col, str) else col
    words = F.lower(F.regexp_replace(F.regexp_replace(col, r"^[^.]*\.", ""), r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.regexp_replace(words, r"[^\p{L}\p{N}]+", "_")


def rename_map(changes: DataFrame, read: DataFrame, max_paths: int = 20_000) -> dict[str, str]:
    """path -> canonical field: spellings of one name and paths linked by a reported rename are one field.

    The canonical name is the folded path with the most files; its ties go to
    the smaller name.  Schemas are narrow next to their data: more than
    ``max_paths`` distinct paths stop with an error instead of filling the driver.
    Every reported rename counts, but for ambiguous ones: those of a file in
    which several new paths come from one, and those whose two fields hold
    values in one and the same file.  They count if at least two lines report
    them, so that two fields which happen to hold equal values are not taken
    for one.
    """
    paths = read.select(F.explode("fields").alias("f")).groupBy(F.col("f.path").alias("path")).agg(F.count("*").alias("n")).withColumn("fold", fold_path("path")).limit(max_paths + 1).collect()
    if len(paths) > max_paths:
        raise ValueError(f"more than {max_paths} distinct paths under the root; raise max_paths if that is meant")
    renamed = changes.where("change_kind = 'renamed'").withColumn("heirs", F.count("*").over(W.partitionBy("line", "seq", "file_id", "old_path")))
    links = renamed.groupBy("old_path", "field_path").agg(F.countDistinct("line").alias("lines"), F.min("heirs").alias("heirs"), F.count("*").alias("reports")).where("lines >= 2 or heirs = 1").collect()  # at most max_paths**2, in practice a few
    links = _clear_links(links, read, {r["path"]: r["fold"] for r in paths})
    parent = {r["fold"]: r["fold"] for r in paths}
    fold = {r["path"]: r["fold"] for r in paths}
    count: dict[str, int] = {}
    for r in paths:
        count[r["fold"]] = count.get(r["fold"], 0) + r["n"]

    def find(x: str) -> str:
        while parent[x] != x:
            x = parent[x]
        return x

    for r in sorted(links, key=lambda r: (r["old_path"], r["field_path"])):
        a, b = find(fold[r["old_path"]]), find(fold[r["field_path"]])
        if a != b:
            keep, drop = sorted((a, b), key=lambda x: (-count[x], x))
            parent[drop] = keep
            count[keep] += count[drop]
    groups: dict[str, list[str]] = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    plain = {r["fold"]: 0 for r in paths}
    for r in paths:
        plain[r["fold"]] += r["n"]
    return {p: min(groups[find(f)], key=lambda x: (-plain[x], x)) for p, f in fold.items()}


def _clear_links(links: list, read: DataFrame, fold: dict[str, str]) -> list:
    """links without those of a single line whose two fields hold values in one file."""
    doubtful = sorted({tuple(sorted((fold[r["old_path"]], fold[r["field_path"]]))) for r in links if r["lines"] < 2})
    if not doubtful:
        return links
    pairs = read.sparkSession.createDataFrame(doubtful, "a string, b string")
    held = read.select(F.transform(F.filter("fields", lambda f: f["type"].isNotNull()), lambda f: fold_path(f["path"])).alias("held"))
    together = held.join(F.broadcast(pairs), F.expr("a <> b and array_contains(held, a) and array_contains(held, b)")).select("a", "b").distinct().collect()
    clash = {(r["a"], r["b"]) for r in together}
    return [r for r in links if r["lines"] >= 2 or tuple(sorted((fold[r["old_path"]], fold[r["field_path"]]))) not in clash]


def unified_table(read: DataFrame, names: dict[str, str]) -> DataFrame:
    """line, seq, file_id and per field: its canonical value, and for a field of more than one type a branch per type.

    The canonical column is a double where all values of the field convert to a
    number (numbers, numeric strings, arrays of one such value), else a string.
    Where a file holds several paths of one field, the smallest path that is
    not null counts.
    """
    spark = read.sparkSession
    folded = spark.createDataFrame(sorted(names.items()) or [("", "")], "path string, field string")  # as many rows as paths
    f = read.select("line", "seq", "file_id", F.explode_outer("fields").alias("f")).select("line", "seq", "file_id", "f.path", "f.type", "f.value")
    f = f.join(F.broadcast(folded), "path", "left")
    one = F.when(F.col("type") == "array", F.regexp_replace(F.get_json_object("value", "$[0]"), '^"|"$', "")).otherwise(F.col("value"))
    number = F.when((F.col("type") != "array") | (F.get_json_object("value", "$[1]").isNull()), one.try_cast("double"))
    f = f.withColumn("number", number)
    kinds: dict[str, tuple[set[str], bool]] = {}
    for r in f.where("field is not null and type is not null").groupBy("field", "type").agg(F.min(F.col("number").isNotNull()).alias("numeric")).collect():  # fields x types
        seen, numeric = kinds.get(r["field"], (set(), True))
        kinds[r["field"]] = (seen | {r["type"]}, numeric and r["numeric"] and r["type"] != "boolean")
    for name in set(names.values()) - set(kinds):
        kinds[name] = (set(), False)
    cols = []
    for name in sorted(kinds):
        seen, numeric = kinds[name]
        here = (F.col("field") == name) & F.col("type").isNotNull()
        value = F.col("number") if numeric else F.col("value")
        cols.append(F.min_by(F.when(here, value), F.when(here, F.col("path"))).alias(name))
        if len(seen) > 1:
            for t in TYPES:
                if t in seen:
                    typed = here & (F.col("type") == t)
                    v = {"number": F.col("number"), "boolean": F.col("value").try_cast("boolean")}.get(t, F.col("value"))
                    cols.append(F.min_by(F.when(typed, v), F.when(typed, F.col("path"))).alias(f"{name}__{t}"))
    return f.groupBy("line", "seq", "file_id").agg(*(cols or [F.lit(None).cast("string").alias("no_fields")]))
