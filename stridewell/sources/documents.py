"""One large JSON document, read and written by parts: no task and no driver holds its array.

A document is {"name": value, ..., "records": [{...}, {...}]} in one file, or in files that follow one another by name, each
ending in a line as Spark writes them.

Reading: Spark's text source cuts files into byte ranges, and each range into pieces at closing braces. What a range
means depends on what comes before it: whether it begins within a string, how deep it lies, and whether within the
array. A first pass tells of each range what it would do from either state (a row a range); a walk over these rows tells
where each range truly begins; a second pass cuts the records out. A record over several ranges is joined by the range
in which it begins.

Writing: rows are numbered in order and dealt by ranges of their number; the first has the head before it, the last the
tail after it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges

BRACE = "}"
#: Characters that are scanned at once, unless a piece is longer.
SCANNED = 1 << 20
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.S)
STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
OPENS = re.compile(r"\s*:\s*\[")


class Walk:
    """A walk over the text of a range. inside: in a string; depth: open braces and brackets; found: the array has begun.

    Events are ("key", depth, place) where a string that is the array's name opens an array, ("open", depth, place) at
    each brace or bracket that opens, and ("close", depth, place) after one that closes. Depths are from the range's
    start.
    """

    def __init__(self, array: str, inside: bool = False):
        self.name, self.inside, self.depth = json.dumps(array), inside, 0

    def events(self, text: str) -> Iterator[tuple[str, int, int]]:
        at = 0
        if self.inside:
            m = STRING_END.match(text)
            if not m:
                return
            self.inside, at = False, m.end()
        while m := TOKEN.search(text, at):
            at, token = m.end(), m[0]
            if token in ("{", "["):
                yield "open", self.depth, m.start()
                self.depth += 1
            elif token in ("}", "]"):
                self.depth -= 1
                yield "close", self.depth, at
            elif token == '"':
                self.inside = True
                return
            elif token == self.name and (o := OPENS.match(text, at)):
                yield "key", self.depth, o.end()


def _texts(batches: Iterator[pa.RecordBatch], open_ends: set | None = None) -> Iterator[tuple[tuple[str, int], str]]:
    """(range, text), a megabyte or so at a time; a range's texts follow one another.

    The text source takes the brace after each piece away, but the last piece of a file may have had none: ranges in
    open_ends (None: all) get none after their last piece.
    """
    range_, held, size = None, [], 0

    def text(done: bool) -> str:
        return "".join(held[:-1] if done and (open_ends is None or range_ in open_ends) else held)

    for b in batches:
        for file, start, value in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if held and ((file, start) != range_ or size >= SCANNED):
                yield range_, text((file, start) != range_)
                held, size = [], 0
            range_ = (file, start)
            held += [value, BRACE]
            size += len(value) + 1
    if held:
        yield range_, text(True)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("lineSep", BRACE).text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _told(pieces: DataFrame, array: str) -> list:
    """Of each range, from either state, less its last brace: how it ends, how deep it gets, and where the array may begin and
    still be open; and whether its last piece ends a line."""
    kinds = {"line": pa.bool_(), "file": pa.string(), "start": pa.int64(), "inside": pa.int32(), "ends_inside": pa.bool_(), "depth": pa.int32(), "low": pa.int32(), "keys": pa.list_(pa.int32()), "still": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, range_, walks, line = [], None, [], False

        def tell() -> None:
            for inside, (walk, low, keys) in enumerate(walks):
                done.append({"line": line, "file": range_[0], "start": range_[1], "inside": inside, "ends_inside": walk.inside, "depth": walk.depth, "low": low, "keys": list(keys), "still": [k for k in keys if keys[k]]})

        for now, text in _texts(batches):
            if now != range_:
                tell()
                range_, walks = now, [[Walk(array, inside), 0, {}] for inside in (False, True)]
            line = text.endswith("\n")
            for w in walks:
                for kind, depth, _ in w[0].events(text):
                    if kind == "key":
                        w[2][depth] = True
                    elif kind == "close":
                        w[1] = min(w[1], depth)
                        for k in w[2]:
                            w[2][k] &= depth > k
        tell()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(list(kinds.items())))

    return pieces.mapInArrow(run, "line boolean, file string, start long, inside int, ends_inside boolean, depth int, low int, keys array<int>, still array<int>").collect()  # two rows a range


def starts(told: list) -> tuple[dict[tuple[str, int], tuple[bool, int, bool, int]], set]:
    """Of each range: whether it begins in a string, its depth, whether in the array, and in which range the record that is
    open there began; and the ranges whose last piece has no brace: a file's last, if it ends a line."""
    by: dict = {}
    for r in told:
        by.setdefault((r["file"], r["start"]), {})[r["inside"]] = r
    out, inside, depth, within, owner, order, open_ends = {}, False, 0, False, -1, sorted(by), set()
    for k, range_ in enumerate(order):
        r = by[range_][int(inside)]
        end, low, still = r["depth"], r["low"], r["still"]
        if r["line"] and (k + 1 == len(order) or order[k + 1][0] != range_[0]):
            open_ends.add(range_)
        elif not r["ends_inside"]:
            end -= 1
            low, still = min(low, end), [x for x in still if end > x]
        out[range_] = (inside, depth, within, owner)
        if depth + low <= 2 or 1 - depth in r["keys"]:
            owner = k
        within = (within and depth + low > 1) or 1 - depth in still
        inside, depth = r["ends_inside"], depth + end
    return out, open_ends


def _cut(batches: Iterator[pa.RecordBatch], array: str, begin: dict, place: dict, open_ends: set) -> Iterator[tuple[int, int, str, int, bool]]:
    """(range, number, text, owner, whole) of records and their parts; what is outside of the array has owner -2."""
    range_ = None
    for now, text in _texts(batches, open_ends):
        if now != range_:
            if range_ is not None and open_:
                yield place[range_], n, "".join(held), owner, False
            range_, n, held = now, 0, []
            inside, base, within, owner = begin[now]
            walk, open_, ours = Walk(array, inside), within and base > 2, False
        at, copied, rest = (0 if open_ else None), 0, []
        for kind, depth, here in walk.events(text):
            level = base + depth
            if kind == "key" and level == 1 and not within:
                within = True
                rest.append(text[copied:here])
            elif within and kind == "open" and level == 2:
                at, open_, ours, held, owner = here, True, True, [], place[now]
            elif within and kind == "close" and level == 2 and open_:
                yield place[now], n, "".join([*held, text[at:here]]), owner, ours
                at, open_, held, n = None, False, [], n + 1
            elif within and kind == "close" and level == 1:
                within, copied = False, here - 1
        if open_:
            held.append(text[at:])
        if not within:
            rest.append(text[copied:])
        if rest:
            yield place[now], n, "".join(rest), -2, False
            n += 1
    if range_ is not None and open_:
        yield place[range_], n, "".join(held), owner, False


def records(spark: SparkSession, path: str, array: str, schema: str) -> tuple[DataFrame, dict]:
    """The elements of a document's array, with schema's columns and the order _range, _place; and its other fields.

    Elements must be objects. A document without the array gives no rows; other fields must be few, as they are held at
    once.
    """
    pieces = _pieces(spark, path)
    begin, open_ends = starts(_told(pieces, array))
    place = {range_: k for k, range_ in enumerate(sorted(begin))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in _cut(batches, array, begin, place, open_ends):
            rows.append(row)
            size += len(row[2])
            if size >= SCANNED:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    cut = pieces.mapInArrow(run, "_range int, _place int, text string, owner int, whole boolean")
    rest = "".join(r["text"] for r in sorted(cut.where("owner = -2").collect(), key=lambda r: (r["_range"], r["_place"])))
    whole = cut.where("whole").select("_range", "_place", "text")
    parts = cut.where("not whole and owner >= 0").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("_range", "_place", "text"))).alias("p"))  # of one record
    parts = parts.select(F.col("p")[0]["_range"].alias("_range"), F.col("p")[0]["_place"].alias("_place"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    found = whole.union(parts).select("_range", "_place", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("_r"))
    return found.select("_r.*", "_range", "_place"), _fields(rest, array)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_()), strict=True)], names=["_range", "_place", "text", "owner", "whole"])


def _fields(rest: str, array: str) -> dict:
    """The document's fields but the array, whose elements are gone from its text; of its last brace see starts()."""
    for text in (rest, rest + BRACE, rest.rstrip()[:-1]):
        try:
            return {k: v for k, v in json.loads(text).items() if k != array}
        except json.JSONDecodeError:
            continue
    return json.loads(rest)


def write_document(df: DataFrame, path: str, array: str, order: list[str], **fields) -> None:
    """df's rows, in a total order, as the array of one JSON document, whose text is that of the files in order of name."""
    head = json.dumps(fields)[:-1] + (", " if fields else "") + json.dumps(array) + ": ["
    rows = ranges.numbered(df.select(*df.columns), order, "_n").select("_n", F.concat(F.when(F.col("_n") > 0, ",").otherwise(""), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("text"))
    ends = df.sparkSession.createDataFrame([(-1, head), (1 << 62, "]}")], "_n long, text string")
    rows.union(ends).repartitionByRange("_n").sortWithinPartitions("_n").select("text").write.mode("overwrite").text(path)
