"""PLY files: each element is a DataFrame, a list property an array column.

A schema comes from the first file's header; all files of one read share it. Binary files are read by the data source
`ply`: rows of one width by ranges, many tasks to a file, rows with lists as one stream of bounded portions. Ascii files are split
at lines, many tasks to a file. Files in stores that tasks can't open on their own are parsed whole, a task to a file, as are ascii
files whose rows aren't lines. All tasks write their part of a file (see sink).
"""

from __future__ import annotations

import json
import pickle
import re
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.joins import lookup
from . import ranges, sink, texts

# Scalar types of the format with their numpy codes, names of older files, and the names under
# which elements and properties of meshes are found.
SCALARS = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8"}
ALIASES = {
    "char8": "char", "uchar8": "uchar", "short16": "short", "ushort16": "ushort", "int32": "int", "uint32": "uint", "float32": "float", "double64": "double",
    "int8": "char", "uint8": "uchar", "int16": "short", "uint16": "ushort", "float64": "double",
}
FORMATS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}
VERTEX_NAMES = ["vertex", "Vertex", "point", "Point", "pts", "Pts"]
FACE_NAMES = ["face", "Face", "poly", "Poly", "tri", "Tri"]
INDEX_NAMES = ["vertex_indices", "vertex_indexes", "vertex_index", "indices", "indexes"]

_SPARK = {"i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
#: Rows that leave a parser at once.
PORTION = 50_000


class PlyError(ValueError):
    pass


@dataclass
class Property:
    name: str
    kind: str
    count: str | None = None  # of a list: the type of its length


@dataclass
class Element:
    name: str
    rows: int
    properties: list[Property] = field(default_factory=list)


@dataclass
class Header:
    format: str
    elements: list[Element]
    comments: list[str]
    size: int  # bytes, with the end of its last line

    def element(self, name: str) -> Element:
        for e in self.elements:
            if e.name == name:
                return e
        raise PlyError(f"no element {name!r}; there are {[e.name for e in self.elements]}")


def _kind(word: str) -> str:
    kind = ALIASES.get(word, word)
    if kind not in SCALARS:
        raise PlyError(f"unknown type {word!r}")
    return SCALARS[kind]


def parse_header(content: bytes) -> Header:
    if not re.match(rb"ply\s*[\r\n]", content):
        raise PlyError("not a PLY file")
    m = re.search(rb"(?:^|[\r\n])end_header[ \t]*(?:\r\n|\n|\r)", content)
    if not m:
        raise PlyError("the header doesn't end")
    form, elements, comments = None, [], []
    for line in re.split(r"\r\n|\n|\r", content[: m.start()].decode("latin-1"))[1:]:
        words = line.split()
        if not words or words[0] == "obj_info":
            continue
        if words[0] == "comment":
            comments.append(line[len("comment") :].strip())
        elif words[0] == "format":
            if len(words) != 3 or words[1] not in FORMATS:
                raise PlyError(f"unknown format {line!r}")
            if words[2] != "1.0":
                raise PlyError(f"unknown version {words[2]!r}")
            form = words[1]
        elif words[0] == "element":
            if len(words) != 3 or not words[2].isdigit():
                raise PlyError(f"bad element {line!r}")
            if any(e.name == words[1] for e in elements):
                raise PlyError(f"element {words[1]!r} comes twice")
            elements.append(Element(words[1], int(words[2])))
        elif words[0] == "property":
            if not elements or len(words) != (5 if words[1:2] == ["list"] else 3):
                raise PlyError(f"bad property {line!r}")
            if any(p.name == words[-1] for p in elements[-1].properties):
                raise PlyError(f"property {words[-1]!r} comes twice")
            elements[-1].properties.append(Property(words[4], _kind(words[3]), _kind(words[2])) if words[1] == "list" else Property(words[2], _kind(words[1])))
        else:
            raise PlyError(f"unknown line {line!r}")
    if form is None:
        warnings.warn("the header has no format; taken as ascii", stacklevel=2)
    return Header(form or "ascii", elements, comments, m.end())


def _ascii(content: bytes, header: Header, wanted: str):
    """Portions of columns of the wanted element."""
    words, at = content[header.size :].split(), 0
    for e in header.elements:
        lists = any(p.count for p in e.properties)
        if not lists:  # as many values in each row
            n = len(e.properties)
            if e.name == wanted:
                if at + n * e.rows > len(words):
                    raise PlyError("the file ends early")
                for a in range(0, e.rows, PORTION):
                    b = min(a + PORTION, e.rows)
                    table = np.array(words[at + n * a : at + n * b], dtype="S").reshape(b - a, n)
                    yield [_number(table[:, k], p.kind) for k, p in enumerate(e.properties)]
                return
            at += n * e.rows
            continue
        columns: list[list] = [[] for _ in e.properties]
        for row in range(e.rows):
            for k, p in enumerate(e.properties):
                size = int(words[at]) if p.count else 1
                at += bool(p.count)
                part = words[at : at + size]
                if len(part) < size:
                    raise PlyError("the file ends early")
                at += size
                if e.name == wanted:
                    columns[k].append(_number(np.array(part, dtype="S"), p.kind) if p.count else part[0])
            if e.name == wanted and (len(columns[0]) == PORTION or row == e.rows - 1):
                yield [c if p.count else _number(np.array(c, dtype="S"), p.kind) for c, p in zip(columns, e.properties)]
                columns = [[] for _ in e.properties]
        if e.name == wanted:
            return


def _number(words: np.ndarray, kind: str) -> np.ndarray:
    return words.astype("f8").astype(kind) if len(words) else np.empty(0, kind)


def _binary(content: bytes, header: Header, wanted: str):
    order, at = FORMATS[header.format], header.size
    for e in header.elements:
        if not any(p.count for p in e.properties):
            row = np.dtype([(p.name, order + p.kind) for p in e.properties])
            if at + row.itemsize * e.rows > len(content):
                raise PlyError("the file ends early")
            if e.name == wanted:
                table = np.frombuffer(content, row, e.rows, at)
                for a in range(0, e.rows, PORTION):
                    yield [table[p.name][a : a + PORTION].astype(p.kind) for p in e.properties]
                return
            at += row.itemsize * e.rows
            continue
        columns: list[list] = [[] for _ in e.properties]
        kinds = [(np.dtype(order + p.count) if p.count else None, np.dtype(order + p.kind)) for p in e.properties]
        for row in range(e.rows):
            for k, (count, kind) in enumerate(kinds):
                size = 1
                if count is not None:
                    size = int(np.frombuffer(content, count, 1, at)[0])
                    at += count.itemsize
                if at + size * kind.itemsize > len(content):
                    raise PlyError("the file ends early")
                if e.name == wanted:
                    v = np.frombuffer(content, kind, size, at).astype(kind.newbyteorder("="))
                    columns[k].append(v if count is not None else v[0])
                at += size * kind.itemsize
            if e.name == wanted and (len(columns[0]) == PORTION or row == e.rows - 1):
                yield [c if p.count else np.array(c, p.kind) for c, p in zip(columns, e.properties)]
                columns = [[] for _ in e.properties]
        if e.name == wanted:
            return


def _arrow(column, p: Property) -> pa.Array:
    kind = pa.from_numpy_dtype(np.dtype(p.kind))
    wide = {"u1": pa.int16(), "u2": pa.int32(), "u4": pa.int64()}.get(p.kind, kind)  # Spark has signed types only
    if p.count:
        ends = np.concatenate([[0], np.cumsum([len(c) for c in column])]).astype(np.int32)
        flat = np.concatenate(column) if len(column) else np.empty(0, p.kind)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(wide))
    return pa.array(column).cast(wide)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """file, format, comments, elements (name, rows, properties) of each file."""

    def run(batches):
        for b in batches:
            found = [parse_header(c) for c in b.column("content").to_pylist()]
            kind = pa.list_(pa.struct([("name", pa.string()), ("rows", pa.int64()), ("properties", pa.list_(pa.string()))]))
            elements = [[{"name": e.name, "rows": e.rows, "properties": [p.name for p in e.properties]} for e in h.elements] for h in found]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([h.format for h in found]), pa.array([h.comments for h in found], pa.list_(pa.string())), pa.array(elements, kind)], names=["file", "format", "comments", "elements"])

    shape = "file string, format string, comments array<string>, elements array<struct<name: string, rows: long, properties: array<string>>>"
    return spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 1 << 20).alias("content")).mapInArrow(run, shape)


def _head(content, name: str) -> Header:
    """The header of a file that is open: no more of it is read than needed."""
    size = 1 << 16
    while True:
        content.seek(0)
        head = content.read(size)
        if len(head) < size or re.search(rb"(?:^|[\r\n])end_header[ \t]*(?:\r\n|\n|\r)(?=.)", head, re.S):
            try:
                return parse_header(head)
            except PlyError as e:
                raise PlyError(f"{name}: {e}") from None
        size *= 4


def _shape(properties: list[Property]) -> T.StructType:
    shape = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
    for p in properties:
        shape.add(p.name, T.ArrayType(_SPARK[p.kind]) if p.count else _SPARK[p.kind])
    return shape


def _named(header: Header, names: list[str]) -> Element:
    known = [e.name for e in header.elements]
    return header.element(next((n for n in names if n in known), names[0]))


def _own(header: Header, wanted: str, properties: list[tuple[str, bool]], name: str) -> Element:
    own = header.element(wanted)
    if [(p.name, bool(p.count)) for p in own.properties] != properties:
        raise PlyError(f"{name}: its {wanted!r} has other properties than the first file's")
    return own


def _batch(name: str, row: int, columns: list, properties: list[Property], names: list[str]) -> pa.RecordBatch:
    n = len(columns[0]) if columns else 0
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(row, row + n), pa.int64()), *(_arrow(c, p) for c, p in zip(columns, properties))], names=names)


def _width(element: Element, order: str) -> np.dtype | None:
    """The type of a row, if all rows have one width."""
    return None if any(p.count for p in element.properties) else np.dtype([(p.name, order + p.kind) for p in element.properties])


def _streamed(content, at: int, element: Element, order: str, wanted: bool):
    """Portions of columns of an element with lists, from place `at` on; returns the place after it. Rows whose lists are
    as long as those of the row before are taken together."""
    buffer, done = b"", 0
    content.seek(at)
    while done < element.rows:
        start = np.zeros(len(element.properties), np.int64)
        more = content.read(1 << 22)
        buffer, used = buffer + more, 0
        columns: list[list] = [[] for _ in element.properties]
        while done < element.rows:
            kinds, x = [], used
            for k, p in enumerate(element.properties):  # the shape of the next row
                size = 1
                if p.count:
                    count = np.dtype(order + p.count)
                    if x + count.itemsize > len(buffer):
                        x = len(buffer) + 1
                        break
                    size = int(np.frombuffer(buffer, count, 1, x)[0])
                    kinds.append((f"n{k}", count))
                    start[k] = size
                    x += count.itemsize
                kinds.append((f"v{k}", np.dtype(order + p.kind), (size,)))
                x += size * np.dtype(p.kind).itemsize
            if x > len(buffer):
                break
            row = np.dtype(kinds)
            table = np.frombuffer(buffer, row, min(element.rows - done, max(1, (len(buffer) - used) // row.itemsize)), used)
            same = np.ones(len(table), bool)
            for k, p in enumerate(element.properties):
                if p.count:
                    same &= table[f"n{k}"] == start[k]
            n = len(table) if same.all() else int(np.argmin(same))
            if wanted:
                for k, p in enumerate(element.properties):
                    v = table[f"v{k}"][:n].astype(p.kind)
                    columns[k] += list(v) if p.count else v[:, 0].tolist()
            done, used = done + n, used + n * row.itemsize
        if not more and done < element.rows and not used:
            raise PlyError("the file ends early")
        at, buffer = at + used, buffer[used:]
        if wanted and columns and len(columns[0]):
            yield [c if p.count else np.array(c, p.kind) for c, p in zip(columns, element.properties)]
    return at


class _Range(InputPartition):
    def __init__(self, path: str, k: int, of: int):
        self.path, self.k, self.of = path, k, of


class PlyReader(DataSourceReader):
    """Rows of an element of binary files: the k-th of so many ranges of a file's rows in each partition."""

    def __init__(self, files: list[tuple[str, int]], wanted: str, properties: list[tuple[str, bool]], names: list[str], step: int):
        self.files, self.wanted, self.properties, self.names, self.step = files, wanted, properties, names, step

    def partitions(self):
        return [_Range(path, k, of) for path, size in self.files for of in [max(1, -(-size // self.step))] for k in range(of)]

    def read(self, part: _Range):
        with ranges.opened(part.path) as content:
            header = _head(content, part.path)
            own = _own(header, self.wanted, self.properties, part.path)
            order, at, row = FORMATS[header.format], header.size, 0
            if header.format == "ascii":
                raise PlyError(f"{part.path}: this source reads binary files")
            for e in header.elements:
                kind = _width(e, order)
                if kind is None and part.k:
                    return  # where it ends is known to the first partition only
                if kind is None:
                    stream = _streamed(content, at, e, order, e is own)
                    while True:
                        try:
                            columns = next(stream)
                        except StopIteration as end:
                            at = end.value
                            break
                        yield _batch(part.path, row, columns, e.properties, self.names)
                        row += len(columns[0])
                    if e is own:
                        return
                    continue
                if e is own:
                    a, z = (e.rows * k // part.of for k in (part.k, part.k + 1))
                    if any(x.properties and _width(x, order) is None for x in header.elements[: header.elements.index(e)]):
                        a, z = 0, e.rows  # behind lists
                    for first in range(a, z, PORTION):
                        n = min(PORTION, z - first)
                        content.seek(at + first * kind.itemsize)
                        body = content.read(n * kind.itemsize)
                        if len(body) < n * kind.itemsize:
                            raise PlyError(f"{part.path}: the file ends early")
                        table = np.frombuffer(body, kind, n)
                        yield _batch(part.path, first, [table[p.name].astype(p.kind) for p in e.properties], e.properties, self.names)
                    return
                at += kind.itemsize * e.rows


class PlySource(DataSource):
    """spark.read.format("ply").load(path) of binary files: file, row, and the properties of the element that the option
    `element` names (several names, by commas: the first that there is). range_bytes: how much of a file a task reads, about."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _files(self) -> list[tuple[str, int]]:
        if "files" in self.options:
            return [tuple(x) for x in json.loads(self.options["files"])]
        from pyarrow import fs

        path = self.options["path"]
        own, where = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
        found = own.get_file_info(where)
        scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
        inside = [found] if found.is_file else own.get_file_info(fs.FileSelector(where))
        return sorted((scheme + f.path, f.size) for f in inside if f.is_file and not f.base_name.startswith(("_", ".")))

    def _first(self) -> Element:
        files = self._files()
        if not files:
            raise PlyError("no file")
        with ranges.opened(files[0][0]) as content:
            return _named(_head(content, files[0][0]), self.options.get("element", ",".join(VERTEX_NAMES)).split(","))

    def schema(self) -> T.StructType:
        return _shape(self._first().properties)

    def reader(self, schema: T.StructType) -> PlyReader:
        e = self._first()
        return PlyReader(self._files(), e.name, [(p.name, bool(p.count)) for p in e.properties], schema.names, int(self.options.get("range_bytes", ranges.RANGE)))


def _whole(spark: SparkSession, paths: list[str], wanted: str, properties: list[tuple[str, bool]], shape: T.StructType) -> DataFrame:
    """Files that are one cell each."""
    names = shape.names

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                content, row = content.as_py(), 0
                header = parse_header(content)
                own = _own(header, wanted, properties, name)
                for columns in (_ascii if header.format == "ascii" else _binary)(content, header, wanted):
                    yield _batch(name, row, columns, own.properties, names)
                    row += len(columns[0]) if columns else 0

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, shape)


def _from_lines(spark: SparkSession, heads: dict[str, tuple[int, Header]], wanted: str, properties: list[tuple[str, bool]], shape: T.StructType) -> DataFrame:
    """Ascii files, split at lines. heads: by file, its header's lines and the header."""
    numbered = texts.lines(spark, list(heads), blank=False)
    totals = {r["file"]: r["n"] for r in numbered.groupBy("file").agg((F.max("line_no") + 1).alias("n")).collect()}  # a row for each file
    odd = [f for f, (n, h) in heads.items() if totals.get(f, 0) < n + sum(e.rows for e in h.elements)]  # rows of several lines
    places, kinds = [], {}
    for f, (n, h) in heads.items():
        own = _own(h, wanted, properties, f)
        for e in h.elements:
            if e is own and f not in odd:
                places.append((f, n, n + e.rows))
            n += e.rows
        kinds[f] = own.properties
    names = shape.names

    def run(batches):
        for b in batches:
            files = b.column(0).to_pylist()
            cuts = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)] if files else [0]
            for a, z in zip(cuts, cuts[1:]):
                rows, mine = b.column(2).slice(a, z - a).cast(pa.binary()).to_pylist(), kinds[files[a]]
                if not any(p.count for p in mine):
                    table = np.array([r.split()[: len(mine)] for r in rows], dtype="S")
                    columns = [_number(table[:, k], p.kind) for k, p in enumerate(mine)]
                else:
                    columns = [[] for _ in mine]
                    for r in rows:
                        words, at = r.split(), 0
                        for k, p in enumerate(mine):
                            size = int(words[at]) if p.count else 1
                            at += bool(p.count)
                            if at + size > len(words):
                                raise PlyError(f"{files[a]}: a row ends early")
                            columns[k].append(_number(np.array(words[at : at + size], dtype="S"), p.kind) if p.count else words[at])
                            at += size
                    columns = [c if p.count else _number(np.array(c, dtype="S"), p.kind) for c, p in zip(columns, mine)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), *(_arrow(c, p) for c, p in zip(columns, mine))], names=names)

    starts = spark.createDataFrame(places, "file string, first long, end long")
    own = lookup(numbered, starts, ["file"]).filter("line_no >= first AND line_no < end")
    out = own.select("file", (F.col("line_no") - F.col("first")).alias("row"), "line").mapInArrow(run, shape)
    return out.unionByName(_whole(spark, odd, wanted, properties, shape)) if odd else out


def _heads(spark: SparkSession, files: list[str]) -> list[tuple[str, int, Header]]:
    """file, lines of its header that aren't blank, the header: read by tasks, a small row for each file."""

    def run(batches):
        for b in batches:
            found = []
            for f in b.column(0).to_pylist():
                with ranges.opened(f) as content:
                    h = _head(content, f)
                    content.seek(0)
                    n = sum(bool(x.strip()) for x in re.split(rb"\r\n|\n|\r", content.read(h.size)))
                    found.append(pickle.dumps((f, n, h)))
            yield pa.RecordBatch.from_pydict({"head": pa.array(found, pa.binary())})

    held = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 1_000))
    return [pickle.loads(r["head"]) for r in held.mapInArrow(run, "head binary").collect()]


def read(spark: SparkSession, path: str | list[str], element: str | list[str] = "vertex", range_bytes: int = ranges.RANGE) -> DataFrame:
    """file, row (from 0) and the properties of an element (or the first of several names that there is)."""
    files = ranges.listed(spark, path)
    if not files:
        raise PlyError(f"no file at {path!r}")
    names = [element] if isinstance(element, str) else element
    if not ranges.reachable(files[0][0]):
        head = spark.read.format("binaryFile").load(files[0][0]).select(F.substring("content", 1, 1 << 20).alias("head")).first()
        wanted = _named(parse_header(bytes(head["head"])), names)
        return _whole(spark, [f for f, _ in files], wanted.name, [(p.name, bool(p.count)) for p in wanted.properties], _shape(wanted.properties))
    heads = {f: (n, h) for f, n, h in _heads(spark, [f for f, _ in files])}
    wanted = _named(heads[files[0][0]][1], names)
    properties, shape = [(p.name, bool(p.count)) for p in wanted.properties], _shape(wanted.properties)
    for f, (_, h) in heads.items():
        _own(h, wanted.name, properties, f)
    binary = [(f, size) for f, size in files if heads[f][1].format != "ascii"]
    ascii_ = {f: heads[f] for f, _ in files if heads[f][1].format == "ascii"}
    out = []
    if binary:
        spark.dataSource.register(PlySource)
        out.append(spark.read.format("ply").schema(shape).options(files=json.dumps(binary), element=wanted.name, range_bytes=str(range_bytes)).load())
    if ascii_:
        out.append(_from_lines(spark, ascii_, wanted.name, properties, shape))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def read_cloud(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """cloud_id (the file's name), pt_id, x, y, z, nx, ny, nz as doubles; what a file doesn't have is 0."""
    v = read(spark, path, VERTEX_NAMES)
    has = lambda *names: next((F.col(n).cast("double") for n in names if n in v.columns), F.lit(0.0))
    name = F.regexp_extract("file", r"([^/]+?)(\.ply)?$", 1)
    return v.select(name.alias("cloud_id"), F.col("row").alias("pt_id"), has("x").alias("x"), has("y").alias("y"), has("z").alias("z"), has("nx", "normal_x").alias("nx"), has("ny", "normal_y").alias("ny"), has("nz", "normal_z").alias("nz"))


def read_faces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """cloud_id, face_id, vertex_indices (from 0, as on disk)."""
    f = read(spark, path, FACE_NAMES)
    index = next((n for n in INDEX_NAMES if n in f.columns), None)
    if index is None:
        raise PlyError(f"faces have none of {INDEX_NAMES}")
    return f.select(F.regexp_extract("file", r"([^/]+?)(\.ply)?$", 1).alias("cloud_id"), F.col("row").alias("face_id"), F.col(index).cast("array<long>").alias("vertex_indices"))


_WIDTHS = [("i1", -128, 127), ("u1", 0, 255), ("i2", -32768, 32767), ("u2", 0, 65535), ("i4", -(1 << 31), (1 << 31) - 1), ("u4", 0, (1 << 32) - 1)]
_NAMES = {v: k for k, v in SCALARS.items()}


def _fitted(df: DataFrame, doubles: bool) -> list[Property]:
    """Properties with the narrowest integer type that holds a column's values."""
    out, limits = [], []
    for f in df.schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, T.IntegralType):
            c = F.col(f"`{f.name}`")
            low, high = (F.array_min(c), F.array_max(c)) if isinstance(f.dataType, T.ArrayType) else (c, c)
            limits += [F.min(low).alias(f"low_{f.name}"), F.max(high).alias(f"high_{f.name}")]
    found = df.agg(*limits).first().asDict() if limits else {}
    for f in df.schema.fields:
        lists = isinstance(f.dataType, T.ArrayType)
        kind = f.dataType.elementType if lists else f.dataType
        if isinstance(kind, T.IntegralType):
            low, high = found[f"low_{f.name}"] or 0, found[f"high_{f.name}"] or 0
            code = next((n for n, a, b in _WIDTHS if a <= low and high <= b), None)
            if code is None:
                raise PlyError(f"{f.name}: {low} to {high} fits no type of the format")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            code = "f8" if doubles and isinstance(kind, T.DoubleType) else "f4"
        else:
            raise PlyError(f"{f.name}: {kind.simpleString()} isn't a type of the format")
        out.append(Property(f.name, code, "u1" if lists else None))
    return out


def _encoder(properties: list[Property], form: str):
    order = FORMATS[form]

    def encode(b) -> bytes:
        columns = [b.column(p.name).to_pylist() for p in properties]
        if any(p.count and len(v) > 255 for p, c in zip(properties, columns) for v in c):
            raise PlyError("a list of more than 255 values")
        if not order:
            text = lambda x, p: repr(float(np.dtype(p.kind).type(x))) if p.kind[0] == "f" else str(x)
            lines = [" ".join(f"{len(v)} " + " ".join(text(x, p) for x in v) if p.count else text(v, p) for v, p in zip(row, properties)) for row in zip(*columns)]
            return "".join(x + "\n" for x in lines).encode("ascii")
        if not any(p.count for p in properties):
            table = np.empty(b.num_rows, [(p.name, order + p.kind) for p in properties])
            for p, c in zip(properties, columns):
                table[p.name] = c
            return table.tobytes()
        return b"".join((bytes([len(v)]) if p.count else b"") + np.array(v, order + p.kind).tobytes() for row in zip(*columns) for v, p in zip(row, properties))

    return encode


def write(elements: dict[str, DataFrame], path: str, form: str = "binary_big_endian", doubles: bool = False, comments: list[str] = (), order: dict[str, str] | None = None) -> None:
    """One PLY file of the elements' rows (sorted by their column in `order`, which isn't written). Doubles
    are written as floats unless `doubles`. Tasks encode the rows and write them at their places in the file."""
    if form not in FORMATS:
        raise PlyError(f"unknown format {form!r}")
    order = order or {}
    spark = next(iter(elements.values())).sparkSession
    lines, parts = ["ply", f"format {form} 1.0", *(f"comment {c}" for c in comments)], []
    for name, df in elements.items():
        key = order.get(name)
        rows = df.drop(key) if key else df
        properties = _fitted(rows, doubles)
        body = sink.bodies((df.orderBy(key) if key else df).select(*[F.col(f"`{p.name}`") for p in properties]), _encoder(properties, form))
        lines.append(f"element {name} {sink.rows_of(body)}")
        lines += [f"property list uchar {_NAMES[p.kind]} {p.name}" if p.count else f"property {_NAMES[p.kind]} {p.name}" for p in properties]
        parts.append(body)
    sink.write_file(spark, path, ("\n".join([*lines, "end_header"]) + "\n").encode("ascii"), parts)


def write_meshes(vertices: DataFrame, faces: DataFrame, folder: str) -> None:
    """An ascii file `cloud_id`.ply for each mesh, all in one pass. vertices: cloud_id, pt_id and what else is to be written, as
    doubles; faces: cloud_id, face_id, vertex_indices (places of the vertices in the order of pt_id, from 0)."""
    fields = [c for c in vertices.columns if c not in ("cloud_id", "pt_id")]
    sizes = vertices.groupBy("cloud_id").agg(F.count("*").alias("n")).join(faces.groupBy("cloud_id").agg(F.count("*").alias("m")), "cloud_id", "left")
    head = [F.lit("ply"), F.lit("format ascii 1.0"), F.format_string("element vertex %d", "n"), *[F.lit(f"property double {c}") for c in fields], F.format_string("element face %d", F.coalesce("m", F.lit(0))), F.lit("property list uchar int vertex_indices"), F.lit("end_header")]
    at = lambda part, place: F.struct(F.lit(part).alias("part"), F.col(place).cast("long").alias("place")).alias("line_no")
    name = F.concat(F.col("cloud_id").cast("string"), F.lit(".ply")).alias("name")
    first = sizes.select(name, F.posexplode(F.array(*head)).alias("place", "line")).select("name", at(0, "place"), "line")
    points = vertices.select(name, at(1, "pt_id"), F.concat_ws(" ", *[F.col(f"`{c}`").cast("double").cast("string") for c in fields]).alias("line"))
    corners = faces.select(name, at(2, "face_id"), F.concat_ws(" ", F.size("vertex_indices").cast("string"), F.transform("vertex_indices", lambda x: x.cast("string"))).alias("line"))
    sink.write_named_lines(first.unionByName(points).unionByName(corners), folder)
