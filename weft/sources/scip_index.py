"""Symbol indexes in their wire format, as a data source of tables.

``spark.read.format("scip_index").option("table", "occurrences").load(path)`` reads an index file, or a folder
of them, without a protobuf library. The driver steps over the lengths of a file's top-level fields and
deals its documents out in byte ranges of about ``split`` bytes, so one file is read by many tasks; small
files are whole ranges and aren't opened by the driver. Each task decodes its documents to Arrow batches.

Tables: ``documents``, ``occurrences``, ``symbols`` (of documents, and externals with a null path) and
``metadata``. ``df.write.format("scip_index")`` writes documents (see DOCUMENTS), one file a task; a
concatenation of index files is an index file, so a folder is one index.

Unknown fields are skipped; a field that is repeated counts as its last value, as the format has it. A file
that ends within a field is an error that names its path. Paths are those that the driver and the tasks
can open (local and shared folders, and stores that pyarrow knows by address).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Kinds of symbols by number; there is none at 83 (fixed values).
KINDS = (
    "UnspecifiedKind Array Assertion AssociatedType Attribute Axiom Boolean Class Constant Constructor DataFamily Enum EnumMember Event Fact Field File Function Getter Grammar Instance Interface Key Lang Lemma Macro "
    "Method MethodReceiver Message Module Namespace Null Number Object Operator Package PackageObject Parameter ParameterLabel Pattern Predicate Property Protocol Quasiquoter SelfParameter Setter Signature Subscript "
    "String Struct Tactic Theorem ThisParameter Trait Type TypeAlias TypeClass TypeFamily TypeParameter Union Value Variable Contract Error Library Modifier AbstractMethod MethodSpecification ProtocolMethod "
    "PureVirtualMethod TraitMethod TypeClassMethod Accessor Delegate MethodAlias SingletonClass SingletonMethod StaticDataMember StaticEvent StaticField StaticMethod StaticProperty StaticVariable - Extension Mixin Concept"
).split()
#: Position encodings by number (fixed values).
ENCODINGS = ("Unspecified", "UTF8", "UTF16", "UTF32")
#: Bytes of documents that a task reads.
SPLIT = 8 << 20

_RELATIONS = "array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean>>"
TABLES = {
    "documents": "relative_path string, language string, text string, encoding string, occurrences int, symbols int",
    "occurrences": "relative_path string, ord int, symbol string, roles int, range array<int>, enclosing_range array<int>, encoding string",
    "symbols": f"relative_path string, symbol string, display_name string, kind string, documentation array<string>, relationships {_RELATIONS}",
    "metadata": "project_root string, text_encoding int, tool_name string, tool_version string, arguments array<string>",
}
#: What is written: a row a document; rows without a path give their symbols as external ones.
DOCUMENTS = (
    "relative_path string, language string, text string, encoding string, occurrences array<struct<range:array<int>,symbol:string,roles:int,enclosing_range:array<int>>>, "
    f"symbols array<struct<symbol:string,display_name:string,kind:string,documentation:array<string>,relationships:{_RELATIONS}>>"
)
COLUMNS = ("relative_path", "language", "text", "encoding", "occurrences", "symbols")


def varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number of more than ten bytes")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a message: numbers, or the bytes of all else."""
    at, end = 0, len(data)
    while at < end:
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 2, 5):
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = varint(data, at)
            if at + size > end:
                raise ValueError("a field that ends after its message")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"fields of kind {kind} aren't known")
        yield tag >> 3, value


def _int(value: int) -> int:
    """A 32-bit number as it was before it was written."""
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def _ints(value: int | bytes, into: list[int]) -> None:
    """Adds a repeated number, packed or not."""
    if isinstance(value, int):
        into.append(_int(value))
        return
    at = 0
    while at < len(value):
        x, at = varint(value, at)
        into.append(_int(x))


def _text(value: bytes) -> str:
    return value.decode("utf-8", "replace")


def occurrence(data: bytes) -> dict:
    out = {"range": [], "symbol": "", "roles": 0, "enclosing_range": []}
    for number, value in fields(data):
        if number == 1:
            _ints(value, out["range"])
        elif number == 2:
            out["symbol"] = _text(value)
        elif number == 3:
            out["roles"] = _int(value)
        elif number == 7:
            _ints(value, out["enclosing_range"])
    return out


_FLAGS = {2: "is_reference", 3: "is_implementation", 4: "is_type_definition", 5: "is_definition"}


def symbol(data: bytes) -> dict:
    out = {"symbol": "", "display_name": "", "kind": None, "documentation": [], "relationships": []}
    for number, value in fields(data):
        if number == 1:
            out["symbol"] = _text(value)
        elif number == 3:
            out["documentation"].append(_text(value))
        elif number == 4:
            relation = {"symbol": "", **dict.fromkeys(_FLAGS.values(), False)}
            for n, v in fields(value):
                if n == 1:
                    relation["symbol"] = _text(v)
                elif n in _FLAGS:
                    relation[_FLAGS[n]] = bool(v)
            out["relationships"].append(relation)
        elif number == 5:
            out["kind"] = KINDS[value] if 0 < value < len(KINDS) else None
        elif number == 6:
            out["display_name"] = _text(value)
    return out


def document(data: bytes) -> dict:
    out = {"relative_path": "", "language": "", "text": "", "encoding": ENCODINGS[0], "occurrences": [], "symbols": []}
    for number, value in fields(data):
        if number in (1, 4, 5):
            out[{1: "relative_path", 4: "language", 5: "text"}[number]] = _text(value)
        elif number == 2:
            out["occurrences"].append(value)
        elif number == 3:
            out["symbols"].append(value)
        elif number == 6:
            out["encoding"] = ENCODINGS[value] if value < len(ENCODINGS) else ENCODINGS[0]
    return out


def metadata(data: bytes) -> dict:
    out = {"project_root": "", "text_encoding": 0, "tool_name": "", "tool_version": "", "arguments": []}
    for number, value in fields(data):
        if number == 2:
            for n, v in fields(value):
                if n == 3:
                    out["arguments"].append(_text(v))
                elif n in (1, 2):
                    out[{1: "tool_name", 2: "tool_version"}[n]] = _text(v)
        elif number == 3:
            out["project_root"] = _text(value)
        elif number == 4:
            out["text_encoding"] = value
    return out


def rows(table: str, number: int, data: bytes) -> Iterator[dict]:
    """The rows of a table that a top-level field gives."""
    if table == "metadata":
        if number == 1:
            yield metadata(data)
    elif number == 3:
        if table == "symbols":
            yield {"relative_path": None, **symbol(data)}
    elif number == 2:
        doc = document(data)
        path = doc["relative_path"]
        if table == "documents":
            yield {**doc, "occurrences": len(doc["occurrences"]), "symbols": len(doc["symbols"])}
        elif table == "occurrences":
            for i, x in enumerate(doc["occurrences"]):
                yield {"relative_path": path, "ord": i, "encoding": doc["encoding"], **occurrence(x)}
        else:
            for x in doc["symbols"]:
                yield {"relative_path": path, **symbol(x)}


def _opened(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _head(data: bytes, at: int, path: str) -> tuple[int, int, int]:
    """(field, bytes of its head, bytes of its body) of a top-level field."""
    try:
        tag, begin = varint(data, 0)
        size, begin = varint(data, begin)
    except IndexError:
        raise ValueError(f"{path} ends within the field at byte {at}") from None
    if tag & 7 != 2:
        raise ValueError(f"{path} isn't a symbol index: kind {tag & 7} at byte {at}")
    return tag >> 3, begin, size


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


@dataclass
class Share(InputPartition):
    """Ranges that one task reads, one after another."""

    ranges: list[Range]


#: Tasks that a scan has at most, and documents that a writer holds as Python objects at once.
TASKS, HELD = 512, 16


def shares(found: list[Range]) -> list[Share]:
    """Ranges in order, as many to each task as keeps tasks at TASKS or fewer."""
    n = max(1, -(-len(found) // TASKS))
    return [Share(found[i : i + n]) for i in range(0, len(found), n)]


def ranges(path: str, size: int, split: int) -> Iterator[Range]:
    """Byte ranges of whole top-level fields; only the heads of fields are read."""
    if size <= split:
        if size:
            yield Range(path, 0, size)
        return
    files, place = _opened(path)
    begin = at = 0
    with files.open_input_file(place) as f:
        while at < size:
            f.seek(at)
            _, head, body = _head(f.read(20), at, path)
            if at + head + body > size:
                raise ValueError(f"{path} ends within the field at byte {at}")
            if at > begin and at + head + body - begin > split:
                yield Range(path, begin, at)
                begin = at
            at += head + body
    yield Range(path, begin, size)


class _Reader(DataSourceReader):
    def __init__(self, table: str, schema: StructType, path: str, split: int, batch: int = 4096) -> None:
        self.table, self.schema, self.path, self.split, self.batch = table, schema, path, split, batch

    def partitions(self) -> list[Share]:
        files, place = _opened(self.path)
        info = files.get_file_info(place)
        if info.type == afs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in files.get_file_info(afs.FileSelector(place, recursive=True)) if x.is_file and not x.base_name.startswith((".", "_"))]
        prefix = self.path[: len(self.path) - len(place)] if self.path.endswith(place) else ""
        return shares([r for x in sorted(found, key=lambda x: x.path) for r in ranges(prefix + x.path, x.size, self.split)])

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges if partition is not None else ():  # None: there are no partitions
            yield from self._range(one)

    def _range(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, place = _opened(partition.path)
        schema = to_arrow_schema(self.schema)
        with files.open_input_file(place) as f:
            f.seek(partition.begin)
            data = f.read(partition.end - partition.begin)
        at, held = 0, []
        while at < len(data):
            number, head, size = _head(data[at : at + 20], partition.begin + at, partition.path)
            body = data[at + head : at + head + size]
            if len(body) < size:
                raise ValueError(f"{partition.path} ends within the field at byte {partition.begin + at}")
            at += head + size
            for row in rows(self.table, number, body):
                held.append(row)
                if len(held) == self.batch:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


def number(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _bytes(field: int, value: bytes | str) -> bytes:
    value = value.encode() if isinstance(value, str) else value
    return number(field << 3 | 2) + number(len(value)) + value


def _put(field: int, value) -> bytes:
    """A field; what is empty, zero or null isn't written."""
    if not value:
        return b""
    if isinstance(value, (bool, int)):
        return number(field << 3) + number(int(value))
    if isinstance(value, list):
        return _bytes(field, b"".join(map(number, value)))
    return _bytes(field, value)


def _symbol_bytes(x: dict) -> bytes:
    relations = (_put(1, r["symbol"]) + b"".join(_put(n, r[flag]) for n, flag in _FLAGS.items()) for r in x["relationships"] or ())
    kind = KINDS.index(x["kind"]) if x["kind"] else 0
    return _put(1, x["symbol"]) + b"".join(_bytes(3, d) for d in x["documentation"] or ()) + b"".join(_bytes(4, r) for r in relations) + _put(5, kind) + _put(6, x["display_name"])


def encoded(row: dict) -> bytes:
    """The top-level fields of a row of DOCUMENTS."""
    symbols = [_symbol_bytes(x) for x in row["symbols"] or ()]
    if row["relative_path"] is None:
        return b"".join(_bytes(3, x) for x in symbols)
    body = [_put(1, row["relative_path"]), *(_bytes(2, _put(1, o["range"]) + _put(2, o["symbol"]) + _put(3, o["roles"]) + _put(7, o["enclosing_range"])) for o in row["occurrences"] or ())]
    body += [*(_bytes(3, x) for x in symbols), _put(4, row["language"]), _put(5, row["text"]), _put(6, ENCODINGS.index(row["encoding"] or ENCODINGS[0]))]
    return _bytes(2, b"".join(body))


@dataclass
class _Wrote(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.options = path.rstrip("/"), options
        files, place = _opened(self.path)
        if overwrite and files.get_file_info(place).type == afs.FileType.Directory:
            files.delete_dir_contents(place)
        files.create_dir(place, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{self.path}/part-{context.partitionId():05d}-{context.taskAttemptId()}.scip"
        files, place = _opened(name)
        with files.open_output_stream(place) as f:
            if context.partitionId() == 0:
                tool = _put(1, self.options.get("tool", "weft")) + _put(2, self.options.get("toolversion", ""))
                f.write(_bytes(1, _bytes(2, tool) + _put(3, self.options.get("projectroot", "")) + _put(4, 1)))
            for batch in iterator:
                for i in range(0, batch.num_rows, HELD):  # a batch may hold all occurrences of thousands of documents
                    for row in batch.slice(i, HELD).to_pylist():
                        f.write(encoded(row))
        return _Wrote(name)

    def commit(self, messages: list[_Wrote | None]) -> None:
        pass

    def abort(self, messages: list[_Wrote | None]) -> None:
        for m in messages:
            if m is not None:
                files, place = _opened(m.path)
                files.delete_file(place)


class ScipIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scip_index"

    def schema(self) -> str:
        return TABLES[self._table]

    @property
    def _table(self) -> str:
        table = self.options.get("table", "occurrences")
        if table not in TABLES:
            raise ValueError(f"no table {table}: {', '.join(TABLES)}")
        return table

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._table, schema, self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if tuple(schema.names) != COLUMNS:
            raise ValueError(f"an index is written from columns {', '.join(COLUMNS)}")
        return _Writer(self.options["path"], dict(self.options), overwrite)


def index_table(spark: SparkSession, path: str, table: str, split: int = SPLIT):
    """A table of the index at path."""
    spark.dataSource.register(ScipIndex)
    return spark.read.format("scip_index").option("table", table).option("split", str(split)).load(path)


def write_index(documents, path: str, **options: str) -> None:
    """Writes documents (columns of DOCUMENTS) as an index at path, which is replaced."""
    documents.sparkSession.dataSource.register(ScipIndex)
    documents.select(*COLUMNS).write.format("scip_index").options(**options).mode("overwrite").save(path)
