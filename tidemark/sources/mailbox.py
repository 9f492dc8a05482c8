"""Mailboxes as a Spark data source: `spark.read.format("mailbox")` and `spark.readStream.format("mailbox")`.

A store is a folder with a folder per mailbox, which holds messages as Parquet files of the schema of sources.messages
(in any order; a message's uid is unique in its mailbox and later messages have greater ones). Files are split by row
group, and what the footers say of uid and sent_at decides which groups are read at all. A group's headers are read
first; bodies and attachments only of groups in which a message passes.

Batch: conditions on mailbox, sender, uid and sent_at are evaluated by the source. Stream: an offset is the last uid of
each mailbox. A batch takes, per mailbox, messages in order of uid up to max_bytes and max_messages (one message at
least, as a larger one would be waited for forever); oversize ones (over max_bytes_each) are passed over. Every run goes
on behind the last batch that was planned, which is noted in the folder `progress`; a batch that failed is planned again
by Spark itself, from its own log. With trigger(availableNow=True) a run takes one batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.sources.messages import MESSAGE

SCHEMA = StructType([StructField("mailbox", StringType()), *MESSAGE.fields, StructField("sender", StringType())])
#: Messages that a task holds at once.
AT_A_TIME = 500
HEADERS = ["uid", "from_raw", "sent_at", "size"]
ADDRESS = re.compile(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}")


def sender_of(header: str | None) -> str | None:
    """The one address of a header; null if there isn't exactly one."""
    found = {*ADDRESS.findall((header or "").lower())}
    return found.pop() if len(found) == 1 else None


@dataclass
class Group(InputPartition):
    """A row group, and the uids of it that are asked for (first excluded, last included)."""

    mailbox: str
    file: str
    number: int
    least_uid: int
    most_uid: int
    least_sent: object
    most_sent: object
    after: int = -1
    upto: int = (1 << 63) - 1


class Store:
    def __init__(self, path: str):
        self.path = path

    @cached_property
    def opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def mailboxes(self) -> list[str]:
        files, root = self.opened
        return sorted(x.base_name for x in files.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory)

    def groups(self, mailbox: str, after: int = -1) -> list[Group]:
        """Row groups with uids above `after`, in order of their least uid; only footers are read."""
        files, root = self.opened
        found = []
        for info in files.get_file_info(fs.FileSelector(f"{root}/{mailbox}")):
            if not info.base_name.endswith(".parquet"):
                continue
            meta = pq.read_metadata(info.path, filesystem=files)
            at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                uid, sent = (meta.row_group(g).column(at[c]).statistics for c in ("uid", "sent_at"))
                least, most = (uid.min, uid.max) if uid is not None and uid.has_min_max else (0, (1 << 63) - 1)
                dates = (sent.min, sent.max) if sent is not None and sent.has_min_max else (None, None)
                if most > after:
                    found.append(Group(mailbox, info.path, g, least, most, *dates))
        return sorted(found, key=lambda g: (g.least_uid, g.file, g.number))

    def read(self, group: Group, columns: list[str]) -> pa.Table:
        files, _ = self.opened
        with files.open_input_file(group.file) as f:
            file = pq.ParquetFile(f)
            return file.read_row_group(group.number, [c for c in columns if c in file.schema_arrow.names])

    def batches(self, group: Group, columns: list[str]) -> Iterator[pa.Table]:
        """A group's rows, AT_A_TIME at once, so that a task's memory doesn't grow with the group."""
        files, _ = self.opened
        with files.open_input_file(group.file) as f:
            file = pq.ParquetFile(f, buffer_size=1 << 20, pre_buffer=False)
            for batch in file.iter_batches(AT_A_TIME, [group.number], [c for c in columns if c in file.schema_arrow.names], use_threads=False):
                yield pa.Table.from_batches([batch])


def kept(table: pa.Table, group: Group, conditions: list[tuple[str, str, object]]) -> pa.Table:
    """Headers with sender, of the uids and conditions asked for."""
    table = table.append_column("sender", pa.array([sender_of(x) for x in table.column("from_raw").to_pylist()], pa.string()))
    uid = table.column("uid")
    keep = pc.and_(pc.greater(uid, group.after), pc.less_equal(uid, group.upto))
    compare = {">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal, "=": pc.equal}
    for column, op, value in conditions:
        if column == "mailbox":
            continue
        own = table.column(column)
        if op == "in":
            test = pc.is_in(own, value_set=pa.array(value, own.type))
        elif op == "known":
            test = pc.is_valid(own)
        elif op == "not above":  # null passes
            test = pc.fill_null(pc.less_equal(own, value), True)
        else:
            value = pa.scalar(value.replace(tzinfo=None) if hasattr(value, "tzinfo") and own.type.tz is None else value)
            test = compare[op](own, value.cast(own.type))
        keep = pc.and_(keep, pc.fill_null(test, False))
    return table.filter(pc.fill_null(keep, False))


def taken(store: Store, group: Group | None, columns: list[str], conditions: list) -> Iterator[pa.RecordBatch]:
    """The messages of a group that pass, with the columns of the schema; bodies only if one passes. Spark asks for no
    group (None) where there is none."""
    if group is None:
        return
    if not any(kept(heads, group, conditions).num_rows for heads in store.batches(group, HEADERS)):
        return
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType([x for x in SCHEMA.fields if x.name in columns]))
    names = [f.name for f in MESSAGE.fields if f.name in columns]
    for some in store.batches(group, list(dict.fromkeys([*HEADERS, *names]))):
        whole = kept(some, group, conditions)
        if whole.num_rows:
            yield from shaped(whole.take(pc.sort_indices(whole.column("uid"))), group, schema).to_batches()


def shaped(whole: pa.Table, group: Group, schema: pa.Schema) -> pa.Table:
    """Messages with their sender, with the columns of a schema."""
    out = []
    for f in schema:
        if f.name == "mailbox":
            out.append(pa.array([group.mailbox] * whole.num_rows, f.type))
        elif f.name in whole.column_names:
            own = whole.column(f.name).combine_chunks()
            if pa.types.is_timestamp(f.type) and own.type.tz is None:
                own = pc.assume_timezone(own.cast(pa.timestamp("us")), "UTC")
            out.append(own.cast(f.type))
        else:
            out.append(pa.nulls(whole.num_rows, f.type))
    return pa.table(out, schema.names)


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options, schema)


OPS: dict[type, str] = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "known"}


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.store, self.columns = Store(options["path"]), schema.names
        self.conditions: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in OPS and f.attribute in (("mailbox",), ("sender",), ("uid",), ("sent_at",)):
                self.conditions.append((f.attribute[0], OPS[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Group]:
        def may(value, op: str, least, most) -> bool:
            if least is None or op == "known":
                return True
            if hasattr(least, "tzinfo") and least.tzinfo is None and getattr(value, "tzinfo", None) is not None:
                value = value.replace(tzinfo=None)
            if op == "in":
                return any(least <= v <= most for v in value)
            return {"=": least <= value <= most, ">": most > value, ">=": most >= value, "<": least < value, "<=": least <= value}[op]

        boxes = self.store.mailboxes()
        for column, op, value in self.conditions:
            if column == "mailbox":
                wanted = {"=": lambda b, v=value: b == v, "in": lambda b, v=value: b in v, ">": lambda b, v=value: b > v, ">=": lambda b, v=value: b >= v, "<": lambda b, v=value: b < v, "<=": lambda b, v=value: b <= v, "known": lambda b: True}[op]
                boxes = [b for b in boxes if wanted(b)]
        found = []
        for group in (g for b in boxes for g in self.store.groups(b)):
            bounds = {"uid": (group.least_uid, group.most_uid), "sent_at": (group.least_sent, group.most_sent)}
            if all(c not in bounds or may(v, op, *bounds[c]) for c, op, v in self.conditions):
                found.append(group)
        return found

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return taken(self.store, partition, self.columns, self.conditions)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.store, self.columns = Store(options["path"]), schema.names
        self.progress = Store(options["progress"]) if options.get("progress") else None
        self.max_bytes, self.max_messages = int(options.get("max_bytes", 100 << 20)), int(options.get("max_messages", 2000))
        self.max_each = int(options.get("max_bytes_each", 25 << 20))
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def noted(self) -> dict:
        """The end of the last batch that was planned."""
        if self.at is None:
            self.at = {}
            if self.progress:
                files, root = self.progress.opened
                if files.get_file_info(f"{root}/offset.json").type == fs.FileType.File:
                    with files.open_input_stream(f"{root}/offset.json") as f:
                        self.at = json.loads(f.read())
        return self.at

    def latestOffset(self) -> dict:
        """The last uid per mailbox that the next batch may take."""
        at = self.noted()
        return {b: self.admitted(b, int(at.get(b, -1))) for b in self.store.mailboxes()}

    def admitted(self, mailbox: str, after: int) -> int:
        last, total, n = after, 0, 0
        held: list[tuple[int, int]] = []
        groups = self.store.groups(mailbox, after)
        for i, group in enumerate(groups):
            heads = self.store.read(group, ["uid", "size"])
            held += [(u, s or 0) for u, s in zip(heads.column("uid").to_pylist(), heads.column("size").to_pylist(), strict=True) if u is not None and u > after]
            # groups may overlap: what lies below all that is still to come is in order
            bound = groups[i + 1].least_uid if i + 1 < len(groups) else 1 << 63
            ready = sorted(x for x in held if x[0] < bound)
            held = [x for x in held if x[0] >= bound]
            for uid, size in ready:
                own = 0 if size > self.max_each else size
                if n and (total + own > self.max_bytes or n >= self.max_messages):
                    return last
                last, total, n = uid, total + own, n + (own > 0 or size == 0)
        return last

    def partitions(self, start: dict, end: dict) -> list[Group]:
        found = []
        for box, upto in end.items():
            after = int(start.get(box, -1))
            for group in self.store.groups(box, after) if int(upto) > after else []:
                if group.least_uid <= int(upto):
                    group.after, group.upto = after, int(upto)
                    found.append(group)
        self.at = {**self.noted(), **end}
        if self.progress:
            files, root = self.progress.opened
            files.create_dir(root, recursive=True)
            with files.open_output_stream(f"{root}/offset.json") as f:
                f.write(json.dumps(self.at).encode())
        return found

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return taken(self.store, partition, self.columns, [("size", "not above", self.max_each)])


def register(spark) -> None:
    """Make the source known to a session, and let Spark hand conditions to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Mailbox)
