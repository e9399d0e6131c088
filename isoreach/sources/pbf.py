"""Binary street archives (the PBF exchange format) as a Spark data source.

An archive is a row of blobs, each a compressed block of some thousand nodes or
ways.  The plan reads only the few bytes before each blob; tasks then read,
inflate and decode the blocks of their part, one at a time.  What is written
is a folder with one whole archive per partition, and folders are read alike.

``spark.read.format("street_archive").option("kind", "nodes" or "ways")``:
columns beside ``osmid``, ``x``, ``y``, ``nodes`` and ``tags`` (all tags as a
map) are tags by name, null where an element has none.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from isoreach.shipping import ship

# The schemas of nodes and ways and the limits and field numbers of the format.
NODE_SCHEMA = "osmid long, x double, y double, highway string, ele string, junction string, railway string, ref string"
WAY_SCHEMA = (
    "osmid long, nodes array<long>, access string, area string, bridge string, est_width string, highway string, sidewalk string, cycleway string, footway string, "
    "junction string, landuse string, lanes string, maxspeed string, name string, oneway string, ref string, service string, tunnel string, width string"
)
MAX_HEADER, MAX_BLOB, GRANULARITY, BLOCK_ROWS = 64 * 1024, 32 * 1024 * 1024, 100, 8000
FEATURES = ("OsmSchema-V0.6", "DenseNodes")
OWN = ("osmid", "x", "y", "nodes", "tags")
#: Packed fields up to this long are handled number by number, which is faster there than arrays.
FEW = 64


# Messages: (field, value) pairs, a value being a number or the bytes of its length.


def varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a position and the position after it."""
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """All fields of a message in order."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"not a field of an archive: {key}")
        yield key >> 3, value


def signed(value: int) -> int:
    """A number of 64 bits as a signed one."""
    return value - (1 << 64) if value >= 1 << 63 else value


def numbers(data: bytes, zigzag: bool = False) -> np.ndarray:
    """All numbers of a packed field at once."""
    if len(data) <= FEW:
        out, at = [], 0
        while at < len(data):
            value, at = varint(data, at)
            out.append((value >> 1) ^ -(value & 1) if zigzag else signed(value))
        return np.array(out, np.int64)
    out = _numbers(np.frombuffer(data, np.uint8))
    return _unzigzag(out) if zigzag else out


def _numbers(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 0x80)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), first).view(np.int64)


def _unzigzag(values: np.ndarray) -> np.ndarray:
    v = values.view(np.uint64)
    return ((v >> np.uint64(1)) ^ (np.uint64(0) - (v & np.uint64(1)))).view(np.int64)


def packed(values: Sequence[int] | np.ndarray, zigzag: bool = False) -> bytes:
    """The bytes of a packed field."""
    if len(values) <= FEW:
        out = bytearray()
        for v in map(int, values):
            left = ((v << 1) ^ (v >> 63) if zigzag else v) & ((1 << 64) - 1)
            while left > 0x7F:
                out.append(left & 0x7F | 0x80)
                left >>= 7
            out.append(left)
        return bytes(out)
    v = np.asarray(values, np.int64)
    left = ((v << 1) ^ (v >> 63)).view(np.uint64) if zigzag else v.view(np.uint64)
    digits = np.zeros((len(v), 10), np.uint8)
    used = np.zeros((len(v), 10), bool)
    more = np.ones(len(v), bool)
    for i in range(10):
        if not more.any():
            break
        used[:, i] = more
        digits[:, i] = (left & np.uint64(0x7F)).astype(np.uint8)
        left = left >> np.uint64(7)
        more = more & (left > 0)
        digits[:, i] |= np.where(more, 0x80, 0).astype(np.uint8)
    return digits[used].tobytes()


def number(field: int, value: int) -> bytes:
    """A number as a field."""
    return packed([field << 3, value])


def part(field: int, data: bytes) -> bytes:
    """Bytes as a field."""
    return packed([field << 3 | 2, len(data)]) + data


def deltas(values) -> np.ndarray:
    """Differences of consecutive numbers, the first from zero."""
    return np.diff(np.asarray(values, np.int64), prepend=np.int64(0))


# Blocks


def inflated(blob: bytes) -> bytes:
    """The message in a blob: plain, deflated or by zstandard."""
    found = dict(fields(blob))
    if 1 in found:
        return found[1]
    if 3 in found:
        return zlib.decompress(found[3])
    if 7 in found:
        return pa.decompress(found[7], decompressed_size=found[2], codec="zstd", asbytes=True)
    raise ValueError("a blob is compressed in a way that is not read")


class Rows(NamedTuple):
    """Columns of elements: places of nodes, references of ways with their offsets, and tags as rows, keys and values (numbers of texts)."""

    ids: np.ndarray
    places: tuple[np.ndarray, np.ndarray] | None
    refs: tuple[np.ndarray, np.ndarray] | None
    tags: tuple[np.ndarray, np.ndarray, np.ndarray]


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of every row, one after another: rows and places."""
    counts = ends - starts
    return np.repeat(np.arange(len(starts)), counts), np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))


def elements(block: bytes, kind: str) -> Iterator[tuple[Rows, list[str]]]:
    """Nodes or ways of a block, group by group, and the texts that their tags number."""
    texts, groups, granularity, lat0, lon0 = [], [], GRANULARITY, 0, 0
    for field, value in fields(block):
        if field == 1:
            texts = [v.decode() for f, v in fields(value) if f == 1]
        elif field == 2:
            groups.append(value)
        elif field == 17:
            granularity = value
        elif field == 19:
            lat0 = signed(value)
        elif field == 20:
            lon0 = signed(value)
    degrees = lambda base, units: (base + granularity * units) / 1e9
    for group in groups:
        if kind == "ways" and (rows := _ways(group)) is not None:
            yield rows, texts
            continue
        one_by_one = []
        for field, value in fields(group):
            if kind == "nodes" and field == 2:
                yield _dense(value, lambda u: degrees(lon0, u), lambda u: degrees(lat0, u)), texts
            elif (kind, field) in (("nodes", 1), ("ways", 3)):
                one_by_one.append(dict(fields(value)))
        if one_by_one:
            yield _single(one_by_one, kind, lambda u: degrees(lon0, u), lambda u: degrees(lat0, u)), texts


def _single(found: list[dict], kind: str, lon, lat) -> Rows:
    """Plain nodes, and ways of messages with parts that are not numbers."""
    tags = [(i, k, v) for i, f in enumerate(found) for k, v in zip(numbers(f.get(2, b"")).tolist(), numbers(f.get(3, b"")).tolist())]
    tags = tuple(np.array(tags, np.int64).reshape(-1, 3).T)
    if kind == "ways":
        refs = [np.cumsum(numbers(f.get(8, b""), True)) for f in found]
        return Rows(np.array([signed(f.get(1, 0)) for f in found], np.int64), None, (_offsets(np.array([len(r) for r in refs])), np.concatenate(refs)), tags)
    ids, ys, xs = (numbers(packed([f.get(n, 0) for f in found]), True) for n in (1, 8, 9))
    return Rows(ids, (lon(xs), lat(ys)), None, tags)


def _ways(group: bytes) -> Rows | None:
    """Ways of a group, whose bytes are all numbers; none if they are not.

    A part of a message ends with a number's last byte, so that its end in
    bytes is one in numbers.  Ways are found one after another, and their
    fields by rounds, a field of every way at a time.
    """
    if not group or group[-1] > 0x7F:
        return None
    raw = np.frombuffer(group, np.uint8)
    final = raw < 0x80
    values, after, ended = _numbers(raw), np.flatnonzero(final) + 1, _offsets(final)
    value_at, after_at, ended_at = values.tolist(), after.tolist(), ended.tolist()
    at, starts, stops = 0, [], []
    while at < len(value_at):
        key = value_at[at]
        if key & 7 not in (0, 2):
            return None
        to = at + 2
        if key & 7 == 2:
            end = after_at[at + 1] + value_at[at + 1]
            if group[end - 1] > 0x7F:
                return None
            to = ended_at[end]
            if key >> 3 == 3:
                starts.append(at + 2)
                stops.append(to)
        at = to
    now, stop = np.array(starts, np.int64), np.array(stops, np.int64)
    ids = np.zeros(len(now), np.int64)
    spans = {f: (np.zeros(len(now), np.int64), np.zeros(len(now), np.int64)) for f in (2, 3, 8)}
    live = np.arange(len(now))
    while len(live := live[now[live] < stop[live]]):
        i = now[live]
        field, long = values[i] >> 3, (values[i] & 7) == 2
        end = after[i + 1] + np.where(long, values[i + 1], 0)
        if (~long & ((values[i] & 7 != 0) | np.isin(field, (2, 3, 8)))).any() or (end > len(raw)).any() or not final[end - 1].all():
            return None
        one = ~long & (field == 1)
        ids[live[one]] = values[i[one] + 1]
        for f, (first, past) in spans.items():
            hit = long & (field == f)
            first[live[hit]], past[live[hit]] = i[hit] + 2, ended[end[hit]]
        now[live] = ended[end]
    (k0, k1), (v0, v1), (r0, r1) = spans.values()
    tagged = np.minimum(k1 - k0, v1 - v0)
    rows, keys = _spread(k0, k0 + tagged)
    tags = (rows, values[keys], values[_spread(v0, v0 + tagged)[1]])
    back = _unzigzag(values[_spread(r0, r1)[1]])
    offsets = _offsets(r1 - r0)
    return Rows(ids, None, (offsets, np.cumsum(back) - np.repeat(_offsets(back)[offsets[:-1]], r1 - r0)), tags)


def _dense(data: bytes, lon, lat) -> Rows:
    f = dict(fields(data))
    ids, ys, xs = (np.cumsum(numbers(f.get(n, b""), True)) for n in (1, 8, 9))
    keys = numbers(f.get(10, b""))
    zeros = np.flatnonzero(keys == 0)
    starts = np.concatenate(([0], zeros[:-1] + 1))
    if not len(keys):
        tags = (np.zeros(0, np.int64),) * 3
    elif len(zeros) == len(ids) and zeros[-1] == len(keys) - 1 and not ((zeros - starts) % 2).any():
        rows, at = _spread(starts, zeros)
        tags = (rows[::2], keys[at[::2]], keys[at[1::2]])
    else:  # a value is text 0, or the last nodes are left out
        at, found, numbered = 0, [], keys.tolist()
        for i in range(len(ids)):
            while at < len(numbered) and numbered[at]:
                found.append((i, numbered[at], numbered[at + 1]))
                at += 2
            at += 1
        tags = tuple(np.array(found, np.int64).reshape(-1, 3).T)
    return Rows(ids, (lon(xs), lat(ys)), None, tags)


def batch_of(rows: Rows, texts: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """Elements as an Arrow batch: own columns, all tags as a map, and tags by name."""
    place: dict[str, int] = {}
    same = np.array([place.setdefault(t, i) for i, t in enumerate(texts)], np.int64)
    (at, keys, values), named, n = rows.tags, pa.array(texts, pa.string()), len(rows.ids)
    keys = same[keys]

    def column(name: str, kind: pa.DataType) -> pa.Array:
        if name == "osmid":
            return pa.array(rows.ids, kind)
        if name in ("x", "y") and rows.places is not None:
            return pa.array(rows.places[name == "y"], kind)
        if name == "nodes" and rows.refs is not None:
            return pa.ListArray.from_arrays(pa.array(rows.refs[0], pa.int32()), pa.array(rows.refs[1], kind.value_type), type=kind)
        if name == "tags":
            _, last = np.unique((at * max(1, len(texts)) + keys)[::-1], return_index=True)
            last = np.sort(len(at) - 1 - last)  # of a key given twice the last one
            offsets = _offsets(np.bincount(at[last], minlength=n))
            return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), named.take(pa.array(keys[last])), named.take(pa.array(values[last])), type=kind)
        if name in OWN or name not in place:
            return pa.nulls(n, kind)
        hit, chosen = keys == place[name], np.full(n, -1)
        chosen[at[hit]] = values[hit]
        return named.take(pa.array(chosen, mask=chosen < 0))

    return pa.RecordBatch.from_arrays([column(c, t) for c, t in zip(schema.names, schema.types)], schema=schema)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of each list or map begin and end; a null has none."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return ends[:-1], np.where(column.is_null().to_numpy(zero_copy_only=False), ends[:-1], ends[1:])


def _tagged(rows: pa.Table) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a block, and its tags as rows, keys and values in order; a column goes before the map."""
    at, keys, values = [], [], []
    for name in sorted(rows.column_names, key=lambda c: c != "tags"):
        if name in OWN and name != "tags":
            continue
        column = _whole(rows, name)
        if name == "tags":
            row, place = _spread(*_lists(column))
            key, value = column.keys.take(pa.array(place)), column.items.take(pa.array(place))
        else:
            row, key, value = np.arange(len(column)), pa.repeat(name, len(column)), column.cast(pa.string())
        there = np.flatnonzero(value.is_valid().to_numpy(zero_copy_only=False))
        at.append(row[there])
        keys.append(key.take(pa.array(there)).cast(pa.string()))
        values.append(value.take(pa.array(there)).cast(pa.string()))
    found = pa.concat_arrays([pa.array([], pa.string()), *keys, *values]).dictionary_encode()
    texts, numbered = found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)
    at, (key, value) = np.concatenate([np.zeros(0, np.int64), *at]), np.split(numbered, 2)
    rank = np.zeros(len(texts), np.int64)
    used = sorted(np.unique(key).tolist(), key=texts.__getitem__)
    rank[used] = np.arange(len(used))
    order = np.lexsort((rank[key], at))
    at, key, value = at[order], key[order], value[order]
    last = np.append((at[1:] != at[:-1]) | (key[1:] != key[:-1]), np.ones(min(1, len(at)), bool))
    return part(1, b"".join(part(1, t.encode()) for t in ("", *texts))), at[last], key[last] + 1, value[last] + 1


def _whole(rows: pa.Table, name: str) -> pa.Array:
    column = rows[name].combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _widths(values: np.ndarray) -> np.ndarray:
    """How many bytes each number takes."""
    return 1 + sum((values.view(np.uint64) >= np.uint64(1 << 7 * i)).astype(np.int64) for i in range(1, 10))


def block_of(rows: pa.Table, kind: str) -> bytes:
    """The message of a block that holds some rows."""
    texts, at, key, value = _tagged(rows)
    ids, n = _whole(rows, "osmid"), rows.num_rows
    if ids.null_count:
        raise ValueError("an element without id")
    ids, tags = ids.to_numpy().astype(np.int64), np.bincount(at, minlength=n)
    nth = np.arange(len(at)) - np.repeat(_offsets(tags)[:-1], tags)
    if kind == "nodes":
        units = lambda c: deltas(np.rint(_whole(rows, c).to_numpy(zero_copy_only=False).astype(float) * 1e9 / GRANULARITY).astype(np.int64))
        base = _offsets(2 * tags + 1)
        keys = np.zeros(base[-1], np.int64)
        keys[base[at] + 2 * nth], keys[base[at] + 2 * nth + 1] = key, value
        return texts + part(2, part(2, part(1, packed(deltas(ids), True)) + part(8, packed(units("y"), True)) + part(9, packed(units("x"), True)) + part(10, packed(keys))))
    nodes = _whole(rows, "nodes")
    row, place = _spread(*_lists(nodes))
    refs = nodes.values.take(pa.array(place)).to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.bincount(row, minlength=n)
    refs = np.where(np.append(True, row[1:] != row[:-1])[: len(row)], refs, deltas(refs))
    refs = (refs << 1) ^ (refs >> 63)
    size = lambda numbers, rows: np.diff(_offsets(_widths(numbers))[_offsets(rows)])
    lengths = [size(key, tags), size(value, tags), size(refs, count)]
    # of each way: its field and length, id, keys, values and references, each with their field and length
    base = _offsets(10 + 2 * tags + count)
    out = np.zeros(base[-1], np.int64)
    base = base[:-1]
    whole = 1 + _widths(ids) + sum(1 + _widths(x) + x for x in lengths)
    out[base], out[base + 1], out[base + 2], out[base + 3] = 3 << 3 | 2, whole, 1 << 3, ids
    begin = base + 4
    for field, r, i, data, length, each in ((2, at, nth, key, lengths[0], tags), (3, at, nth, value, lengths[1], tags), (8, row, np.arange(len(row)) - np.repeat(_offsets(count)[:-1], count), refs, lengths[2], count)):
        out[begin], out[begin + 1] = field << 3 | 2, length
        out[begin[r] + 2 + i] = data
        begin = begin + 2 + each
    return texts + part(2, packed(out))


def blob_of(message: bytes, kind: str = "OSMData") -> bytes:
    """A message as a blob with its header."""
    blob = number(2, len(message)) + part(3, zlib.compress(message))
    header = part(1, kind.encode()) + number(3, len(blob))
    return struct.pack(">I", len(header)) + header + blob


# The data source


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise ValueError(f"no archive at {path}")
    if info.type == pafs.FileType.File:
        return [(at, info.size)]
    found = fs.get_file_info(pafs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def blocks(path: str) -> list[tuple[str, int, int]]:
    """(file, offset, size) of every blob of data, from the bytes before each."""
    fs, _ = opened(path)
    out = []
    for name, size in _files(path):
        with fs.open_input_file(name) as f:
            at = 0
            while at < size:
                length = struct.unpack(">I", f.read_at(4, at))[0]
                if length > MAX_HEADER:
                    raise ValueError(f"not a street archive: {name}")
                header = dict(fields(f.read_at(length, at + 4)))
                start, length = at + 4 + length, header[3]
                if length > MAX_BLOB or start + length > size:
                    raise ValueError(f"a blob is cut off or too long: {name}")
                if header[1] == b"OSMData":
                    out.append((name, start, length))
                at = start + length
    return out


class Part(InputPartition):
    """Blocks that one task decodes."""

    def __init__(self, blobs: list[tuple[str, int, int]]):
        self.blobs = blobs


class Reader(DataSourceReader):
    """Decodes blocks into Arrow batches, one batch a group of elements."""

    def __init__(self, schema, options):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.kind = options["path"], options.get("kind", "nodes")
        self.bytes = int(options.get("partition_bytes", str(4 * 1024 * 1024)))
        self.arrow = to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        out, size = [], 0
        for blob in blocks(self.path):
            if not out or size + blob[2] > self.bytes:
                out.append(Part([]))
                size = 0
            out[-1].blobs.append(blob)
            size += blob[2]
        return out or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        for name, start, length in partition.blobs:
            with fs.open_input_file(name) as f:
                block = inflated(f.read_at(length, start))
            for rows, texts in elements(block, self.kind):
                yield batch_of(rows, texts, self.arrow)


class Written(WriterCommitMessage):
    """The file of a finished task, under a name that only its attempt has."""

    def __init__(self, hidden: str, final: str):
        self.hidden, self.final = hidden, final


class Writer(DataSourceArrowWriter):
    """Writes one archive per partition; files get their names when all tasks are done."""

    def __init__(self, options, overwrite: bool):
        self.path, self.kind, self.rows = options["path"], options.get("kind", "nodes"), int(options.get("block_rows", str(BLOCK_ROWS)))
        fs, at = opened(self.path)
        self.old = [name for name, _ in _files(self.path) if name.rsplit("/", 1)[-1].startswith(f"{self.kind}-")] if fs.get_file_info(at).type != pafs.FileType.NotFound else []
        if self.old and not overwrite:
            raise ValueError(f"there are {self.kind} in {self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        name = uuid.uuid4().hex
        hidden = f"{at}/.{name}"
        with fs.open_output_stream(hidden) as out:
            out.write(blob_of(b"".join(part(4, t.encode()) for t in FEATURES), "OSMHeader"))
            for rows in self._blocks(iterator):
                out.write(blob_of(block_of(rows, self.kind)))
        return Written(hidden, f"{at}/{self.kind}-{name}.osm.pbf")

    def _blocks(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of a block each; batches may be shorter."""
        held, n = [], 0
        for batch in iterator:
            held, n = [*held, batch], n + batch.num_rows
            while n >= self.rows:
                rows = pa.Table.from_batches(held)
                yield rows.slice(0, self.rows)
                held, n = rows.slice(self.rows).to_batches(), n - self.rows
        if n:
            yield pa.Table.from_batches(held)

    def commit(self, messages) -> None:
        fs, _ = opened(self.path)
        for name in self.old:
            fs.delete_file(name)
        for m in messages:
            fs.move(m.hidden, m.final)

    def abort(self, messages) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.hidden)


class StreetArchive(DataSource):
    """Binary street archives, read and written by blocks."""

    @classmethod
    def name(cls) -> str:
        return "street_archive"

    def schema(self) -> str:
        return NODE_SCHEMA if self.options.get("kind", "nodes") == "nodes" else WAY_SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(StreetArchive)


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """Nodes or ways of an archive or a folder of archives."""
    register(spark)
    reader = spark.read.format("street_archive").option("kind", kind)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str) -> None:
    """Nodes (osmid, x, y, tags) or ways (osmid, nodes, tags) as archives, one per partition, in place of those of their kind."""
    register(df.sparkSession)
    df.write.format("street_archive").option("kind", kind).mode("overwrite").save(path)
