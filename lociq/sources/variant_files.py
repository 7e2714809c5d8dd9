"""Data sources of block-compressed VCF and of BCF, in many tasks a file and by region.

``vcf_blocks`` gives the data lines (line, chrom, pos, value) of files or folders
of .vcf.gz; ``bcf`` the records (line, chrom, pos, ref, alt, ac, an, af, gt).  With an
index beside a file (.tbi or .csi), a region reads the blocks that may hold it and no
others; conditions on chrom and pos are pushed down to the same end.  Without one,
a VCF is cut into ranges of blocks and a BCF, whose records cannot be told apart in
the middle of a file, is one task.  ``line`` numbers records in the file's order.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from lociq.sources import bgzf

#: Bytes of a file in a task.
SPLIT = 32 << 20
BATCH = 2_000
LINES = "line bigint, chrom string, pos bigint, value string"
RECORDS = "line bigint, chrom string, pos bigint, ref string, alt string, ac int, an int, af double, gt array<int>"


def plain(name: str) -> str:
    return re.sub("^chr", "", name)


def kind_of(path: str) -> str:
    """bcf, blocks (block-compressed VCF), or text for anything that Spark's text source should read."""
    if any(c in path for c in "*?[{,"):
        return "text"
    try:
        binary, compressed = bgzf.files_of(path, (".bcf",)), bgzf.files_of(path, (".vcf.gz", ".vcf.bgz"))
        if binary and all(f.endswith(".bcf") for f in binary):
            return "bcf"
        return "blocks" if compressed and all(f.endswith((".gz", ".bgz")) and bgzf.is_bgzf(f) for f in compressed) else "text"
    except (pa.ArrowInvalid, FileNotFoundError):  # a store that only Spark knows
        return "text"


@dataclass
class Range(InputPartition):
    number: int
    path: str
    begin: int
    skip: int | None
    end: int
    end_skip: int | None


def ranges(path: str, split: int, chrom: str | None, start: int | None, end: int | None, contigs: list[str] | None = None) -> list[tuple]:
    """(path, begin, skip, end, end_skip) of a file's parts that may hold a region; see ``bgzf.lines``."""
    index = bgzf.read_index(path) if chrom is not None else None
    size = bgzf.size_of(path)
    if index is None:
        cuts = [*range(0, size, split), size] if contigs is None else [0, size]
        return [(path, a, 0 if a == 0 else None, b, None) for a, b in zip(cuts, cuts[1:], strict=False)]
    names = index.names if contigs is None else contigs
    out = []
    for ref in (k for k, n in enumerate(names) if plain(n) == plain(chrom)):
        for a, b in index.chunks(ref, max((start or 1) - 1, 0), end):
            first, last = a >> 16, b >> 16
            cuts = [first, *(range(first + split, last, split) if contigs is None else ()), last]
            for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                out.append((path, x, a & 0xFFFF if k == 0 else None, y, b & 0xFFFF if k == len(cuts) - 2 else None))
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.chrom = options.get("chrom")
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start", "end"))

    def pushFilters(self, filters):  # noqa: N802  name given by Spark
        """Conditions narrow the region that is read; Spark checks them again, row by row."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column == "chrom" and isinstance(f, EqualTo):
                self.chrom = f.value
            elif column == "pos" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start or 1, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    most = f.value - isinstance(f, LessThan)
                    self.end = most if self.end is None else min(self.end, most)
            yield f

    def _inside(self, chrom: str, pos: int) -> bool:
        return (self.chrom is None or plain(chrom) == plain(self.chrom)) and (self.start is None or pos >= self.start) and (self.end is None or pos <= self.end)


class LinesReader(_Reader):
    def partitions(self) -> list[Range]:
        found = [r for path in bgzf.files_of(self.path, (".vcf.gz", ".vcf.bgz")) for r in ranges(path, self.split, self.chrom, self.start, self.end)]
        return [Range(k, *r) for k, r in enumerate(found)] or [Range(0, "", 0, 0, 0, 0)]

    def lines(self, part: Range, source: bgzf.Blocks) -> Iterator[tuple[str, int, bytes]]:
        for line in bgzf.lines(source, part.begin, part.skip, part.end, part.end_skip):
            if not line or line.startswith(b"#"):
                continue
            chrom, pos, _ = line.split(b"\t", 2)
            chrom, pos = plain(chrom.decode()), int(pos)
            if self._inside(chrom, pos):
                yield chrom, pos, line.rstrip(b"\r")

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        n, held = part.number << 33, []
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
        with bgzf.Blocks(part.path) as source:
            for chrom, pos, line in self.lines(part, source):
                held.append((n, chrom, pos, line.decode()))
                n += 1
                if len(held) == BATCH:
                    yield _batch(held, kinds, LINES)
                    held = []
        if held:
            yield _batch(held, kinds, LINES)


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class VcfBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf_blocks"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(dict(self.options))


# ---- BCF

_SIZE = {1: 1, 2: 2, 3: 4, 5: 4, 7: 1}
_INT = {1: ("b", -128, -127), 2: ("h", -32768, -32767), 3: ("i", -(1 << 31), 1 - (1 << 31))}
_MISSING_FLOAT, _END_FLOAT = 0x7F800001, 0x7F800002


def _described(data: bytes, at: int) -> tuple[int, int, int]:
    """(number of values, type, place of the values) of a typed value."""
    head = data[at]
    n, kind, at = head >> 4, head & 15, at + 1
    if n == 15:
        (n,), at = _ints(data, at)
    return n, kind, at


def _ints(data: bytes, at: int) -> tuple[list[int], int]:
    n, kind, at = _described(data, at)
    if kind == 0:
        return [], at
    return list(struct.unpack_from(f"<{n}{_INT[kind][0]}", data, at)), at + n * _SIZE[kind]


def _value(data: bytes, at: int) -> tuple[list | str | None, int]:
    """Values without missing ones and ends; a text as such."""
    n, kind, at = _described(data, at)
    stop = at + n * _SIZE.get(kind, 0)
    if kind in _INT:
        form, missing, end = _INT[kind]
        return [None if v == missing else v for v in struct.unpack_from(f"<{n}{form}", data, at) if v != end], stop
    if kind == 5:
        bits, values = struct.unpack_from(f"<{n}I", data, at), struct.unpack_from(f"<{n}f", data, at)
        return [None if b == _MISSING_FLOAT else v for b, v in zip(bits, values, strict=True) if b != _END_FLOAT], stop
    return (data[at:stop].decode() if kind == 7 else None), stop


def bcf_header(text: str) -> tuple[list[str], list[str]]:
    """Contigs and the dictionary of FILTER, INFO and FORMAT names, by number."""
    contigs, names = {}, {0: "PASS"}
    for line in text.split("\n"):
        m = re.match(r"##(contig|FILTER|INFO|FORMAT)=<(?:.*?,)?ID=([^,>]+)", line)
        if not m:
            continue
        table = contigs if m[1] == "contig" else names
        if m[2] in table.values():
            continue
        given = re.search(r"[,<]IDX=(\d+)", line)
        table[int(given[1]) if given else (max(table) + 1 if table else 0)] = m[2]
    most = lambda t: max(t) + 1 if t else 0
    return [contigs.get(k, "") for k in range(most(contigs))], [names.get(k, "") for k in range(most(names))]


def bcf_record(shared: bytes, each: bytes, contigs: list[str], names: list[str]) -> tuple:
    """(chrom, pos, ref, alt, ac, an, af, gt) of one record; gt as VCF text would give it."""
    chrom, pos, _, _, alleles_info, samples = struct.unpack_from("<iiifII", shared)
    n_allele, n_info, n_format, n_sample = alleles_info >> 16, alleles_info & 0xFFFF, samples >> 24, samples & 0xFFFFFF
    _, at = _value(shared, 24)
    alleles = []
    for _ in range(n_allele):
        a, at = _value(shared, at)
        alleles.append(a or "")
    _, at = _value(shared, at)
    info = {}
    for _ in range(n_info):
        (key,), at = _ints(shared, at)
        value, at = _value(shared, at)
        info[names[key]] = value[0] if isinstance(value, list) and value else value
    gt, at = None, 0
    for _ in range(n_format):
        (key,), at = _ints(each, at)
        n, kind, at = _described(each, at)
        stop = at + n_sample * n * _SIZE.get(kind, 0)
        if names[key] == "GT" and kind in _INT:
            form, _, end = _INT[kind]
            gt = [(v >> 1) - 1 for v in struct.unpack_from(f"<{n_sample * n}{form}", each, at) if v != end]
        at = stop
    number = lambda k, t: t(info[k]) if isinstance(info.get(k), (int, float)) else None
    return plain(contigs[chrom]), pos + 1, alleles[0], ",".join(alleles[1:]) or ".", number("AC", int), number("AN", int), number("AF", float), gt


class BcfReader(_Reader):
    @staticmethod
    def header(path: str) -> tuple[list[str], list[str], int]:
        """Contigs, names, and the virtual offset of the first record."""
        with bgzf.Blocks(path) as source:
            data, places = b"", []
            for place, _, more in source.blocks(0):
                places.append((len(data), place))
                data += more
                if len(data) >= 9 and data[:3] != b"BCF":
                    raise ValueError(f"no BCF: {path}")
                if len(data) >= 9 and len(data) >= (n := struct.unpack_from("<I", data, 5)[0] + 9):
                    offset, place = next(p for p in reversed(places) if p[0] <= n)
                    return *bcf_header(data[9:n].rstrip(b"\0").decode()), place << 16 | (n - offset)
        raise ValueError(f"no whole header: {path}")

    def partitions(self) -> list[Range]:
        found = []
        for path in bgzf.files_of(self.path, (".bcf",)):
            contigs, _, first = self.header(path)
            for r in ranges(path, self.split, self.chrom, self.start, self.end, contigs):
                found.append((path, first >> 16, first & 0xFFFF, r[3], None) if r[1] == 0 else r)
        return [Range(k, *r) for k, r in enumerate(found)] or [Range(0, "", 0, 0, 0, 0)]

    def records(self, part: Range, source: bgzf.Blocks) -> Iterator[tuple]:
        contigs, names, _ = self.header(part.path)
        data, stop = b"", None if part.end_skip is None else part.end << 16 | part.end_skip
        places: list[tuple[int, int]] = []  # where the blocks begin, in ``data`` and in the file
        for place, _, more in source.blocks(part.begin):
            skip = part.skip if place == part.begin else 0
            places.append((len(data) - skip, place))
            data += more[skip:]
            at = block = 0
            while len(data) - at >= 8:
                while block + 1 < len(places) and places[block + 1][0] <= at:
                    block += 1
                if stop is not None and places[block][1] << 16 | (at - places[block][0]) >= stop:
                    return
                a, b = struct.unpack_from("<II", data, at)
                if len(data) - at < 8 + a + b:
                    break
                record = bcf_record(data[at + 8 : at + 8 + a], data[at + 8 + a : at + 8 + a + b], contigs, names)
                at += 8 + a + b
                if self._inside(record[0], record[1]):
                    yield record
            data = data[at:]
            places = [(offset - at, p) for offset, p in places[block:]]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        n, held = part.number << 33, []
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32()))
        with bgzf.Blocks(part.path) as source:
            for record in self.records(part, source):
                held.append((n, *record))
                n += 1
                if len(held) == BATCH:
                    yield _batch(held, kinds, RECORDS)
                    held = []
        if held:
            yield _batch(held, kinds, RECORDS)


class Bcf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return BcfReader(dict(self.options))


def load(spark: SparkSession, kind: type[DataSource], path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, split: int = SPLIT) -> DataFrame:
    """Records of a path, of a region if one is given; filters on the result narrow what is read."""
    spark.dataSource.register(kind)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"split": split, "chrom": chrom, "start": start, "end": end}
    return spark.read.format(kind.name()).options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)


# ---- sinks

_INFO = (("AC", "A", "Integer"), ("AF", "A", "Float"), ("AN", "1", "Integer"))


def header(contigs: dict[str, int], samples: int) -> str:
    lines = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed",IDX=0>', *(f"##contig=<ID={name},length={n},IDX={k}>" for k, (name, n) in enumerate(contigs.items()))]
    lines += [f'##INFO=<ID={name},Number={n},Type={kind},Description="{name}",IDX={k + 1}>' for k, (name, n, kind) in enumerate(_INFO)]
    lines += [f'##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype",IDX={len(_INFO) + 1}>']
    return "\n".join(lines) + "\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{k}" for k in range(samples)) + "\n"


def vcf_line(chrom: str, pos: int, ref: str, alt: str, ac: int | None, an: int | None, af: float | None, gt: list[int]) -> bytes:
    info = ";".join(f"{k}={v}" for k, v in (("AC", ac), ("AF", None if af is None else repr(af)), ("AN", an)) if v is not None) or "."
    name = lambda a: "." if a < 0 else str(a)
    calls = "\t".join(f"{name(x)}|{name(y)}" for x, y in zip(gt[::2], gt[1::2], strict=True))
    return f"{chrom}\t{pos}\t.\t{ref}\t{alt}\t.\tPASS\t{info}\tGT\t{calls}\n".encode()


def _typed_ints(values: list[int]) -> bytes:
    kind = next(k for k, (_, _, least) in _INT.items() if k == 3 or (min(values, default=0) > least + 7 and max(values, default=0) <= -least))
    return _head(len(values), kind) + struct.pack(f"<{len(values)}{_INT[kind][0]}", *values)


def _head(n: int, kind: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + _typed_ints([n])


def _typed_text(text: str) -> bytes:
    return _head(len(text.encode()), 7) + text.encode()


def bcf_bytes(contig: int, pos: int, ref: str, alt: str, ac: int | None, an: int | None, af: float | None, gt: list[int]) -> bytes:
    alleles = [ref, *([] if alt == "." else alt.split(","))]
    info = [_typed_ints([k + 1]) + (_head(1, 5) + struct.pack("<f", v) if name == "AF" else _typed_ints([v])) for k, (name, v) in enumerate((("AC", ac), ("AF", af), ("AN", an))) if v is not None]
    shared = struct.pack("<iii", contig, pos - 1, len(ref)) + struct.pack("<I", _MISSING_FLOAT) + struct.pack("<II", len(alleles) << 16 | len(info), 1 << 24 | len(gt) // 2)
    shared += _typed_text("") + b"".join(map(_typed_text, alleles)) + _typed_ints([0]) + b"".join(info)
    codes = [(a + 1) << 1 | (k & 1) for k, a in enumerate(gt)]
    kind = 1 if max(codes, default=0) < 120 else 2 if max(codes) < 32_000 else 3
    each = _typed_ints([len(_INFO) + 1]) + _head(2, kind) + struct.pack(f"<{len(codes)}{_INT[kind][0]}", *codes)
    return struct.pack("<II", len(shared), len(each)) + shared + each


def write(df: DataFrame, folder: str, contigs: dict[str, int], binary: bool = False) -> DataFrame:
    """Records (chrom, pos, ref, alt, ac, an, af, gt) as sorted files with an index each; the files and their numbers of records.

    A task writes the records of a range of (chrom, pos): part-*.vcf.gz and .tbi, or part-*.bcf
    and .csi.  Files appear under their names when they are whole.  All records need as many
    alleles (two a sample); -1 is a missing one.
    """
    fs, inner = bgzf.file_system(folder)
    fs.create_dir(inner, recursive=True)
    fs.delete_dir_contents(inner)
    numbers = {name: k for k, name in enumerate(contigs)}
    rows = df.select(F.col("chrom").cast("string"), F.col("pos").cast("bigint"), "ref", "alt", F.col("ac").cast("int"), F.col("an").cast("int"), F.col("af").cast("double"), F.col("gt").cast("array<int>"))
    ending = "bcf" if binary else "vcf.gz"

    def run(batches):
        fs, inner = bgzf.file_system(folder)
        name = f"{inner}/part-{TaskContext.get().partitionId():05d}.{ending}"
        draft = f"{inner}/.{uuid.uuid4().hex}"
        index, n, out, stream = bgzf.IndexBuilder(), 0, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    stream = fs.open_output_stream(draft)
                    out = bgzf.Writer(stream)
                    head = header(contigs, len(row[7]) // 2)
                    out.write(b"BCF\x02\x02" + struct.pack("<I", len(head) + 1) + head.encode() + b"\0" if binary else head.encode())
                start = out.tell()
                out.write(bcf_bytes(numbers[row[0]], *row[1:]) if binary else vcf_line(*row))
                index.add(row[0], row[1] - 1, row[1] - 1 + len(row[2]), start, out.tell())
                n += 1
        if out is None:
            return
        out.close()
        stream.close()
        with fs.open_output_stream(f"{draft}.index") as s:
            w = bgzf.Writer(s)
            w.write(index.csi(list(contigs)) if binary else index.tabix())
            w.close()
        fs.move(f"{draft}.index", f"{name}.{'csi' if binary else 'tbi'}")
        fs.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    made = rows.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").mapInArrow(run, "file string, records bigint")
    spark = df.sparkSession
    return spark.createDataFrame(made.collect(), "file string, records bigint")  # a row a task
