"""Lines of VCF and BED files, block-compressed or plain, as a Spark data source with pushed-down regions.

`spark.read.format("genome_lines")` gives (chrom, pos, start, end, line, block): pos is 1-based, [start, end) 0-based,
block the file offset at which the block of the line begins. Filters on chrom, pos, start and end that Spark pushes down become a
region. Where a file has a tabix index beside it, only the chunks of blocks that the index names for the region are
planned; without one, a block-compressed or plain file is dealt in ranges of bytes, each of which finds its own first
block and line; other gzip files are one partition. Spark applies the filters again, so pruning only ever leaves rows out
that do not qualify. Sinks write one block-compressed file with its index a task, moved into place on commit.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

SCHEMA = "chrom string, pos long, start long, end long, line string, block long"
WRITE_SCHEMA = "chrom string, start long, end long, line string"
#: Fixed values of the published block-compression and tabix formats.
MAGIC, END_OF_FILE = b"\x1f\x8b\x08\x04", bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES, FIRST_BIN, WINDOW_BITS, MOST_POS, SUMMARY_BIN = 65_280, ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)), 14, 1 << 29, 37_450
PRESETS = {"vcf": (2, 1, 2, 0), "bed": (0x10000, 1, 2, 3)}
#: Compressed bytes of a partition.
PARTITION_BYTES = 64 << 20


def opened(path: str):
    """(file system, path in it); a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# Blocks and lines


def block_at(f, at: int) -> tuple[bytes, int] | None:
    """(data, offset of the next block) of the block at an offset; None at the file's end."""
    f.seek(at)
    head = f.read(12)
    if len(head) < 12:
        return None
    if head[:4] != MAGIC:
        raise ValueError(f"no block at offset {at}")
    extra = f.read(struct.unpack("<H", head[10:12])[0])
    size, i = None, 0
    while i + 4 <= len(extra):
        kind, length = extra[i : i + 2], struct.unpack_from("<H", extra, i + 2)[0]
        if kind == b"BC":
            size = struct.unpack_from("<H", extra, i + 4)[0] + 1
        i += 4 + length
    if size is None:
        raise ValueError(f"no block at offset {at}")
    body = f.read(size - 12 - len(extra))
    return zlib.decompress(body[:-8], -15), at + size


def first_block(f, at: int, size: int) -> int | None:
    """The offset of the first block at or after `at`: a place that reads as a block and is followed by another or the end."""
    while at < size:
        f.seek(at)
        chunk = f.read(1 << 17)
        i = chunk.find(MAGIC)
        while i >= 0:
            try:
                _, after = block_at(f, at + i)
                if after == size or block_at(f, after) is not None:
                    return at + i
            except (ValueError, TypeError, struct.error, zlib.error):
                pass
            i = chunk.find(MAGIC, i + 1)
        if len(chunk) < 1 << 17:
            return None
        at += len(chunk) - len(MAGIC) + 1
    return None


def compressed_blocks(f, at: int):
    while (found := block_at(f, at)) is not None:
        yield at, found[0]
        at = found[1]


def plain_blocks(f, at: int, size: int = 1 << 16):
    f.seek(at)
    while data := f.read(size):
        yield at, data
        at += len(data)


def whole_gzip(f):
    """Pieces of a gzip file without blocks, all at offset 0."""
    f.seek(0)
    machine = zlib.decompressobj(31)
    while raw := f.read(1 << 18):
        while raw:
            yield 0, machine.decompress(raw)
            raw = machine.unused_data if machine.eof else b""
            if machine.eof:
                machine = zlib.decompressobj(31)


def lines(blocks, skip: int, beyond):
    """((block, place in it), line) of lines whose start is not beyond; the last may run into later blocks."""
    held, held_at = b"", None
    for at, data in blocks:
        i, skip = skip, 0
        if held_at is not None:
            nl = data.find(b"\n")
            held += data if nl < 0 else data[:nl]
            if nl < 0:
                continue
            yield held_at, held
            held, held_at, i = b"", None, nl + 1
        while i < len(data):
            if beyond(at, i):
                return
            nl = data.find(b"\n", i)
            if nl < 0:
                held, held_at = data[i:], (at, i)
                break
            yield (at, i), data[i:nl]
            i = nl + 1
    if held_at is not None:
        yield held_at, held


# The tabix index


@dataclass
class Index:
    names: list[str]
    bins: list[dict[int, list[tuple[int, int]]]]
    linear: list[list[int]]

    def chunks(self, chrom: str, start: int, end: int) -> list[tuple[int, int]]:
        """Disjoint ranges of virtual offsets that hold every line of the region."""
        if chrom not in self.names:
            return []
        i = self.names.index(chrom)
        start, end = max(0, start), min(end, MOST_POS)
        if start >= end:
            return []
        windows = self.linear[i]
        least = windows[min(start >> WINDOW_BITS, len(windows) - 1)] if windows else 0
        wanted = [c for b in bins_of(start, end) for c in self.bins[i].get(b, ()) if c[1] > least]
        return merged_chunks([(max(a, least), b) for a, b in wanted])

    def everything(self) -> list[tuple[int, int]]:
        return merged_chunks([c for bins in self.bins for b, chunks in bins.items() if b != SUMMARY_BIN for c in chunks])

    def line_starts(self) -> list[int]:
        return sorted({v for windows in self.linear for v in windows if v})


def merged_chunks(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks in order, those that meet made one."""
    ends, out = 0, []
    for a, b in sorted(set(chunks)):
        if out and a <= ends:
            out[-1] = (out[-1][0], max(ends, b))
        else:
            out.append((a, b))
        ends = out[-1][1]
    return out


def bins_of(start: int, end: int) -> list[int]:
    """Numbers of all bins that overlap [start, end)."""
    return [0] + [b for shift, first in FIRST_BIN for b in range(first + (start >> shift), first + ((end - 1) >> shift) + 1)]


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    return next((first + (start >> shift) for shift, first in reversed(FIRST_BIN) if start >> shift == (end - 1) >> shift), 0)


def read_index(f) -> Index:
    data = b"".join(d for _, d in compressed_blocks(f, 0))
    if data[:4] != b"TBI\x01":
        raise ValueError("not a tabix index")
    at = 36
    n_ref, names_length = struct.unpack_from("<i", data, 4)[0], struct.unpack_from("<i", data, 32)[0]
    names = [n.decode() for n in data[at : at + names_length].split(b"\0")[:-1]]
    at += names_length
    bins, linear = [], []
    for _ in range(n_ref):
        (n_bins,), at, own = struct.unpack_from("<i", data, at), at + 4, {}
        for _ in range(n_bins):
            number, n_chunks = struct.unpack_from("<Ii", data, at)
            own[number] = [struct.unpack_from("<QQ", data, at + 8 + 16 * k) for k in range(n_chunks)]
            at += 8 + 16 * n_chunks
        (n_windows,) = struct.unpack_from("<i", data, at)
        linear.append(list(struct.unpack_from(f"<{n_windows}Q", data, at + 4)))
        at += 4 + 8 * n_windows
        bins.append(own)
    return Index(names, bins, linear)


class BlockFile:
    """A block-compressed file being written, and its index. Lines come sorted by chromosome and start."""

    def __init__(self, out):
        self.out, self.at, self.held, self.index = out, 0, bytearray(), Index([], [], [])

    def _flush(self, size: int) -> None:
        data, self.held = bytes(self.held[:size]), self.held[size:]
        machine = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = machine.compress(data) + machine.flush()
        self.out.write(MAGIC + struct.pack("<IBBHccHH", 0, 0, 255, 6, b"B", b"C", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data)))
        self.at += len(body) + 26

    def _here(self) -> int:
        while len(self.held) >= BLOCK_BYTES:
            self._flush(BLOCK_BYTES)
        return self.at << 16 | len(self.held)

    def add(self, line: str, chrom: str | None = None, start: int = 0, end: int = 0) -> None:
        """A line; header lines have no chromosome and are not indexed."""
        before = self._here()
        self.held += line.encode() + b"\n"
        if chrom is None:
            return
        after, index = self._here(), self.index
        if not index.names or index.names[-1] != chrom:
            if chrom in index.names:
                raise ValueError(f"lines of {chrom} are not together")
            index.names.append(chrom)
            index.bins.append({})
            index.linear.append([])
        end = max(end, start + 1)
        if start < 0 or end > MOST_POS:
            raise ValueError(f"the index ends at position {MOST_POS}")
        chunks, windows = index.bins[-1].setdefault(bin_of(start, end), []), index.linear[-1]
        if chunks and chunks[-1][1] == before:
            chunks[-1] = (chunks[-1][0], after)
        else:
            chunks.append((before, after))
        windows += [before] * (((end - 1) >> WINDOW_BITS) + 1 - len(windows))

    def close(self) -> None:
        while self.held:
            self._flush(min(len(self.held), BLOCK_BYTES))
        self.out.write(END_OF_FILE)
        self.out.close()

    def write_index(self, out, kind: str) -> None:
        names = b"".join(n.encode() + b"\0" for n in self.index.names)
        inner = BlockFile(out)
        inner.held += b"TBI\x01" + struct.pack("<8i", len(self.index.names), *PRESETS[kind], ord("#"), 0, len(names)) + names
        for bins, windows in zip(self.index.bins, self.index.linear):
            inner.held += struct.pack("<i", len(bins))
            for number, chunks in sorted(bins.items()):
                inner.held += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
            inner.held += struct.pack(f"<i{len(windows)}Q", len(windows), *windows)
        inner.close()


# The data source


class Piece(ds.InputPartition):
    """What a task reads: chunks of virtual offsets, a range of bytes, or a whole file."""

    def __init__(self, path, kind, chunks, size):
        super().__init__(None)
        self.path, self.kind, self.chunks, self.size = path, kind, chunks, size


class LineReader(ds.DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "vcf")
        if self.kind not in PRESETS:
            raise ValueError(f"kind is one of {sorted(PRESETS)}")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.chroms, self.start, self.end = None, 0, MOST_POS

    def pushFilters(self, filters):
        """Narrows the region; every filter is left for Spark to apply again."""
        for f in filters:
            at, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if at == ("chrom",) and isinstance(f, (ds.EqualTo, ds.In)):
                named = {value} if isinstance(f, ds.EqualTo) else set(value)
                self.chroms = named if self.chroms is None else self.chroms & named
            elif len(at) == 1 and at[0] in ("pos", "start", "end") and isinstance(value, int):
                base = value - 1 if at[0] == "pos" else value
                if at[0] != "end" and isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)):
                    self.end = min(self.end, base + (not isinstance(f, ds.LessThan)))
                if at[0] != "end" and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo)):
                    self.start = max(self.start, base + isinstance(f, ds.GreaterThan))
                if at[0] == "end" and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo)):
                    # An index keeps a zero-length interval as one of length 1.
                    self.start = max(self.start, base - (not isinstance(f, ds.GreaterThan)))
            yield f

    def files(self):
        store, path = opened(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        return store, [i for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")) and not i.path.endswith(".tbi")]

    def partitions(self):
        store, found = self.files()
        out = []
        for info in sorted(found, key=lambda i: i.path):
            with store.open_input_file(info.path) as f:
                head = f.read(18)
            if head[:4] == MAGIC and head[12:14] == b"BC":
                tabix = store.get_file_info(info.path + ".tbi")
                if tabix.type == fs.FileType.File:
                    with store.open_input_file(tabix.path) as f:
                        out += self.from_index(info, read_index(f))
                    continue
                out += self.ranges(info, "blocks")
            elif head[:2] == MAGIC[:2]:
                out.append(Piece(info.path, "gzip", (), info.size))
            else:
                out += self.ranges(info, "plain")
        return out or [Piece("", "none", (), 0)]

    def ranges(self, info, kind: str):
        step = self.partition_bytes
        return [Piece(info.path, kind, ((a, min(a + step, info.size)),), info.size) for a in range(0, info.size, step)]

    def from_index(self, info, index: Index):
        if self.chroms is None and self.start == 0 and self.end == MOST_POS:
            chunks = index.everything()
        else:
            chunks = merged_chunks([c for n in index.names if self.chroms is None or n in self.chroms for c in index.chunks(n, self.start, self.end)])
        cut, starts = [], index.line_starts()
        for a, b in chunks:
            for s in starts:
                if a < s < b and (s >> 16) - (a >> 16) >= self.partition_bytes:
                    cut.append((a, s))
                    a = s
            cut.append((a, b))
        out, now, size = [], [], 0
        for a, b in cut:
            now.append((a, b))
            size += (b >> 16) - (a >> 16)
            if size >= self.partition_bytes:
                out.append(Piece(info.path, "index", tuple(now), info.size))
                now, size = [], 0
        return out + ([Piece(info.path, "index", tuple(now), info.size)] if now else [])

    def read(self, piece: Piece):
        if piece.kind == "none":
            return
        store, _ = opened(self.path)
        with store.open_input_file(piece.path) as f:
            for (block, _), line in self.lines_of(f, piece):
                if line and not line.startswith((b"#", b"track", b"browser")):
                    chrom, start, end = place(line, self.kind)
                    yield chrom, start + 1, start, end, line.decode(), block

    def lines_of(self, f, piece: Piece):
        if piece.kind == "gzip":
            yield from lines(whole_gzip(f), 0, lambda at, i: False)
        elif piece.kind == "index":
            for a, b in piece.chunks:
                yield from lines(compressed_blocks(f, a >> 16), a & 0xFFFF, lambda at, i, b=b: at << 16 | i >= b)
        else:
            first, end = piece.chunks[0]
            at = first
            if piece.kind == "blocks":
                at = first_block(f, first, piece.size)
                # The block in which the range begins belongs to the range before; so does what it ends in.
                if at is None or at >= end:
                    return
            edge = [piece.size + 1]

            def noted():
                """Blocks with data; the first of them at or after the range's end is its edge."""
                for block, data in compressed_blocks(f, at):
                    if data:
                        edge[0] = min(edge[0], block) if block >= end else edge[0]
                        yield block, data

            # A line that starts right at the edge still belongs to the range, as the next one skips its first line.
            if piece.kind == "blocks":
                own = lines(noted(), 0, lambda block, i: block > edge[0] or (block == edge[0] and i > 0))
            else:
                own = lines(plain_blocks(f, at), 0, lambda block, i: block + i > end)
            if first:
                next(own, None)
            yield from own


def place(line: bytes, kind: str) -> tuple[str, int, int]:
    """(chromosome, 0-based start, end) of a record."""
    f = line.split(b"\t", 4)
    if kind == "bed":
        return f[0].decode(), int(f[1]), int(f[2])
    start = int(f[1]) - 1
    return f[0].decode(), start, start + len(f[3])


@dataclass
class Written(ds.WriterCommitMessage):
    attempt: str
    final: str


class LineWriter(ds.DataSourceWriter):
    def __init__(self, options):
        self.path, self.kind, self.header = options["path"], options.get("kind", "vcf"), options.get("header", "")

    def write(self, rows):
        store, path = opened(self.path)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.{self.kind}.gz"
        f = BlockFile(store.open_output_stream(f"{path}/_{name}", compression=None))
        for line in self.header.splitlines():
            f.add(line)
        for chrom, start, end, line in rows:
            f.add(line, chrom, start, end)
        f.close()
        with store.open_output_stream(f"{path}/_{name}.tbi", compression=None) as out:
            f.write_index(out, self.kind)
        return Written(f"{path}/_{name}", f"{path}/part-{name}")

    def commit(self, messages):
        store, _ = opened(self.path)
        for m in messages:
            if m is not None:
                store.move(m.attempt + ".tbi", m.final + ".tbi")
                store.move(m.attempt, m.final)


class GenomeLines(ds.DataSource):
    """options: path; kind vcf (default) or bed; partitionBytes; for a sink also header, lines ahead of each file's records."""

    @classmethod
    def name(cls):
        return "genome_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LineReader(self.options)

    def writer(self, schema, overwrite):
        return LineWriter(self.options)


def read_lines(spark: SparkSession, path: str, kind: str = "vcf", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Records of a file or folder as (chrom, pos, start, end, line, block); filters on the first four choose what is opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GenomeLines)
    return spark.read.format("genome_lines").option("kind", kind).option("partitionBytes", partition_bytes).load(path)


def write_lines(df: DataFrame, path: str, kind: str = "vcf", header: str = "", files: int | None = None) -> None:
    """df (chrom, start, end, line) as indexed block-compressed files, dealt by ranges of (chrom, start); refuses to write into a folder that has files."""
    store, at = opened(path)
    if store.get_file_info(at).type != fs.FileType.NotFound and any(not i.base_name.startswith("_") for i in store.get_file_info(fs.FileSelector(at))):
        raise FileExistsError(path)
    df.sparkSession.dataSource.register(GenomeLines)
    rows = df.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "line")
    dealt = rows.repartitionByRange(files, "chrom", "start") if files else rows.repartitionByRange("chrom", "start")
    dealt.sortWithinPartitions("chrom", "start", "end", "line").write.format("genome_lines").option("kind", kind).option("header", header).mode("append").save(path)
