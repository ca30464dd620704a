"""PDF files as a data source: words with their boxes are read, redacted files are written.

    spark.dataSource.register(PdfSource)
    words = spark.read.format("pdf").load(folder)
    redact_files(spark, folder, target, lambda pages: find_spans(pages, patterns, key="place"))

A partition of a read is a group of files of about `partitionBytes` (a three-hundredth of all, between 1 and 64 MB, if none
is given), and a file is one task's. The driver keeps the first and last names of each group; tasks list folders. Words are placed in their page's text where the file is read, so nothing is exchanged
but spans and boxes: files with spans are read again where boxes are made of them. Files are written to a staging folder by each
attempt and moved when the job commits, so a lost executor leaves nothing and a repeated task replaces nothing.
The option rows says what is read: words, placed words (with start_char and end_char in the text of their page, where a word
follows a space or, on a new line, a newline), pages (path, page, text), or files (path, and part, the number of their group; nothing is opened). The option columns
names some of these, with spaces between them; file is the path's last part, which is shorter where there is a row a word.

Cases: empty folders, files and pages give no rows; a file that can't be read gives none, or, with the option
mode=failfast, an error, as does then a file without words.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sablespan.shared import stored
from sablespan.sources import pdf

WORDS = "path string, page int, word_no int, line int, text string, x0 double, y0 double, x1 double, y1 double"
ROWS = {"words": WORDS, "placed": f"{WORDS}, start_char int, end_char int", "pages": "path string, page int, text string", "files": "path string, part int"}


def columns(options: dict[str, str]) -> str:
    """The columns that options ask for, with their types."""
    rows = ROWS[options.get("rows", "words")]
    known = {c.split()[0]: c for c in [*rows.split(", "), "file string"]}
    return ", ".join(known[c] for c in options["columns"].split()) if "columns" in options else rows


#: Characters of pages that are laid out together.
CHARS = 1 << 18
#: Bytes of files that one task reads at least.
LEAST = 1 << 20
#: Bytes of files that are handed on together.
TOGETHER = 4 << 20


def _located(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, the path there, and what stands before it in Spark's form of it."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        place = "/" + (rest if colon else path).lstrip("/")
        return pafs.LocalFileSystem(), place.rstrip("/"), "file:"
    system, place = pafs.FileSystem.from_uri(path)
    return system, place.rstrip("/"), path.rstrip("/").removesuffix(place.rstrip("/"))


def _content(path: str) -> bytes:
    system, place, _ = _located(path)
    with open(place, "rb") if isinstance(system, pafs.LocalFileSystem) else system.open_input_stream(place) as f:
        return f.read()


def _listed(folder: str, first: str = "", last: str = chr(0x10FFFF)) -> tuple[list[tuple[str, int]], list[str]]:
    """The PDF files of a folder with their sizes, and its folders, both by name, from a name to another; names that begin with a dot or an
    underscore are left out."""
    system, place, _ = _located(folder)
    shown = lambda name: name[0] not in "._" and first <= name <= last
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(place) as entries:
            found = [(e.name, None if e.is_dir() else e.stat().st_size if e.is_file() else -1) for e in entries if shown(e.name) and (_is_pdf(e.name) or e.is_dir())]
    else:
        sizes = {pafs.FileType.Directory: lambda i: None, pafs.FileType.File: lambda i: i.size}
        found = [(i.base_name, sizes.get(i.type, lambda i: -1)(i)) for i in system.get_file_info(pafs.FileSelector(place)) if shown(i.base_name)]
    return sorted((name, size) for name, size in found if size is not None and size >= 0 and _is_pdf(name)), sorted(name for name, size in found if size is None)


def _is_pdf(name: str) -> bool:
    return name.lower().endswith(".pdf")


def _pieces(root: str, most: int) -> Iterator[tuple[int, list[tuple[str, str, str]]]]:
    """Bytes and ranges (a folder, its first file and its last) of groups of files of about most bytes. One folder's names are
    held at a time."""
    held: list[tuple[str, str, str]] = []
    bytes_held, todo = 0, [root]
    while todo:
        folder = todo.pop()
        files, folders = _listed(folder)
        for name, size in files:
            if held and bytes_held + size > most:
                yield bytes_held, held
                held, bytes_held = [], 0
            if held and held[-1][0] == folder:
                held[-1] = (folder, held[-1][1], name)
            else:
                held.append((folder, name, name))
            bytes_held += size
        todo += [f"{folder}/{name}" for name in reversed(folders)]
    if held:
        yield bytes_held, held


@dataclass
class Group(InputPartition):
    """Files that one task reads: its number, and ranges of files, whose names are listed where they are read."""

    number: int
    ranges: tuple[tuple[str, str, str], ...]

    def paths(self) -> Iterator[str]:
        for folder, first, last in self.ranges:
            names = [first] if first == last else [n for n, _ in _listed(folder, first, last)[0]]
            yield from (f"{folder}/{n}" for n in names)


class PdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.most = int(options.get("partitionbytes", 0))
        self.rows = options.get("rows", "words")
        self.columns = [c.split()[0] for c in columns(options).split(", ")]
        self.strict = options.get("mode", "permissive").lower() == "failfast"

    def partitions(self) -> list[Group]:
        """Groups are ranges of names, so the driver's memory grows with the groups and folders, not with the files."""
        system, place, before = _located(self.path)
        kind = system.get_file_info(place).type
        if kind == pafs.FileType.File and _is_pdf(place):
            folder, _, name = f"{before}{place}".rpartition("/")
            return [Group(0, ((folder, name, name),))]
        pieces = list(_pieces(f"{before}{place}", self.most or LEAST)) if kind == pafs.FileType.Directory else []
        most = self.most or min(max(sum(size for size, _ in pieces) // 300, LEAST), 64 << 20)
        groups: list[list[tuple[str, str, str]]] = []
        held = most
        for size, ranges in pieces:
            if held + size > most:
                groups.append([])
                held = 0
            own = groups[-1]
            if own and own[-1][0] == ranges[0][0]:
                own[-1] = (own[-1][0], own[-1][1], ranges[0][2])
                ranges = ranges[1:]
            own += ranges
            held += size
        return [Group(i, tuple(g)) for i, g in enumerate(groups)] or [Group(0, ())]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        if self.rows == "files":
            paths = list(partition.paths())
            yield self._named({"path": lambda: pa.array(paths, pa.string()), "file": lambda: pa.array(map(_last, paths), pa.string()), "part": lambda: np.full(len(paths), partition.number, np.int32)})
            return
        held: list[tuple[str, int, pdf.Laid | list[pdf.Piece]]] = []
        chars = 0
        for path in partition.paths():
            any_word = False
            try:
                for number, found in placed_pages(pdf.File(_content(path))):
                    if isinstance(found, list):
                        chars += sum(len(p.codes) for p in found)
                        any_word = any_word or any(p.codes.strip(b" ") for p in found)
                    else:
                        chars += len(found.text)
                        any_word = True
                    held.append((path, number, found))
                    if chars >= CHARS:
                        yield from self._batches(held)
                        held, chars = [], 0
            except Exception as e:
                if self.strict:
                    raise ValueError(f"can't read {path}: {e}") from e
            if self.strict and not any_word:
                raise ValueError(f"{path} has no words")
        yield from self._batches(held)

    def _batches(self, held: list[tuple[str, int, pdf.Laid | list[pdf.Piece]]]) -> Iterator[pa.RecordBatch]:
        """Batches of pages: plain ones are laid out together, others, which stand alone, as they are."""
        at = 0
        while at < len(held):
            end = at + 1
            while isinstance(held[at][2], list) and end < len(held) and isinstance(held[end][2], list):
                end += 1
            some = held[at:end]
            laid = pdf.lay([f for *_, f in some]) if isinstance(some[0][2], list) else some[0][2]
            if len(laid.page):
                yield self._batch([h[0] for h in some], np.array([h[1] for h in some], np.int32), laid)
            at = end

    def _batch(self, paths: list[str], numbers: np.ndarray, laid: pdf.Laid) -> pa.RecordBatch:
        if self.rows == "pages":
            own, texts = page_texts(laid)
            more = {"page": lambda: numbers[own], "text": lambda: texts}
        else:
            own, first = laid.page, np.searchsorted(laid.page, laid.page)
            more = {"page": lambda: numbers[own], "word_no": lambda: (np.arange(len(first)) - first + 1).astype(np.int32), "line": lambda: laid.line, "text": lambda: _strings(laid.starts, laid.text)}
            more |= {name: lambda k=k: laid.boxes[k] for k, name in enumerate(("x0", "y0", "x1", "y1"))}
            more |= {name: lambda k=k: places(laid)[k].astype(np.int32) for k, name in enumerate(("start_char", "end_char"))}
        return self._named({"path": lambda: pa.array(paths).take(pa.array(own)), "file": lambda: pa.array(list(map(_last, paths))).take(pa.array(own))} | more)

    def _named(self, made: dict[str, Callable[[], Any]]) -> pa.RecordBatch:
        """A batch of the columns that are asked for; no other is made."""
        arrays = [made[c]() for c in self.columns]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in arrays], names=self.columns)


def _last(path: str) -> str:
    return path.rpartition("/")[2]


def _strings(starts: np.ndarray, text: bytes) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())


def placed_pages(file: pdf.File) -> Iterator[tuple[int, pdf.Laid | list[pdf.Piece]]]:
    """Number, from 1, and the plain pieces of each page, or its words where it isn't plain; pages that show nothing are left out."""
    for number, page in enumerate(file.pages(), 1):
        content = file.content(page)
        plain = pdf.simple_pieces(content, file.fonts(page), *file.size(page))
        if plain is None:
            shown = list(file.shown(page, content))
            plain = pdf.plain_pieces(shown)
        if plain:
            yield number, plain
        elif plain is None and (words := pdf.single_words(shown)):
            yield number, pdf.laid(words)


def places(laid: pdf.Laid) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in the text of its page, by characters."""
    first = np.searchsorted(laid.page, laid.page)
    upto = np.cumsum(laid.sizes + 1)
    end = upto - np.r_[0, upto][first] - 1
    return end - laid.sizes, end


def page_texts(laid: pdf.Laid) -> tuple[np.ndarray, pa.Array]:
    """The pages that have words, and their texts."""
    new = np.diff(laid.page, prepend=-1) != 0
    gap = np.where(new, b"", np.where(np.diff(laid.line, prepend=-1) != 0, b"\n", b" "))
    sizes = laid.sizes_of_bytes() + (~new)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]), np.uint8)
    from_text = np.ones(len(out), bool)
    signs = (ends - sizes)[~new]
    from_text[signs] = False
    out[from_text] = np.frombuffer(laid.text, np.uint8)
    out[signs] = np.frombuffer(b"".join(gap[~new].tolist()), np.uint8)
    return laid.page[new], _strings(np.r_[(ends - sizes)[new], ends[-1]], out.tobytes())


@dataclass
class Moved(WriterCommitMessage):
    """A task's folder in the staging folder; empty if it wrote nothing."""

    folder: str


def _merge(system: pafs.FileSystem, source: str, target: str) -> None:
    """Move what is in a folder to another: folders that aren't there yet as a whole, else file by file."""
    there = {i.path for i in system.get_file_info(pafs.FileSelector(target)) if i.type == pafs.FileType.Directory}
    for info in system.get_file_info(pafs.FileSelector(source)):
        to = f"{target}/{info.base_name}"
        if info.type == pafs.FileType.Directory and to in there:
            _merge(system, info.path, to)
        else:
            system.move(info.path, to)


class PdfWriter(DataSourceArrowWriter):
    """Writes rows of name and content as files, with the option parts in a folder of each task's own, which is moved as a whole."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.parts = options.get("parts", "false").lower() == "true"

    def _staging(self) -> tuple[pafs.FileSystem, str, str]:
        system, place, _ = _located(self.path)
        return system, place, f"{place}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moved:
        system, _, staging = self._staging()
        folder, made = f"{staging}/{uuid.uuid4().hex}", set()
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"a file can't be named {name}")
                at = f"{folder}/{name}"
                if (above := at.rpartition("/")[0]) not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with open(at, "wb") if isinstance(system, pafs.LocalFileSystem) else system.open_output_stream(at) as f:
                    f.write(content)
        return Moved(folder if made else "")

    def commit(self, messages: list[Moved | None]) -> None:
        system, place, staging = self._staging()
        system.create_dir(place, recursive=True)
        if self.overwrite:
            for info in system.get_file_info(pafs.FileSelector(place)):
                if info.path.rpartition("/")[2][:1] not in "._":
                    (system.delete_dir if info.type == pafs.FileType.Directory else system.delete_file)(info.path)
        for folder in [m.folder for m in messages if m and m.folder]:
            if self.parts:
                system.move(folder, f"{place}/part-{folder.rpartition('/')[2]}")
            else:
                _merge(system, folder, place)
        self.abort(messages)

    def abort(self, messages: list[Moved | None]) -> None:
        system, _, staging = self._staging()
        if system.get_file_info(staging).type == pafs.FileType.Directory:
            system.delete_dir(staging)


class PdfSource(DataSource):
    """format("pdf"): reads WORDS; writes files from the columns name and content."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return columns(self.options)

    def reader(self, schema: Any) -> PdfReader:
        return PdfReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> PdfWriter:
        return PdfWriter(self.options, overwrite)


def read_words(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    spark.dataSource.register(PdfSource)
    return spark.read.format("pdf").options(**options).load(path)


def write_files(files: DataFrame, path: str, mode: str = "append", parts: bool = False) -> None:
    """Files from name (which may have folders) and content; of millions, parts spares the driver the move of each."""
    files.sparkSession.dataSource.register(PdfSource)
    files.select("name", "content").write.format("pdf").option("parts", parts).mode(mode).save(path)


def _by_file(rows: DataFrame, of: list[str]) -> DataFrame:
    """path and a list of rows' columns, for each file that has rows."""
    return rows.groupBy("path").agg(F.collect_set(F.struct(*of)).alias("own"))


BOXES = "path string, page int, entity_type string, start_char int, end_char int, line int, n_words bigint, x0 double, y0 double, x1 double, y1 double"


def span_boxes(spark: SparkSession, path: str, spans: DataFrame) -> DataFrame:
    """A box for each line that a span (place, entity_type, start_char, end_char) touches, of the whole words there:
    path, page, entity_type, start_char, end_char, line, n_words and the box. Files with spans are read again."""
    flat = spans.select("place.path", "place.page", "entity_type", F.col("start_char").cast("int"), F.col("end_char").cast("int"))
    # Over as many tasks as read the folder: the rows say nothing of what reading a file costs.
    per = _by_file(flat.repartition(len(PdfReader({"path": path}).partitions()), "path"), ["page", "entity_type", "start_char", "end_char"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 3, pa.int64(), *[pa.float64()] * 4]
        for batch in batches:
            for path, own in zip(batch.column("path").to_pylist(), batch.column("own").to_pylist(), strict=True):
                by_page: dict[int, list[dict]] = {}
                for s in own:
                    by_page.setdefault(s["page"], []).append(s)
                rows = []
                for number, found in placed_pages(pdf.File(_content(path))):
                    if number not in by_page:
                        continue
                    laid = pdf.lay([found]) if isinstance(found, list) else found
                    begin, end = places(laid)
                    for s in by_page[number]:
                        a, b = int(np.searchsorted(end, s["start_char"], "right")), int(np.searchsorted(begin, s["end_char"]))
                        cuts = np.flatnonzero(np.diff(laid.line[a:b])) + 1 + a
                        for i, j in zip([a, *cuts.tolist()], [*cuts.tolist(), b]) if a < b else ():
                            (x0, y0), (x1, y1) = laid.boxes[:2, i:j].min(axis=1), laid.boxes[2:, i:j].max(axis=1)
                            rows.append((path, number, s["entity_type"], s["start_char"], s["end_char"], int(laid.line[i]), j - i, x0, y0, x1, y1))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=[c.split()[0] for c in BOXES.split(", ")])

    return per.mapInArrow(work, BOXES)


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes with occurrence, their number within file and type by page, then from top to bottom and left to right."""
    order = Window.partitionBy("path", "entity_type").orderBy("page", "y0", "x0", "start_char")
    return boxes.withColumn("occurrence", F.row_number().over(order))


def redacted_files(spark: SparkSession, root: str, boxes: DataFrame) -> DataFrame:
    """name and content of all files of a folder, without what stands in boxes (path, page and edges).

    Only paths and boxes are shuffled; a file is read where it is rewritten, and those of a group by one task, so that their folders are
    dealt to few. A file that can't be rewritten is an error: leaving it out, or as it is, would be worse.
    """
    _, place, before = _located(root)
    start = len(f"{before}{place}/")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, made = [], []
        full = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.binary())], names=["name", "content"])
        for batch in batches:
            for path, boxes in zip(batch.column("path").to_pylist(), batch.column("own").to_pylist(), strict=True):
                by_page: dict[int, list[pdf.Box]] = {}
                for b in boxes or ():
                    by_page.setdefault(b["page"], []).append((b["x0"], b["y0"], b["x1"], b["y1"]))
                names.append(path[start:])
                made.append(pdf.without(_content(path), by_page))
                if sum(map(len, made)) >= TOGETHER or len(made) >= 64:
                    yield full()
                    names, made = [], []
        if made:
            yield full()

    files = read_words(spark, root, rows="files")
    rows = files.join(_by_file(boxes, ["page", "x0", "y0", "x1", "y1"]), "path", "left")
    return rows.repartitionById(len(PdfReader({"path": root}).partitions()), F.col("part")).select("path", "own").mapInArrow(work, "name string, content binary")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row a page: place (path and page) and text."""
    return read_words(spark, path, rows="pages").select(F.struct("path", "page").alias("place"), "text")


def redact_files(spark: SparkSession, source: str, target: str, detect: Callable[[DataFrame], DataFrame], mode: str = "append", parts: bool = False) -> DataFrame:
    """Write the PDF files of a folder to another, without what detect finds; returns the boxes.

    detect takes pages (place, text) and gives spans (place, entity_type, start_char, end_char). Files keep their names, with parts
    below a folder of each task's own.
    """
    spans = stored(detect(read_pages(spark, source)).select("place", "entity_type", "start_char", "end_char"), "spans")
    boxes = stored(span_boxes(spark, source, spans), "boxes")
    write_files(redacted_files(spark, source, boxes), target, mode, parts)
    return boxes
