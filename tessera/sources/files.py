"""A data source of the files of a workspace: ``spark.read.format("workspace_files")``.

Unlike Spark's own listing it sees names that begin with ``.`` or ``_``, and it reads ignore
files on its way down. ``.ignore`` wins over ``.gitignore`` at any depth, and that over
``.git/info/exclude`` of the root; of files of one name the deeper one wins, in a file the last
pattern that matches; ``!`` takes a path back, but nothing brings back what lies in an ignored
folder, as it is not entered. ``.git`` itself is never entered, links are not followed, and
ignore files above the root are not read. Include and exclude patterns come before all ignore
files: with includes, only files that one of them matches are taken, even if they are ignored.

The driver lists folders from the root down until there are as many subtrees as the option
``subtrees`` says, and no more; each is a partition, which carries the ignore rules that hold
there and is walked by its task. A folder that is one huge level is one task's.

Rows: path (relative), size_bytes, modified_at, content, error. Files that are larger than
``mostBytes``, have a NUL in their first 8 KiB or are no UTF-8 give no row; those that can't be
read give one with their error.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PROBE = 8192
#: The files that rules are read from, by precedence.
IGNORE_FILES = (".ignore", ".gitignore", ".git/info/exclude")
SCHEMA = "path string, size_bytes long, modified_at timestamp, content string, error string"
ARROW = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("content", pa.string()), ("error", pa.string())])


def glob_regex(glob: str) -> str:
    """A path pattern as a regular expression: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out, i = "", 0
    while i < len(glob):
        rest, c = glob[i:], glob[i]
        if rest.startswith("**/") and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + len(re.match(r"\*+", rest)[0])
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.match(r"\[([!^]?)(\]?[^]]*)\]", rest)):
            inside = m[2].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{inside}]", i + len(m[0])
        else:
            i += c == "\\" and i + 1 < len(glob)
            out, i = out + re.escape(glob[i]), i + 1
    return out


def rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(what it matches, whether it takes back, whether folders only) of a line of an ignore
    file; None for comments and blank lines. Without an inner slash it holds at any depth."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:]
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    anchored = "/" in line
    if not (line := line.removeprefix("/")):
        return None
    return re.compile(("" if anchored else "(?:.*/)?") + glob_regex(line) + r"\Z", re.DOTALL), back, folders


def verdict(rules: list, path: str, folder: bool) -> bool | None:
    """Whether rules ignore a path: what the last that matches says; None if none does."""
    for pattern, back, folders in reversed(rules):
        if (folder or not folders) and pattern.match(path):
            return not back
    return None


class Rules:
    """What holds in a folder: the ignore files from the root down to it, and the patterns
    that come before them."""

    def __init__(self, files: tuple[tuple[str, str, str], ...], include: list[str], exclude: list[str]) -> None:
        #: (folder, name of the file, its text), the root's first
        self.files, self.include, self.exclude = files, include, exclude
        first = [rule(p) for p in include] + [r and (r[0], not r[1], r[2]) for r in map(rule, exclude)]
        self.first = [r for r in first if r]
        self.by_kind = [[(d, [r for r in map(rule, text.split("\n")) if r]) for d, name, text in reversed(files) if name == kind] for kind in IGNORE_FILES]

    def within(self, more: list[tuple[str, str, str]]) -> Rules:
        return Rules((*self.files, *more), self.include, self.exclude) if more else self

    def ignored(self, path: str, folder: bool) -> bool:
        name = path.rsplit("/", 1)[-1]
        if name == ".git":
            return True
        if self.first:
            taken = verdict(self.first, path, folder)  # of these patterns a match takes, and ! leaves out
            if taken is not None:
                return not taken
            if self.include and not folder:
                return True
        for levels in self.by_kind:
            for base, rules in levels:
                said = verdict(rules, path[len(base) :], folder)
                if said is not None:
                    return said
        return False


@dataclass
class Subtree(InputPartition):
    folder: str
    below: bool
    files: tuple[tuple[str, str, str], ...]

    def __init__(self, folder: str, below: bool, files: tuple) -> None:
        super().__init__(folder)
        self.folder, self.below, self.files = folder, below, files


class WorkspaceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.include, self.exclude = (json.loads(options.get(k, "[]")) for k in ("include", "exclude"))
        self.most, self.subtrees = int(options.get("mostBytes", 1 << 20)), int(options.get("subtrees", 256))

    def _open(self) -> tuple[fs.FileSystem, str]:
        root = re.sub(r"^file:/*", "file:///", self.root)
        return fs.FileSystem.from_uri(root if ":" in root else f"file://{os.path.abspath(root)}")

    def _level(self, at: fs.FileSystem, base: str, folder: str, rules: Rules) -> tuple[Rules, list[str], list[fs.FileInfo]]:
        """The rules in ``folder`` (relative, with a slash behind), its subfolders, its files."""
        entries = sorted(at.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))), key=lambda e: e.path)
        there = {e.base_name for e in entries}
        found = []
        for name in IGNORE_FILES:
            if name.split("/")[0] in there and (folder == "" or "/" not in name):
                info = at.get_file_info(f"{base}/{folder}{name}")
                if info.type == fs.FileType.File:
                    with at.open_input_stream(info.path) as f:
                        found.append((folder, name, f.read().decode("utf-8", "replace")))
        rules = rules.within(found)
        local = isinstance(at, fs.LocalFileSystem)
        seen = [e for e in entries if not rules.ignored(folder + e.base_name, e.type == fs.FileType.Directory) and not (local and os.path.islink(e.path))]
        return rules, [f"{folder}{e.base_name}/" for e in seen if e.type == fs.FileType.Directory], [e for e in seen if e.type == fs.FileType.File]

    def partitions(self) -> list[Subtree]:
        at, base = self._open()
        if at.get_file_info(base).type != fs.FileType.Directory:
            raise ValueError(f"{self.root} is no folder")
        flat, todo = [], [Subtree("", True, ())]
        while todo and len(flat) + len(todo) < self.subtrees and len(flat) < self.subtrees // 2:
            top = todo.pop(0)
            try:
                rules, folders, _ = self._level(at, base, top.folder, Rules(top.files, self.include, self.exclude))
            except OSError:
                folders, rules = [], Rules(top.files, self.include, self.exclude)
            flat.append(Subtree(top.folder, False, top.files))
            todo += [Subtree(f, True, rules.files) for f in folders]
        return flat + todo

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        at, base = self._open()
        rows: list[tuple] = []
        wide, todo = 0, [(partition.folder, Rules(partition.files, self.include, self.exclude))]
        while todo:
            folder, rules = todo.pop()
            try:
                rules, folders, files = self._level(at, base, folder, rules)
            except OSError as e:
                rows.append((folder, None, None, None, str(e)[:500]))
                continue
            if partition.below:
                todo += [(f, rules) for f in reversed(folders)]
            for info in files:
                row = self._row(at, info, folder + info.base_name)
                if row:
                    rows.append(row)
                    wide += len(row[3] or "")
                if len(rows) >= 4096 or wide >= 1 << 23:
                    yield self._batch(rows)
                    rows, wide = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, at: fs.FileSystem, info: fs.FileInfo, path: str) -> tuple | None:
        if info.size > self.most:
            return None
        try:
            with at.open_input_stream(info.path) as f:
                content = f.read()
        except OSError as e:
            return path, info.size, info.mtime, None, str(e)[:500]
        if b"\0" in content[:PROBE] or len(content) > self.most:
            return None
        try:
            return path, len(content), info.mtime, content.decode(), None
        except UnicodeDecodeError:
            return None

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def written(files: DataFrame, root: str) -> DataFrame:
    """Writes each row (path, text) as a file under ``root``, by the tasks that hold them; the
    paths written. ``root`` is one that driver and executors share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", root))
        for b in batches:
            for path, text in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True):
                at.create_dir(f"{base}/{path}".rsplit("/", 1)[0])
                with at.open_output_stream(f"{base}/{path}") as f:
                    f.write(text.encode())
            yield b.select(["path"])

    return files.select("path", "text").mapInArrow(work, "path string")


class WorkspaceFiles(DataSource):
    """``spark.read.format("workspace_files")``; options: path, include and exclude (JSON
    lists), mostBytes, subtrees."""

    @classmethod
    def name(cls) -> str:
        return "workspace_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkspaceReader:  # noqa: ANN001
        return WorkspaceReader(self.options)
