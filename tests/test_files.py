"""The file source against a plain walk that applies git's rules one path at a time."""

from __future__ import annotations

import fnmatch
import random
from pathlib import Path

import pytest

from tessera.sources import workspace
from tessera.sources.files import Rules, rule


def tree(root, files):
    for path, text in files.items():
        p = Path(root, path)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def paths(spark, root, **options):
    return {r["path"] for r in workspace.scan(spark, str(root), **options).select("path").collect()}


def test_ignore_files_hidden_names_and_odd_contents(spark, tmp_path):
    tree(tmp_path, {
        ".gitignore": "ignored.txt\nbuild/\n*.log\n!keep.log\n# comment\n\n\\#odd\ntrailing \nspace\\ \n", "ignored.txt": "x", "sub/ignored.txt": "x", "visible.rs": "fn main() {}", ".hidden": "h", "_under": "u", ".config/x.toml": "t",
        "build/a": "x", "a/build": "a file of that name", "a/b.log": "x", "a/keep.log": "x", "build/keep.log": "in an ignored folder", "#odd": "x", "trailing": "x", "space ": "x",
        ".git/config": "x", "a/.git/config": "x", "a/.gitignore": "!b.log\n/only.txt\n", "a/only.txt": "x", "a/c/only.txt": "x", "a/.ignore": "*.md\n", "a/r.md": "x", "a/d/.gitignore": "!r.md\n", "a/d/r.md": ".ignore wins", ".git/info/exclude": "secret*\n!visible.rs\n",
        "secret.txt": "x", "a/secret2": "x", "binary.bin": b"\x01\x00\x02", "late.bin": b"a" * 9000 + b"\0", "latin": b"\xe9t\xe9", "empty": "", "large": "x" * 2000,
    })
    seen = paths(spark, tmp_path, most_bytes=9500, subtrees=3)
    ignore_files = {".gitignore", "a/.gitignore", "a/.ignore", "a/d/.gitignore"}
    assert seen == ignore_files | {"visible.rs", ".hidden", "_under", ".config/x.toml", "a/build", "a/b.log", "a/keep.log", "a/c/only.txt", "late.bin", "empty", "large"}
    assert paths(spark, tmp_path, most_bytes=9500, subtrees=1) == seen == paths(spark, tmp_path, most_bytes=9500)
    assert "large" not in paths(spark, tmp_path, most_bytes=1999)


def test_includes_and_excludes_come_first(spark, tmp_path):
    tree(tmp_path, {"keep.rs": "x", "skip.rs": "x", "notes.txt": "x", ".gitignore": "gone.rs\ndeep/\n", "gone.rs": "x", "deep/a.rs": "x", "in/b.rs": "x"})
    assert paths(spark, tmp_path, include=["*.rs"], exclude=["skip.rs"]) == {"keep.rs", "gone.rs", "in/b.rs"}
    assert paths(spark, tmp_path, exclude=["*.rs", "!keep.rs", "in/"]) == {"keep.rs", "notes.txt", ".gitignore"}


def test_unreadable_files_are_named(spark, tmp_path):
    tree(tmp_path, {"a": "x"})
    Path(tmp_path, "loop").symlink_to(tmp_path)
    Path(tmp_path, "dead").symlink_to(tmp_path / "nowhere")
    assert paths(spark, tmp_path) == {"a"} and workspace.failed(spark, str(tmp_path)).isEmpty()
    with pytest.raises(Exception, match="no folder"):
        paths(spark, tmp_path / "nowhere")


@pytest.mark.parametrize("pattern, path, hit", [
    ("foo", "a/foo", True), ("/foo", "a/foo", False), ("a/foo", "b/a/foo", False), ("**/foo", "foo", True), ("foo/**", "foo", False), ("foo/**", "foo/x/y", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a/*/b", "a/x/y/b", False),
    ("*.c", "x/y.c", True), ("fo?", "fo/", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[^a-c]x", "dx", True), ("[]]x", "]x", True), ("\\!a", "!a", True), ("\\*", "x", False), ("a[", "a[", True), ("x.y", "xzy", False), ("a**b", "axxb", True),
])
def test_patterns(pattern, path, hit):
    assert bool(rule(pattern)[0].match(path)) is hit


def plain_ignored(files, path):
    """Every folder above ``path``, then itself, by simple patterns (*, one name, folder/)."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        here, folder = "/".join(parts[:n]), n < len(parts)
        said = None
        for depth in range(n):
            for line in files.get("/".join([*parts[:depth], ".gitignore"]), "").split("\n"):
                bare = line.lstrip("!").rstrip("/")
                if not bare or line.endswith("/") and not folder:
                    continue
                below = "/".join(parts[depth:n])
                if fnmatch.fnmatchcase(below, bare[1:]) and "/" not in below if bare.startswith("/") else fnmatch.fnmatchcase(parts[n - 1], bare):
                    said = not line.startswith("!")
        if said:
            return True
    return False


@pytest.mark.parametrize("seed", range(4))
def test_nested_rules_against_a_plain_walk(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d.x", "e.x", ".f"]
    folders = [""] + [f"{a}/" for a in names[:3]] + [f"{a}/{b}/" for a in names[:3] for b in names[:3]]
    files = {f"{f}{n}_": "x" for f in folders for n in names} | {f"{f}{n}" if n[-1] == "x" or n == ".f" else f"{f}{n}.y": "x" for f in folders for n in names}
    for f in rng.sample(folders, 7):
        files[f"{f}.gitignore"] = "\n".join(rng.choice(["", "!"]) + rng.choice(["", "/"]) + rng.choice(["*.x", "a*", "b", "c/", "*_", ".f", "?.y", "d.x", "a/"]) for _ in range(4))
    tree(tmp_path, files)
    assert paths(spark, tmp_path, subtrees=rng.choice([1, 5, 50])) == {p for p in files if not plain_ignored(files, p)}


def test_rules_of_a_folder_reach_no_other():
    r = Rules((("a/", ".gitignore", "*.x\n"),), [], [])
    assert r.ignored("a/b.x", False) and not r.ignored("a/b.y", False)
