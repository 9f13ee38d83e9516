"""The walk by levels: what it finds, and that it lists nothing below an excluded folder."""

import os

import pytest
from pyspark.sql import functions as F

from loamline.sources import files


def plain_walk(root, include, exclude):
    """(paths of files, paths of listed folders) by recursion."""
    import re

    fits = lambda path, globs: any(re.search(files.glob_regex(g), path) for g in globs)
    found, listed = set(), set()

    def below(folder, path):
        listed.add(path)
        for name in os.listdir(folder):
            own = f"{path}/{name}" if path else name
            if fits(own, exclude) or fits(name, exclude):
                continue
            if os.path.isdir(f"{folder}/{name}"):
                below(f"{folder}/{name}", own)
            elif fits(own, include):
                found.add(own)

    below(root, "")
    return found, listed


@pytest.fixture()
def tree(tmp_path):
    for name in ("a.md", ".hidden/b.md", "_kept/c.txt", "node_modules/x/y/z.md", "deep/1/2/3/4/d.md", "deep/1/skip/e.md", "deep/.git/f.md", "odd name/ä #?.md", "deep/g.bin", "empty.md"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("" if name == "empty.md" else f"text of {name}")
    (tmp_path / "nothing").mkdir()
    return tmp_path


@pytest.mark.parametrize("include, exclude", [(None, None), (["**/*.md"], ["skip"]), (["**/*"], ["deep/1/**"]), (["deep/**"], []), ([], None)])
def test_equals_recursion(spark, tree, include, exclude):
    found, listed = files.walk(spark, str(tree), include, exclude)
    want = plain_walk(str(tree), files.DEFAULT_INCLUDES if include is None else include, files.DEFAULT_EXCLUDES if exclude is None else exclude)
    assert {r["path"] for r in found.collect()} == want[0] and found.count() == len(want[0])
    assert {r["path"] for r in listed.collect()} == want[1] and listed.count() == len(want[1])


def test_excluded_folders_are_not_listed(spark, tree):
    _, listed = files.walk(spark, str(tree))
    names = [r["path"] for r in listed.collect()]
    assert "deep/1/2/3/4" in names and not any("node_modules" in n or ".git" in n for n in names)


def test_content_times_and_sizes(spark, tree):
    rows = {r["path"]: r for r in files.with_content(files.walk(spark, str(tree))[0]).collect()}
    for path, row in rows.items():
        at = tree / path
        assert bytes(row["content"]) == at.read_bytes() and row["size"] == at.stat().st_size and row["uri"] == f"file:{os.path.realpath(at)}"
    seen = files.walk(spark, f"file:{tree}")[0].select("path", F.unix_millis("modified").alias("ms")).collect()
    assert all(r["ms"] == (tree / r["path"]).stat().st_mtime_ns // 1_000_000 for r in seen) and len(seen) == len(rows)
    assert files.with_content(files.walk(spark, str(tree), [])[0]).count() == 0


def test_links_that_lead_back_end(spark, tree):
    os.symlink(tree, tree / "deep" / "up")
    os.symlink(tree / "_kept", tree / "again")
    found, listed = files.walk(spark, str(tree))
    assert sorted(r["uri"].rsplit("/", 1)[1] for r in found.collect()).count("c.txt") == 1
    assert listed.count() == listed.select("uri").distinct().count()


def test_a_root_that_is_not_there_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="none"):
        files.walk(spark, str(tmp_path / "none"))


def test_enumeration_walks_local_folders(spark, tree):
    rows = files.enumerate_files(spark, str(tree), ["**/*.md"], ["skip"])
    assert rows.columns == ["uri", "path", "modified", "size", "content"]
    assert {r["path"] for r in rows.collect()} == plain_walk(str(tree), ["**/*.md"], ["skip"])[0]
