import os

import pytest
from pyspark.sql import functions as F

from quarry.functions import strings
from quarry.operators import report
from quarry.sources import paths, tree
from quarry.spec import SearchSpec as S

FILES = {
    "a.txt": b"one TODO\ntwo\n", ".hidden.txt": b"TODO\n", "_under.py": b"TODO here\n", "src/b.py": b"x = 1\n# TODO\n", "src/deep/c.py": b"TODO\nTODO\n", "src/deep/er/d.rs": b"none\n", "node_modules/e.js": b"TODO",
    ".git/f": b"TODO", "vendor/g.c": b"TODO", "logs/h.log": b"TODO", "logs/keep.log": b"TODO", "bin.dat": b"\x00\x01TODO", "empty.txt": b"", "latin.txt": b"caf\xe9 TODO\n",
    ".gitignore": b"# logs\n*.log\n!keep.log\n", "src/.gitignore": b"/deep/er\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, data in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(data)
    os.symlink(top / "a.txt", top / "link.txt")
    return str(top)


def listed(*args, **how):
    return [r[1] for r in tree.list_tree(*args, **how)]


def test_walk(root):
    assert listed(root + "/") == [
        ".gitignore",
        ".hidden.txt",
        "_under.py",
        "a.txt",
        "bin.dat",
        "empty.txt",
        "latin.txt",
        "logs/keep.log",
        "src/.gitignore",
        "src/b.py",
        "src/deep/c.py",
    ]
    assert listed(root, ignore_files=()) == [
        *listed(root)[:7], "logs/h.log", "logs/keep.log", "src/.gitignore", "src/b.py", "src/deep/c.py", "src/deep/er/d.rs"
    ]
    assert "src/b.py" in listed(root, max_depth=1) and "src/deep/c.py" not in listed(root, max_depth=1)
    assert listed(root, max_depth=0) == [n for n in listed(root) if "/" not in n]
    assert listed(root, ext="py") == ["_under.py", "src/b.py", "src/deep/c.py"]
    assert listed(f"{root}/vendor/g.c") == ["g.c"]


def test_search_in_files(spark, root):
    files = tree.files(spark, [root, f"{root}/vendor/g.c", f"{root}/gone"])
    docs = tree.as_documents(files)
    assert docs.filter(F.col("path").endswith("bin.dat") | F.col("path").endswith("empty.txt")).count() == 0
    got = {r.path[len(root) + 1 :]: r.n for r in report.counts(docs, S("TODO"), "path").collect()}
    assert got == {
        ".hidden.txt": 1,
        "_under.py": 1,
        "a.txt": 1,
        "src/b.py": 1,
        "src/deep/c.py": 2,
        "logs/keep.log": 1,
        "vendor/g.c": 1,
        "latin.txt": 1,
    }
    assert tree.files(spark, f"{root}/gone").count() == 0


RULES = "\n# c\n*.log\n!keep.log\nbuild/\n/top.txt\ndoc/*.md\na/**/z\n\\#odd\n[ab]?.x  \n"


@pytest.mark.parametrize(
    "path,is_dir,ignored",
    [
        ("x.log", False, True), ("d/x.log", False, True), ("keep.log", False, False), ("build", True, True), ("build", False, False), ("s/build/x", False, True), ("top.txt", False, True), ("d/top.txt", False, False),
        ("doc/a.md", False, True), ("doc/b/a.md", False, False), ("a/z", False, True), ("a/b/c/z", False, True), ("#odd", False, True), ("a1.x", False, True), ("c1.x", False, False), ("other", False, False),
    ],
)
def test_rules(path, is_dir, ignored):
    assert paths.is_ignored(paths.parse_rules(RULES), path, is_dir) == ignored


def test_nested_rules_stay_in_their_directory():
    rules = paths.parse_rules("*.c", "sub")
    assert paths.is_ignored(rules, "sub/x.c") and not paths.is_ignored(rules, "x.c")


def test_columns_agree_with_the_driver(spark):
    rules = paths.parse_rules("*.es\n!*7.es\nsrc1*\n?.md\n")
    names = [
        "a/1.es",
        "a/7.es",
        "src1/x",
        "b/src12",
        "b.md",
        "xx/b.md",
        "bb.md",
        "a.tar.gz",
        ".bashrc",
        "no",
        "x/.git/y",
        "x/vendor/y",
        ".h/y",
        "vendor",
    ]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = df.select(
        "p",
        paths.not_ignored(F.col("p"), rules).alias("k"),
        paths.in_open_directories(F.col("p")).alias("o"),
        strings.extension(F.col("p")).alias("e"),
        strings.depth(F.col("p")).alias("d"),
        paths.included(F.col("p"), ["*.es", "a*"], ["*7*"]).alias("i"),
    ).collect()
    for r in got:
        assert r.k == (not paths.is_ignored(rules, r.p, compat=True))
        assert r.o == (not any(paths.skips_directory(d) for d in r.p.split("/")[:-1]))
        assert r.e == strings.py_extension(r.p.rsplit("/", 1)[-1]) and r.d == r.p.count("/")
        assert r.i == ((r.p.endswith(".es") or r.p.startswith("a") or r.p.rsplit("/")[-1].startswith("a")) and "7" not in r.p)
