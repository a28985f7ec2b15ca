import io

import pytest

from quarry.__main__ import run


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    (top / "a.txt").write_text("one TODO\ntwo\nthree todo\n")
    (top / "b.py").write_text("x\n-flag TODO\n")
    return str(top)


def said(spark, *argv):
    out = io.StringIO()
    status = run(list(argv), spark, out)
    return status, out.getvalue().splitlines()


def test_options(spark, root):
    assert said(spark, "TODO", root) == (0, [f"{root}/a.txt:1:one TODO", f"{root}/b.py:2:-flag TODO"])
    assert said(spark, "-i", "-c", "todo", root) == (0, [f"{root}/a.txt:2", f"{root}/b.py:1"])
    assert said(spark, "-l", "-t", "py", "TODO", root) == (0, [f"{root}/b.py"])
    assert said(spark, "-c", "-l", "-t", "py", "TODO", root) == (0, [f"{root}/b.py:1", f"{root}/b.py"])
    assert said(spark, "-e", "-flag", "--no-line-number", root) == (0, [f"{root}/b.py:-flag TODO"])
    assert said(
        spark, "-A", "1", "-m", "1", "--include", "*.txt", "TODO", root
    ) == (0, [f"{root}/a.txt:1:one TODO", f"{root}/a.txt-2-two"])
    assert said(spark, "--json", "--exclude", "*.txt", "TODO", root)[1] == [
        f'{{"path":"{root}/b.py","line_no":2,"line":"-flag TODO"}}'
    ]
    assert "\x1b[1;31mTODO" in said(spark, "--color", "always", "TODO", root)[1][0]
    assert said(spark, "zzz", root) == (1, [])
    assert said(spark, "a(b", root)[0] == 2


def test_index(spark, root, tmp_path):
    folder = str(tmp_path / "index")
    assert said(spark, "--index-build", folder, root)[0] == 0
    assert said(spark, "--index", folder, "TODO", root) == said(spark, "TODO", root)
    for options in (["-m", "1"], ["-C", "1"], ["-A", "1", "-m", "1"], ["-c"], ["-l"], ["-v"], ["-i"], ["-w"], ["--json"], ["-c", "-l", "-m", "1"], ["--color", "always"]):
        assert said(spark, "--index", folder, *options, "TODO", root) == said(spark, *options, "TODO", root), options


def test_paths_that_are_not_there(spark, root, capsys):
    assert said(spark, "TODO", f"{root}/none", f"{root}/b.py") == (0, [f"{root}/b.py:2:-flag TODO"])
    assert capsys.readouterr().err == f"quarry: {root}/none: No such file or directory\n"
    assert said(spark, "TODO", f"{root}/none")[0] == 1
