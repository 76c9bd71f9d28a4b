import io

import pytest

from tamarack import cli
from tamarack.engine import Engine


@pytest.fixture
def shell(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "sub").mkdir()
    return cli.Shell(Engine(spark, str(tmp_path)), io.StringIO())


def test_shell(shell, tmp_path):
    shell.loop(io.StringIO('SELECT a\nFROM "t.csv" t;\nSELECT FROM;\nSELECT z FROM "t.csv" t;\n.pretty on;\nSELECT a FROM "t.csv" t WHERE a = 2;\n.pwd;\n.cd sub;\n.nope;\n.help;'), prompt=False)
    out = shell.out.getvalue()
    assert out.startswith("a\n1\n2\n")
    assert "syntax error at line 1, column 12" in out or "syntax error at line 2" in out
    assert "no such column: z" in out
    assert "|2                   |" in out
    assert f"{tmp_path}\n" in out and str(tmp_path / "sub") in out
    assert "unknown command: .nope" in out and ".debug on|off;" in out


def test_debug_shows_the_plan(shell):
    shell.loop(io.StringIO('.debug on; SELECT a FROM "t.csv" t;'), prompt=False)
    assert "Physical Plan" in shell.out.getvalue()


def test_arguments():
    a = cli.arguments().parse_args(["q.sql", "--output", "o", "--graph", "g", "--use-caching", "--no-select-push-down", "--no-projection-opti", "--no-joins", "--big-data"])
    assert (a.path, a.output, a.graph) == ("q.sql", "o", "g")
    assert a.use_caching and a.no_select_push_down and a.no_projection_opti and a.no_joins and a.big_data
