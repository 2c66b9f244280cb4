import ast
import pathlib

import prefixspark
from prefixspark.llm import common as C

ROOT = pathlib.Path(prefixspark.__file__).parent


def test_scratch_tables_follow_the_session_and_can_be_dropped(spark):
    since = C.scratch_mark()
    kept, gone = (C.materialise(spark.range(3), name) for name in ("kept", "gone"))
    assert C.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert all(p.startswith(C.shared_dir(spark)) for p in C._written[since:])
    C.drop_scratch(spark, since, keep="kept")
    assert kept.count() == 3 and len(C._written) == since + 1
    assert not any("gone-" in p for p in C._written[since:]) and gone.columns == ["id"]


def test_nothing_else_imports_the_operators():
    for path in ROOT.rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_no_local_checkpoints():
    assert not any("localCheckpoint" in p.read_text() for p in ROOT.rglob("*.py"))
