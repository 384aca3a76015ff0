"""Tuple files against Python's own parser and pattern search, with blocks of a few hundred bytes."""

import ast
import random
import re

import pytest

from trivet.sources import tuple_files


def brute(text):
    text = text.removeprefix("﻿")
    try:
        tree = ast.parse(text.replace("\r\n", "\n"))
        node = next(n.value for n in tree.body if isinstance(n, ast.Assign) and ast.unparse(n.targets[0]) == "dataset")
        if not isinstance(node, ast.List):
            raise ValueError
        rows = [ast.literal_eval(x) for x in node.elts]
    except (SyntaxError, ValueError, StopIteration, RecursionError, MemoryError):
        return [m.groups() for m in re.compile(tuple_files.TUPLE, re.A).finditer(text)]
    return [tuple(None if x is None else str(x) for x in r[:3]) for r in rows if isinstance(r, (tuple, list)) and len(r) >= 3]


def read(spark, folder, texts, block):
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        rows = tuple_files.read_tuples(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {name: [] for name in texts}
    for r in sorted(rows, key=lambda r: (r.source_file, r.source_index)):
        got[r.source_file].append((r.source_index, r.context, r.username, r.password))
    return got


def literal(rng, n):
    parts = ["a", "(", ")", "[", "]", "'", '"', "#", "\n", "\\", ",", "é", "dataset = [", '"""', "'''", "{", " x ", ")("]
    words = lambda k: "".join(rng.choices(parts, k=rng.randint(0, k)))
    items = []
    for _ in range(n):
        context = words(30)
        spelled = f'"""{context}"""' if '"' not in context and "\\" not in context and rng.random() < 0.5 else repr(context)
        items.append(rng.choice([f"({spelled}, {words(3)!r}, None)", f"[{spelled}, 1, 2, 3]", f"( {spelled} , # note )\n None, 'p' '(')", f"({spelled}, 'short')", "7", f"({spelled}, ('a', [1, (2,)]), {{'k': ')'}})"]))
    head = rng.choice(["", "# a ( comment ['\n", "import os\nx = ('[', 1)\n", '"""doc (\n"""\n'])
    tail = rng.choice(["", "\n", "\nprint(len(dataset))\n", "\nprint('x')", "\ny = {1: [2]}  # (\n"])
    return f"{head}dataset = [\n" + ",\n".join(items) + rng.choice([",", ""]) + "\n]" + tail


@pytest.mark.parametrize("block", [60, 333, 1 << 20])
def test_random_files_equal_python(spark, tmp_path, block):
    rng = random.Random(block)
    texts = {f"r{i}.txt": literal(rng, rng.choice([0, 1, 5, 40])) for i in range(12)}
    got = read(spark, tmp_path, texts, block)
    for name, text in texts.items():
        assert got[name] == [(i, *r) for i, r in enumerate(brute(text), 1)], name


ODD = {
    "empty.txt": "",
    "mark.txt": "﻿dataset = [('a', None, 'b')]",
    "windows.txt": "dataset = [\r\n('''x\r\ny''', None, 'b'),\r\n]\r\n",
    "broken.txt": 'dataset = [("""one""", None, "p"), ("""two""", "u", \'q\'), (',
    "names.txt": 'dataset = [("""one""", None, value)]',
    "no_list.txt": 'dataset = ("""one""", None, "p")',
    "open_end.txt": 'x ("""a""", None, "b"',
    "closed_end.txt": 'x ("""a""", None, "b")',
    "call_end.txt": "dataset = [('a', 'b', 'c')]\nprint(1)",
    "other_list.txt": "other = [('x', 'y', 'z')]\ndataset = [('a', 'b', 'c')]\nmore = [('d', 'e', 'f')]\n",
    "wrong_bracket.txt": "dataset = [('a', 'b', 'c'))\n",
    "wrong_tail.txt": "dataset = [('a', 'b', 'c')]\nx = = 3\n",
    "inner.txt": "def f():\n    dataset = [('n', 'n', 'n')]\ndataset = [('a', 'b', 'c')]\n",
    "deep.txt": "dataset = [" + "(" * 500 + "1" + ")" * 500 + "]\n",
    "prose.txt": "no python ' here (\n" * 50 + 'and ( """ctx ) """ , "u" , None ) then' + " ) (" * 50,
}


@pytest.mark.parametrize("block", [25, 1 << 20])
def test_odd_files(spark, tmp_path, block):
    got = read(spark, tmp_path, ODD, block)
    for name, text in ODD.items():
        assert [r[1:] for r in got[name]] == [tuple(r) for r in brute(text)], name
        assert [r[0] for r in got[name]] == list(range(1, len(got[name]) + 1))


def test_long_files_are_read_by_many_tasks(spark, tmp_path):
    """One line and one item of a file are longer than a block; no value is longer than an item."""
    rows = [(f"context {i} (" + "x" * 400, f"u{i}", None) for i in range(3000)] + [("y )" * 60_000, None, "p")] + [("z", "a", "b")] * 10
    (tmp_path / "long.txt").write_text("dataset = [" + ", ".join(map(repr, rows)) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        lines = spark.read.option("lineSep", ")").text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 20 and lines.selectExpr("max(length(value))").first()[0] < 1000
        got = tuple_files.read_tuples(spark, str(tmp_path)).orderBy("source_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r)[1:] for r in got] == [(i, *r) for i, r in enumerate(rows, 1)]


def test_pattern_search_is_a_stream(monkeypatch, spark, tmp_path):
    monkeypatch.setattr(tuple_files, "SEARCHED_AHEAD", 50)
    text = "".join(f'no ( """c{i}\n""" , None, \'p{i}\' )\n' + "(" * (i % 3) for i in range(300))
    assert [r[1:] for r in read(spark, tmp_path, {"s.txt": text}, 200)["s.txt"]] == brute(text)
