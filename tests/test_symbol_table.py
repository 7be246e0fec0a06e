"""The table function of symbols, its slices, and bodies in one pass."""

import random
import time

from forgelens.sources import symbols

CODE = {
    "Python": "class Queue:\n    def push(self, x):\n        # note\n\n        self.x = x\n\ndef retry(items):\n    return items\n\n\nMAX = 3\nretry([])\n",
    "JavaScript": "app.get('/a', h)\n/// Doc.\nexport function go(x) {\n  return x\n}\n\nclass Page {\n  run() {\n    return 1\n  }\n}\n",
    "Rust": "pub struct A {\n    x: i32,\n}\n\nimpl A {\n    pub fn new() -> A {\n        A { x: 1 }\n    }\n}\n",
    "Cobol": "anything",
}


def body_by_rescan(lines, at, indent):
    n = 1
    for raw in lines[at + 1 :]:
        text = raw.strip()
        if text and len(raw) - len(raw.lstrip()) <= indent and not text.startswith(("//", "#")):
            break
        n += 1
    return n


def test_bodies():
    rng = random.Random(1)
    for _ in range(300):
        lines = [" " * rng.randrange(5) + rng.choice(["def f(x):", "class A:", "x = 1", "", "# c", "// d", "def g():"]) for _ in range(rng.randrange(40))]
        text = "\n".join(lines)
        lines = text.splitlines()
        for row in symbols.extract("Python", "a.py", text):
            at = row[4] - 1
            assert row[7] == body_by_rescan(lines, at, len(lines[at]) - len(lines[at].lstrip())), lines


def test_long_source_in_time():
    text = "".join(f"def f{i}():\n  x = {i}\n" for i in range(60_000))
    began = time.perf_counter()
    assert sum(1 for _ in symbols.extract("Python", "a.py", "class A:\n" + text.replace("def", " def").replace("  x", "   x"))) == 60_001
    assert time.perf_counter() - began < 20


def test_sql_forms_are_the_dataframe_form(spark):
    rows = [("p", lang, f"{lang}-{i}", code if i else None) for lang, code in CODE.items() for i in range(3)]
    files = spark.createDataFrame(rows, "project_id string, language string, rel_path string, text string")
    want = sorted(map(tuple, symbols.symbols(files).collect()), key=str)
    assert len(want) >= 14
    symbols.register(spark)
    files.createOrReplaceTempView("files_of_test")
    assert sorted(map(tuple, spark.sql("SELECT * FROM source_symbols(TABLE(files_of_test))").collect()), key=str) == want
    lateral = spark.sql("SELECT f.project_id, s.*, f.rel_path FROM files_of_test f, LATERAL symbols_of(f.language, f.rel_path, f.text) s").collect()
    assert sorted([tuple(r)[:-1] for r in lateral], key=str) == want and all(r.file_path == r.rel_path for r in lateral)


def test_slices():
    rows = [("p", f"n{i}", "function", "Python", "a.py", i, "s", None, 1, None, False) for i in range(symbols.SLICE * 2 + 5)]
    sizes = [b.num_rows for b in symbols._batches(iter(rows))]
    assert sizes == [symbols.SLICE, symbols.SLICE, 5]
