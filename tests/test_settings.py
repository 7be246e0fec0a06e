"""Settings as versions of a store, and numbers of projects below directories."""

import datetime

import pytest
from pyspark.sql import functions as F

from forgelens.plans import settings
from forgelens.plans.errors import Invalid, NotFound, described
from forgelens.sources.tables import Conflict, Store

T = datetime.datetime(2024, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_ancestors(spark):
    raw = ["/a/b/c", "/a/b/", "/", "a\\b", "a", "", "//x"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, p string").select("i", settings.ancestors(F.col("p")).alias("a")).orderBy("i").collect()
    assert [r["a"] for r in rows] == [["/", "/a", "/a/b", "/a/b/c"], ["/", "/a", "/a/b"], ["/"], ["a", "a/b"], ["a"], ["/"], ["/", "//x"]]


@pytest.mark.parametrize("few", [0, 100])
def test_counts_by_directory(spark, monkeypatch, few):
    monkeypatch.setattr(settings, "FEW_DIRECTORIES", few)
    dirs = spark.createDataFrame([("/a",), ("/a/b/",), ("/ab",), ("/none",), ("D:\\code",)], "path string")
    paths = ["/a", "/a/x", "/a/b/y", "/a/b/y/", "/ab/z", "/abc", None, " ", "D:/code/p", "D:\\code\\q"]
    got = {r["path"]: r["n"] for r in settings.directory_counts(dirs, spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    clean = {p.strip().replace("\\", "/").rstrip("/") for p in paths if p and p.strip()}
    brute = {d: sum(p == c or p.startswith(c + "/") for p in clean) for d in got for c in [d.replace("\\", "/").rstrip("/")]}
    assert got == brute == {"/a": 3, "/a/b/": 1, "/ab": 1, "/none": 0, "D:\\code": 2}
    assert settings.directory_counts(dirs.limit(0), dirs).count() == 0 and {r["n"] for r in settings.directory_counts(dirs, dirs.limit(0)).collect()} == {0}


def test_directories_come_and_go(spark, store, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "file").write_text("x")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    scan = settings.ScanSettings(store)
    assert scan.problems() == ["there is no directory yet"]
    scan.add(one + "/", T)
    scan.add(two, T)
    for path, error in ((one, Conflict), (" ", Invalid), (str(tmp_path / "gone"), Invalid), (str(tmp_path / "file"), Invalid)):
        with pytest.raises(error) as caught:
            scan.add(path, T)
        assert described(caught.value)["status"] in (400, 409)
    assert scan.roots() == [one + "/", two] and scan.problems() == []
    scan.enable(one, False)
    assert scan.roots() == [two]
    for change in (lambda: scan.enable("/gone", True), lambda: scan.remove("/gone")):
        with pytest.raises(NotFound):
            change()
    (tmp_path / "two").rmdir()
    assert scan.problems() == [f"there is no directory {two}"]
    assert [(r["path"], r["exists"], r["project_count"], r["scanned"]) for r in scan.view(F.lit(T)).collect()] == [(one + "/", True, None, None), (two, False, None, None)]
    scan.remove(two)
    assert [r["path"] for r in scan.directories().collect()] == [one + "/"]


def test_a_scan_marks_its_directories(spark, store, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    scan = settings.ScanSettings(store)
    scan.add(str(tmp_path / "one"), T)
    scan.add(str(tmp_path / "two"), T)
    store.commit({"projects": spark.createDataFrame([(f"{tmp_path}/one/p",), (f"{tmp_path}/one/q",), (f"{tmp_path}/two/r",)], "path string")})
    scan.scanned([f"{tmp_path}/one/"], F.lit("2024-01-01").cast("timestamp"))
    got = [(r["project_count"], r["scanned"]) for r in scan.view(F.lit("2024-01-03").cast("timestamp")).collect()]
    assert got == [(2, "2 d ago"), (None, None)]


def test_two_writers_of_one_version(store, tmp_path, monkeypatch):
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    first, second = settings.ScanSettings(store), settings.ScanSettings(store)
    first.add(str(tmp_path / "one"), T)
    seen = second._rows

    def late(at):
        rows = seen(at)
        first.enable(str(tmp_path / "one"), False)
        return rows

    monkeypatch.setattr(second, "_rows", late)
    with pytest.raises(Conflict):
        second.add(str(tmp_path / "two"), T)
    assert [(r["path"], r["enabled"]) for r in first.directories().collect()] == [(str(tmp_path / "one"), False)]


def test_scan_options(store):
    scan = settings.ScanSettings(store)
    assert scan.options() == settings.SCAN
    assert scan.update(max_depth=20, exclude=[" **/out ", " "]) == {"watch": True, "parse": True, "max_depth": 20, "exclude": ["**/out"]}
    assert scan.update(watch=False)["max_depth"] == 20 and scan.options()["watch"] is False
    for depth in (0, 21):
        with pytest.raises(Invalid):
            scan.update(max_depth=depth)
    assert store.read("settings").count() == 3


def test_model_settings_hide_the_key(store):
    model = settings.ModelSettings(store)
    assert model.view()["key_masked"] == "" and model.view()["sensitive_local_only"] is True
    got = model.update(key="sk-1234567890", url=" https://x.example ", route_deep="cloud")
    assert (got["key_masked"], got["url"], got["cloud_configured"], got["local_configured"], got["route_deep"]) == ("sk-1****7890", "https://x.example", True, False, "cloud") and "key" not in got
    assert model.update(key=settings.UNCHANGED, model="m")["cloud_configured"] and model.update(key="")["cloud_configured"] is False
    for bad in ({"url": "ftp://x"}, {"local_url": "https://"}, {"route_fast": "x"}, {"colour": "red"}):
        with pytest.raises(Invalid):
            model.update(**bad)
