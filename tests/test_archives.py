"""Archives whose directory is longer than the part that is looked at first."""

import io
import zipfile

from appfacts.sources.archives import archive_flags, scan_app_archives


def archive(names, pad=0):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("res/pad", "x" * pad)
        for n in names:
            z.writestr(n, "1")
    return buf.getvalue()


FILES = {
    "both": archive(["AndroidManifest.xml", "classes.dex"]),
    "long": archive(["AndroidManifest.xml", "classes.dex"], 50_000),
    "many": archive(["AndroidManifest.xml", *[f"res/{i}" for i in range(400)], "classes.dex"]),
    "code": archive(["classes.dex", *[f"res/{i}" for i in range(400)]]),
    "none": archive(["res/x"]),
    "cut": archive(["AndroidManifest.xml", "classes.dex"], 50_000)[:30_000],
    "text": b"no archive" * 1000,
    "empty": b"",
}
WANT = {"both": (True, True), "long": (True, True), "many": (True, True), "code": (False, True)}


def test_tail_and_whole(spark):
    df = spark.createDataFrame(list(FILES.items()), "uri string, content binary")
    for tail in (1000, 1 << 20):
        got = {r.uri: r for r in archive_flags(df, tail).collect()}
        assert got.keys() == FILES.keys()
        for uri, r in got.items():
            assert (r.is_valid, r.is_decompilable) == WANT.get(uri, (False, False)), (uri, tail)
            assert (r.error is not None) == (uri in ("cut", "text", "empty"))


def test_folder(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / f"{name}.apk").write_bytes(data)
    got = scan_app_archives(spark, str(tmp_path)).collect()
    # Spark lists no empty files.
    assert sum(r.is_valid for r in got) == 3 and len(got) == len(FILES) - 1


def test_file_of_three_gigabytes(spark, tmp_path):
    """Longer than a value may be; the file is sparse, and only its directory is read."""
    with open(tmp_path / "large.apk", "wb") as f:
        f.truncate(3 << 30)
        f.seek(3 << 30)
        f.write(FILES["both"])
    (tmp_path / "small one.apk").write_bytes(FILES["code"])
    got = {r.uri.rsplit("/", 1)[1]: (r.is_valid, r.is_decompilable, r.error) for r in scan_app_archives(spark, str(tmp_path)).collect()}
    assert got == {"large.apk": (True, True, None), "small one.apk": (False, True, None)}


def test_store_that_workers_cannot_open(spark, tmp_path, monkeypatch):
    for name in ("both", "text"):
        (tmp_path / f"{name}.apk").write_bytes(FILES[name])

    def closed(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([(u, None, None, None, False) for u in batch["uri"]], columns=["uri", "has_manifest", "has_code", "error", "opened"])

    monkeypatch.setattr("appfacts.sources.archives._ranged", closed)
    assert sorted((r.is_valid, r.error is None) for r in scan_app_archives(spark, str(tmp_path)).collect()) == [(False, False), (True, True)]


def test_files_are_made_once(spark):
    """Flags come from one pass over the files, unless a directory is larger than the tail."""
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for b in batches:
            made.add(len(b))
            yield b

    df = spark.createDataFrame([(k, v) for k, v in FILES.items()], "uri string, content binary")
    assert archive_flags(df.mapInPandas(make, df.schema)).count() == len(FILES)
    assert made.value == len(FILES)
