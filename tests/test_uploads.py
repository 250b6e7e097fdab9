"""Files that are handed in: kept once by content, turned away with a reason, the same after batches that run again."""

import json

from pyspark.sql import functions as F

from tests.test_transcripts import RICH, rows, said, write
from tracelake.sources import catalog, transcripts, uploads


def jsonl(records):
    return "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records).encode()


GOOD, OTHER = jsonl(RICH), jsonl([said("user", "hello", 1)])
HANDED_IN = [("a/b\\log one.jsonl", GOOD), ("again.jsonl", GOOD), ("x.jsonl", OTHER), ("junk.jsonl", b"{broken\n[1]\n"), ("empty.jsonl", b""), ("bin", b"\xff\xfe\x00"), (" .. .jsonl", jsonl([said("user", "bye", 1)]))]


def frame(spark, files):
    return spark.createDataFrame([(n, bytearray(c)) for n, c in files], "original string, content binary")


def test_kept_once(spark, tmp_path):
    store = str(tmp_path / "store")
    uploads.ingest(frame(spark, HANDED_IN[:4]), store, 0)
    uploads.ingest(frame(spark, HANDED_IN[:4]), store, 0)  # runs again
    uploads.ingest(frame(spark, [*HANDED_IN[4:], ("late copy.jsonl", OTHER)]), store, 1)
    got = rows(uploads.stored(spark, store), "name", "original", "bytes")
    assert got == sorted([("log one", HANDED_IN[0][0], len(GOOD)), ("x", "x.jsonl", len(OTHER)), ("upload", " .. .jsonl", len(HANDED_IN[-1][1]))], key=repr)
    bad = spark.read.parquet(f"{store}/rejected")
    assert rows(bad, "original", "reason") == [("bin", "nothing but dropped records"), ("empty.jsonl", "nothing but dropped records"), ("junk.jsonl", "nothing but dropped records")]
    path = write(tmp_path / "log one.jsonl", RICH)
    cols = ["session", "origin", "seq", "part", "type", "text", "output", "reason"]
    assert rows(uploads.events(spark, store).where("session = 'log one'"), *cols) == rows(transcripts.load(spark, path).withColumn("session", F.lit("log one")), *cols)


def test_a_stream_keeps_each_file_once(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    for n, (_, content) in enumerate(HANDED_IN[:3]):
        (src / f"f{n}.jsonl").write_bytes(content)
    schema = spark.read.format("binaryFile").load(str(src)).schema
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", 1).load(str(src)).select(F.col("path").alias("original"), "content")
        uploads.ingest_stream(stream, store).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(200)
    assert uploads.stored(spark, store).count() == 2


def test_fingerprints_of_injected_entries(spark):
    a = {"one": {"description": "does things well", "intent": "x"}, "two": {"description": "other things"}}
    same = {"skills": {"two": {"description": " other things "}, "one": {"intent": "x", "description": "does things well", "more": 1}}}
    sets = [(1, json.dumps(a)), (2, json.dumps(same, indent=3)), (3, json.dumps(a | {"two": {"description": "changed things"}})), (4, "{"), (5, "{}")]
    got = dict(rows(catalog.fingerprint(catalog.injected(spark.createDataFrame(sets, "id long, json string"), keys=["id"]), ["id"]), "id", "fingerprint"))
    assert got.keys() == {1, 2, 3} and got[1] == got[2] != got[3] and len(got[1]) == 16
