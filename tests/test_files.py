import os
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spillway import cli
from spillway.operators.merge import merge
from spillway.operators.order import sort
from spillway.operators.verify import same_rows
from spillway.plans.params import GenerateParams, MemoryParams, MergeParams, memory_bytes
from spillway.plans.spec import NAMED, U32, Field, Ordering, RecordSpec
from spillway.sources.binary import read_records, reading, write_records


def put(path, values):
    path.write_bytes(struct.pack(f"<{len(values)}I", *values))
    return str(path)


def test_memory_and_merges():
    assert [memory_bytes(10, u) for u in "BKM"] == [10, 10240, 10485760]
    assert MemoryParams(1, "M", 2).block_records(4) == 131072 and GenerateParams(16, "M").records(4) == 4194304
    assert [MergeParams(fan_in=4).merge_count(r) for r in (0, 1, 2, 4, 5, 32)] == [0, 0, 1, 1, 2, 11]
    for bad in (lambda: MergeParams(fan_in=1), lambda: MergeParams(merges=0), lambda: MergeParams(stream_blocks=0), lambda: MemoryParams(blocks=0), lambda: memory_bytes(1, "G"), lambda: MemoryParams(1, "B", 2).block_records(4)):
        with pytest.raises(ValueError):
            bad()


def test_partial_record_and_ranges(spark, tmp_path):
    path = tmp_path / "f"
    path.write_bytes(struct.pack("<5I", 9, 8, 4294967295, 0, 7) + b"\1\2\3")
    df = read_records(spark, str(path), U32, partition_bytes="8")
    assert df.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in df.orderBy("pos").collect()] == [(0, 9), (1, 8), (2, 4294967295), (3, 0), (4, 7)]
    with pytest.raises(Exception, match="ends with 3 bytes"):
        read_records(spark, str(path), U32, on_partial="error").collect()
    with pytest.raises(Exception, match="no such file"):
        read_records(spark, str(tmp_path / "none"), U32).collect()
    assert read_records(spark, put(tmp_path / "empty", []), U32).count() == 0


def test_every_kind_survives_a_round_trip(spark, tmp_path):
    spec = RecordSpec.parse("a:int8,b:int16,c:int32,d:int64,e:uint8,f:uint16,g:uint32,h:uint64,i:float,j:double,k:bool,l:char[5],m:bytes[3]")
    rows = [(-1, -2, -3, -4, 255, 65535, 4294967295, Decimal(2**64 - 1), 1.5, -2.5, True, "héy", b"\0\1\2"), (1, 2, 3, 4, 0, 0, 0, Decimal(0), 0.0, 0.0, False, "", b"abc")]
    df = spark.createDataFrame(rows, spec.schema)
    write_records(df, str(tmp_path / "f"), spec, single="true")
    assert os.path.getsize(tmp_path / "f") == 2 * spec.record_size
    assert same_rows(read_records(spark, str(tmp_path / "f"), spec).drop("pos"), df)
    with pytest.raises(Exception, match="outside uint32"):
        write_records(spark.sql("select 4294967296L as value"), str(tmp_path / "g"), U32)
    with pytest.raises(Exception, match="null"):
        write_records(spark.sql("select cast(null as bigint) as value"), str(tmp_path / "g"), U32)


def test_offsets_and_parsing():
    assert NAMED.record_size == 100 and U32.text() == "value:uint32"
    padded = RecordSpec((Field("a", "int8"), Field("b", "int64", 8)), 16)
    assert padded.record_size == 16 and padded.dtype.fields["b"][1] == 8
    with pytest.raises(ValueError):
        RecordSpec.parse("a:int7")


def test_sorted_frame_becomes_one_sorted_file(spark, tmp_path):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("value"))
    write_records(df.orderBy("value"), str(tmp_path / "f"), U32, single="true")
    got = struct.unpack("<5000I", (tmp_path / "f").read_bytes())
    assert list(got) == sorted(got) and sorted(got) == sorted(r[0] for r in df.collect())
    write_records(df.orderBy("value"), str(tmp_path / "parts"), U32)
    assert [r[1] for r in read_records(spark, str(tmp_path / "parts"), U32).orderBy("pos").collect()] == list(got)
    joined = b"".join((tmp_path / "parts" / p).read_bytes() for p in sorted(os.listdir(tmp_path / "parts")))
    assert joined == (tmp_path / "f").read_bytes() and not [p for p in os.listdir(tmp_path) if ".parts-" in p]


def test_sort_file(spark, tmp_path):
    cli.sort_file(spark, put(tmp_path / "in", [3, 1, 2, 3]), str(tmp_path / "out"), U32, Ordering.of("-value"))
    assert struct.unpack("<4I", (tmp_path / "out").read_bytes()) == (3, 3, 2, 1)


def resolved(*args):
    return cli.resolve(cli.parser().parse_args(args))


def test_defaults_of_files():
    p = resolved("--gen.ofile", "/d/g")
    assert (p.split_in, p.runs, p.merged, p.checked) == ("/d/g", "/d/g", "/d/g.sorted", "/d/g.sorted")
    p = resolved("--act", "srt", "--srt.ifile", "/d/x", "--tmpdir", "/t")
    assert (p.split_in, p.runs, p.merged) == ("/d/x", "/t/x", "/d/x.sorted")
    assert resolved("--act", "srt", "--srt.ifile", "/d/x", "--spl.ofile", "/r/y").runs == "/r/y"
    assert resolved("--act", "chk", "--chk.ifile", "/d/z").checked == "/d/z"
    with pytest.raises(SystemExit):
        resolved("--act", "mrg", "--mrg.ofile", "/d/m")
    assert [cli.run_file("p", i) for i in (1, 999, 1000)] == ["p.split.001", "p.split.999", "p.split.1000"]


def test_all_steps_from_the_command_line(spark, tmp_path):
    g = str(tmp_path / "g")
    assert cli.main(["--gen.ofile", g, "--msize", "8", "--munit", "K", "--gen.fsize", "20"]) == 0
    assert os.path.getsize(g) == os.path.getsize(g + ".sorted") == 20480 and os.path.exists(f"{g}.split.005")
    assert cli.main(["--act", "chk", "--chk.ifile", g]) == 2
    assert cli.main(["--act", "chk", "--chk.ifile", g + ".sorted"]) == 0
    out = str(tmp_path / "m")
    assert cli.main(["--act", "mrg", "--mrg.ifiles", f"{g}.split.001,{g}.split.002", "--mrg.ofile", out, "--rm-input"]) == 0
    assert os.path.getsize(out) == 8192 and not os.path.exists(f"{g}.split.001")
    empty = put(tmp_path / "e", [])
    assert cli.main(["--act", "srt", "--srt.ifile", empty, "--srt.ofile", str(tmp_path / "es")]) == 0 and os.path.getsize(tmp_path / "es") == 0


def test_run_files_come_from_one_job_and_are_read_by_one_scan(spark, tmp_path):
    source = put(tmp_path / "in", [5, 3, 9, 1, 4, 4, 8])
    runs = cli.split_file(spark, source, str(tmp_path / "r"), U32, U32.order(), 3)
    assert [struct.unpack(f"<{os.path.getsize(x) // 4}I", open(x, "rb").read()) for x in runs] == [(3, 5, 9), (1, 4, 4), (8,)]
    assert not [p for p in os.listdir(tmp_path) if ".parts-" in p]
    df = read_records(spark, runs, U32)
    assert [tuple(r) for r in df.orderBy("pos").collect()] == list(enumerate((3, 5, 9, 1, 4, 4, 8)))
    cli.merge_files(spark, runs, str(tmp_path / "m"), U32, U32.order(), cleanup=True)
    assert struct.unpack("<7I", (tmp_path / "m").read_bytes()) == (1, 3, 4, 4, 5, 8, 9) and not any(map(os.path.exists, runs))


def test_cleanup_only_after_success(spark, tmp_path):
    path = put(tmp_path / "in", [1])
    with pytest.raises(RuntimeError), reading(spark, path, U32, cleanup=True):
        raise RuntimeError
    assert os.path.exists(path)
    with reading(spark, path, U32) as df:
        assert df.count() == 1
    assert os.path.exists(path)
    with reading(spark, path, U32, cleanup=True) as df:
        assert df.count() == 1
    assert not os.path.exists(path)


def test_strict_empty(spark, tmp_path):
    nothing = spark.range(0).toDF("value")
    for strict in (lambda: sort(nothing, U32.order(), strict_empty=True), lambda: merge([nothing], U32.order(), strict_empty=True)):
        with pytest.raises(ValueError, match="nothing to"):
            strict()
    assert sort(nothing, U32.order()).count() == merge([nothing], U32.order()).count() == 0


def test_traits_of_a_spec(spark, tmp_path):
    spec = RecordSpec.parse("a:int8,b:uint16,c:uint64,d:double,e:bool,f:char[6],g:bytes[40]")
    rows = spec.generate(spark, 300, 7)
    assert [f.dataType for f in rows.drop("pos").schema] == [f.dataType for f in spec.schema]
    assert rows.orderBy("pos").collect() == spec.generate(spark, 300, 7).repartition(5).orderBy("pos").collect()
    assert rows.select("c", "d").collect() != spec.generate(spark, 300, 8).select("c", "d").collect()
    write_records(rows, str(tmp_path / "f"), spec)
    assert rows.agg(F.min("a"), F.max("a")).first()[0] < 0 < rows.agg(F.max("a")).first()[0] and rows.select("b").distinct().count() > 250
    assert {len(r[0]) for r in rows.select("g").collect()} == {40}
    assert spec.order() == Ordering.of("a") and NAMED.order() == Ordering.of("id")
    pair = RecordSpec.parse("x:int32,y:int32")
    own = RecordSpec(pair.fields, ordering=Ordering.of("-y"), formatter=lambda c: F.concat_ws("/", c("x"), c("y")))
    assert own == pair and own.order() == Ordering.of("-y")
    one = spark.sql("select 1 as x, 2 as y, 3L as id, 'n' as name, 't' as text")
    assert one.select(pair.shown(), own.shown(), NAMED.shown()).first() == ("(x = 1; y = 2)", "1/2", "(id = 3; name = 'n'; text = 't')")


def test_levels_parameters_and_times(spark, tmp_path, caplog):
    assert [cli.level(n) for n in (0, 2, 4, 5, 6, 7, -1)] == [51, 40, 25, 20, 15, 25, 25]
    path = put(tmp_path / "f", [2, 1])
    assert cli.main(["--act", "chk", "--chk.ifile", path, "--log", "5", "--chk.blocks", "3", "--no_rm"]) == 2
    said = caplog.text
    assert "check_blocks = 3" in said and "keep = True" in said and "check: " in said and "overall: " in said and "previous 2, current 1" in said
    with pytest.raises(ValueError):
        cli.main(["--act", "chk", "--chk.ifile", path, "--gen.blocks", "0"])


def test_custom_records_from_the_command_line(spark, tmp_path):
    g = str(tmp_path / "g")
    assert cli.main(["--gen.ofile", g, "--spec", "a:uint16,b:char[8]", "--key=-a", "--msize", "2", "--munit", "K", "--rm-input", "--no_rm"]) == 0
    assert os.path.getsize(g) == os.path.getsize(g + ".sorted") and os.path.exists(g + ".split.001")
