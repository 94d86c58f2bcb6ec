import gzip
import json
import math
import struct

import numpy as np
import pytest

from tessera.operators import frame
from tessera.sources import jsonio, npy, rdata, text
from tessera.streaming import queries as streams


def write(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content, newline="")
    return str(p)


def got(df):
    return [tuple(r) for r in df.collect()]


def test_csv(spark, tmp_path):
    df = text.read_csv(spark, write(tmp_path, "a.csv", "name,age,score\nAlice,30,95.5\n\nBob,25,88.0"))
    assert df.dtypes == [("name", "string"), ("age", "double"), ("score", "double")] and got(df) == [("Alice", 30, 95.5), ("Bob", 25, 88)]
    assert got(text.read_csv(spark, write(tmp_path, "b.csv", 'n,v\n"Smith, John",30\n"He said ""hi""",40\n'))) == [("Smith, John", 30), ('He said "hi"', 40)]
    assert text.read_csv(spark, write(tmp_path, "c.csv", "1;2\n3;4\n5;6\n"), header=False, delimiter=";").columns == ["col0", "col1"]
    assert got(text.read_csv(spark, write(tmp_path, "d.csv", "x\n1.5\nNA\n4.0\n"))) == [("1.5",), ("NA",), ("4.0",)]
    assert got(text.read_csv(spark, write(tmp_path, "e.csv", "x,y\n3,\n4,5\n")))[0] == (3.0, "")
    assert [math.isinf(r[0]) or r[0] for r in got(text.read_csv(spark, write(tmp_path, "f.csv", "x\n 0x10\n-inf\n1e3\n")))] == [16.0, True, 1000.0]
    with pytest.raises(Exception):
        text.read_csv(spark, write(tmp_path, "g.csv", "a,b\n1,2,3\n")).collect()
    with pytest.raises(text.FormatError):
        text.read_csv(spark, write(tmp_path, "h.csv", ""))


def test_csv_and_txt_written(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.0), ('q"q', 0.1), ("", 5.5)], "s string, x double").coalesce(1)
    text.write_csv_single(df, path := str(tmp_path / "out.csv"))
    assert open(path).read() == 's,x\n"a,b",1\n"q""q",0.1\n,5.5\n'
    assert got(text.read_csv(spark, path)) == [("a,b", 1.0), ('q"q', 0.1), ("", 5.5)]
    nums = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.5)], "a double, b double, c double").coalesce(1)
    text.write_txt_single(nums, path := str(tmp_path / "out.txt"))
    assert open(path).read() == "1 2 3\n4 5 6.5\n" and got(text.read_txt(spark, path)) == got(nums)
    assert got(text.read_txt(spark, write(tmp_path, "t.txt", "1.0\t2.0   3.0\n\n  4.0  5.0\t\t6.0  \n"))) == [(1, 2, 3), (4, 5, 6)]
    assert text.read_txt(spark, write(tmp_path, "u.txt", "a b\n1 2\n"), header=True).columns == ["a", "b"]
    with pytest.raises(text.FormatError):
        text.write_txt_single(df, path)


def test_npy(spark, tmp_path):
    a = np.array([[1.5, 2], [3, 4]])
    for name, arr in (("a", a), ("b", np.array([1.0, 2])), ("c", a.astype("<f4"))):
        np.save(tmp_path / f"{name}.npy", arr)
        assert np.array(got(npy.read_npy(spark, str(tmp_path / f"{name}.npy")))) == pytest.approx(arr.reshape(len(arr), -1))
    npy.write_npy(spark.createDataFrame([(2.0,), (1.0,)], "x double"), str(tmp_path / "w.npy"), "x")
    assert np.load(tmp_path / "w.npy").ravel().tolist() == [1, 2]
    for bad in (b"nope", (tmp_path / "a.npy").read_bytes()[:-4]):
        with pytest.raises(text.FormatError):
            npy._array(bad)
    np.save(tmp_path / "i.npy", np.arange(3))
    with pytest.raises(text.FormatError):
        npy._array((tmp_path / "i.npy").read_bytes())


def test_json():
    tree = jsonio.parse('{"lr": 0.05, "sizes": [2, 4, 1], "tanh": true, "note": null, "lr": 7}')
    assert jsonio.as_number(jsonio.get(tree, "lr")) == 7 and jsonio.array_len(tree["sizes"]) == 3 and jsonio.as_bool(tree["tanh"]) and jsonio.get(tree, "no") is None
    assert jsonio.write({"a": [1, 2.5, None, False], "b": 'x"\n\u0001'}) == '{"a":[1,2.5,null,false],"b":"x\\"\\n\\u0001"}'
    assert json.loads(jsonio.write(tree)) == tree
    for bad in ("{} x", "[1,", ""):
        with pytest.raises(jsonio.JsonError):
            jsonio.parse(bad)
    with pytest.raises(jsonio.JsonError):
        jsonio.as_string(1.0)


# --- a small writer of R's format, for the reader's tests ---


def _char(s):
    return struct.pack(">i", 9) + struct.pack(">i", -1) if s is None else struct.pack(">ii", 9 | 64 << 12, len(s.encode())) + s.encode()


def _sym(s):
    return struct.pack(">i", 1) + _char(s)


def _pairs(items):
    return b"".join(struct.pack(">i", 2 | 0x400) + _sym(k) + v for k, v in items) + struct.pack(">i", 254)


def _vec(code, body, n, attrs=()):
    return struct.pack(">ii", code | (0x200 if attrs else 0), n) + body + (_pairs(attrs) if attrs else b"")


def _real(xs, attrs=()):
    return _vec(14, struct.pack(f">{len(xs)}d", *xs), len(xs), attrs)


def _int(xs, attrs=(), code=13):
    return _vec(code, struct.pack(f">{len(xs)}i", *xs), len(xs), attrs)


def _str(xs, attrs=()):
    return _vec(16, b"".join(map(_char, xs)), len(xs), attrs)


def _workspace(items, version=2):
    head = b"RDX2\nX\n" + struct.pack(">iii", 2, 0, 0) if version == 2 else b"RDX3\nX\n" + struct.pack(">iiii", 3, 0, 0, 5) + b"UTF-8"
    return head + (_pairs(items) if items else struct.pack(">i", 254))


def test_rdata(spark, tmp_path):
    frame_ = _vec(19, _real([1.0, 2.5]) + _str(["a", None]) + _int([2, -(2**31)], [("levels", _str(["lo", "hi"])), ("class", _str(["factor"]))]) + _int([1, -(2**31)], code=10), 4,
                  [("names", _str(["x", "s", "f", "l"])), ("class", _str(["data.frame"])), ("row.names", _int([1, 2]))])
    cube = _real(list(map(float, range(12))), [("dim", _int([2, 3, 2])), ("dimnames", _vec(19, _str(["u", "v"]) + struct.pack(">i", 254) + struct.pack(">i", 254), 3))])
    matrix = _real([1.0, 2, 3, 4], [("dim", _int([2, 2]))])
    data = _workspace([("df", frame_), ("cube", cube), ("m", matrix)])
    (tmp_path / "w.RData").write_bytes(gzip.compress(data))
    path = str(tmp_path / "w.RData")
    rows = got(rdata.read_rdata(spark, path, "df"))
    assert rows[0] == (1.0, "a", "hi", 1.0) and rows[1][:3] == (2.5, "NA", "NA") and math.isnan(rows[1][3])
    assert got(rdata.read_rdata(spark, path, "m")) == [(1, 3), (2, 4)]
    sliced = rdata.read_rdata(spark, path, "cube", 1)
    assert sliced.columns == ["u", "v"] and got(sliced) == [(6, 7), (8, 9), (10, 11)]
    with pytest.raises(rdata.FormatError):
        rdata.read_rdata(spark, path)
    state = _real([4.0, 3.0, 1.0])
    info = struct.pack(">i", 2) + _sym("compact_intseq") + struct.pack(">i", 2) + _sym("base") + struct.pack(">i", 2) + _int([13]) + struct.pack(">i", 254)
    space = rdata.read_workspace(_workspace([("s", struct.pack(">i", 238) + info + state + struct.pack(">i", 254))], 3))
    assert space["s"].data.tolist() == [3, 4, 5, 6]
    assert rdata.read_workspace(_workspace([])) == {}
    for bad in (b"\xfd7zXZ\x00", data[:40], gzip.compress(data)[:-6]):
        with pytest.raises(rdata.FormatError):
            rdata.read_workspace(bad)


def test_frame(spark):
    df = frame.from_matrix(spark, [[1, 2], [3, 4.0]])
    assert df.columns == ["col0", "col1"] and frame.column_type(df, "col0") == "NUM" and frame.empty(spark, 3).count() == 3
    named = frame.set_row_names(df, ["a", "b"], "col0")
    assert frame.show(named.orderBy("col0")).split()[2:5] == ["a", "1.0000", "2.0000"]
    wide = frame.add_column(df, "s", ["x", "y"], "col0").orderBy("col0")
    assert [r.s for r in frame.string(wide, "s").collect()] == ["x", "y"] and frame.numeric(wide, "col1").count() == 2
    for bad in (lambda: frame.numeric(wide, "s"), lambda: frame.string(wide, "nope"), lambda: frame.add_column(df, "z", [1], "col0")):
        with pytest.raises(ValueError):
            bad()


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 10.0), (2, float("nan")), (3, 70.0)], "id int, x double").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id int, x double").parquet(str(tmp_path / "in"))
    q = streams.stream_sql(source, "SELECT id, x * 2 AS y FROM s WHERE x > 5").writeStream.format("memory").queryName("s_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(got(spark.table("s_out"))) == [(1, 20.0), (3, 140.0)]
    with pytest.raises(ValueError):
        streams.stream_sql(source, "SELECT SUM(x) AS s FROM s")
