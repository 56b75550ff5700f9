"""Readers and writers on files made here."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from panelwise.schemas import LAB_RESULTS, TRIAL_TABLES
from panelwise.sources import delimited, stages, studies, synthetic, xport

SUBJECTS = [
    "SUB1\t\t\tNot Hispanic or Latino\tFemale\tWhite\t\tHomo sapiens\t\t\t3133",
    "SUB2\t\t\t\tMale\tAsian\t\tHomo sapiens\t\t\t3133",
]
HEADER = "\t".join(f.name.upper() for f in TRIAL_TABLES["subject"].schema.fields)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_tab_file(spark, tmp_path):
    path = write(tmp_path / "t.txt", "col1\tcol2\n1\ta\n2\tb\n3\tc\n")
    df = delimited.read_delimited(spark, path)
    assert df.count() == 3 and df.dtypes == [("col1", "int"), ("col2", "string")]


@pytest.mark.parametrize("separator", ["\t", "~@@~", "~@~", ","])
def test_separators_bad_lines_and_types(spark, tmp_path, separator):
    lines = [["B", "a", "c"], ["1", "x", "2.5"], ["2", "y", "3.5", "too many"], ["3", "z"], ["no", "w", "nan"], ["5", "", ""]]
    path = write(tmp_path / "t.txt", "\n".join(separator.join(line) for line in lines) + "\n")
    schema = "A string, b int, C double, absent int"
    from pyspark.sql.types import _parse_datatype_string

    df = delimited.read_delimited(spark, path, _parse_datatype_string(schema))
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted([("x", 1, 2.5, None), ("z", 3, None, None), ("w", None, None, None), (None, 5, None, None)], key=str)


def test_missing_file_is_an_empty_table(spark, tmp_path):
    df = delimited.read_delimited(spark, str(tmp_path / "absent.txt"), TRIAL_TABLES["subject"].schema)
    assert df.isEmpty() and df.columns[0] == "subject_accession"


def test_dump_file(spark, tmp_path):
    record = "SUB203702~@~\\N~@~line one\nline two~@~Not Hispanic or Latino~@~Female~@~White~@~\\N~@~Homo sapiens~@~\\N~@~\\N~@~3133~@@~\n"
    path = write(tmp_path / "subject.txt", record + record.replace("203702", "203703"))
    rows = delimited.read_dump(spark, path, TRIAL_TABLES["subject"].schema).orderBy("subject_accession").collect()
    assert len(rows) == 2
    assert rows[0]["subject_accession"] == "SUB203702" and rows[0]["workspace_id"] == 3133
    assert rows[0]["ancestral_population"] is None and rows[0]["description"] == "line one\nline two"


def make_studies(root):
    tab = root / "Folder One" / "SDY1513-X_Tab" / "SDY1513-X_Tab" / "Tab"
    write(tab / "subject.txt", HEADER + "\n" + "\n".join(SUBJECTS) + "\n")
    write(
        tab / "immune_exposure.txt",
        "\t".join(f.name.upper() for f in TRIAL_TABLES["immune_exposure"].schema.fields) + "\nEX1\tARM1" + "\t" * 10 + "\tSUB1\n",
    )
    dump = "~@~".join(["OTHER"] + ["\\N"] * 9 + ["1"]) + "~@@~\n"
    # the first study has a dump too, which must not be read; the second has only a dump
    for study, folder in (("SDY1513", "Folder One"), ("SDY1520", "Folder Two")):
        write(root / folder / f"{study}-X_MySQL" / f"{study}-X_MySQL" / "MySQL" / "subject.txt", dump)
    lab_header = "\t".join(f.name for f in LAB_RESULTS.schema.fields)
    lab = [
        "SUB1\tA\t00\tMSL\tPEA\tIGE\tf13\t829\t\t0.5\t",
        "SUB1\tA\t04\tMSL\tPEA\tIGE\tf13\t-21\t\t1.5\t",
        "SUB1\tA\t00\tMSL\tTOT\tIGE\tf13\t829\t\t40\t",
    ]
    for place in ("StudyFiles", "StudyFiles/StudyFiles"):
        write(root / "Folder One" / place / "cf1_IgE.txt", "\n".join([lab_header, *lab]) + "\n")


def test_studies(spark, tmp_path):
    make_studies(tmp_path)
    tables = studies.read_studies(spark, str(tmp_path))
    subjects = tables["subject"].orderBy("subject_accession").collect()
    assert [(r["subject_accession"], r["study"]) for r in subjects] == [("OTHER", "SDY1520"), ("SUB1", "SDY1513"), ("SUB2", "SDY1513")]
    assert subjects[1]["ethnicity"] == "Not Hispanic or Latino" and subjects[2]["ethnicity"] is None
    lab = tables["lab_results"]
    assert lab.count() == 3 and {r["VISNO"] for r in lab.collect()} == {"00", "04"}
    assert tables["planned_visit"].isEmpty()
    joined = studies.trial_table(tables, ["PEA_IGE", "TOT_IGE"])
    got = {r["subject_accession"]: (r["study"], r["exposure_accession"], r["PEA_IGE"], r["TOT_IGE"]) for r in joined.collect()}
    assert got == {
        "SUB1": ("emp_123", "EX1", 1.0, 40.0),
        "SUB2": ("emp_123", None, None, None),
        "OTHER": ("peanut_epicutaneous", None, None, None),
    }


def ibm_double(value):
    """Eight bytes of a base-16 floating number."""
    if value is None:
        return b"." + b"\0" * 7
    if value == 0:
        return b"\0" * 8
    sign, value = (0x80, -value) if value < 0 else (0, value)
    exponent = 64
    while value >= 1:
        value, exponent = value / 16, exponent + 1
    while value < 1 / 16:
        value, exponent = value * 16, exponent - 1
    return struct.pack(">Q", ((sign | exponent) << 56) | int(value * (1 << 56)))


def xport_bytes(columns, data):
    """A transport file: columns are (name, is_text, width)."""
    date = b"01JAN24:00:00:00"
    mark = lambda name, tail: (f"HEADER RECORD*******{name:<8}HEADER RECORD!!!!!!!".encode() + tail)
    blank = b"0" * 30 + b"  "
    out = mark("LIBRARY", blank) + (b"SAS     SAS     SASLIB  9.4     LINUX   " + b" " * 24 + date) + date.ljust(80)
    out += mark("MEMBER", b"000000000000000001600000000140  ") + mark("DSCRPTR", blank)
    out += (b"SAS     DATA    SASDATA 9.4     LINUX   " + b" " * 24 + date) + date.ljust(80)
    out += mark("NAMESTR", f"000000{len(columns):04d}00000000000000000000  ".encode())
    names, place = b"", 0
    for i, (name, text, width) in enumerate(columns):
        names += struct.pack(
            ">hhhh8s40s8shhh2s8shhl52s", 2 if text else 1, 0, width, i + 1, name.encode().ljust(8), b" " * 40, b" " * 8,
            0, 0, 0, b"\0\0", b" " * 8, 0, 0, place, b"\0" * 52,
        )
        place += width
    out += names + b" " * (-len(names) % 80) + mark("OBS", blank)
    body = b"".join(
        v.encode().ljust(width) if text else ibm_double(v) for row in data for v, (_, text, width) in zip(row, columns)
    )
    return out + body + b" " * (-len(body) % 80)


def test_transport_files(spark, tmp_path):
    demo = tmp_path / "raw" / "DEMO_D.xpt"
    demo.parent.mkdir()
    demo.write_bytes(xport_bytes([("SEQN", False, 8), ("RIDAGEYR", False, 8)], [(1.0, 45.0), (2.0, 7.5)]))
    lab = tmp_path / "raw" / "AL_IGE_D.XPT"
    lab.write_bytes(
        xport_bytes([("SEQN", False, 8), ("LBXD1", False, 8), ("CODE", True, 8)], [(1.0, 0.35, "pos"), (2.0, None, ""), (3.0, -2.25, "neg")])
    )
    (tmp_path / "raw" / "MCQ_D.xpt").write_bytes(b"not a transport file")
    out = str(tmp_path / "tables")
    found = xport.convert_survey(spark, str(tmp_path / "raw"), out)
    assert found == ["AL_IGE_D", "DEMO_D"]
    assert spark.read.parquet(f"{out}/AL_IGE_D").dtypes == [("SEQN", "bigint"), ("LBXD1", "double"), ("CODE", "string")]
    joined = xport.read_survey(spark, out, ["DEMO_D", "AL_IGE_D"]).orderBy("SEQN").collect()
    assert [(r["SEQN"], r["LBXD1"], r["CODE"], r["RIDAGEYR"]) for r in joined] == [
        (1, 0.35, "pos", 45.0),
        (2, None, None, 7.5),
        (3, -2.25, "neg", None),
    ]
    problems = xport.xport_headers(spark, [str(tmp_path / "raw" / "MCQ_D.xpt")]).collect()
    assert len(problems) == 1 and problems[0]["problem"]


def test_synthetic_survey(spark):
    df = synthetic.synthetic_survey(spark, 5000)
    assert len(df.columns) == 22 and df.count() == 5000
    row = df.agg(
        F.avg("RIDAGEYR").alias("age"), F.min("RIDAGEYR").alias("low"), F.max("RIDAGEYR").alias("high"),
        F.avg(F.ln("LBXIGE")).alias("log_total"), F.stddev(F.ln("LBXIGE")).alias("log_std"),
        F.avg((F.col("LBXD1") >= 0.35).cast("int")).alias("d1"), F.corr(F.ln("LBXIGE"), F.ln("LBXD1")).alias("r"),
        F.corr("LBXD1", "LBXD2").alias("r2"), F.avg("INDFMPIR").alias("pir"),
    ).first()
    assert 44 < row["age"] < 46 and row["low"] == 2.0 and row["high"] == 85.0
    assert abs(row["log_total"] - 3.5) < 0.08 and abs(row["log_std"] - 1.2) < 0.08
    assert 0.14 < row["d1"] < 0.21 and row["r"] > 0.05 and abs(row["r2"]) < 0.1
    assert abs(row["pir"] - 2 * (1 - 2.718281828 ** -2.5)) < 0.1
    assert df.exceptAll(synthetic.synthetic_survey(spark, 5000).repartition(3)).isEmpty()


def test_synthetic_trial_and_fallback(spark):
    df = synthetic.synthetic_trial(spark, 50)
    assert len(df.columns) == 9 and df.count() == 50
    assert df.orderBy("subject_id").first()["subject_id"] == "SUB0001"
    assert synthetic.or_synthetic(None, lambda: df) is df
    assert synthetic.or_synthetic(df.limit(0), lambda: df) is df
    real = spark.range(1)
    assert synthetic.or_synthetic(real, lambda: df) is real


def test_reuse_depends_on_inputs_and_age(spark, tmp_path):
    folder = str(tmp_path / "reuse")
    a, b = spark.range(5), spark.range(6)
    assert stages.reuse(a, [a], "r", folder).count() == 5
    assert stages.reuse(b, [a], "r", folder).count() == 5  # same input: the stored copy
    assert stages.reuse(b, [b], "r", folder).count() == 6
    assert stages.reuse(spark.range(7), [a], "r", folder, ttl_hours=0).count() == 7


def test_tables_and_csv(spark, tmp_path):
    df = spark.range(4).withColumn("study", F.lit("s"))
    stages.save_table(df, str(tmp_path / "p"), partition_by=("study",))
    assert stages.load_table(spark, str(tmp_path / "p")).where("study = 's'").count() == 4
    stages.save_table(df, str(tmp_path / "c"), "csv")
    assert delimited.read_delimited(spark, stages.stage_path(spark, str(tmp_path / "c"))).count() == 4
    assert stages.load_optional(spark, str(tmp_path / "none"), df.schema).isEmpty()


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "stage")
    stages.save_table(spark.range(5), path)
    reading = stages.load_table(spark, path)  # a reader that has begun

    @F.udf("long")
    def breaks(i):
        if i == 3:
            raise RuntimeError("lost")
        return i

    with pytest.raises(Exception, match="lost"):
        stages.save_table(spark.range(9).select(breaks("id").alias("id")), path)
    assert stages.load_table(spark, path).count() == 5
    # A process that dies before the rename leaves an unnamed version behind.
    spark.range(7).write.parquet(f"{path}/version-00000000000000000000-x")
    assert stages.load_table(spark, path).count() == 5
    stages.save_table(spark.range(6), path)
    assert stages.load_table(spark, path).count() == 6 and reading.count() == 5
    stages.save_table(spark.range(8), path)
    assert sum(p.name.startswith("version-") for p in (tmp_path / "stage").iterdir()) == stages.KEPT_VERSIONS
    with pytest.raises(FileNotFoundError):
        stages.load_report(spark, str(tmp_path / "none"))


def spoil(path):
    """Other bytes under the same size and time: whoever reads the file notices."""
    import os

    state = os.stat(path)
    path.write_bytes(b"x" * state.st_size)
    os.utime(path, ns=(state.st_atime_ns, state.st_mtime_ns))


def test_reuse_reads_changed_files_only(spark, tmp_path):
    folder, data = str(tmp_path / "reuse"), tmp_path / "data"
    spark.range(0, 10, 1, 1).write.parquet(str(data))
    spark.range(10, 30, 1, 1).write.mode("append").parquet(str(data))
    files = sorted(data.glob("*.parquet"))
    load = lambda: spark.read.schema("id bigint").parquet(str(data))
    assert stages.reuse(spark.range(3), [load()], "r", folder).count() == 3
    kept = files[0].read_bytes()
    spoil(files[0])  # an unchanged file is not read at a hit
    assert stages.reuse(spark.range(4), [load()], "r", folder).count() == 3
    # Another file is there: it alone is read, and the copy no longer fits.
    spark.range(90, 95, 1, 1).write.mode("append").parquet(str(data))
    assert stages.reuse(spark.range(4), [load()], "r", folder).count() == 4
    new = next(p for p in data.glob("*.parquet") if p not in files)
    new.unlink()
    assert stages.reuse(spark.range(7), [load()], "r", folder).count() == 3  # as it was before
    # The same rows under a new time of change: read again, and still the same input.
    files[0].write_bytes(kept)
    import os

    os.utime(files[0], (1, 1))
    assert stages.reuse(spark.range(7), [load()], "r", folder).count() == 3
    # Frames with something done to them are read.
    assert stages.reuse(spark.range(8), [load().where("id > 5")], "r", folder).count() == 8


def test_final_report(spark):
    results = {"a": spark.range(2).withColumn("t", F.lit("x")), "empty": spark.range(0)}
    row = stages.final_report(spark, {"s": 1.0}, results, {"k": "v"}).first()
    assert row["results"] == {"a": ['{"id":0,"t":"x"}', '{"id":1,"t":"x"}'], "empty": []}
    assert row["settings"] == {"s": 1.0} and row["summary"] == {"k": "v"}
    assert stages.final_report(spark, {}, {}, {}).first()["results"] == {}


def test_rejects(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    lines = ["B,a,c", "1,x,2.5", "2,y,3.5,too many", "3,z", "no,w,nan", "5,,", "bad,v,worse"]
    path = write(tmp_path / "t.txt", "\n".join(lines) + "\n")
    schema = _parse_datatype_string("A string, b int, C double, absent int")
    rows, rejects = delimited.read_with_rejects(spark, path, schema)
    assert rows.exceptAll(delimited.read_delimited(spark, path, schema)).isEmpty() and rows.count() == 5
    got = sorted((r["line"], r["reason"], r["row_kept"]) for r in rejects.collect())
    assert got == [
        ("2,y,3.5,too many", "too many fields: 4 of 3", False),
        ("bad,v,worse", "C: 'worse' is no double", True),
        ("bad,v,worse", "b: 'bad' is no int", True),
        ("no,w,nan", "b: 'no' is no int", True),
    ]
    assert {r["file"].rsplit("/", 1)[-1] for r in rejects.collect()} == {"t.txt"}
    none, wrong = delimited.read_with_rejects(spark, str(tmp_path / "absent"), schema)
    assert none.isEmpty() and wrong.isEmpty() and none.columns == ["A", "b", "C", "absent"]


@pytest.fixture(scope="module")
def measured(spark):
    value = F.when(F.col("id") % 7 != 0, (F.col("id") - 500) / 3)
    return spark.range(0, 1000, 1, 2).select("id", value.alias("value"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("t é"), "id")).alias("text"))


def test_transport_in_ranges(spark, tmp_path, measured):
    """Each file is read by several tasks; rows end where the blanks of the last card begin."""
    folder = str(tmp_path / "out")
    xport.write_xport(measured, folder)
    paths = [str(p) for p in sorted((tmp_path / "out").glob("*.xpt"))]
    assert len(paths) == 2 and not list((tmp_path / "out").glob("*.tmp"))
    df = xport.read_xport(spark, paths, range_bytes=1000)
    assert df.rdd.getNumPartitions() > 10
    expected = measured.withColumn("id", F.col("id").cast("double"))
    assert df.exceptAll(expected).isEmpty() and expected.exceptAll(df).isEmpty()


def test_transport_without_ranges(spark, tmp_path, measured, monkeypatch):
    """A store that only Spark opens: the same rows."""
    xport.write_xport(measured, str(tmp_path))
    paths = [str(p) for p in sorted(tmp_path.glob("*.xpt"))]
    ranged = xport.read_xport(spark, paths).collect()
    monkeypatch.setattr(xport, "_store", lambda path: None)
    assert sorted(map(str, xport.read_xport(spark, paths).collect())) == sorted(map(str, ranged))


def test_transport_heads(tmp_path, monkeypatch):
    names = [(f"C{i}", bool(i % 2), 3 if i % 2 else 8) for i in range(40)]
    row = ["ab" if i % 2 else float(i) for i in range(40)]
    for n in (0, 1, 2, 7, 50):
        path = tmp_path / f"{n}.xpt"
        path.write_bytes(xport_bytes(names, [row] * n))
        for size in (80, 1000, 1 << 18):  # the header is longer than what is read first
            monkeypatch.setattr(xport, "HEAD_BYTES", size)
            columns, _, count = xport._head(str(path))
            assert [c.name for c in columns] == [c for c, _, _ in names] and count == n
    # One short column: blanks of the last card are no rows, blank rows before it are.
    path.write_bytes(xport_bytes([("T", True, 8)], [(" ",)] * 12 + [("x",)] * 3))
    assert xport._head(str(path))[2] == 15
    path.write_bytes(b"no transport file")
    with pytest.raises(ValueError, match="not a SAS"):
        xport._head(str(path))


def test_numbers_of_transport_files():
    import numpy as np

    r = np.random.default_rng(1)
    values = np.concatenate([r.normal(size=500) * 10.0 ** r.integers(-60, 60, 500), [0.0, 1.0, -1.0, 0.5, 16.0, 1 / 16, 1e-70, 255.999, np.nan, np.inf]])
    back = xport._doubles(xport._base16(values))
    assert np.array_equal(back[:-1], values[:-1], equal_nan=True) and np.isnan(back[-1])
    assert [bytes(c) for c in xport._base16(np.array([1.0, -2.5, 0.0]))] == [ibm_double(v) for v in (1.0, -2.5, 0.0)]
    with pytest.raises(ValueError, match="range"):
        xport._base16(np.array([1e80]))


def test_transport_refuses(spark, tmp_path):
    with pytest.raises(ValueError, match="eight"):
        xport.write_xport(spark.range(1).toDF("much_too_long"), str(tmp_path))
    with pytest.raises(Exception, match="more than 2 characters"):
        xport.write_xport(spark.createDataFrame([("abc",)], "t string"), str(tmp_path), {"t": 2})
    xport.write_xport(spark.range(0).toDF("n"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert xport.read_xport(spark, []).count() == 0
