"""S1-S6, P1, P2, P4 on files and headers."""

import csv
import json
import random

import pytest
from conftest import one, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutorspark import schema
from tutorspark.sources.load import load_dataset, load_frame
from tutorspark.sources.normalize import apply_column_map, coerce_types, normalize_columns
from tutorspark.sources.positions import number_rows, with_position
from tutorspark.sources.profiles import parse_mapping_profile, profile_column_map
from tutorspark.sources.readers import MALFORMED, read_csv, read_json, read_table
from tutorspark.sources.writers import in_canonical_order, write_table

SESSION_HEADER = "student_id,session_topic,session_date,session_duration,tutor_id"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_schema_counts_and_metadata():
    assert len(schema.STUDENT_FIELDS) == 23
    assert len(schema.SESSION_FIELDS) == 6
    session, student = schema.standard("session"), schema.standard("student")
    assert session.names(required=True) == [
        "student_id", "session_topic", "session_date", "session_duration", "tutor_id",
    ]
    assert isinstance(student.struct["ell"].dataType, T.BooleanType)
    assert student.about("gender", "max_unique") == 5 and "ethnicity" in student.limited()
    assert student.canonical(" Free_Reduced_Lunch") == "economic_disadvantage" and student.canonical("x") is None
    assert student.used_by()["cost"][0] == "student_id" and list(session.used_by())[0] == "overview"
    with pytest.raises(ValueError):
        schema.standard("tutor")


def test_column_map_matches_trimmed_lower_case_names(table):
    df = table([("z9", 5, 1)], "`  PUPIL ` string, Room int, pupil_2 int")
    renamed, applied = apply_column_map(df, {" Pupil": "student_id", "ROOM": "", "absent": "tutor_id"})
    assert renamed.columns == ["student_id", "Room", "pupil_2"]
    assert applied == {"  PUPIL ": "student_id"}


def test_aliases_merge_by_first_non_blank_cell(table):
    df = table(
        [("  ", "3/4/2025", "b"), ("2025-03-05T08:15", "later", ""), (None, "", "c ")],
        "Session_DateTime string, session_date string, ` weather ` string",
    )
    merged, report = normalize_columns(df, "session")
    assert merged.columns == ["session_date", "weather"]
    assert rows(merged) == [("3/4/2025", "b"), ("2025-03-05T08:15", None), (None, "c")]
    assert report.combined_columns == {"session_date": ["Session_DateTime", "session_date"]}
    assert report.unknown_columns == ["weather"] and report.renamed() == {"session_date": ["Session_DateTime"]}


def test_two_columns_mapped_to_one_name_are_merged(table):
    df = table([(None, "2"), ("1", "9")], "a string, b string")
    renamed, _ = apply_column_map(df, {"a": "student_id", "b": "student_id"})
    merged, _ = normalize_columns(renamed, "student")
    assert rows(merged) == [("2",), ("1",)]


def test_names_differing_in_case_are_merged(spark, tmp_path):
    path = write(tmp_path / "s.csv", "Student_ID,student_id,minutes.raw", ",7,1", "8,9,2")
    loaded = load_dataset(spark, path, "session")
    assert rows(loaded.raw) == [("7", "1"), ("8", "2")]
    assert loaded.report.combined_columns == {"student_id": ["Student_ID", "student_id"]}


def test_coercion_keeps_id_text_and_types_the_rest(table):
    df = table(
        [("0e5", " pk", "n", "-12.25", "1e999", " as is "), ("1.50", "12.0", "2", ".5", "7,5", None)],
        "school_id string, current_grade_level string, iep string, math_outcome_measure_2 string, "
        "ela_outcome_measure_3 string, bus string",
    )
    assert rows(coerce_types(df, "student")) == [
        ("0e5", -1, False, -12.25, None, " as is "), ("1.50", 12, None, 0.5, None, None),
    ]


def test_coercion_of_typed_columns(table):
    df = table([("1", 4.0, False, float("nan"))], "student_id string, current_grade_level double, iep boolean, ela_outcome_measure_1 double")
    assert rows(coerce_types(df, "student")) == [("1", 4, False, None)]


def test_csv_load_with_old_headers(spark, tmp_path):
    """Every accepted old header of the standard, in reverse order, with cells that need work."""
    student = schema.standard("student")
    old = {alias: f.name for f in student.struct for alias in f.metadata["aliases"]}
    cells = {alias: "yes" if student.about(name, "kind") == "flag" else "" for alias, name in old.items()}
    cells |= {"sex": " Nonbinary", "math_state_score_current_year": "801.25", "performance_level_prior_year": "Level 2 "}
    cells |= {"PUPIL ": "0x1F", "current_grade_level": "KG"}
    header, line = reversed(cells), reversed(list(cells.values()))
    path = write(tmp_path / "st.csv", ",".join(header), ",".join(line))
    loaded = load_dataset(spark, path, "student", {"pupil": "student_id"})
    got = one(loaded.typed)
    assert (got["student_id"], got["gender"], got["current_grade_level"]) == ("0x1F", "Nonbinary", 0)
    assert got["math_outcome_measure_3"] == 801.25 and got["performance_level_previous"] == "Level 2"
    assert (got["ell"], got["economic_disadvantage"]) == (True, True) and got["ela_outcome_measure_1"] is None
    assert loaded.report.applied_column_map == {"PUPIL ": "student_id"} and not loaded.report.unknown_columns
    assert set(loaded.report.combined_columns) >= {"ell", "ela_outcome_measure_2"}


def test_csv_load_with_a_profile(spark, tmp_path):
    headers = {"Who": "student_id", "What": "session_topic", "When": "session_date", "How Long": "session_duration", "With": "tutor_id"}
    path = write(tmp_path / "se.csv", ",".join(headers), "007,Literacy,20250307,12.5,", "7,maths,7/3/2025 4:30 PM,0,x")
    profile = parse_mapping_profile(json.dumps({"dataset_profiles": {"session": {"custom_column_map": headers}}}))
    loaded = load_dataset(spark, path, "session", profile_column_map(profile, "session"))
    assert loaded.typed.columns == schema.standard("session").names(required=True)
    assert rows(loaded.typed) == [("007", "ela", "20250307", 12.5, None), ("7", "math", "7/3/2025 4:30 PM", 0.0, "x")]


def test_session_dates_stay_text(spark, tmp_path):
    dates = ["31-12-2024", "2025/1/2 7:05", "soon"]
    path = write(tmp_path / "s.csv", SESSION_HEADER, *(f"a,ela,{d},1,b" for d in dates))
    typed = load_dataset(spark, path, "session").typed
    assert isinstance(typed.schema["session_date"].dataType, T.StringType)
    assert [r[0] for r in rows(typed.select("session_date"))] == dates


def test_malformed_lines_are_marked(spark, tmp_path):
    path = write(tmp_path / "s.csv", "student_id,tutor_id", "1,a", "2,b,c", "3", '"4,x",d')
    assert rows(read_table(spark, path, mark=True)) == [("1", "a", None), ("2", "b", "2,b,c"), ("3", None, "3"), ("4,x", "d", None)]
    assert read_table(spark, path).columns == ["student_id", "tutor_id"]
    loaded = load_dataset(spark, path, "session")
    assert loaded.typed.columns == ["student_id", "tutor_id"] and loaded.typed.count() == 4


@pytest.mark.parametrize("columns", [None, ["student_id", "tutor_id"]])
def test_broken_json_lines_are_findings(spark, tmp_path, columns):
    path = write(tmp_path / "s.jsonl", '{"student_id": 1, "tutor_id": "a"}', '{"student_id": 2, ', '{"tutor_id": "c", "student_id": "03"}')
    loaded = load_dataset(spark, path, "session", columns=columns)
    assert loaded.report.unknown_columns == [] and loaded.raw.columns == ["student_id", "tutor_id"]
    found = {(r.row_num, r.rule, r.field) for r in loaded.validation.issues.collect()}
    assert found == {(3, "malformed_record", ""), (3, "missing", "student_id"), (3, "missing", "tutor_id")}


def test_findings_name_their_file(spark, tmp_path):
    folder = tmp_path / "two.csv"
    folder.mkdir()
    for name in ("a.csv", "b.csv"):
        write(folder / name, SESSION_HEADER, "1,gym,2025-01-02,5,t", "2,ela,2025-01-02,5,t")
    v = load_dataset(spark, str(folder), "session").validation
    issues = sorted((r.file.rsplit("/", 1)[1], r.row_num, r.rule) for r in v.issues.collect())
    assert issues == [("a.csv", 2, "unsupported_topic"), ("b.csv", 2, "unsupported_topic")]
    lines = [r.message for r in v.messages.filter("section = 71").orderBy("line").collect()]
    assert ["/a.csv: " in lines[0], "/b.csv: " in lines[1], len(lines)] == [True, True, 2]


def test_files_of_a_folder_agree_on_their_header(spark, tmp_path):
    folder = tmp_path / "two.csv"
    folder.mkdir()
    write(folder / "a.csv", "ID,id,topic", "1,,ela")
    write(folder / "b.csv", "topic,ID,id", "ela,1,")
    with pytest.raises(ValueError, match="b.csv"):
        read_table(spark, str(folder))


def test_a_large_first_record_of_a_json_array_gives_the_order(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('[ {"tutor_id": {"a": {"b": "}"}}, "student_id": "1"}, {"student_id": "2", "x": 1} ]')
    assert read_table(spark, str(path)).columns == ["tutor_id", "student_id", "x"]


def test_words_for_missing_stay_text_in_csv(spark, tmp_path):
    path = write(tmp_path / "s.csv", "student_id,tutor_id,note", "NA,nan,", '"a,b","say ""hi""",null')
    assert rows(read_table(spark, path)) == [("NA", "nan", None), ("a,b", 'say "hi"', "null")]


def test_repeated_headers_are_kept_apart(spark, tmp_path):
    path = write(tmp_path / "s.csv", "student_id,x,x", "1,2,3")
    assert read_table(spark, path).columns == ["student_id", "x", "x.1"]
    assert rows(load_dataset(spark, path, "session").raw) == [("1", "2", "3")]


def test_quoted_line_breaks_need_multi_line(spark, tmp_path):
    path = write(tmp_path / "s.csv", "student_id,note", '1,"two', 'lines"')
    assert rows(read_table(spark, path, multi_line=True)) == [("1", "two\nlines")]


@pytest.mark.parametrize("lines", [False, True])
def test_json_keeps_ids_and_key_order(spark, tmp_path, lines):
    records = [
        {"student_id": "00123", "session_duration": 45, "a_first": None, "session_topic": "math"},
        {"student_id": "4", "session_duration": 1.5, "late": True, "session_topic": None},
    ]
    path = tmp_path / ("s.jsonl" if lines else "s.json")
    path.write_text("\n".join(map(json.dumps, records)) if lines else json.dumps(records, indent=1))
    df = read_table(spark, str(path))
    assert df.columns[:4] == ["student_id", "session_duration", "a_first", "session_topic"]
    assert rows(df.select("student_id", "session_duration", "late")) == [("00123", "45", None), ("4", "1.5", "true")]


def test_unsupported_suffix(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/tmp/students.xlsx")


def test_profiles_reject_other_shapes():
    for text in ("[]", '{"version": 1}', '{"dataset_profiles": {"student": 3}}',
                 '{"dataset_profiles": {"session": {"custom_column_map": [1]}}}'):
        with pytest.raises(ValueError):
            parse_mapping_profile(text)
    assert profile_column_map(None, "student") == {}
    assert profile_column_map({"dataset_profiles": {"student": {}}}, "student") == {}
    ok = parse_mapping_profile('{"dataset_profiles": {"student": {"custom_column_map": {"No": 5}}}}')
    assert profile_column_map(ok, "student") == {"No": "5"}


def test_canonical_order_and_csv_round_trip(spark, table, tmp_path):
    df = table(
        [("T1", " x ", 7, None), ("T2", 'q"uote', 8, "math")],
        "tutor_id string, note string, student_id int, session_topic string",
    )
    assert in_canonical_order(df, "session").columns == ["student_id", "session_topic", "tutor_id", "note"]
    path = str(tmp_path / "out.csv")
    write_table(df, "session", path)
    assert sorted(rows(read_table(spark, path))) == [("7", None, "T1", " x "), ("8", "math", "T2", 'q"uote')]
    with pytest.raises(ValueError):
        write_table(df, "session", path, "orc")


def test_row_numbers_survive_splits_and_several_files(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for name, count in (("a.csv", 3000), ("b.csv", 700)):
        write(folder / name, "student_id,note", *(f"{name[0]}{i},{'x' * 40}" for i in range(count)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        positioned = with_position(read_table(spark, str(folder)))
        assert positioned.rdd.getNumPartitions() > 5
        numbered = rows(number_rows(positioned, positioned).select("student_id", "row_num"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(numbered) == 3700
    assert all(int(sid[1:]) + 2 == n for sid, n in numbered)


def test_row_numbers_without_a_file(spark):
    positioned = with_position(spark.range(0, 1000, 1, 7))
    assert all(r.row_num == r.id + 2 for r in number_rows(positioned, positioned).collect())


def test_load_frame_rejects_unknown_kind(table):
    with pytest.raises(ValueError):
        load_frame(table([("1",)], "student_id string"), "tutor")


def test_parquet_load(spark, table, tmp_path):
    path = str(tmp_path / "p.parquet")
    table([("1", "math", 30.0)], "student_id string, session_topic string, session_duration double").write.parquet(path)
    typed = load_dataset(spark, path, "session").typed
    assert rows(typed.select(F.col("session_duration") + 1)) == [(31.0,)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


CELLS = ["", "plain", "two\nlines", 'say ""x""', "a,b", '""', "\n\n", "é\u2028ü", " x ", "}{", "1.50", "long " * 90]


def test_quoted_line_breaks_in_many_tasks(spark, tmp_path, small_splits, plan_of):
    """The same rows as Python reads, whatever lies on a split, with a header over two lines and two files."""
    rng, want = random.Random(4), []
    for name, end in (("a.csv", "\n"), ("b.csv", "\n")):
        records = [[rng.choice(CELLS) for _ in range(3)] for _ in range(120)]
        lines = ['"x\ny",z,"w ""q"""'] + [",".join(f'"{c}"' if set(c) & set(',"\n') else c for c in r) for r in records]
        (tmp_path / name).write_text(end.join(lines) + end, encoding="utf-8")
        with open(tmp_path / name, newline="", encoding="utf-8") as file:
            header, *read = list(csv.reader(file))
        assert header == ["x\ny", "z", 'w "q"']
        want += [tuple(c or None for c in r) for r in read]
    df = read_csv(spark, str(tmp_path), multi_line=True)
    assert df.columns == ["x\ny", "z", 'w "q"'] and "SinglePartition" not in plan_of(df)
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10
    assert sorted(map(str, rows(df))) == sorted(map(str, want))
    marked = read_csv(spark, str(tmp_path), multi_line=True, mark=True)
    numbered = number_rows(marked, marked).select("row_num", "file").collect()
    assert sorted(r.row_num for r in numbered) == sorted([*range(2, 122)] * 2)


def test_records_that_do_not_fit_are_marked(spark, tmp_path):
    path = write(tmp_path / "s.csv", "a,b", '1,"x', 'y"', "2", "3,4,5", "", '6,"7"')
    got = rows(read_csv(spark, path, multi_line=True, mark=True).select("a", "b", MALFORMED))
    assert sorted(got) == [("1", "x\ny", None), ("2", None, "2"), ("3", "4", "3,4,5"), ("6", "7", None)]
    assert rows(read_csv(spark, write(tmp_path / "e.csv", "a,b"), multi_line=True)) == []


def compact(row):
    """Nested values without the white space between their parts, which only one of the readers keeps."""
    nested = [isinstance(c, str) and c[:1] in ("{", "[") and len(c) > 1 and c[-1] in "}]" for c in row]
    return str([json.dumps(json.loads(c)) if n else c for c, n in zip(row, nested)])


def test_json_array_in_many_tasks(spark, tmp_path, small_splits):
    """Nested objects, braces and quotes in strings, numbers as written, on one line or on many."""
    rng = random.Random(5)
    values = ["", "x", 'a "b" }{ ,', "\\", '\\"', "}", "{", "é\u2028", 1.5, 10**20, True, None, {"k": "}", "l": {"m": '"'}}, ["{", {"n": 1}], "long {" * 60]
    records = [{k: rng.choice(values) for k in ("id", "b.c", "d")} for _ in range(300)]
    for n, indent in enumerate((None, 2)):
        folder = tmp_path / str(n)
        folder.mkdir()
        (folder / "r.json").write_text(json.dumps(records, indent=indent, ensure_ascii=n == 0), encoding="utf-8")
        df = read_json(spark, str(folder / "r.json"), columns=["id", "b.c", "d", "absent"])
        whole = spark.read.option("multiLine", True).schema("id string, `b.c` string, d string, absent string").json(str(folder))
        assert df.columns == whole.columns
        assert sorted(map(compact, rows(df))) == sorted(map(compact, rows(whole))) and df.count() == 300
        marked = read_json(spark, str(folder / "r.json"), columns=["id"], mark=True)
        numbered = number_rows(marked, marked).collect()
        assert sorted(r.row_num for r in numbered) == [*range(2, 302)] and {r[MALFORMED] for r in numbered} == {None}
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "0")).rdd.getNumPartitions() > 10


def test_key_order_of_a_deep_first_record(spark, tmp_path):
    first = {"z": 1, **{f"k{n}": {"deep": {"deeper": n}} for n in range(100)}, "a": 2}
    path = tmp_path / "r.json"
    path.write_text(json.dumps([first, {"a": 1, "z": 2}]))
    columns = read_json(spark, str(path)).columns
    assert columns == list(first)
    (tmp_path / "e.json").write_text("[]")
    assert rows(read_json(spark, str(tmp_path / "e.json"), columns=["a"])) == []
