import random

from pyspark.sql import functions as F

from lumaprof.functions import address as A
from lumaprof.functions import classify as C
from lumaprof.functions import metric_value as M
from lumaprof.functions import paths as P
from lumaprof.functions.columns import derived_columns, pmu_columns, raw_columns
from lumaprof.functions.names import dimension_metric_keys, spe_column_keys
from lumaprof.operators.lines import derived_metrics


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_fixed_text_rounds_the_binary_value(spark):
    random.seed(3)
    values = [n / 2 / 1e6 for n in range(1, 200)] + [k / 128 for k in range(1, 200)] + [
        random.random() * 10 ** random.randint(-8, 8) for _ in range(500)] + [0.0, 0.5, 1.5, 2.5, 1e18, -2.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", *[M.fixed_text(F.col("v"), d).alias(f"d{d}") for d in (0, 3, 6)]).collect()
    assert [(r.v, d) for r in rows for d in (0, 3, 6) if r[f"d{d}"] != f"{r.v:.{d}f}"] == []


def test_metric_states(spark):
    row = one(spark, zero=M.classify(M.number(F.lit(0.0))), negative=M.classify(M.number(F.lit(-1.0))),
              missing=M.classify(M.missing("x")), text=M.metric_text(M.undefined("x")), whole=M.metric_text(M.number(F.lit(7.0))),
              part=M.metric_text(M.number(F.lit(0.25))), absent=M.metric_text(F.lit(None).cast(M.TYPE)))
    assert tuple(row) == ("zero", "nonzero", "missing", "Undefined", "7", "0.250000", "0")


def test_row_status_needs_positive_numbers(spark):
    maps = [F.create_map(F.lit("a"), M.number(F.lit(-1.0)), F.lit("b"), M.missing("m")), F.create_map(F.lit("c"), M.undefined("u"))]
    row = one(spark, status=M.row_status(maps), flags=F.array_join(M.status_flags(maps), "|"), detail=M.row_detail(maps))
    assert row.status == "Missing|Undefined"
    assert row.flags == "nonzero|missing|undefined"
    assert row.detail == "a=-1; b=Missing; c=Undefined"


def test_derived_metrics_literals(spark):
    counts = {"cpu_cycles": 2000, "inst_retired": 1000, "l1d_cache_access": 100, "l1d_cache_refill": 10, "branch_retired": 50, "branch_mispredict": 5}
    metrics = derived_metrics({k: F.lit(v) for k, v in counts.items()}, 0.001)
    row = one(spark, **{k: v for k, v in metrics.items()})
    assert row.cpi.value == 2 and row.l1d_cache_hit_rate.value == 0.9 and row.branch_miss_rate.value == 0.1
    assert round(row.mips.value, 9) == 1 and round(row.mcps.value, 9) == 2 and row.mpki.value == 10
    assert row.l2d_cache_hit_rate.state == "missing"
    zero = derived_metrics({"cpu_cycles": F.lit(1), "inst_retired": F.lit(0)}, None)
    row = one(spark, cpi=zero["cpi"], mips=zero["mips"])
    assert (row.cpi.state, row.mips.state) == ("undefined", "missing")


def test_relative_addresses(spark):
    rel = lambda ip, start, end, bias, offset: A.relative(*[F.lit(x) for x in (ip, start, end, bias, offset)])
    row = one(spark, bias=rel(0x7684, 0x4000, 0x9000, 0x3000, 0), negative=rel(100, 0, 200, -50, 0), plain=rel(120, 100, 200, 0, 7),
              outside=rel(200, 100, 200, 0, 0), below=rel(10, 0, 50, 20, 0), tag=A.untagged(F.lit(-0x7FFFFF8957 - 1).cast("bigint")),
              hex=A.hex_text(F.lit(255)))
    assert (row.bias, row.negative, row.plain, row.outside, row.below, row.hex) == (0x4684, 150, 27, None, None, "0xff")
    assert row.tag >= 0


def test_column_plans():
    catalog = [("cpu_cycles", "pmu"), ("inst_retired", "pmu"), ("spe", "spe"), ("stall_backend", "pmu")]
    assert raw_columns(catalog) == ["cpu_cycles", "inst_retired", "stall_backend"]
    assert raw_columns(catalog, ["zz", "stall_backend", "aa"]) == ["stall_backend", "aa", "zz"]
    assert derived_columns(["cpu_cycles", "stall_backend"]) == ["mcps"]
    assert pmu_columns([])[:2] == ["cpu_cycles", "inst_retired"]
    assert len(spe_column_keys()) == 5 + 44 * 13
    assert dimension_metric_keys("class")[0] == "instruction_class.compute_int.sample_pct"
    assert len(dimension_metric_keys("kind")) == 130


def test_instruction_words(spark):
    words = {0xD503201F: ("system_instruction", None), 0xD5033BBF: ("system_instruction", None), 0xD50330BF: ("barrier_or_sync", None),
             0x94000001: ("branch", None), 0xF9800000: ("prefetch", "load_prefetch"), 0xF9400020: ("scalar_load", "load_scalar_single"),
             0xF9000020: ("scalar_store", None), 0xA9400440: ("scalar_load", "load_scalar_pair"), 0x3DC00020: ("vector_load", "load_vector_single"),
             0xC8DFFC20: ("acquire_release", "load_acquire"), 0x1E622820: ("compute_fp_simd", None), 0x8B020020: ("compute_int", None)}
    rows = spark.createDataFrame([(w,) for w in words], "w bigint").select("w", C.word_class(F.col("w")).alias("c")).collect()
    assert {r.w: (r.c["class"], r.c.kind) for r in rows} == words


def test_path_rules(spark):
    row = one(spark, root=P.remap(F.lit("/a/b"), F.lit("/a/b/"), F.lit("/x")), deep=P.remap(F.lit("C:\\w\\f.cpp"), F.lit("C:\\w"), F.lit("/s")),
              other=P.remap(F.lit("/q/f"), F.lit("/a"), F.lit("/x")), external=P.external_path(F.lit("/a:b/../c?d")),
              under=P.is_under(F.lit("/src2/f"), F.lit("/src")), skipped=P.in_skipped_directory(F.lit("a/Saved/f.cpp")),
              kept=P.in_skipped_directory(F.lit("a/Saved.cpp")), hidden=P.is_source_file(F.lit("/a/.cpp")))
    assert tuple(row) == ("/x", "/s/f.cpp", None, "external/a_b/_parent/c_d", False, True, False, False)
    assert P.parse_remaps(["a=b=c"]) == [("a", "b=c")]
    for bad in ("ab", "=b", "a="):
        try:
            P.parse_remaps([bad])
            raise AssertionError(bad)
        except ValueError:
            pass
