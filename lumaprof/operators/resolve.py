"""From runtime addresses to modules, symbols and source lines.

Every step works on *distinct* addresses, after aggregation and before the
results are joined back, so its cost follows the code size and not the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.functions import address as A
from lumaprof.functions import paths as P
from lumaprof.operators.lookup import first_containing, latest_before
from lumaprof.operators.reuse import cut

_MAP_COLUMNS = ["start", "end", "offset", "load_bias", "module_id"]


def _first_mapping(maps: DataFrame) -> DataFrame:
    """One row per mapping id: the earliest listed."""
    payload = F.struct("mapping_id", *_MAP_COLUMNS)
    return maps.groupBy("mapping_id").agg(F.min_by(payload, F.col("pos")).alias("m")).select("m.*")


def narrowest_mapping(ips: DataFrame, maps: DataFrame) -> DataFrame:
    """Per distinct ``ip``, the narrowest mapping holding it; earliest listed on a tie."""
    sized = maps.select("mapping_id", *_MAP_COLUMNS, "pos", (F.col("end") - F.col("start")).alias("_width"))
    return first_containing(ips, sized, "ip", "start", "end", ["_width", "pos"], ["mapping_id", *_MAP_COLUMNS])


def _relative() -> Column:
    return A.relative(F.col("ip"), F.col("start"), F.col("end"), F.col("load_bias"), F.col("offset"))


def to_module(addresses: DataFrame, maps: DataFrame) -> DataFrame:
    """``(mapping_id, ip)`` with module and relative address; both null when unmapped.

    A nonzero mapping id is final, even if the address lies outside it; only
    id 0 asks for a range lookup. Tags are masked first.
    """
    keys = cut(addresses.select("mapping_id", F.col("ip").alias("raw_ip")).distinct()).withColumn(
        "ip", A.untagged(F.col("raw_ip")))
    by_id = keys.filter("mapping_id <> 0").join(_first_mapping(maps), "mapping_id", "left")
    in_range = narrowest_mapping(keys.filter("mapping_id = 0"), maps).drop("mapping_id")
    by_range = keys.filter("mapping_id = 0").join(in_range, "ip", "left")
    rel = _relative()
    return by_id.unionByName(by_range).select(
        "mapping_id", F.col("raw_ip").alias("ip"),
        F.when(rel.isNotNull(), F.col("module_id")).alias("module_id"), rel.alias("rel"))


def to_named_module(ips: DataFrame, maps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call stack naming of distinct ips: range lookup only, tags kept, symbol name or ''."""
    distinct = ips.select("ip").distinct()
    found = narrowest_mapping(distinct, maps).withColumn("rel", _relative()).filter("rel is not null")
    named = symbol_names(found.select("module_id", "rel"), symbols)
    full = found.join(named, ["module_id", "rel"], "left").select(
        "ip", "mapping_id", "module_id", "rel", "name")
    return distinct.join(full, "ip", "left").select(
        "ip",
        F.coalesce("mapping_id", F.lit(0)).alias("mapping_id"),
        F.coalesce("module_id", F.lit("<unknown>")).alias("module"),
        F.coalesce("rel", "ip").alias("relative_address"),
        F.coalesce("name", F.lit("")).alias("function"))


def address_symbols(symbols: DataFrame) -> DataFrame:
    """One text symbol per (module, address): the smallest, with its same-name run's largest size."""
    usable = symbols.filter("address <> 0 and name <> ''").select(
        "module_id", "address", "size", "name").distinct()
    here = Window.partitionBy("module_id", "address")
    order = here.orderBy(F.desc("size"), "name")
    ranked = usable.withColumn("_rank", F.row_number().over(order)).withColumn(
        "_last", F.last("name").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # The run of the winning name starts after the last symbol with another name.
    ranked = ranked.withColumn(
        "_other", F.max(F.when(F.col("name") != F.col("_last"), F.col("_rank"))).over(here))
    run = ranked.filter(F.col("_rank") > F.coalesce("_other", F.lit(0)))
    return run.groupBy("module_id", "address").agg(
        F.max("size").alias("size"), F.first("name").alias("name"))


def symbol_names(addresses: DataFrame, symbols: DataFrame) -> DataFrame:
    """As-of symbol lookup for distinct ``(module_id, rel)``; rows without a symbol are null."""
    table = address_symbols(symbols)
    hit = latest_before(addresses, table, ["module_id"], "rel", "address", ["size", "name"])
    inside = (F.col("size") == 0) | (F.col("rel") < F.col("address") + F.col("size"))
    return hit.select("module_id", "rel", F.when(inside, F.col("name")).alias("name"))


def match_symbol_files(modules: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best symbol file per module: build id, then hint path, then soname and size, then file name.

    Candidates are reduced to one winner per lookup key before each join, so a
    build id or file name shared by many files never meets its modules pairwise.
    """
    files = candidates.select(
        F.col("path").alias("candidate_path"), F.col("build_id").alias("c_build_id"),
        F.coalesce("file_size", F.lit(0)).alias("c_size"), F.col("file_size").alias("real_size"),
        "has_debug_info", P.slashes(F.col("path")).alias("c_text"), P.base_name(F.col("path")).alias("c_name"))

    # Build id: debug info, then equal size, then larger file, then the last path.
    # The winner is the best file overall or the best one of the module's own size.
    rank = F.struct("has_debug_info", "c_size", "candidate_path")
    identified = files.filter("c_build_id is not null")
    overall = identified.groupBy("c_build_id").agg(F.max(F.struct(
        "has_debug_info", "c_size", "candidate_path", "real_size")).alias("best"))
    same_size = identified.filter("real_size is not null").groupBy("c_build_id", "real_size").agg(
        F.max(rank).alias("best"))
    equal = F.coalesce(F.col("file_size") == F.col("best.real_size"), F.lit(False))
    wanted = modules.select("module_id", "build_id", "file_size")

    def ranked(equal_size: Column) -> Column:
        return F.struct(F.col("best.has_debug_info"), equal_size.alias("same_size"),
                        F.col("best.c_size"), F.col("best.candidate_path"))

    exact = (
        wanted.join(overall, F.col("build_id") == F.col("c_build_id")).select("module_id", ranked(equal).alias("r"))
        .unionByName(
            wanted.join(same_size, (F.col("build_id") == F.col("c_build_id")) & (F.col("file_size") == F.col("real_size")))
            .select("module_id", ranked(F.lit(True)).alias("r")))
        .groupBy("module_id").agg(F.max("r").alias("r"))
        .select("module_id", F.lit(1).alias("tier"), F.lit("build_id").alias("quality"),
                "r.candidate_path", "r.has_debug_info"))

    def first_by(table: DataFrame, *keys: str) -> DataFrame:
        return table.groupBy(*keys).agg(F.min(F.struct("candidate_path", "has_debug_info")).alias("best"))

    def tier(number: int, quality: str, joined: DataFrame) -> DataFrame:
        return joined.select("module_id", F.lit(number).alias("tier"), F.lit(quality).alias("quality"),
                             "best.candidate_path", "best.has_debug_info")

    # A path ends with the hint iff its tail of the hint's length equals it: tails of the few lengths that hints have.
    lengths = modules.filter("debug_elf_candidate_path <> ''").agg(
        F.collect_set(F.length("debug_elf_candidate_path"))).scalar()
    tails = files.withColumn("_n", F.explode(lengths)).filter(F.col("_n") <= F.length("c_text")).withColumn(
        "_tail", F.substr(F.col("c_text"), F.length("c_text") - F.col("_n") + 1))
    hinted = tier(2, "user_path", modules.join(
        first_by(tails, "_tail"), F.col("debug_elf_candidate_path") == F.col("_tail")))
    by_soname = tier(3, "soname_and_size", modules.join(
        first_by(files.filter("real_size is not null"), "c_name", "real_size"),
        (F.col("soname") == F.col("c_name")) & (F.col("file_size") == F.col("real_size"))))
    by_name = tier(4, "file_name", modules.join(
        first_by(files, "c_name"), F.substring_index(F.col("runtime_path"), "/", -1) == F.col("c_name")))

    best = exact.unionByName(hinted).unionByName(by_soname).unionByName(by_name).groupBy("module_id").agg(
        F.min(F.struct("tier", "quality", "candidate_path", "has_debug_info")).alias("m"))
    return modules.join(best, "module_id", "left").select(
        "module_id", "runtime_path", "m.candidate_path",
        F.coalesce("m.quality", F.lit("missing")).alias("quality"),
        F.coalesce("m.has_debug_info", F.lit(False)).alias("has_debug_info"))


def with_symbol_file(addresses: DataFrame, matches: DataFrame) -> DataFrame:
    """Module match of resolved addresses; null without a symbol file."""
    return addresses.join(matches.select("module_id", "candidate_path"), "module_id", "left")


def to_line(addresses: DataFrame, line_table: DataFrame) -> DataFrame:
    """Distinct ``(module_id, rel)`` to ``file, line, function``; the innermost entry, never line 0."""
    entries = line_table.filter("line <> 0").select(
        "module_id", "lo", "hi", "file", "line", "function", (F.col("hi") - F.col("lo")).alias("_width"))
    best = first_containing(addresses, entries, "rel", "lo", "hi", ["_width", "lo", "file", "line", "function"],
                            ["file", "line", "function"], by=["module_id"])
    return best.withColumn("function", F.coalesce("function", F.lit("")))


def address_lines(addresses: DataFrame, maps: DataFrame, matches: DataFrame, line_table: DataFrame) -> DataFrame:
    """``(mapping_id, ip)`` to module and line; file is null for every address that stays unresolved."""
    placed = with_symbol_file(to_module(addresses, maps), matches)
    usable = placed.filter("candidate_path is not null and rel is not null")
    lines = to_line(usable, line_table)
    return placed.join(lines, ["module_id", "rel"], "left").withColumn(
        "file", F.when(F.col("candidate_path").isNotNull(), F.col("file")))


def unresolved(addresses: DataFrame, lane: str, address_label: str = "ip") -> DataFrame:
    """One warning per address that found no line."""
    lost = addresses.filter(F.col("file").isNull())
    return lost.select("mapping_id", "ip", F.concat(
        F.lit(f"Unresolved {lane} sample mapping="), F.col("mapping_id").cast("string"),
        F.lit(f" {address_label}="), A.hex_text(F.col("ip"))).alias("warning"))


def instruction_words(addresses: DataFrame, sections: DataFrame) -> DataFrame:
    """Little-endian word at each ``(module_id, rel)``; none where 4 bytes do not fit the section."""
    usable = sections.withColumn("size", F.least(F.col("size"), F.length("bytes"))).filter("size >= 4")
    spans = usable.select("module_id", F.col("address").alias("lo"), (F.col("address") + F.col("size") - 3).alias("hi"), "pos")
    hits = first_containing(addresses, spans, "rel", "lo", "hi", ["pos"], ["lo", "pos"], by=["module_id"])
    start = (F.col("rel") - F.col("lo")) * 2 + 1
    digits = F.hex("bytes")
    word = F.concat(*[F.substr(digits, (start + 2 * i).cast("int"), F.lit(2)) for i in (3, 2, 1, 0)])
    # Segments name a section by its position; its bytes are met only here.
    return hits.join(usable.select("module_id", F.col("address").alias("lo"), "pos", "bytes"), ["module_id", "lo", "pos"]).select(
        "module_id", "rel", F.conv(word, 16, 10).cast("bigint").alias("word"))


def exact_instruction(addresses: DataFrame, table: DataFrame) -> DataFrame:
    """Exact-address lookup in a disassembly table."""
    return addresses.join(table, ["module_id", "address"], "left")


def resolve_source_paths(files: DataFrame, known: DataFrame, roots: list[str], remaps: list[tuple[str, str]],
                         compile_dir: str | None = None) -> DataFrame:
    """Raw file name to an existing source path, by the first candidate that exists.

    Order: as is, under the compile directory, each remap, each root with the
    relative path and then the base name; then any known file of that base name
    (last listed); else the raw name. ``roots`` and ``remaps`` are report options.
    """
    raw = F.col("raw_file")
    is_relative = ~raw.startswith("/")
    name = P.base_name(raw)
    candidates = [raw]
    if compile_dir:
        candidates.append(F.when(is_relative, F.concat(F.lit(compile_dir.rstrip("/") + "/"), raw)))
    candidates += [P.remap(raw, F.lit(old), F.lit(new)) for old, new in remaps]
    for root in roots:
        prefix = F.lit(root.rstrip("/") + "/")
        candidates += [F.when(is_relative, F.concat(prefix, raw)), F.concat(prefix, name)]
    distinct = files.select("raw_file").distinct()
    ranked = distinct.select("raw_file", F.posexplode(F.array(*candidates)).alias("_pos", "path")).join(
        known.select("path").distinct(), "path")
    first = ranked.groupBy("raw_file").agg(F.min_by("path", "_pos").alias("direct"))
    named = known.groupBy(P.base_name(F.col("path")).alias("_name")).agg(F.max("path").alias("by_name"))
    return (
        distinct.withColumn("_name", name).join(first, "raw_file", "left").join(named, "_name", "left")
        .select("raw_file", F.coalesce("direct", "by_name", "raw_file").alias("file")))
