"""Sample and instruction classifiers as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: sampling record fields ------------------------------------
OP_LOAD, OP_STORE, OP_BRANCH, OP_OTHER = 1, 2, 4, 8
DATA_SOURCES = {
    0x00: "l1", 0x08: "l2", 0x09: "peer_core", 0x0A: "peer_cluster",
    0x0B: "system_cache", 0x0C: "peer_cluster", 0x0D: "remote",
    0x0E: "dram", 0x0F: "io",
}


def _has(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == mask


def spe_category(operation_flags: Column, data_source: Column, branch_result: Column,
                 decode_status: Column) -> Column:
    """One of the 44 report categories."""
    level = F.lit("unknown")
    for code, name in DATA_SOURCES.items():
        level = F.when(data_source == code, F.lit(name)).otherwise(level)
    atomic_level = F.when(level == "io", F.lit("unknown")).otherwise(level)
    outcome = (F.when(branch_result == 1, F.lit("hit"))
               .when(branch_result == 2, F.lit("miss")).otherwise(F.lit("unknown")))
    return (
        F.when(decode_status != 0, F.lit("decode_unknown"))
        .when(_has(operation_flags, OP_LOAD | OP_STORE), F.concat(F.lit("atomic_"), atomic_level))
        .when(_has(operation_flags, OP_LOAD), F.concat(F.lit("load_"), level))
        .when(_has(operation_flags, OP_STORE), F.concat(F.lit("store_"), level))
        .when(_has(operation_flags, OP_BRANCH), F.concat(F.lit("branch_"), outcome))
        .when(_has(operation_flags, OP_OTHER), F.lit("compute_unknown"))
        .otherwise(F.lit("other_unknown"))
    )


def child_class(category: Column, instruction_class: Column) -> Column:
    """Class shown under a category; undecodable parents have no usable class."""
    return F.when(category.isin("decode_unknown", "other_unknown"),
                  F.lit("unknown_instruction")).otherwise(instruction_class)


# --- fixed values: AArch64 encodings, as (mask, value) pairs ------------------
BARRIER_WORDS = (0xD50330BF, 0xD50331BF, 0xD50332BF, 0xD50333BF, 0xD5033F9F)
BARRIER_PATTERNS = ((0xFFFFF0FF, 0xD503305F), (0xFFFFF0FF, 0xD503309F), (0xFFFFF0FF, 0xD50330DF))
SYSTEM_PATTERN = (0xFFC00000, 0xD5000000)
BRANCH_PATTERNS = (
    (0xFC000000, 0x14000000), (0xFC000000, 0x94000000),
    (0x7E000000, 0x34000000), (0x7E000000, 0x36000000),
    (0xFE000000, 0x54000000), (0xFE000000, 0xD6000000),
)
PREFETCH_PATTERNS = (
    (0xFFC00000, 0xF9800000), (0xFFE00C00, 0xF8800000),
    (0xFFE00C00, 0xF8A00000), (0xFF000000, 0xD8000000),
)
LOAD_STORE_PATTERNS = ((0x0E000000, 0x08000000), (0x0E000000, 0x0C000000))
EXCLUSIVE_PATTERN = (0x3F000000, 0x08000000)
PAIR_PATTERN = (0x3A000000, 0x28000000)
LITERAL_PATTERN = (0x1B000000, 0x18000000)
FP_SIMD_PATTERNS = ((0x0E000000, 0x06000000), (0x0E000000, 0x0E000000))
VECTOR_BIT, ACQUIRE_BITS, LOAD_BIT = 1 << 26, (1 << 23) | (1 << 15), 1 << 22
SIGN_EXTEND_BITS = (1 << 31) | (1 << 23)


def _match(word: Column, *patterns: tuple[int, int]) -> Column:
    found = F.lit(False)
    for mask, value in patterns:
        found = found | (word.bitwiseAND(F.lit(mask)) == value)
    return found


def word_class(word: Column) -> Column:
    """``struct<class, kind>`` of one 32-bit instruction word held in a long."""
    exclusive = _match(word, EXCLUSIVE_PATTERN)
    acquire = exclusive & _has(word, ACQUIRE_BITS)
    vector = _has(word, VECTOR_BIT)
    pair = _match(word, PAIR_PATTERN)
    literal = _match(word, LITERAL_PATTERN)
    load = literal | _has(word, LOAD_BIT)
    memory = _match(word, *LOAD_STORE_PATTERNS)
    prefetch = _match(word, *PREFETCH_PATTERNS)
    before_memory = (
        F.when(word.isin(*BARRIER_WORDS) | _match(word, *BARRIER_PATTERNS), F.lit("barrier_or_sync"))
        .when(_match(word, SYSTEM_PATTERN), F.lit("system_instruction"))
        .when(_match(word, *BRANCH_PATTERNS), F.lit("branch"))
        .when(prefetch, F.lit("prefetch"))
    )
    direction = F.when(load, F.lit("load")).otherwise(F.lit("store"))
    memory_class = (
        F.when(acquire, F.lit("acquire_release"))
        .when(exclusive, F.lit("atomic"))
        .otherwise(F.concat(F.when(vector, F.lit("vector_")).otherwise(F.lit("scalar_")), direction))
    )
    load_kind = (
        F.when(acquire, F.lit("load_acquire"))
        .when(exclusive, F.lit("load_atomic_exclusive"))
        .when(pair & vector, F.lit("load_vector_pair"))
        .when(pair, F.lit("load_scalar_pair"))
        .when(literal, F.lit("load_literal"))
        .when(vector, F.lit("load_vector_single"))
        .when(_has(word, SIGN_EXTEND_BITS), F.lit("load_sign_extend"))
        .otherwise(F.lit("load_scalar_single"))
    )
    compute = F.when(_match(word, *FP_SIMD_PATTERNS), F.lit("compute_fp_simd")).otherwise(
        F.lit("compute_int"))
    return F.struct(
        F.coalesce(before_memory, F.when(memory, memory_class).otherwise(compute)).alias("class"),
        F.when(before_memory == "prefetch", F.lit("load_prefetch"))
        .when(before_memory.isNull() & memory & load, load_kind).alias("kind"),
    )


# --- fixed values: mnemonic lists --------------------------------------------
BARRIERS = ("dmb", "dsb", "isb", "yield", "wfe", "wfi", "sev", "sevl")
SYSTEM = ("mrs", "msr", "sys", "sysl")
BRANCHES = ("b", "bl", "br", "blr", "ret", "cbz", "cbnz", "tbz", "tbnz")
ATOMICS = (
    "ldxr", "ldxrb", "ldxrh", "ldxp", "stxr", "stxrb", "stxrh", "stxp",
    "cas", "casa", "casal", "casl", "casb", "cash",
    "swp", "swpa", "swpal", "swpl",
    "ldadd", "ldadda", "ldaddal", "ldaddl", "ldclr", "ldeor", "ldset",
    "ldsmax", "ldsmin", "ldumax", "ldumin",
)
ACQUIRES = ("ldar", "ldarb", "ldarh", "ldapr", "ldaprb", "ldaprh")
RELEASES = ("stlr", "stlrb", "stlrh")
EXCLUSIVE_LOADS = ("ldxr", "ldxrb", "ldxrh", "ldxp", "ldaxr", "ldaxrb", "ldaxrh", "ldaxp")
SIGN_EXTENDING = ("ldrsb", "ldrsh", "ldrsw", "ldursb", "ldursh", "ldursw", "ldpsw")
INTEGER_OPS = (
    "add", "adds", "sub", "subs", "mul", "madd", "msub", "smull", "umull",
    "and", "ands", "orr", "eor", "bic", "lsl", "lsr", "asr", "ror",
    "mov", "movk", "movn", "movz", "cmp", "cmn", "tst", "sdiv", "udiv",
)
VECTOR_REGISTERS = "[vqdshb]"


def _base(mnemonic: Column) -> Column:
    return F.split(F.lower(F.trim(mnemonic)), r"\.", 2)[0]


def _vector_first(operands: Column) -> Column:
    return F.lower(operands).rlike(r"^\s*\{*\s*" + VECTOR_REGISTERS)


def mnemonic_class(mnemonic: Column, operands: Column) -> Column:
    """Instruction class of a disassembled instruction; first matching rule wins."""
    base = _base(mnemonic)
    vector = _vector_first(operands)
    width = F.when(vector, F.lit("vector_")).otherwise(F.lit("scalar_"))
    return (
        F.when(base.isin(*BARRIERS), F.lit("barrier_or_sync"))
        .when(base.isin(*SYSTEM), F.lit("system_instruction"))
        .when(base.rlike("^(aes|sha)|^pmull2?$"), F.lit("compute_crypto"))
        .when(base.isin(*BRANCHES), F.lit("branch"))
        .when(base == "prfm", F.lit("prefetch"))
        .when(base.isin(*ATOMICS), F.lit("atomic"))
        .when(base.isin(*ACQUIRES, *RELEASES), F.lit("acquire_release"))
        .when(base.rlike("^(ldr|ldur|ldp)"), F.concat(width, F.lit("load")))
        .when(base.rlike("^(str|stur|stp)"), F.concat(width, F.lit("store")))
        .when(base.rlike("^(f|scvtf|ucvtf)") | vector, F.lit("compute_fp_simd"))
        .when(base.isin(*INTEGER_OPS), F.lit("compute_int"))
        .otherwise(F.lit("unknown_instruction"))
    )


def mnemonic_load_kind(mnemonic: Column, operands: Column) -> Column:
    """Load kind of a disassembled instruction, or null when it is no load."""
    base = _base(mnemonic)
    shape = F.when(_vector_first(operands), F.lit("load_vector_")).otherwise(F.lit("load_scalar_"))
    return (
        F.when(base == "prfm", F.lit("load_prefetch"))
        .when(base.isin(*EXCLUSIVE_LOADS), F.lit("load_atomic_exclusive"))
        .when(base.isin(*ACQUIRES), F.lit("load_acquire"))
        .when(base.isin(*SIGN_EXTENDING), F.lit("load_sign_extend"))
        .when(base.isin("ldp", "ldnp"), F.concat(shape, F.lit("pair")))
        .when(base.rlike("^ldu?r") & ~operands.contains("["), F.lit("load_literal"))
        .when(base.rlike("^ldu?r"), F.concat(shape, F.lit("single")))
        .when(base.startswith("ld"), F.lit("load_unknown"))
    )
