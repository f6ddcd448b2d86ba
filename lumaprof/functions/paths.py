"""Module and source path rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: platform module names and locations ------------------------
OS_MODULE_PREFIXES = ("memfd:", "mali", "android.", "androidx.", "com.android.")
OS_MODULE_PARTS = ("@resource-cache@", "(deleted)")
OS_MODULE_SUFFIXES = (".jar", ".odex", ".vdex", ".apk", ".map", ".val", ".txt")
OS_PATH_PREFIXES = (
    "/dev/", "/memfd:", "/mali", "/system/", "/system_ext/", "/vendor/",
    "/product/", "/apex/", "/odm/", "/oem/",
)
APP_PATH_PREFIXES = ("/data/app/", "/data/data/", "/data/user/", "/data/local/tmp/")

# --- fixed values: source discovery -------------------------------------------
SOURCE_EXTENSIONS = ("c", "cc", "cpp", "cxx", "h", "hpp", "hh", "inl")
SKIPPED_DIRECTORIES = (
    ".git", ".vs", "reports", "annotated_source", "Binaries",
    "DerivedDataCache", "Intermediate", "Saved", "Build", "target",
    "node_modules",
)
SKIPPED_DIRECTORY_PREFIX = "annotated_files"
SKIPPED_ROOT_PART = "/Engine/Source"


def _any(tests: list[Column]) -> Column:
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def is_os_module(module: Column, path: Column) -> Column:
    name, where = F.lower(module), F.lower(slashes(path))
    return _any(
        [name.startswith(p) for p in OS_MODULE_PREFIXES]
        + [name == "binder"]
        + [name.contains(p) for p in OS_MODULE_PARTS]
        + [name.endswith(s) for s in OS_MODULE_SUFFIXES]
        + [where.startswith(p) for p in OS_PATH_PREFIXES])


def is_app_native_module(module: Column, path: Column) -> Column:
    name, where = F.lower(module), F.lower(slashes(path))
    native = name.endswith(".so") | name.contains(".so.")
    return native & _any([where.startswith(p) for p in APP_PATH_PREFIXES])


def warns_without_symbols(module: Column, path: Column) -> Column:
    return is_app_native_module(module, path) & ~is_os_module(module, path)


def remap(path: Column, old: Column, new: Column) -> Column:
    """The path under its new prefix, or null when the old prefix does not apply."""
    text = slashes(path)
    prefix = F.rtrim(slashes(old), F.lit("/"))
    suffix = F.ltrim(F.substr(text, F.length(prefix) + 1), F.lit("/"))
    target = slashes(new)
    joined = F.when(suffix == "", target).otherwise(F.concat(target, F.lit("/"), suffix))
    return F.when(text.startswith(prefix), joined)


def parse_remaps(options: list[str]) -> list[tuple[str, str]]:
    """``from=to`` options; both sides must be non-empty."""
    pairs = []
    for option in options:
        old, sign, new = option.partition("=")
        if not sign:
            raise ValueError(f"path remap {option!r}: expected from=to")
        if not old or not new:
            raise ValueError(f"path remap {option!r}: both sides must be non-empty")
        pairs.append((old, new))
    return pairs


def absolute(root: Column, path: Column) -> Column:
    return canonical(F.when(path.startswith("/"), path).otherwise(
        F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path)))


def canonical(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` parts; links are not followed."""
    def add(kept: Column, part: Column) -> Column:
        return (F.when(part.isin("", "."), kept)
                .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
                .otherwise(F.concat(kept, F.array(part))))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), add)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def is_skipped_name(name: str) -> bool:
    return name in SKIPPED_DIRECTORIES or name.startswith(SKIPPED_DIRECTORY_PREFIX)


def is_source_file(path: Column) -> Column:
    # A leading dot alone makes a hidden file, not an extension.
    name = base_name(path)
    return name.rlike(r"^.+\.(" + "|".join(SOURCE_EXTENSIONS) + ")$")


def in_skipped_directory(relative_path: Column) -> Column:
    """Is any directory of a root-relative path one that discovery skips?"""
    directories = F.slice(F.split(relative_path, "/"), 1,
                          F.greatest(F.size(F.split(relative_path, "/")) - 1, F.lit(0)))
    return F.exists(directories, lambda d: d.isin(*SKIPPED_DIRECTORIES)
                    | d.startswith(SKIPPED_DIRECTORY_PREFIX))


def is_under(path: Column, root: Column) -> Column:
    """Component-wise prefix test."""
    trimmed = F.rtrim(root, F.lit("/"))
    return (path == trimmed) | path.startswith(F.concat(trimmed, F.lit("/")))


def external_path(path: Column) -> Column:
    """``external/`` plus the absolute path with unsafe characters replaced."""
    components = F.filter(F.split(path, "/"), lambda c: ~c.isin("", "."))
    safe = F.transform(components, lambda c: F.when(c == "..", F.lit("_parent")).otherwise(
        F.translate(c, '\\/:?*"<>|', "_" * 9)))
    return F.array_join(F.concat(F.array(F.lit("external")), safe), "/")
