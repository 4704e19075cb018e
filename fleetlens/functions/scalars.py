"""Scalar functions on paths, flags, scores and texts. All are built-in expressions but `args_literal`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# open(2) flag bits and names that mean writing, and the directories that count as sensitive.
ACCESS_MASK, WRITE_MODES, WRITE_BITS = 3, (1, 2), 64 | 512 | 1024
WRITE_NAMES = ("O_WRONLY", "O_RDWR", "O_CREAT", "O_TRUNC", "O_APPEND")
SENSITIVE_DIRS = ("etc", "tmp", "dev")
# Event names of the labelled corpus by class.
EVENT_CLASSES = {
    "execve": ("execve", "security_bprm_check"),
    "openat": ("open", "openat", "security_file_open", "stat", "lstat", "fstat", "access", "getdents64", "unlink", "unlinkat"),
    "connect": ("accept", "accept4", "bind", "connect", "getsockname", "listen", "socket"),
    "clone": ("clone", "dup", "dup2", "dup3", "prctl", "sched_process_exit"),
}
# Fixed value: what a kernel pointer looks like.
KERNEL_POINTER = r"(?i)\b(?:0x)?ffff[0-9a-f]{12}\b"


def path_prefix(path: Column) -> Column:
    """/a or /a/b of a path; '' for an empty or null one."""
    parts = F.slice(F.array_remove(F.split(F.coalesce(path, F.lit("")), "/"), ""), 1, 2)
    return F.when(F.size(parts) == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


def sensitive_dir(path: Column) -> Column:
    """etc, tmp or dev if the path is that directory or below it; else null."""
    out = F.lit(None).cast("string")
    for d in SENSITIVE_DIRS:
        out = F.when((path == f"/{d}") | path.startswith(f"/{d}/"), F.lit(d)).otherwise(out)
    return out


def write_intent_flags(flags: Column) -> Column:
    """Whether numeric open flags ask for writing; null asks for nothing."""
    whole = flags.cast("bigint")
    return F.coalesce(whole.bitwiseAND(F.lit(ACCESS_MASK)).isin(*WRITE_MODES) | (whole.bitwiseAND(F.lit(WRITE_BITS)) != 0), F.lit(False))


def write_intent_text(flags: Column) -> Column:
    return F.coalesce(flags.rlike("|".join(WRITE_NAMES)), F.lit(False))


#: Lists of dicts of the plain shape {'name': ..., 'type': ..., 'value': ...}, which patterns read exactly.
_ITEM = r"\{'name': '[^'\\{}]*+'(?:, 'type': '[^'\\{}]*+')?(?:, 'value': (?:'[^'\\{}]*+'|-?\d++(?:\.\d++)?|None|True|False))?\}"
PLAIN_ARGS = rf"^\[(?:{_ITEM}(?:, {_ITEM})*+)?\]$"


@F.pandas_udf(T.StructType([T.StructField("path", T.StringType()), T.StructField("flags", T.StringType())]))
def args_literal(args: pd.Series) -> pd.DataFrame:
    """Path and flags of any Python literal; null and '' of a broken one."""
    import ast

    def one(raw: str | None) -> tuple[str | None, str]:
        try:
            items = ast.literal_eval(raw or "")
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            items = []
        items = [x for x in items if isinstance(x, dict)] if isinstance(items, list) else []
        texts = lambda names: (x["value"] for x in items if x.get("name") in names and isinstance(x.get("value"), str))
        return next(texts(("pathname", "path")), None), next(texts(("flags",)), "")

    return pd.DataFrame([one(x) for x in args], columns=["path", "flags"])


def _from_args(args: Column, name: str, pattern: str) -> Column:
    """What the pattern finds in a list of the plain shape; other rows go to `args_literal`, which gets null for the rest."""
    plain = F.coalesce(args.rlike(PLAIN_ARGS), F.lit(False))
    return F.when(plain, F.regexp_extract(args, pattern, 1)).otherwise(args_literal(F.when(~plain, args))[name])


def args_path(args: Column) -> Column:
    """First text value of the item named pathname or path in a Python-literal list of dicts; null without one, and for
    a broken literal."""
    return F.nullif(_from_args(args, "path", r"\{'name': '(?:pathname|path)'[^{}]*'value': '([^']*)'\}"), F.lit(""))


def args_flags(args: Column) -> Column:
    """Text value of the item named flags; '' without one, and for a broken literal."""
    return F.coalesce(_from_args(args, "flags", r"\{'name': 'flags'[^{}]*'value': '([^']*)'\}"), F.lit(""))


def event_class(name: Column) -> Column:
    """execve, openat, connect or clone of a corpus event name; else none."""
    out = F.lit("none")
    for kind, names in EVENT_CLASSES.items():
        out = F.when(name.isin(*names), F.lit(kind)).otherwise(out)
    return out


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def threat_band(score: Column) -> Column:
    return F.when(~is_finite(score), F.lit("unscored")).when(score < 0.3, "low").when(score < 0.7, "medium").otherwise("high")


def alert_severity(score: Column) -> Column:
    return F.when(score >= 0.9, F.lit("high")).when(score >= 0.8, "medium").otherwise("low")


def redact_pointers(text: Column) -> Column:
    """Line breaks to spaces, kernel pointers to a mark."""
    return F.regexp_replace(F.translate(text, "\n", " "), KERNEL_POINTER, "[redacted-kernel-pointer]")


def clean_control(text: Column) -> Column:
    """Control characters (C0, DEL, C1) to U+FFFD."""
    return F.regexp_replace(text, "[\\x00-\\x1F\\x7F-\\x9F]", "�")


def shorten_path(path: Column, width: int) -> Column:
    """The path if it fits, else .../parent/base."""
    parts = F.array_remove(F.split(path, "/"), "")
    base, parent = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    short = F.when(parent.isNull(), F.concat(F.lit(".../"), base)).otherwise(F.concat(F.lit(".../"), parent, F.lit("/"), base))
    return F.when(F.coalesce(path, F.lit("")) == "", "unknown path").when(F.char_length(path) <= width, path).otherwise(F.coalesce(short, path))


def fmt_bytes(n: Column) -> Column:
    """Bytes, or KiB to TiB with one decimal."""
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", (n / 1024**k).cast("double")), F.lit(f" {unit}"))).otherwise(out)
    return out


def fmt_duration(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def fmt_percent(x: Column) -> Column:
    return F.concat(F.format_string("%.1f", x.cast("double")), F.lit("%"))


def finite_or_zero(x: Column) -> Column:
    return F.when(is_finite(x), x).otherwise(F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite_or_zero(x)))
