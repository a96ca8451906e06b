"""Thresholds of all operators, and the three profiles of them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Defaults are the balanced profile. ``date_prefix_is_log`` and ``bare_hunks`` widen two
    detections: a line that begins with an ISO date is no search hit, and a hunk header may
    have no text after it. ``log_max_errors``, the ``code_`` thresholds and
    ``ls_strip_month`` are part of the profiles, by which these are told apart, and change
    no reducer."""

    #: The defaults of all thresholds.

    min_compress_chars: int = 3000
    json_max_rows_before_drop: int = 200
    json_drop_head: int = 10
    json_drop_tail: int = 10
    json_columnar_min_rows: int = 5
    json_auto_columnar: bool = True
    log_min_repetitions: int = 3
    log_keep_first_last: bool = True
    log_max_errors: int = 30
    log_max_lines_total: int = 200
    code_max_function_lines: int = 15
    code_strip_comments: bool = True
    code_strip_blank_lines: bool = True
    code_max_file_lines: int = 200
    ls_strip_perms: bool = True
    ls_strip_owner: bool = True
    ls_strip_month: bool = False
    text_max_chars: int = 10000
    text_head_chars: int = 2000
    text_tail_chars: int = 2000
    # not part of a profile
    large_string_chars: int = 1000
    search_max_per_file: int = 5
    search_max_total: int = 30
    search_max_files: int = 15
    diff_max_context: int = 2
    diff_max_hunks: int = 10
    diff_max_files: int = 20
    history_threshold_chars: int = 50000
    history_keep_recent: int = 10
    history_candidate_chars: int = 100
    boundary_chars: int = 200
    store_max_entries: int = 500
    hash_length: int = 12
    date_prefix_is_log: bool = True
    bare_hunks: bool = True


#: What the other two profiles change.
PROFILES: dict[str, dict[str, object]] = {
    "conservative": {
        "min_compress_chars": 5000,
        "json_max_rows_before_drop": 999999,
        "json_drop_head": 50,
        "json_drop_tail": 50,
        "json_columnar_min_rows": 999999,
        "log_min_repetitions": 5,
        "log_max_errors": 50,
        "log_max_lines_total": 500,
        "code_max_function_lines": 999999,
        "code_strip_blank_lines": False,
        "code_max_file_lines": 999999,
        "text_max_chars": 999999,
        "text_head_chars": 5000,
        "text_tail_chars": 5000,
    },
    "balanced": {},
    "aggressive": {
        "min_compress_chars": 2000,
        "json_max_rows_before_drop": 50,
        "json_drop_head": 5,
        "json_drop_tail": 5,
        "json_columnar_min_rows": 3,
        "log_min_repetitions": 2,
        "log_max_errors": 15,
        "log_max_lines_total": 100,
        "code_max_function_lines": 8,
        "code_max_file_lines": 100,
        "text_max_chars": 5000,
        "text_head_chars": 1000,
        "text_tail_chars": 1000,
    },
}

#: The thresholds that a profile speaks of.
PROFILE_KEYS = [f.name for f in fields(Config)][:20]


def profile(name: str, base: Config = Config()) -> Config:
    """``base`` with a profile's thresholds; an unknown name is a ValueError."""
    if name not in PROFILES:
        raise ValueError(f"no profile {name!r}; there are {', '.join(PROFILES)}")
    default = asdict(Config())
    return replace(base, **({k: default[k] for k in PROFILE_KEYS} | PROFILES[name]))


def overridden(given: dict[str, str], base: Config = Config()) -> Config:
    """``base`` with thresholds given as text; an unknown name is a ValueError."""
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(Config)}
    unknown = set(given) - set(kinds)
    if unknown:
        raise ValueError(f"no threshold {', '.join(sorted(unknown))}")
    return replace(base, **{k: v.strip().lower() == "true" if kinds[k] is bool else int(v) for k, v in given.items()})


def from_file(path: str, base: Config = Config()) -> Config:
    """Thresholds of a file with a ``name: value`` on each line; ``profile`` names the base, ``#`` begins a comment."""
    with open(path, encoding="utf-8") as f:
        lines = [line.split("#")[0].strip() for line in f]
    given = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}
    named = given.pop("profile", None)
    return overridden(given, profile(named, base) if named else base)


def from_session(spark, base: Config = Config()) -> Config:
    """Thresholds that the session sets as ``textmill.<name>``."""
    given = {f.name: spark.conf.get(f"textmill.{f.name}", None) for f in fields(Config)}
    return overridden({k: v for k, v in given.items() if v is not None}, base)


def profile_rows() -> list[tuple[str, str, str]]:
    """All profiles as (profile, key, value) rows."""
    return [(name, k, str(asdict(profile(name))[k]).lower()) for name in PROFILES for k in PROFILE_KEYS]
