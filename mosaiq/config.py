"""Settings: a file of ``key = value`` lines, overridden by the command line."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, fields, replace

log = logging.getLogger("mosaiq")

#: Words for true and false, other spellings of keys, and keys that are read for nothing.
TRUE, FALSE = {"true", "1", "yes"}, {"false", "0", "no"}
LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warning": logging.WARNING, "error": logging.ERROR, "critical": logging.CRITICAL, "none": logging.CRITICAL + 10}
ALIASES = {"enable_lod": "enable_lod_generation", "enable_hlod_generation": "enable_hlod", "max_objects_per_tile": "quadtree_max_objects_per_tile", "quadtree_depth": "quadtree_max_depth"}


@dataclass(frozen=True)
class Settings:
    input_directory: str = ""
    output_directory: str = ""
    tolerance: float = 0.0
    normal_tolerance: float = 0.0
    skip_attribute_data_hash: tuple[str, ...] = ()
    instance_limit: int = 2
    merge_all_glb: bool = False
    mesh_segmentation: bool = False
    csv_directory: str = ""
    log_level: str = "info"
    enable_lod_generation: bool = False
    lod_level_count: int = 5
    target_screen_sse: float = 16.0
    lod4_size_tolerance: float = 0.05
    lod3_aspect_ratio_tolerance: float = 0.20
    enable_semantic_check: bool = True
    enable_geometric_check: bool = True
    semantic_data_path: str = ""
    enable_non_instanced_lod_generation: bool = False
    non_instanced_lod_level_count: int = 3
    non_instanced_lod_ratio: float = 0.5
    non_instanced_min_simplify_index_count: int = 300
    enable_hlod: bool = False
    quadtree_max_depth: int = 6
    quadtree_max_objects_per_tile: int = 50


KINDS = {f.name: type(getattr(Settings(), f.name)) for f in fields(Settings)}


def parse_bool(text: str) -> bool:
    word = text.strip().lower()
    if word not in TRUE | FALSE:
        raise ValueError(f"neither true nor false: {text!r}")
    return word in TRUE


def _value(key: str, text: str):
    kind = KINDS[key]
    if kind is bool:
        return parse_bool(text)
    if kind is tuple:
        return tuple(x.strip() for x in text.split(",") if x.strip())
    return kind(text.strip())


def from_lines(lines: list[str], base: Settings = Settings()) -> Settings:
    """Settings of a file's lines; ``#`` and ``;`` begin comments, unknown keys and bad values are warned of and passed over."""
    found = {}
    for line in lines:
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        key, sep, text = line.partition("=")
        key = ALIASES.get(key.strip(), key.strip())
        if not sep or key not in KINDS:
            log.warning("unknown setting: %s", line)
            continue
        try:
            found[key] = _value(key, text)
        except ValueError:
            log.warning("bad value: %s", line)
    return replace(base, **found)


def from_arguments(args: list[str], base: Settings = Settings()) -> Settings:
    """Settings of a command line over those of the file that ``--config`` names; an unknown flag ends the program."""
    p = argparse.ArgumentParser(prog="mosaiq", allow_abbrev=False)
    p.add_argument("--config")
    for key, kind in KINDS.items():
        flag = "--" + key.replace("_", "-")
        if kind is bool:
            p.add_argument(flag, nargs="?", const="true", dest=key)
        else:
            p.add_argument(flag, dest=key)
    given = vars(p.parse_args(args))
    if path := given.pop("config"):
        with open(path, encoding="utf-8") as f:
            base = from_lines(f.readlines(), base)
    try:
        return replace(base, **{k: _value(k, v) for k, v in given.items() if v is not None})
    except ValueError as e:
        p.error(str(e))


def set_log_level(name: str) -> None:
    log.setLevel(LEVELS.get(name.lower(), logging.INFO))
