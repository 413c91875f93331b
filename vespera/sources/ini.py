"""Sections of `key=value` lines; `;` and `#` begin comments, other lines are ignored."""

from __future__ import annotations

from pathlib import PurePosixPath

from vespera.types import EngineError, Metadata


def parse_ini(text: str) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    section = ""
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in ";#":
            continue
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip()
            out.setdefault(section, {})
        elif "=" in line:
            key, value = line.split("=", 1)
            out.setdefault(section, {})[key.strip()] = value.strip()
    return out


def parse_list(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]


def metadata_from_ini(path: str, text: str) -> Metadata:
    """A dataset's metadata; its name is the file's, without the ending."""
    own = parse_ini(text).get("dataset", {})
    try:
        numbers = {k: int(own[k]) for k in ("range_size", "accumulator_size", "dim") if k in own}
    except ValueError as e:
        raise EngineError(f"invalid number in {path}") from e
    if not parse_list(own.get("dirs", "")):
        raise EngineError("dirs must not be empty")
    return Metadata(name=PurePosixPath(path).stem, type=own.get("type", "f32"), dist_func=own.get("dist_func", "l1"), dirs=tuple(parse_list(own["dirs"])), **({"dim": 0} | numbers))


def metadata_to_ini(meta: Metadata) -> str:
    lines = ["[dataset]", f"dirs={','.join(meta.dirs)}", f"range_size={meta.range_size}", f"dim={meta.dim}", f"type={meta.type}", f"dist_func={meta.dist_func}", f"accumulator_size={meta.accumulator_size}"]
    return "\n".join(lines) + "\n"
