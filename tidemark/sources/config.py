"""Store options and their files: store.yaml goes before store.json, that before store.ini; a missing file means defaults."""

from __future__ import annotations

import configparser
import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from ..schema import CF_SYSTEM, ConfigError

#: Parquet codecs by option value; bz2 has none.
CODECS = {"none": "none", "snappy": "snappy", "zlib": "gzip", "lz4": "lz4", "zstd": "zstd"}


def _checked(options) -> None:
    if options.compression not in CODECS:
        raise ConfigError(f"no such codec: {options.compression}")
    for f in fields(options):
        if f.type == "int" and getattr(options, f.name) <= 0:
            raise ConfigError(f"{f.name} must be positive")


@dataclass(frozen=True)
class FamilyOptions:
    """What one column family's files are like. filter_policy: none, or bloom (a Parquet Bloom filter on the key)."""

    target_file_rows: int = 5_000_000
    compression: str = "snappy"
    block_size: int = 4096
    restart_interval: int = 16
    filter_policy: str = "none"
    bits_per_key: int = 10

    def __post_init__(self):
        _checked(self)
        if self.filter_policy not in ("none", "bloom"):
            raise ConfigError(f"no such filter policy: {self.filter_policy}")


@dataclass(frozen=True)
class Options:
    """Runtime and open-only settings. user_cf holds for all families but the system family."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    write_buffer_size: int = 64 << 20
    max_write_buffer_number: int = 2
    level0_file_num_compaction_trigger: int = 4
    background: bool = False
    write_sync: bool = True
    checkpoint_edits: int = 50
    compression: str = "snappy"
    wal_dir: str = ""
    sst_dir: str = ""
    manifest_dir: str = ""
    user_cf: FamilyOptions = field(default_factory=FamilyOptions)
    system_cf: FamilyOptions = field(default_factory=FamilyOptions)

    def __post_init__(self):
        _checked(self)

    def of_family(self, cf: int) -> FamilyOptions:
        return self.system_cf if cf == CF_SYSTEM else self.user_cf


def _typed(kind: type, values: dict) -> dict:
    kinds, out = {f.name: f.type for f in fields(kind)}, {}
    for name, value in values.items():
        if name not in kinds:
            raise ConfigError(f"unknown option: {name}")
        try:
            if kinds[name] == "FamilyOptions":
                out[name] = FamilyOptions(**_typed(FamilyOptions, value))
            elif kinds[name] == "bool":
                out[name] = value if isinstance(value, bool) else {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[str(value).lower()]
            elif kinds[name] == "int":
                out[name] = int(value)
            else:
                out[name] = str(value) if name.endswith("_dir") else str(value).lower()
        except (KeyError, ValueError, AttributeError, TypeError) as e:
            raise ConfigError(f"bad value of {name}: {value}") from e
    return out


def from_file(values: dict) -> Options:
    """The schema of an options file: create_if_missing, the three directories, options, user_cf, system_cf, and write with sync, which goes before write_sync among options."""
    flat = dict(values)
    inner, write = flat.pop("options", {}) or {}, flat.pop("write", {}) or {}
    if set(write) - {"sync"}:
        raise ConfigError(f"unknown option: {sorted(set(write) - {'sync'})[0]}")
    options = _typed(Options, flat | inner)
    if "sync" in write:
        options |= _typed(Options, {"write_sync": write["sync"]})
    if "compression" in options:  # what holds for the store holds for its families, unless they say otherwise
        for cf in ("user_cf", "system_cf"):
            if "compression" not in (flat.get(cf) or {}):
                options[cf] = replace(options.get(cf, FamilyOptions()), compression=options["compression"])
    return Options(**options)


def load_options(folder: str) -> Options:
    """Read the first options file of a driver-local folder."""
    base = Path(folder)
    if (p := base / "store.yaml").exists():
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("store.yaml needs the yaml package") from e
        return from_file(yaml.safe_load(p.read_text()) or {})
    if (p := base / "store.json").exists():
        try:
            return from_file(json.loads(p.read_text()))
        except ValueError as e:
            raise ConfigError(f"{p}: {e}") from e
    if (p := base / "store.ini").exists():
        parser = configparser.ConfigParser()
        parser.read(p)
        named = ("options", "write", "user_cf", "system_cf")
        whole = {k: v for section in parser.sections() if section not in named for k, v in parser[section].items()}
        return from_file(whole | {n: dict(parser[n]) for n in named if parser.has_section(n)})
    return Options()
