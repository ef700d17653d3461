"""Settings: defaults, TOML files, partial recovery."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


DEFAULT_PATH = Path.home() / ".config" / "lexispark" / "config.toml"


@dataclass(frozen=True)
class Server:
    max_limit: int = 64
    min_prefix: int = 1
    max_prefix: int = 60
    enable_filter: bool = True


@dataclass(frozen=True)
class Dict:
    max_words: int = 50_000
    chunk_size: int = 10_000
    min_frequency_threshold: int = 20
    min_frequency_short_prefix: int = 24
    max_word_count_validation: int = 1_000_000


@dataclass(frozen=True)
class Cli:
    default_limit: int = 24
    default_min_len: int = 1
    default_max_len: int = 24
    default_no_filter: bool = False


@dataclass(frozen=True)
class Config:
    server: Server = field(default_factory=Server)
    dict: Dict = field(default_factory=Dict)
    cli: Cli = field(default_factory=Cli)


def parse(text: str) -> Config:
    """A key of a wrong type keeps its default and the others count; text that is no TOML gives all defaults."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return Config()
    out = Config()
    for section in fields(Config):
        values, own = given.get(section.name), getattr(out, section.name)
        if isinstance(values, dict):
            good = {f.name: values[f.name] for f in fields(own) if f.name in values and type(values[f.name]) is type(getattr(own, f.name))}
            out = replace(out, **{section.name: replace(own, **good)})
    return out


def dump(config: Config) -> str:
    say = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return "\n".join(f"[{s}]\n" + "".join(f"{k} = {say(v)}\n" for k, v in values.items()) for s, values in asdict(config).items())


def load(path: str | Path | None = None, default: Path = DEFAULT_PATH) -> tuple[Config, Path | None]:
    """Settings and the file they come from: the given one, else the default one (made if missing), else built-in values."""
    if path is not None and Path(path).exists():
        return parse(Path(path).read_text()), Path(path)
    try:
        if not default.exists():
            rebuild(default)
        return parse(default.read_text()), default
    except OSError:
        return Config(), None


def rebuild(path: Path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(dump(Config()))


def update(config: Config, path: Path, **server) -> Config:
    """The settings with some of the server's changed, saved to the file."""
    changed = replace(config, server=replace(config.server, **server))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(dump(changed))
    return changed
