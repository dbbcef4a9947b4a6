"""Downloads source files into a cache and tells what they are."""

from __future__ import annotations

import re
from pathlib import Path
from urllib.parse import urlparse
from urllib.request import Request, urlopen

#: Fixed values (patterns): how source files are named.
KIND_NAME, VERSION_NAME = re.compile(r"master_(\d+)_\d{8}\.pdf$"), re.compile(r"(\d{8})")
KINDS = {"0": "master", "1": "master", "2": "appendix"}


def file_name(url: str) -> str:
    name = Path(urlparse(url).path).name
    if not name.endswith(".pdf"):
        raise ValueError(f"URL does not look like a PDF: {url}")
    return name


def kind_of(name: str, given: str | None = None) -> str:
    """master or appendix: the one given, else by the number in the name."""
    if given:
        return given
    found = KIND_NAME.search(name)
    if not found:
        raise ValueError(f"could not detect the kind from {name!r}\nhint: pass --kind master|appendix")
    if found[1] not in KINDS:
        raise ValueError(f"unknown number {found[1]} in {name!r}\nhint: pass --kind master|appendix")
    return KINDS[found[1]]


def version_of(name: str, given: str | None = None) -> str:
    """The version: the one given, else the first eight digits of the name."""
    found = VERSION_NAME.search(Path(name).stem)
    if not given and not found:
        raise ValueError(f"could not infer the version (YYYYMMDD) from {name!r}\nhint: pass --version YYYYMMDD")
    return given or found[1]


def cached(url: str, folder: Path, force: bool = False) -> tuple[Path, bool]:
    """The file of a URL in the folder, and whether it was downloaded now. It appears there only when it is whole."""
    path = folder / file_name(url)
    if path.exists() and not force:
        return path, False
    folder.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.part")
    with urlopen(Request(url, headers={"User-Agent": "kumiko"})) as answer, part.open("wb") as out:
        while chunk := answer.read(1 << 20):
            out.write(chunk)
    part.replace(path)
    return path, True
