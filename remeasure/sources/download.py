"""Download of public files with resumption and checks; the opener can be replaced."""

from __future__ import annotations

import hashlib
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class RemoteFile:
    url: str
    name: str
    size: int | None = None
    md5: str | None = None


def digest(path: Path, algorithm: str = "md5") -> str:
    """The hex digest of a file, read in pieces."""
    with path.open("rb") as f:
        return hashlib.file_digest(f, algorithm).hexdigest()


def check(path: Path, file: RemoteFile) -> None:
    """ValueError unless size and digest are as stated."""
    if file.size is not None and path.stat().st_size != file.size:
        raise ValueError(f"{file.name}: {path.stat().st_size} bytes instead of {file.size}")
    if file.md5 and digest(path) != file.md5:
        raise ValueError(f"{file.name}: MD5 mismatch")


def fetch(file: RemoteFile, folder: Path, resume: bool = True, opener: Callable = urllib.request.urlopen, piece: int = 1 << 20) -> Path:
    """The file in ``folder``; a part from before is completed if the server allows it, else fetched anew."""
    target, part = folder / file.name, folder / f"{file.name}.part"
    folder.mkdir(parents=True, exist_ok=True)
    if target.exists():
        check(target, file)
        return target
    have = part.stat().st_size if resume and part.exists() else 0
    request = urllib.request.Request(file.url, headers={"Range": f"bytes={have}-"} if have else {})
    try:
        with opener(request) as response:
            # a server that ignores the range sends all of it
            more = have and getattr(response, "status", 200) == 206
            with part.open("ab" if more else "wb") as out:
                while data := response.read(piece):
                    out.write(data)
    except urllib.error.HTTPError as error:
        if error.code != 416:  # nothing is missing
            raise
    check(part, file)
    part.rename(target)
    return target


def fetch_all(files: list[RemoteFile], folder: Path, resume: bool = True, fetcher: Callable = fetch) -> list[Path]:
    return [fetcher(f, folder, resume=resume) for f in files]
