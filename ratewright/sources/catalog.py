"""Published yearly files, and how they are fetched and checked."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass

SITE = "https://www.osha.gov/sites/default/files/"


@dataclass(frozen=True)
class DatasetFile:
    key: str
    year: int
    file: str
    local_name: str
    expected_bytes: int | None = None
    expected_sha256: str | None = None
    partial: bool = False

    @property
    def url(self) -> str:
        return SITE + self.file


# Year, published name, local name, bytes, SHA-256. The last is a year whose collection was still open.
FILES = """
2016 ITA%20Data%20CY%202016.zip ITA_Data_CY_2016.zip 12106381 9f41c720fb02f78788f1090e5fc885fdb09343fc349c4ae4c80cc9165d83742f
2017 ITA%20Data%20CY%202017.zip ITA_Data_CY_2017.zip 14682864 354fb246be90d6bac3d4a7c94e44f90d40f1d3ff73f911d37691ae98a87de0fb
2018 ITA%20Data%20CY%202018.zip ITA_Data_CY_2018.zip 16970794 0bd2e8475a5766baba8883a1258a92168c43c5ff551c853b1992641814b4dc2f
2019 ITA%20Data%20CY%202019.zip ITA_Data_CY_2019.zip 18898257 bf93ea7312bfe34d903c1272f15c785a61b8c8bbc6df6e09f0d3fe372205ac6e
2020 ITA-Data-CY-2020.zip ITA_Data_CY_2020.zip 19480392 eb704f2cc343adc7710b48204015ac11c3018fae684f44747158d731e713899b
2021 ITA-data-cy2021.zip ITA_Data_CY_2021.zip 19431073 5a11abc7c085f07f08f130c25bf78c85581b2379fb8b514f728bfcdf5d61b4a3
2022 ITA-data-cy2022.zip ITA_Data_CY_2022.zip 19730409 e396af8038d40d74b96ebb6ee9b561bbcb8907ee66adff089402a676c919e6ef
2023 ITA_300A_Summary_Data_2023_through_12-31-2024.zip ITA_300A_Summary_Data_2023_through_12-31-2024.zip 24143043 25da8bc426db219a7a5fe872e73830afebdfac87c460f8cf6561658e7103b487
2024 ITA_300A_Summary_Data_2024_through_12-31-2025.zip ITA_300A_Summary_Data_2024_through_12-31-2025.zip 23855931 4cbce7ea32dd4060f442a528670936e552d1b731925f320d9d25a168f9b60b1d
2025 ITA_300A_Summary_Data_2025_through_03-15-2026_v2.csv ITA_300A_Summary_Data_2025_through_03-15-2026_v2.csv 84600899 -
"""


def catalog(text: str = FILES) -> list[DatasetFile]:
    out = []
    for line in text.strip().splitlines():
        year, file, local, size, sha = line.split()
        partial = file.endswith(".csv")
        out.append(DatasetFile(f"ita_300a_{year}" + "_partial" * partial, int(year), file, local, int(size), None if sha == "-" else sha, partial))
    return out


def all_files(include_partial: bool = False) -> list[DatasetFile]:
    """The files in order of years; a partial year only if asked for."""
    return [f for f in catalog() if include_partial or not f.partial]


def by_key(key: str) -> DatasetFile:
    for f in catalog():
        if f.key == key:
            return f
    raise KeyError(key)


class DownloadError(RuntimeError):
    pass


def sha256_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fetch(f: DatasetFile, folder: str, get: Callable = urllib.request.urlopen, timeout: float = 60.0) -> dict:
    """One file, written beside its place and moved there when whole. A wrong size is an error, a wrong hash a warning in the record."""
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, f.local_name)
    if not (os.path.exists(target) and os.path.getsize(target) == f.expected_bytes):
        part = target + ".part"
        with get(f.url, timeout=timeout) as src, open(part, "wb") as out:
            while chunk := src.read(1 << 20):
                out.write(chunk)
        size = os.path.getsize(part)
        if not size or (f.expected_bytes is not None and size != f.expected_bytes):
            os.remove(part)
            raise DownloadError(f"{f.key}: {size} bytes, expected {f.expected_bytes}")
        os.replace(part, target)
    found = sha256_of(target)
    return asdict(f) | {"path": target, "sha256": found, "hash_matches": f.expected_sha256 is None or found == f.expected_sha256}


def fetch_all(folder: str, files: list[DatasetFile] | None = None, get: Callable = urllib.request.urlopen) -> list[dict]:
    """All files, and manifest.json with their records."""
    records = [fetch(f, folder, get) for f in files or all_files()]
    with open(os.path.join(folder, "manifest.json"), "w", encoding="utf-8") as out:
        json.dump(records, out, indent=1, sort_keys=True)
    return records


def require(folder: str, files: list[DatasetFile] | None = None) -> list[str]:
    """Paths of the catalogue's files, or FileNotFoundError with all that are missing."""
    paths = {f.key: os.path.join(folder, f.local_name) for f in files or all_files()}
    if missing := [k for k, p in paths.items() if not os.path.exists(p)]:
        raise FileNotFoundError(f"missing files: {missing}")
    return [*paths.values()]
