"""Reader of FITS binary tables as a Spark data source, without further libraries.

``spark.read.format("fits_table")`` reads the rows of one table extension, with those of others of
the same length beside them: rows belong together by position. Each partition is a range of rows
that is read by seeking in the file, so only its bytes are touched.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import from_arrow_schema

BLOCK = 2880
# Column codes of the format, as big-endian types.
_CODES = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
_ARROW = {"L": pa.bool_(), "B": pa.int16(), "I": pa.int16(), "J": pa.int32(), "K": pa.int64(), "E": pa.float32(), "D": pa.float64(), "A": pa.string()}
# The columns that are taken from each extension, and those that strict reading needs.
WANTED = {
    "RVTAB": (
        "TARGETID", "VRAD", "VRAD_ERR", "SN_R", "SN_B", "SN_Z", "RVS_WARN", "SUCCESS", "EXPID", "FIBER", "TEFF", "LOGG", "FEH", "VSINI", "RR_SPECTYPE",
        "VRAD_SKEW", "VRAD_KURT", "CHISQ_TOT", "CHISQ_C_TOT", "CHISQ_B", "CHISQ_C_B", "CHISQ_R", "CHISQ_C_R", "CHISQ_Z", "CHISQ_C_Z",
    ),
    "FIBERMAP": ("TARGETID", "EXPID", "MJD", "NIGHT", "FIBER", "FIBERSTATUS", "EXPTIME", "TARGET_RA", "TARGET_DEC", "GAIA_PHOT_G_MEAN_MAG", "PARALLAX", "TILEID"),
    "GAIA": ("SOURCE_ID", "RADIAL_VELOCITY", "RADIAL_VELOCITY_ERROR"),
}
STRICT = {
    "RVTAB": ("TARGETID", "VRAD", "VRAD_ERR", "SN_R", "RVS_WARN", "SUCCESS", "EXPID", "FIBER", "VSINI", "RR_SPECTYPE"),
    "FIBERMAP": ("TARGETID", "EXPID", "FIBER", "MJD", "NIGHT", "FIBERSTATUS", "TILEID"),
    "GAIA": ("SOURCE_ID",),
}
ALIGNED = ("TARGETID", "EXPID", "FIBER")


@dataclass(frozen=True)
class Table:
    """A binary table in a file: where its rows begin, and their columns as (name, code, width, offset)."""

    name: str
    start: int
    rows: int
    row_bytes: int
    columns: tuple[tuple[str, str, int, int], ...]


def _open(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


def _header(f) -> dict[str, str] | None:
    cards: dict[str, str] = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            return None
        for k in range(0, BLOCK, 80):
            card = block[k : k + 80].decode("ascii", "replace")
            name = card[:8].strip()
            if name == "END":
                return cards
            if card[8:10] == "= ":
                value = card[10:].strip()
                text = re.match(r"'((?:[^']|'')*)'", value)
                cards[name] = text[1].rstrip() if text else value.split("/")[0].strip()


def tables(path: str) -> list[Table]:
    """The binary tables of a file, from its headers alone."""
    out = []
    with _open(path) as f:
        while (cards := _header(f)) is not None:
            start, size = f.tell(), 0
            axes = int(cards.get("NAXIS", 0))
            if axes:
                size = abs(int(cards["BITPIX"])) // 8
                for k in range(1, axes + 1):
                    size *= int(cards[f"NAXIS{k}"])
                size += int(cards.get("PCOUNT", 0))
            if cards.get("XTENSION") == "BINTABLE":
                columns, at = [], 0
                for k in range(1, int(cards["TFIELDS"]) + 1):
                    count, code = re.match(r"(\d*)([A-Z])", cards[f"TFORM{k}"]).groups()
                    width = int(count) if count else 1
                    columns.append((cards[f"TTYPE{k}"].strip().upper(), code, width, at))
                    at += width * (1 if code in "AL" else np.dtype(_CODES[code]).itemsize if code in _CODES else {"C": 8, "M": 16, "P": 8, "Q": 16}.get(code, 1))
                out.append(Table(cards.get("EXTNAME", "").upper(), start, int(cards["NAXIS2"]), int(cards["NAXIS1"]), tuple(columns)))
            f.seek(start + -(-size // BLOCK) * BLOCK)
    return out


def _usable(table: Table) -> dict[str, tuple[str, int, int]]:
    wanted = WANTED.get(table.name)
    return {n: (c, w, o) for n, c, w, o in table.columns if (wanted is None or n in wanted) and c in _ARROW and (w == 1 or c == "A")}


def plan(path: str, strict: bool) -> list[tuple[Table, list[str]]]:
    """The tables to read with the columns each brings in; ValueError where something required is missing."""
    found = {t.name: t for t in tables(path)}
    if "RVTAB" not in found:
        if strict or not found:
            raise ValueError(f"{path} has no extension RVTAB")
        first = next(iter(found.values()))
        return [(first, list(_usable(first)))]
    if strict:
        for name, columns in STRICT.items():
            there = {c[0] for c in found[name].columns} if name in found else set()
            if missing := [c for c in columns if c not in there]:
                raise ValueError(f"{path} {name} lacks {', '.join(missing)}")
    out, seen = [], set()
    for name in ("RVTAB", "FIBERMAP", "GAIA"):
        if name not in found:
            continue
        if found[name].rows < found["RVTAB"].rows:
            raise ValueError(f"{path}: {name} has fewer rows than RVTAB")
        out.append((found[name], [c for c in _usable(found[name]) if c not in seen]))
        seen |= set(_usable(found[name]))
    return out


def read_rows(path: str, table: Table, columns: list[str], start: int, stop: int) -> dict[str, pa.Array]:
    """Columns of the rows start to stop."""
    usable = _usable(table)
    with _open(path) as f:
        f.seek(table.start + start * table.row_bytes)
        raw = np.frombuffer(f.read((stop - start) * table.row_bytes), np.uint8).reshape(-1, table.row_bytes)
    out = {}
    for name in columns:
        code, width, at = usable[name]
        size = width if code == "A" else np.dtype(_CODES[code]).itemsize
        part = np.ascontiguousarray(raw[:, at : at + size])
        if code == "A":
            out[name] = pa.array([bytes(r).split(b"\0")[0].decode("utf-8", "replace").strip() for r in part])
        elif code == "L":
            out[name] = pa.array(part[:, 0] == ord("T"))
        else:
            values = part.view(np.dtype(_CODES[code])).reshape(-1)
            out[name] = pa.array(values.astype(values.dtype.newbyteorder("=")), _ARROW[code])
    return out


@dataclass
class Rows(InputPartition):
    start: int
    stop: int


class FitsReader(DataSourceReader):
    def __init__(self, path: str, strict: bool, size: int, limit: int | None):
        self.path, self.size = path, size
        self.parts = plan(path, strict)
        self.rows = self.parts[0][0].rows if limit is None else min(limit, self.parts[0][0].rows)

    def partitions(self) -> list[Rows]:
        return [Rows(k, min(k + self.size, self.rows)) for k in range(0, self.rows, self.size)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.stop <= partition.start:
            return
        columns: dict[str, pa.Array] = {}
        first = read_rows(self.path, self.parts[0][0], [c for c in ALIGNED if c in _usable(self.parts[0][0])], partition.start, partition.stop)
        for table, names in self.parts:
            shared = [c for c in first if c in _usable(table)] if table is not self.parts[0][0] else []
            got = read_rows(self.path, table, [*names, *shared], partition.start, partition.stop)
            for c in shared:
                if not got[c].equals(first[c].cast(got[c].type)):
                    raise ValueError(f"row-alignment mismatch of {c} in {table.name}")
            columns |= {n: got[n] for n in names}
        columns["ROW_ID"] = pa.array(np.arange(partition.start, partition.stop, dtype=np.int64))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class FitsTable(DataSource):
    """Options: path; strict (true: required columns must be there); rowsPerPartition; maxRows."""

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def _options(self) -> tuple[str, bool]:
        return self.options["path"].removeprefix("file://"), self.options.get("strict", "false").lower() == "true"

    def schema(self) -> StructType:
        path, strict = self._options()
        fields = []
        for table, names in plan(path, strict):
            usable = _usable(table)
            fields += [pa.field(n, _ARROW[usable[n][0]]) for n in names]
        return from_arrow_schema(pa.schema([*fields, pa.field("ROW_ID", pa.int64())]))

    def reader(self, schema: StructType) -> FitsReader:
        path, strict = self._options()
        limit = self.options.get("maxrows") or self.options.get("maxRows")
        size = self.options.get("rowsperpartition") or self.options.get("rowsPerPartition") or 500_000
        return FitsReader(path, strict, int(size), int(limit) if limit else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsTable)
