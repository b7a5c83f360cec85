"""Catalog of a dataset: dimensions, variables, attributes, and the define/data mode."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .errors import Code, require
from .session import FORMATS
from .types import grid_type

GLOBAL = -1
UNLIMITED = 0
MAX_NAME = 256
DEFLATE, SZIP, BZIP2, ZSTANDARD = "deflate", "szip", "bzip2", "zstandard"
#: Parquet codec for each storage filter; others are recorded only.
CODECS = {DEFLATE: "gzip", ZSTANDARD: "zstd"}
#: Registered numbers of the filters that have a codec.
FILTER_CODECS = {1: DEFLATE, 32015: ZSTANDARD}
QUANTIZE_MODES = ("none", "bitgroom", "granular_bitround", "bitround")


def _name_ok(name: str) -> None:
    require(bool(name), Code.EBADNAME, "empty name")
    require(len(name) <= MAX_NAME, Code.EMAXNAME, name[:20])
    require(not re.search(r"[/\x00-\x1f\x7f]", name) and not name.endswith(" "), Code.EBADNAME, name)


@dataclass
class Dimension:
    name: str
    size: int
    unlimited: bool = False


@dataclass
class Variable:
    name: str
    type: str
    dims: list[int]
    fill: object = None
    use_fill: bool = True
    storage: dict = field(default_factory=dict)
    record: int = -1
    written: bool = False


@dataclass
class Catalog:
    format: str = "netcdf4p"
    dims: list[Dimension] = field(default_factory=list)
    variables: list[Variable] = field(default_factory=list)
    atts: list[dict] = field(default_factory=list)
    defining: bool = True
    fill_mode: bool = True
    caches: dict = field(default_factory=dict)

    # Files

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, data: dict) -> Catalog:
        out = cls(**{**data, "dims": [Dimension(**d) for d in data["dims"]], "variables": [Variable(**v) for v in data["variables"]]})
        for v in out.variables:  # as files are checked when they are opened
            require(all(not out.dims[d].unlimited for d in v.dims[1:]), Code.EUNLIMPOS, v.name)
            v.record = -1  # the current record belongs to whoever has the dataset open
        return out

    @property
    def classic(self) -> bool:
        return FORMATS[self.format]

    # Modes

    def redef(self) -> None:
        require(not self.defining, Code.EINDEFINE)
        self.defining = True

    def enddef(self) -> None:
        require(self.defining, Code.ENOTINDEFINE)
        self.defining = False

    def _define(self) -> None:
        if self.classic:
            require(self.defining, Code.ENOTINDEFINE)
        self.defining = True  # newer formats enter define mode by themselves

    # Dimensions

    def def_dim(self, name: str, size: int) -> int:
        self._define()
        _name_ok(name)
        require(all(d.name != name for d in self.dims), Code.ENAMEINUSE, name)
        require(size >= 0, Code.EDIMSIZE, str(size))
        require(size != UNLIMITED or not self.classic or not self.unlimdims(), Code.EUNLIMIT, name)
        self.dims.append(Dimension(name, size, size == UNLIMITED))
        return len(self.dims) - 1

    def dim_id(self, name: str) -> int:
        found = next((i for i, d in enumerate(self.dims) if d.name == name), None)
        require(found is not None, Code.EBADDIM, name)
        return found

    def dim(self, dimid: int | str) -> Dimension:
        i = self.dim_id(dimid) if isinstance(dimid, str) else dimid
        require(0 <= i < len(self.dims), Code.EBADDIM, str(dimid))
        return self.dims[i]

    def rename_dim(self, dimid: int | str, name: str) -> None:
        _name_ok(name)
        d = self.dim(dimid)
        require(all(x.name != name for x in self.dims), Code.ENAMEINUSE, name)
        require(self.defining or not self.classic or len(name) <= len(d.name), Code.ENOTINDEFINE)
        d.name = name

    def unlimdims(self) -> list[int]:
        return [i for i, d in enumerate(self.dims) if d.unlimited]

    # Variables

    def def_var(self, name: str, type_name: str | int, dims: list[int | str]) -> int:
        self._define()
        _name_ok(name)
        t = grid_type(type_name)
        require(t.classic or not self.classic, Code.EBADTYPE, t.name)
        require(all(v.name != name for v in self.variables), Code.ENAMEINUSE, name)
        ids = [self.dims.index(self.dim(d)) for d in dims]
        require(all(not self.dims[d].unlimited for d in ids[1:]), Code.EINVAL, "only the first dimension may be unlimited")
        self.variables.append(Variable(name, t.name, ids))
        return len(self.variables) - 1

    def var_id(self, name: str) -> int:
        found = next((i for i, v in enumerate(self.variables) if v.name == name), None)
        require(found is not None, Code.ENOTVAR, name)
        return found

    def var(self, varid: int | str) -> Variable:
        i = self.var_id(varid) if isinstance(varid, str) else varid
        require(0 <= i < len(self.variables), Code.ENOTVAR, str(varid))
        return self.variables[i]

    def rename_var(self, varid: int | str, name: str) -> None:
        _name_ok(name)
        v = self.var(varid)
        require(all(x.name != name for x in self.variables), Code.ENAMEINUSE, name)
        v.storage.setdefault("folder", v.name)
        v.name = name

    def shape(self, varid: int | str) -> tuple[int, ...]:
        """Lengths of a variable's dimensions without the record dimension."""
        return tuple(self.dims[d].size for d in self.var(varid).dims if not self.dims[d].unlimited) or (1,)

    def is_record(self, varid: int | str) -> bool:
        ids = self.var(varid).dims
        return bool(ids) and self.dims[ids[0]].unlimited

    # Fill values

    def set_fill(self, mode: bool) -> bool:
        old, self.fill_mode = self.fill_mode, mode
        return old

    def def_var_fill(self, varid: int | str, use: bool, value=None) -> None:
        self._define()
        v = self.var(varid)
        require(not v.written, Code.ELATEFILL, v.name)
        v.use_fill = use or self.format == "netcdf"  # the serial classic format always fills
        v.fill = value
        if value is not None:
            self.put_att(varid, "_FillValue", v.type, [value])

    def var_fill(self, varid: int | str) -> tuple[bool, object]:
        """(whether holes are filled, the value: the variable's own or its type's)."""
        v = self.var(varid)
        return v.use_fill and self.fill_mode, grid_type(v.type).fill if v.fill is None else v.fill

    # Attributes

    def _owner(self, varid: int | str) -> int:
        return GLOBAL if varid == GLOBAL else self.variables.index(self.var(varid))

    def put_att(self, varid: int | str, name: str, type_name: str | int, values) -> None:
        _name_ok(name)
        owner, t = self._owner(varid), grid_type(type_name)
        require(t.classic or not self.classic, Code.EBADTYPE, t.name)
        values = [values] if isinstance(values, str) or not hasattr(values, "__iter__") else list(values)
        if t.low is not None:
            require(all(t.low <= v <= t.high for v in values), Code.ERANGE, name)
        if t.name in ("char", "string"):
            require(all(isinstance(v, str) for v in values), Code.ECHAR, name)
        else:
            require(not any(isinstance(v, str) for v in values), Code.ECHAR, name)
        old = next((a for a in self.atts if (a["var"], a["name"]) == (owner, name)), None)
        if old is None:
            require(self.defining or not self.classic, Code.ENOTINDEFINE)
            self.atts.append({"var": owner, "name": name, "type": t.name, "values": values})
        else:
            old |= {"type": t.name, "values": values}

    def att(self, varid: int | str, name: str) -> dict:
        owner = self._owner(varid)
        found = next((a for a in self.atts if (a["var"], a["name"]) == (owner, name)), None)
        require(found is not None, Code.ENOTATT, name)
        return found

    def get_att(self, varid: int | str, name: str, type_name: str | int | None = None) -> list:
        a = self.att(varid, name)
        if type_name is None:
            return list(a["values"])
        t, text = grid_type(type_name), ("char", "string")
        require((t.name in text) == (a["type"] in text), Code.ECHAR, name)
        if t.name in text:
            return list(a["values"])
        values = [float(v) if t.low is None else int(v) for v in a["values"]]
        require(t.low is None or all(t.low <= v <= t.high for v in values), Code.ERANGE, name)
        return values

    def att_names(self, varid: int | str) -> list[str]:
        owner = self._owner(varid)
        return [a["name"] for a in self.atts if a["var"] == owner]

    def rename_att(self, varid: int | str, name: str, new: str) -> None:
        _name_ok(new)
        require(new not in self.att_names(varid), Code.ENAMEINUSE, new)
        self.att(varid, name)["name"] = new

    def del_att(self, varid: int | str, name: str) -> None:
        require(self.defining or not self.classic, Code.ENOTINDEFINE)
        self.atts.remove(self.att(varid, name))

    # Storage options

    def storage(self, varid: int | str, **options) -> dict:
        """Set (or with no options, get) how a variable is stored; classic formats have none."""
        require(not self.classic, Code.ENOTNC4)
        v = self.var(varid)
        if options:
            require(not v.written, Code.ELATEDEF, v.name)
            for k, x in options.items():
                if k == DEFLATE:
                    require(0 <= x <= 9, Code.EINVAL, "deflate level")
                elif k == ZSTANDARD:
                    require(-131072 <= x <= 22, Code.EINVAL, "zstandard level")
                elif k == BZIP2:
                    require(1 <= x <= 9, Code.EINVAL, "bzip2 level")
                elif k == "chunks":
                    shape = [self.dims[d].size for d in v.dims]
                    require(len(x) == len(shape) and all(c > 0 and (n == 0 or c <= n) for c, n in zip(x, shape)), Code.EBADCHUNK)
                elif k == "endian":
                    require(x in ("native", "little", "big"), Code.EINVAL, "endian")
                elif k == "quantize":
                    require(x[0] in QUANTIZE_MODES and v.type in ("float", "double"), Code.EINVAL, "quantize")
            v.storage |= options
        return dict(v.storage)

    def chunk_cache(self, varid: int | str | None = None, **sizes) -> dict:
        require(not self.classic, Code.ENOTNC4)
        key = "all" if varid is None else self.var(varid).name
        require(all(x >= 0 for x in sizes.values()) and 0 <= sizes.get("preemption", 0) <= 1, Code.EINVAL, "chunk cache")
        return self.caches.setdefault(key, {}) | (self.caches[key].update(sizes) or {})

    def def_filter(self, varid: int | str, number: int, params: list[int] = ()) -> None:
        """Record a storage filter by its registered number; those with a Parquet codec take effect."""
        self.storage(varid, filters=[*self.var(varid).storage.get("filters", []), [number, list(params)]])
        if number in FILTER_CODECS:
            self.storage(varid, **{FILTER_CODECS[number]: params[0] if params else 1})

    def filter_ids(self, varid: int | str) -> list[int]:
        return [number for number, _ in self.storage(varid).get("filters", [])]

    def filter_info(self, varid: int | str, number: int) -> list[int]:
        found = next((p for n, p in self.storage(varid).get("filters", []) if n == number), None)
        require(found is not None, Code.EINVAL, f"filter {number}")
        return found

    def filter_available(self, number: int) -> bool:
        require(not self.classic, Code.ENOTNC4)
        return number in FILTER_CODECS

    def codec(self, varid: int | str) -> str:
        return next((CODECS[k] for k in self.var(varid).storage if k in CODECS), "snappy")

    # Tables

    def inquire(self) -> dict:
        return {"ndims": len(self.dims), "nvars": len(self.variables), "ngatts": len(self.att_names(GLOBAL)), "unlimdimids": self.unlimdims(), "unlimdimid": next(iter(self.unlimdims()), -1), "format": self.format}

    def dims_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, d.name, d.size, d.unlimited) for i, d in enumerate(self.dims)]
        return spark.createDataFrame(rows, "dimid int, name string, len bigint, is_unlimited boolean")

    def vars_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, v.name, v.type, v.dims, str(self.var_fill(i)[1]), self.var_fill(i)[0], len(self.att_names(i))) for i, v in enumerate(self.variables)]
        return spark.createDataFrame(rows, "varid int, name string, type string, dimids array<int>, fill string, use_fill boolean, natts int")

    def atts_table(self, spark: SparkSession) -> DataFrame:
        place: dict[int, int] = {}
        rows = []
        for a in self.atts:
            place[a["var"]] = place.get(a["var"], -1) + 1
            rows.append((a["var"], place[a["var"]], a["name"], a["type"], [str(v) for v in a["values"]]))
        return spark.createDataFrame(rows, "varid int, attnum int, name string, type string, values array<string>")
