"""Sessions: how many ranks compute and do I/O, defaults, error handling and timers."""

from __future__ import annotations

import atexit
import contextlib
import logging
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .errors import Code, GridError, Handler, require
from .functions.layout import BLOCKSIZE, io_ranks

log = logging.getLogger("meshlake")
BOX, SUBSET = "box", "subset"
#: Storage formats and whether each keeps classic limits (six types, one unlimited dimension, no storage options).
FORMATS = {"pnetcdf": True, "netcdf": True, "netcdf4c": False, "netcdf4p": False}
BUFFER_LIMIT = 128 << 20


@dataclass
class RearrangerOptions:
    """Accepted and checked for compatibility; Spark's shuffle does what they tune."""

    comm_type: str = "p2p"
    flow: str = "2denable"
    handshake: bool = False
    isend: bool = False
    max_pending: int = 64

    def __post_init__(self):
        require(self.comm_type in ("p2p", "coll") and self.flow in ("2denable", "1denable_comp2io", "1denable_io2comp", "2ddisable"), Code.EINVAL, "rearranger options")
        require(self.max_pending == -1 or self.max_pending >= 0, Code.EINVAL, "max_pending")


@dataclass
class Timer:
    calls: int = 0
    total: float = 0.0
    least: float = float("inf")
    most: float = 0.0


@dataclass
class GridSession:
    """`num_compute` logical compute ranks, of which `num_io` place and store data; ranks are values in columns, not processes."""

    spark: SparkSession
    num_compute: int = 4
    num_io: int = 1
    stride: int = 1
    base: int = 0
    rearranger: str = BOX
    handler: Handler = Handler.INTERNAL
    options: RearrangerOptions = field(default_factory=RearrangerOptions)
    blocksize: int = BLOCKSIZE
    buffer_limit: int = BUFFER_LIMIT
    hints: dict[str, str] = field(default_factory=dict)
    timers: dict[str, Timer] = field(default_factory=dict)
    components: list[int] = field(default_factory=list)
    open: bool = True

    def __post_init__(self):
        require(self.rearranger in (BOX, SUBSET), Code.EBADREARR, self.rearranger)
        io_ranks(self.num_compute, self.num_io, self.stride, self.base)

    @classmethod
    def with_components(cls, spark: SparkSession, num_io: int, components: list[int], **rest) -> list[GridSession]:
        """One session for each compute component; all share the I/O ranks, which are apart from the computing ones."""
        require(num_io > 0 and bool(components) and min(components) > 0, Code.EINVAL, "components")
        return [cls(spark, num_compute=max(n, num_io), num_io=num_io, components=list(components), **rest) for n in components]

    @property
    def ranks(self) -> list[int]:
        return io_ranks(self.num_compute, self.num_io, self.stride, self.base)

    def is_io(self, rank: int) -> bool:
        return rank in self.ranks

    def io_rank(self, rank: int) -> int:
        return self.ranks.index(rank) if rank in self.ranks else -1

    def set_hint(self, name: str, value: str) -> None:
        self.hints[name] = value

    def set_blocksize(self, size: int) -> None:
        require(size > 256, Code.EINVAL, "blocksize")
        self.blocksize = size

    def set_buffer_limit(self, size: int) -> int:
        old, self.buffer_limit = self.buffer_limit, size if size > 0 else self.buffer_limit
        return old

    def set_handler(self, handler: Handler) -> Handler:
        old, self.handler = self.handler, Handler(handler)
        return old

    def call(self, f: Callable, *args, **kwargs):
        """`f`'s result; its error code instead of an exception where the handler is RETURN."""
        try:
            return f(*args, **kwargs)
        except GridError as e:
            log.error("%s", e)
            if self.handler == Handler.RETURN:
                return e.code
            raise

    @contextlib.contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            took, t = time.perf_counter() - began, self.timers.setdefault(name, Timer())
            t.calls, t.total, t.least, t.most = t.calls + 1, t.total + took, min(t.least, took), max(t.most, took)

    def timer_table(self):
        rows = [(k, t.calls, t.total, t.least, t.most) for k, t in sorted(self.timers.items())]
        return self.spark.createDataFrame(rows, "name string, calls int, total double, least double, most double")

    def reset_timers(self) -> None:
        self.timers.clear()

    def finalize(self) -> None:
        self.open = False


def format_available(name: str) -> bool:
    return name in FORMATS


def set_log_level(level: int) -> None:
    """0 quiet, 1 errors, 2 warnings, 3 progress, more: everything."""
    log.setLevel({0: logging.CRITICAL, 1: logging.ERROR, 2: logging.WARNING, 3: logging.INFO}.get(max(0, level), logging.DEBUG))


#: The folder of local sessions that have set none.
_local: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share: `spark.checkpoint.dir`; a session in one process gets a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        require(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None, Code.EINVAL, "set spark.checkpoint.dir to a shared folder")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="meshlake-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = f"file://{_local[0]}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
