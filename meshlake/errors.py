"""Error codes and what happens on an error."""

from __future__ import annotations

from enum import IntEnum

# Public netCDF error numbers, and the engine's own from -500 on.
_CODES = {
    "NOERR": (0, "No error"),
    "EBADID": (-33, "Bad dataset id"), "ENFILE": (-34, "Too many datasets open"), "EEXIST": (-35, "Dataset exists and may not be replaced"),
    "EINVAL": (-36, "Invalid argument"), "EPERM": (-37, "Write to a read-only dataset"), "ENOTINDEFINE": (-38, "Not in define mode"),
    "EINDEFINE": (-39, "In define mode"), "EINVALCOORDS": (-40, "Index exceeds dimension bound"), "EMAXDIMS": (-41, "Too many dimensions"),
    "ENAMEINUSE": (-42, "Name in use"), "ENOTATT": (-43, "Attribute not found"), "EMAXATTS": (-44, "Too many attributes"),
    "EBADTYPE": (-45, "Bad data type"), "EBADDIM": (-46, "Bad dimension"), "EUNLIMPOS": (-47, "Unlimited dimension in the wrong place"),
    "EMAXVARS": (-48, "Too many variables"), "ENOTVAR": (-49, "Variable not found"), "EGLOBAL": (-50, "Action not allowed on all variables"),
    "ENOTNC": (-51, "Not a known format"), "ESTS": (-52, "String too short"), "EMAXNAME": (-53, "Name too long"),
    "EUNLIMIT": (-54, "Unlimited dimension in use"), "ENORECVARS": (-55, "No record variables"), "ECHAR": (-56, "Text and numbers don't convert"),
    "EEDGE": (-57, "Start plus count exceeds dimension bound"), "ESTRIDE": (-58, "Illegal stride"), "EBADNAME": (-59, "Name has illegal characters"),
    "ERANGE": (-60, "Value out of range"), "ENOMEM": (-61, "Out of memory"), "EVARSIZE": (-62, "Variable too large"),
    "EDIMSIZE": (-63, "Invalid dimension size"), "ETRUNC": (-64, "File truncated"), "EAXISTYPE": (-65, "Unknown axis type"),
    "EDAP": (-66, "Remote access error"), "ECURL": (-67, "Transfer error"), "EIO": (-68, "Input or output error"), "ENODATA": (-69, "No data"),
    "EDAPSVC": (-70, "Remote service error"), "EDAS": (-71, "Bad remote attributes"), "EDDS": (-72, "Bad remote schema"),
    "EDATADDS": (-73, "Bad remote data"), "EDAPURL": (-74, "Bad remote address"), "EDAPCONSTRAINT": (-75, "Bad remote constraint"),
    "ETRANSLATION": (-76, "Translation error"), "EHDFERR": (-101, "Storage layer error"), "ECANTREAD": (-102, "Can't read"),
    "ECANTWRITE": (-103, "Can't write"), "ECANTCREATE": (-104, "Can't create"), "EFILEMETA": (-105, "Bad dataset metadata"),
    "EDIMMETA": (-106, "Bad dimension metadata"), "EATTMETA": (-107, "Bad attribute metadata"), "EVARMETA": (-108, "Bad variable metadata"),
    "ENOCOMPOUND": (-109, "Not a compound type"), "EATTEXISTS": (-110, "Attribute exists"), "ENOTNC4": (-111, "Not available for this format"),
    "ESTRICTNC3": (-112, "Not available for the strict classic model"), "ENOTNC3": (-113, "Not a classic dataset"), "ENOPAR": (-114, "Not opened for parallel access"),
    "EPARINIT": (-115, "Parallel access did not start"), "EBADGRPID": (-116, "Bad group id"), "EBADTYPID": (-117, "Bad type id"),
    "ETYPDEFINED": (-118, "Type already defined"), "EBADFIELD": (-119, "Bad field"), "EBADCLASS": (-120, "Bad class"), "EMAPTYPE": (-121, "Mapped access for atomic types only"),
    "ELATEFILL": (-122, "Fill value set after data"), "ELATEDEF": (-123, "Definition after data"), "EDIMSCALE": (-124, "Dimension scale error"),
    "ENOGRP": (-125, "No group"), "ESTORAGE": (-126, "Bad storage setting"), "EBADCHUNK": (-127, "Bad chunk size"), "ENOTBUILT": (-128, "Feature not built"),
    "EDISKLESS": (-129, "In-memory access error"), "EINDEP": (-203, "Independent mode needed"), "EINSUFFBUF": (-219, "Buffer too small"),
    "EBADIOTYPE": (-500, "Bad storage format"), "EVARDIMMISMATCH": (-501, "Variables of one write differ in dimensions"), "EBADREARR": (-502, "Bad rearranger"),
}

Code = IntEnum("Code", {k: v for k, (v, _) in _CODES.items()})


class Handler(IntEnum):
    """What an error does: INTERNAL and BROADCAST raise; RETURN gives the code back."""

    INTERNAL = -51
    BROADCAST = -52
    RETURN = -53


class GridError(Exception):
    def __init__(self, code: Code, detail: str = ""):
        super().__init__(f"{code.name}: {strerror(code)}" + (f" ({detail})" if detail else ""))
        self.code = code


def strerror(code: int) -> str:
    return next((text for number, text in _CODES.values() if number == code), f"Unknown error {code}")


def require(ok: bool, code: Code, detail: str = "") -> None:
    if not ok:
        raise GridError(code, detail)
