"""Queries of this subpackage and, where SQL can express them, their SQL."""

from .decontaminate import op10_decontamination
from .language_id import op1_language_id
from .licenses import op9_license_scan
from .line_dedup import OP3_SQL, op3_line_dedup
from .media import op8_media
from .mixing import op5_mixing
from .quality import op7_quality
from .simhash_dedup import op6_simhash_dedup
from .suffix_dedup import op4_suffix_dedup
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_mixing": op5_mixing,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_quality": op7_quality,
    "op8_media": op8_media,
    "op9_license_scan": op9_license_scan,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
}
