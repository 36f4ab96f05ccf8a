"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldcast.llm.chunk_dedup import op7_chunk_dedup
from fieldcast.llm.collocations import OP11_SQL, op11_collocations
from fieldcast.llm.decontamination import OP2_SQL, op2_decontamination
from fieldcast.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from fieldcast.llm.licenses import OP8_SQL, op8_licenses
from fieldcast.llm.packing import op10_packing
from fieldcast.llm.pii import op4_pii
from fieldcast.llm.quality import op9_quality
from fieldcast.llm.sharding import op3_sharding
from fieldcast.llm.simhash import op6_simhash
from fieldcast.llm.token_files import op5_token_files
from fieldcast.llm.url_filter import op13_url_filter
from fieldcast.llm.warc import op1_warc

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_decontamination, op3_sharding, op4_pii, op5_token_files,
        op6_simhash, op7_chunk_dedup, op8_licenses, op9_quality, op10_packing, op11_collocations,
        op12_hard_negatives, op13_url_filter,
    )
}

ORACLE: dict[str, str] = {"op2_decontamination": OP2_SQL, "op8_licenses": OP8_SQL, "op11_collocations": OP11_SQL, "op12_hard_negatives": OP12_SQL}
