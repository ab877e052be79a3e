"""The queries of this subpackage and their DuckDB statements, by name."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.chat import OP3_SQL, op3_chat_format
from ledgerline.llm.decontam import op1_decontaminate
from ledgerline.llm.filteraudit import OP12_SQL, op12_filter_audit
from ledgerline.llm.licenses import op7_license_scan
from ledgerline.llm.linededup import OP13_SQL, op13_line_dedup
from ledgerline.llm.merkle import OP11_SQL, op11_merkle_manifest
from ledgerline.llm.mixing import OP4_SQL, op4_mix_sources
from ledgerline.llm.quality import op2_quality_rules
from ledgerline.llm.secrets import op8_secret_scan
from ledgerline.llm.simhash import op10_simhash
from ledgerline.llm.substrings import op5_substring_dedup
from ledgerline.llm.tokencount import op9_token_counts
from ledgerline.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_quality_rules,
        op3_chat_format,
        op4_mix_sources,
        op5_substring_dedup,
        op6_toxicity,
        op7_license_scan,
        op8_secret_scan,
        op9_token_counts,
        op10_simhash,
        op11_merkle_manifest,
        op12_filter_audit,
        op13_line_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op3_chat_format": OP3_SQL,
    "op4_mix_sources": OP4_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
