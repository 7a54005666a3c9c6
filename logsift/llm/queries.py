"""Registered queries of the corpus operators and the DuckDB SQL of those that SQL expresses."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, collocations, exact, hilbert, licences, matrices, mixing, packing, pieces, quality, simhash, spann, suffix
from .common import table


def _op7(s, d):
    return quality.quality_scores(table(s, d, "documents"), table(s, d, "labels"))


def queries():
    return {
        "op1_bestfit_packing": lambda s, d: packing.pack_documents(table(s, d, "documents")),
        "op4_token_matrices": lambda s, d: matrices.token_matrices(table(s, d, "documents")),
        "op2_hilbert_shards": lambda s, d: hilbert.op2(table(s, d, "documents")),
        "op6_spann_search": lambda s, d: spann.op6(table(s, d, "embeddings")),
        "op3_suffix_dedup": lambda s, d: suffix.op3(table(s, d, "documents")),
        "op5_simhash_neardup": lambda s, d: simhash.op5(table(s, d, "documents")),
        "op7_quality_classifier": _op7,
        "op8_licence_scan": lambda s, d: licences.licence_matches(table(s, d, "documents")),
        "op9_sentencepiece": lambda s, d: pieces.op9(table(s, d, "documents")),
        "op10_exact_dedup": lambda s, d: exact.op10(table(s, d, "documents")),
        "op11_token_alignment": lambda s, d: alignment.op11(table(s, d, "documents")),
        "op12_collocations": lambda s, d: collocations.op12(table(s, d, "documents")),
        "op13_source_mix": lambda s, d: mixing.op13(table(s, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

OP10 = f"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, {_NORM} AS norm FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r"""


def oracle_sql():
    return {"op8_licence_scan": licences.oracle_sql(), "op10_exact_dedup": OP10, "op12_collocations": collocations.oracle_sql(), "op13_source_mix": mixing.oracle_sql()}
