"""A corpus pipeline: quality rules, toxicity, near-duplicates, secrets, packing. Each stage works on all that the one before has kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last the pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers

from quillmesh.llm import near_dups, packing, quality, secret_scan, toxicity
from quillmesh.llm.common import drop, keep, shared_dir, table


def quality_rules(spark, docs, sf_dir):
    return quality.keep_good(docs)


def toxic_documents(spark, docs, sf_dir):
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    return near_dups.one_of_each(docs)


def secrets_redacted(spark, docs, sf_dir):
    return secret_scan.without_secrets(docs)


def packed(spark, docs, sf_dir):
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_rules), ("toxicity", toxic_documents), ("near_dedup", near_duplicates), ("secrets", secrets_redacted), ("packing", packed)]
#: Perplexities, lexicon fits and tokens can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on documents; between two of them the rows are a Parquet table in the shared folder, which goes once it has been read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}"
        docs = keep(stage(spark, docs, sf_dir), path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
