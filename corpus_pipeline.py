"""A training corpus out of the documents table: rules, near-duplicates, leaks, personal data, encoding."""

from __future__ import annotations

from loomwork.llm import decontaminate, pieces, pii, quality, simhash
from loomwork.llm.common import discard, materialise, table


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rule or the classifier rejects go."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return simhash.keep_first(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a test item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Accepted spans are replaced by their kind."""
    return pii.redact(docs)


def encoding(spark, docs, sf_dir):
    """Numbers of tokens and digests of ids and decoded text."""
    return pieces.encode_decode(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("piece encoding", encoding)]
#: Classifier, alignment and encoding have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage; each stage is written to the shared folder before the next one reads it, and removed after that."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = materialise(out)
        if before is not None:
            discard(before)
        before = docs
